"""Shared pieces of the corpus operators: table access, written tables, Arrow text kernels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import forget, scratch, shared_dir, written

__all__ = ["forget", "scratch", "shared_dir", "written"]

U64 = np.uint64
#: Python works on at most so many bytes of text at once (one longer text is still processed whole).
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """name, or a variant of it that no column of df has (Spark compares names without case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def whole(column: str) -> Column:
    """The column as a whole number; what isn't one is null."""
    return F.col(column).try_cast("long")


def slices(text: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes of text (or one row)."""
    if len(text) == 0:
        return
    sizes = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(text):
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + limit, "right")))
        yield start, end
        start = end


def one_chunk(column) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, "")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(U64, copy=True)
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    with np.errstate(over="ignore"):
        return mix(a * U64(0x9E3779B97F4A7C15) + b)


class Words:
    """Whitespace-delimited words of some texts: `ids` into `vocab`, row r has words start[r]:start[r+1]; `hashes` by word."""

    def __init__(self, text: pa.Array, lower: bool = False, strip: str = ""):
        if lower:
            text = pc.utf8_lower(text)
        lists = pc.ascii_split_whitespace(text)
        coded = lists.flatten().dictionary_encode()
        offsets = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        vocab = coded.dictionary
        ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if strip:
            again = pc.utf8_trim(vocab, strip).dictionary_encode()
            vocab, ids = again.dictionary, again.indices.to_numpy(zero_copy_only=False).astype(np.int64)[ids]
        self.vocab = vocab
        vocab_hash = np.fromiter(map(xxhash.xxh3_64_intdigest, vocab.cast(pa.binary()).to_pylist()), U64, len(vocab))
        keep = (pc.binary_length(vocab).to_numpy(zero_copy_only=False) > 0)[ids] if len(vocab) else np.zeros(0, bool)
        self.start = np.concatenate([[0], np.cumsum(keep)])[offsets].astype(np.int64)
        self.ids = ids[keep]
        self.vocab_hash = vocab_hash
        self.hashes = vocab_hash[self.ids] if len(vocab) else np.zeros(0, U64)
        self.row = np.repeat(np.arange(len(text)), np.diff(self.start))
