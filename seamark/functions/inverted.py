"""Inverted lists: from rows that hold words to words that hold rows, batch by batch, without a shuffle."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 32
#: Words that are turned over at once: fewer rows the more there are, about 100 bytes of memory each.
MOST_WORDS = 1_000_000


def bucket(key: Column) -> Column:
    return (F.crc32(F.encode(key, "UTF-8")) % BUCKETS).cast("int")


def bucket_of(key: str) -> int:
    return zlib.crc32(key.encode()) % BUCKETS


def _inverted(rows: pa.RecordBatch, lists: dict[str, int]) -> pa.Table:
    """(bucket, key, occurrences, hits) of some rows, by bucket and key: key and row as one number, which is sorted and counted."""
    columns = [rows.column(c) for c in lists]
    texts = [c.flatten() for c in columns]
    words = pa.chunked_array(texts, pa.string()).combine_chunks().dictionary_encode()
    parent = np.concatenate([pc.list_parent_indices(c).to_numpy(zero_copy_only=False) for c in columns]).astype(np.int64)
    weight = np.repeat(np.array(list(lists.values()), np.int32), list(map(len, texts)))
    at_bucket = pa.array([bucket_of(x) for x in words.dictionary.to_pylist()], pa.int32())
    names = pa.table([at_bucket, words.dictionary], names=["bucket", "key"])
    by_name = pc.sort_indices(names, [("bucket", "ascending"), ("key", "ascending")]).to_numpy()
    place = np.empty(len(by_name), np.int64)
    place[by_name] = np.arange(len(by_name))
    n = max(1, len(rows))
    key = place[words.indices.to_numpy(zero_copy_only=False)] * n + parent
    order = np.argsort(key, kind="stable")
    key = key[order]
    hit = np.flatnonzero(np.diff(key, prepend=-1))  # where a key of a row begins
    first = np.flatnonzero(np.diff(key[hit] // n, prepend=-1))  # the hits where a key begins
    own = [c for c in rows.schema.names if c not in lists]
    at, weighed = pa.array(key[hit] % n), pa.array(np.add.reduceat(weight[order], hit) if len(hit) else weight, pa.int32())
    hits = pa.StructArray.from_arrays([*(rows.column(c).take(at) for c in own), weighed], [*own, "weight"])
    held = pa.ListArray.from_arrays(pa.array(np.append(first, len(hit)), pa.int32()), hits)
    return names.take(pa.array(by_name)).append_column("occurrences", pa.array(np.diff(hit[first], append=len(key)), pa.int64())).append_column("hits", held)


def invert(df: DataFrame, key: str, lists: dict[str, int]) -> DataFrame:
    """(bucket, key, occurrences, hits) from the columns `lists` of df, arrays of words with a weight each, none null. A row for each word of a batch;
    hits are df's other columns with `weight`, the sum over the word's occurrences in the row. Rows lie by bucket and word within a batch."""
    own = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema if f.name not in lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                yield from _inverted(pa.Table.from_batches(held).combine_chunks().to_batches()[0], lists).rename_columns(["bucket", key, "occurrences", "hits"]).to_batches(max_chunksize=20_000)
                held.clear()

        for batch in batches:
            done, sizes = 0, sum(pc.list_value_length(batch.column(c)).to_numpy(zero_copy_only=False) for c in lists)
            for end in range(1, len(batch) + 1):
                words += int(sizes[end - 1])
                if words >= MOST_WORDS:
                    held.append(batch.slice(done, end - done))
                    done, words = end, 0
                    yield from out()
            if done < len(batch):
                held.append(batch.slice(done))
        yield from out()

    return df.mapInArrow(run, f"bucket int, {key} string, occurrences long, hits array<struct<{own},weight:int>>")
