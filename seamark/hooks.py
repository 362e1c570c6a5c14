"""Places where a caller's own code joins in: field texts, boost rules, result fields, embeddings, answers.

A listener that fails is passed over and what was there before is kept, so that indexing and search go on. Providers have deterministic defaults that need no network.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 64


def hash_embedding(text: str, dimensions: int = DIMENSIONS) -> list[float]:
    """Unit vector of a text by signed hashes of its words and word pairs: the same everywhere, alike for texts that share words."""
    words = re.findall(r"\w+", text.lower())
    out = np.zeros(dimensions)
    for x in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]:
        h = int.from_bytes(hashlib.md5(x.encode()).digest()[:8], "little")
        out[h % dimensions] += 1 if h >> 63 else -1
    size = float(np.linalg.norm(out))
    return (out / size).tolist() if size else out.tolist()


def cite_all(messages: list[dict[str, str]]) -> str:
    """Answers with the ids of the pages in the prompt, in their order."""
    ids = [int(x) for x in re.findall(r"^THE PAGE (\d+)$", messages[-1]["content"], re.M)]
    return json.dumps({"summary": " ".join(["See", *(f"[{i}]" for i in ids)]), "sourceIds": ids, "confidence": "high" if ids else "low"})


@dataclass
class Hooks:
    """The registry. Listeners run in the order in which they were added."""

    #: (field handle, kind, text) -> text
    field_text: list[Callable[[str, str, str], str]] = field(default_factory=list)
    #: (element id, site id, title) -> [{"terms": [...], "weight": w}]
    boosts: list[Callable[[int, int, str], list[dict]]] = field(default_factory=list)
    #: (result as dict) -> fields to add
    result_fields: list[Callable[[dict], dict]] = field(default_factory=list)
    embed: Callable[[str], list[float]] = hash_embedding
    answer: Callable[[list[dict[str, str]]], str] = cite_all

    def text_of_field(self, handle: str, kind: str, text: str) -> str:
        for f in self.field_text:
            try:
                new = f(handle, kind, text)
                text = new if isinstance(new, str) else text
            except Exception:  # the text stays as it was
                continue
        return text

    def rules_of(self, element_id: int, site_id: int, title: str) -> list[dict]:
        out: list[dict] = []
        for f in self.boosts:
            try:
                for rule in f(element_id, site_id, title):
                    out.append({"terms": [str(t) for t in rule["terms"]], "weight": float(rule["weight"])})
            except Exception:  # no rules of this listener
                continue
        return out

    def fields_of(self, result: dict) -> dict[str, str]:
        out: dict[str, str] = {}
        for f in self.result_fields:
            try:
                out |= {str(k): str(v) for k, v in f(dict(result)).items()}
            except Exception:  # no fields of this listener
                continue
        return out

    def embedding(self) -> Callable[[Column], Column]:
        """A column of vectors; each distinct text of a batch is embedded once, null and blank texts have none."""
        embed = self.embed

        @F.arrow_udf(T.ArrayType(T.FloatType()))
        def run(text: pa.Array) -> pa.Array:
            texts = text.to_pylist()
            known = {x: embed(x) for x in set(texts) if x is not None and x.strip()}
            return pa.array([known.get(x) for x in texts], pa.list_(pa.float32()))

        return run

    def rules(self) -> Callable[[Column, Column, Column], Column]:
        """A column of rules from element id, site id and title."""
        rules_of = self.rules_of

        @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("weight", T.DoubleType())])))
        def run(element: pa.Array, site: pa.Array, title: pa.Array) -> pa.Array:
            made = [rules_of(*row) for row in zip(element.to_pylist(), site.to_pylist(), title.to_pylist())]
            return pa.array(made, pa.list_(pa.struct([("terms", pa.list_(pa.string())), ("weight", pa.float64())])))

        return run
