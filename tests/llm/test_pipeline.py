import brute
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seamark.llm import op7_quality, op8_lines, op9_mixing
from seamark.llm.common import table


def test_against_brute_force(spark, small):
    docs = table(spark, small, "documents")
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
    q, t = op7_quality.train_local(sorted(tuple(r) for r in op7_quality.labelled_sample(docs, table(spark, small, "labels")).collect())).score(pa.array([r[1] for r in rows]))
    rows = [r for r, a, b in zip(rows, q, t) if round(a, 6) >= 0.5 and round(b, 6) <= 0.5]
    cleaned = brute.dedup_lines([r[:2] for r in rows], op8_lines.SHARE, op8_lines.LEAST_DOCS)
    rows = [(r[0], x, *r[2:]) for r, (x, n) in zip(rows, cleaned) if n == 0 or x.strip(" ")]
    gone = brute.near_duplicates([r[:2] for r in rows])
    rows = [r for r in rows if r[0] not in gone]
    items = [tuple(r) for r in table(spark, small, "benchmark").select("item_id", "text").collect()]
    leaks = {x[0] for x in brute.contamination([r[:2] for r in rows], items)}
    rows = [r for r in rows if r[0] not in leaks]
    want, _, _ = brute.mixed(rows, op9_mixing.Targets())
    got = corpus_pipeline.run(spark, small).collect()
    assert gone and leaks and sorted(r[:2] for r in want) == sorted((r["doc_id"], r["text"]) for r in got)


def test_stages_return_the_columns_of_documents(spark, small):
    docs = table(spark, small, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.dtypes == docs.dtypes
        docs = out


LONG = "word " * 100_000
COPY = "A text that is like others. " * 5
ROWS = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, None, "en", "a", None), (3, COPY, None, None, 100), (3, COPY, None, None, 100), (9, COPY, "xx", None, 100), (None, COPY, "en", "a", 100), (4, LONG, "en", "a", 500_000)]
#: What each stage keeps of ROWS, as (doc_id, text is COPY or LONG or neither).
EXPECTED = {
    "line_dedup": [(None, None), (1, ""), (2, None), (3, COPY), (3, COPY), (9, COPY), (None, COPY), (4, LONG)],  # no line is in more than 10 documents
    "near_dedup": [(None, None), (1, ""), (2, None), (3, COPY), (3, COPY), (4, LONG)],  # rows 9 and without id are copies of 3
    "decontaminate": [(None, None), (1, ""), (2, None), (3, COPY), (3, COPY), (9, COPY), (None, COPY), (4, LONG)],
}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_bear_nulls_and_empty_tables(spark, small, name, stage):
    kind = table(spark, small, "documents").schema
    got = sorted(((r["doc_id"], r["text"]) for r in stage(spark, spark.createDataFrame(ROWS, kind), small).collect()), key=repr)
    if name in EXPECTED:
        assert got == sorted(EXPECTED[name], key=repr)
    elif name == "quality":  # equal texts share their lot, and all texts of these are judged
        model = op7_quality.train(op7_quality.labelled_sample(spark.createDataFrame(ROWS, kind), table(spark, small, "labels")))
        q, t = model.score(pa.array([r[1] or "" for r in ROWS]))
        assert got == sorted(((r[0], r[1]) for r, a, b in zip(ROWS, q, t) if round(a, 6) >= 0.5 and round(b, 6) <= 0.5), key=repr)
    else:  # mix: texts without tokens are never sampled
        assert got == sorted(((r[0], r[1]) for r in brute.mixed([(r[0], r[1], r[2], r[3]) for r in ROWS], op9_mixing.Targets())[0]), key=repr)
    assert stage(spark, spark.createDataFrame([], kind), small).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_pass_columns_with_names_of_their_own(spark, small, name, stage):
    """Extra columns that are named like the operators' own come back as they were."""
    extra = ("keep", "quality_score", "dropped_lines", "text_key", "topic", "tokens", "probability", "seamark_id", "item_id", "rep")
    docs = table(spark, small, "documents").limit(60)
    for c in extra:
        docs = docs.withColumn(c, F.lit(f"my {c}"))
    out = stage(spark, docs, small)
    assert out.columns[: len(docs.columns)] == docs.columns
    for r in out.collect():
        assert all(r[c] == f"my {c}" for c in extra)
