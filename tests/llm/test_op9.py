import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from seamark.llm import op9_mixing as op


def ids(rows):
    return sorted((str(r[0]), r[1]) for r in rows)


def test_whole_table_against_brute_force(spark, documents):
    df, rows = documents
    kept, p, _ = brute.mixed(rows, op.Targets())
    got = op.mix_sources(df).collect()
    assert kept and ids(kept) == ids((r["doc_id"], r["text"]) for r in got)
    for r in got:
        assert abs(r["probability"] - p[r["source"], r["lang"], r["topic"]]) < 1e-6 and r["tokens"] == brute.tokens(r["text"]) and r["topic"] == brute.topic(r["text"])


def test_expected_tokens_meet_the_targets():
    rng = np.random.default_rng(2)
    cells = [(s, x, t, int(rng.integers(500, 3000))) for s in "abcdef" for x in ("en", "de") for t in ("prose", "legal")]
    targets = op.Targets(lang={"en": 0.6, "de": 0.4}, topic={"prose": 0.7, "legal": 0.3}, source={"a": 0.3}, budget=0.1)
    out = op.cell_probabilities(cells, targets)
    expected = {c[:3]: c[3] * c[5] for c in out}
    total = sum(expected.values())
    assert total == pytest.approx(0.1 * sum(c[3] for c in cells))
    for k, named in ((0, targets.source), (1, targets.lang), (2, targets.topic)):
        for v, share in named.items():
            assert sum(x for c, x in expected.items() if c[k] == v) / total == pytest.approx(share, abs=1e-6)


def test_full_cells_hand_their_rest_on():
    tokens, weights = np.array([10.0, 1000.0, 1000.0, 0.0]), np.array([0.5, 0.25, 0.25, 0.0])
    p = op.probabilities(tokens, weights, 500)
    assert p[0] == 1 and p[3] == 0 and (p * tokens).sum() == pytest.approx(500)
    assert op.probabilities(tokens, weights, 1e9).tolist() == [1, 1, 1, 0]
    assert not op.probabilities(tokens, weights, 0).any()


def test_cases(spark):
    rows = [(k, f"text {k} " * (k % 9 + 1), ("en", "de", "fr", None)[k % 4], ("a", "b", None)[k % 3]) for k in range(300)]
    rows += [(None, "no id", "en", "a"), (400, None, "en", "a"), (401, "", "en", "a"), (402, "long " * 100_000, "en", "b"), (5, "text 5 " * 6, "de", None), (5, "text 5 " * 6, "de", None), (403, "a@b Licensed 123456 | x", "xx", "z")]
    df = spark.createDataFrame([(*r, 1, 2.0, "t") for r in rows], "doc_id long, text string, lang string, source string, tokens int, probability double, topic string")
    kept, _, _ = brute.mixed(rows, op.Targets())
    out = op.mix_sources(df)
    assert out.columns == [*df.columns, "_topic", "_tokens", "weight", "_probability"]
    assert ids((r["doc_id"], r["text"]) for r in out.collect()) == ids(kept)
    assert op.mix_sources(df.limit(0)).count() == 0
    # Raked as a table: the same cells' probabilities, the same rows.
    assert ids((r["doc_id"], r["text"]) for r in op.mix_sources(df, op.Targets(driver_cells=2)).collect()) == ids(kept)


def test_the_two_forms_of_raking_agree(spark):
    rng = np.random.default_rng(4)
    cells = [(s, x, t, int(rng.integers(0, 3000))) for s in "abcdefgh" for x in ("en", "de", "xx") for t in ("prose", "legal")]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    for targets in (op.Targets(source={"a": 0.3}, budget=0.1), op.Targets(budget=0.9), op.Targets(budget=1.0), op.Targets(budget=0.0)):
        want = {c[:3]: c[4:] for c in op.cell_probabilities(cells, targets)}
        got = {tuple(r[:3]): (r["weight"], r["probability"]) for r in op.rake_table(df, targets).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_nothing_is_dropped_for_being_unnamed(spark):
    rows = [(k, f"text {k}", ("en", "xx", None)[k % 3], "a") for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert len(op.mix_sources(df, op.Targets(budget=1.0)).collect()) == 150
    half = {r["lang"] for r in op.mix_sources(df, op.Targets(budget=0.9)).collect()}
    assert half == {"en", "xx", None}
    mine = op.mix_sources(df, op.Targets(topic={"odd": 0.5, "even": 0.5}, budget=1.0), topic=F.when(F.col("doc_id") % 2 == 1, "odd").otherwise("even"))
    assert {r["topic"] for r in mine.collect()} == {"odd", "even"}
