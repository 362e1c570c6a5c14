import json
import math

from helpers import assert_same

from seamark.llm import op6_chat as op


def test_whole_table_against_sql(spark, duck, small):
    assert_same(op.format_chats(op.with_parts(spark.read.parquet(f"{small}/conversations.parquet"))), duck, op.ORACLE)


def test_visitor_on_each_type():
    parts = ["plain", {"type": "text", "text": "a<|end|>b"}, {"type": "image", "url": "i.png", "width": 57, "height": 28}, {"type": "audio", "url": "s.wav", "seconds": 2.5}, {"type": "document", "url": "d", "parts": [{"type": "image", "url": "j.png"}, "in"]}, {"type": "video"}, 7, None, ["x"]]
    text, refs, tokens = op.flatten(json.dumps(parts), op.Format())
    assert text == "plaina<​|end|>b<|image|><|audio|><|document|><|image|>in<|/document|><|unknown|><|unknown|><|unknown|>x"
    assert refs == ["image:i.png", "audio:s.wav", "document:d", "image:j.png"]
    assert tokens == 2 + 3 + 3 + 32 + (1 + 1 + 1 + 1) + 3 + 1


def test_malformed_parts():
    f = op.Format()
    assert op.flatten(None, f) == ("", [], 0)
    assert op.flatten("[not json", f) == ("[not json", [], 3)
    assert op.flatten("[" * 100_000, f)[0].startswith("[[")
    assert op.flatten('[{"type":"text","text":5}]', f) == ("", [], 0)
    assert op.flatten('[{"type":"image","url":3,"width":-4,"height":"x"}]', f) == ("<|image|>", ["image:"], 1)
    assert op.flatten('[{"type":"audio","seconds":-3}]', f) == ("<|audio|>", ["audio:"], 1)
    assert op.flatten('[{"type":"image","width":100000,"height":100000}]', f)[2] == f.most_image_tokens
    assert op.flatten('[{"type":"document","parts":5}]', f)[0] == "<|document|><|unknown|><|/document|>"


def test_deep_parts_are_kept():
    f = op.Format()
    deep = '[{"type":"document","parts":' * 150 + '["core"]' + "}]" * 150
    text, refs, _ = op.flatten(deep, f)
    assert text == "<|document|>" * 150 + "core" + "<|/document|>" * 150 and len(refs) == 150
    v = op.Visitor(f)
    part = "core"
    for _ in range(50_000):  # deeper than any parser reads
        part = {"type": "document", "parts": [part]}
    v.visit(part)
    assert "".join(v.text).count("<|document|>") == 50_000 and v.tokens == 100_001
    while isinstance(part, dict):  # taken apart piece by piece
        part = part.pop("parts")[0]


def test_numbers_and_characters_out_of_range(spark):
    f, big = op.Format(), "1" + "0" * 400
    cases = {
        '[{"type":"audio","seconds":%s}]' % big: ("<|audio|>", ["audio:"], math.ceil(f.most_seconds * f.audio_tokens_per_second)),
        '[{"type":"audio","seconds":1e300}]': ("<|audio|>", ["audio:"], math.ceil(f.most_seconds * f.audio_tokens_per_second)),
        '[{"type":"audio","seconds":NaN}]': ("<|audio|>", ["audio:"], 1),
        '[{"type":"image","width":%s,"height":1}]' % big: ("<|image|>", ["image:"], f.most_image_tokens),
        '[{"type":"image","width":1e300}]': ("<|image|>", ["image:"], 1),
        '["a\\ud800b"]': ("a\ufffdb", [], 2),
        '[{"type":"image","url":"\\udfffx"}]': ("<|image|>", ["image:\ufffdx"], 1),
        '["\\ud83d\\ude00"]': ("\U0001f600", [], 1),
    }
    for content, want in cases.items():
        assert op.flatten(content, f) == want
    df = spark.createDataFrame([(k, 1, "user", c) for k, c in enumerate(cases)], "conv_id long, turn long, role string, content string")
    assert {r["conv_id"]: r["tokens"] for r in op.format_chats(df).collect()} == {k: w[2] for k, w in enumerate(cases.values())}


def test_cases(spark):
    rows = [(1, 2, "user", "b"), (1, 1, None, "a"), (1, 2, "user", "b"), (1, None, "user", "first"), (None, 1, "user", "n"), (None, 2, "assistant", None), (2, 1, "user", "x" * 300_000), (3, 1, "user", "")]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "conv_id long, turn long, role string, content string, tokens int, messages string")
    got = {r["conv_id"]: r for r in op.format_chats(df).collect()}
    say = lambda role, t: f"<|start|>{role}\n{t}<|end|>\n"
    assert got[1]["text"] == say("user", "first") + say("user", "a") + say("user", "b") * 2 and got[1]["messages"] == 4 and got[1]["tokens"] == 2 + 3
    assert got[None]["messages"] == 2 and got[None]["text"].endswith(say("assistant", ""))
    assert len(got[2]["text"]) > 300_000 and got[3]["tokens"] == 0 and got[3]["attachments"] == ""
    assert op.format_chats(df.limit(0)).count() == 0
