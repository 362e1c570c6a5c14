import base64
import gzip
import hashlib
import io
import json
import random
import struct
import zipfile

import pytest
from helpers import assert_same

from seamark.llm import op4_archive as op

ROWS = [(1, "http://a.org/x y%20z", "<p>ä</p>"), (2, None, "x" * 3_000_000), (None, "http://b.org/", None), (3, "", ""), (1, "http://a.org/x y%20z", "<p>ä</p>"), (4, "http://c.org/\r\n", "a\r\n\r\nb"), (-5, "http://d.org/" + "p" * 70_000, "\x00")]


def test_whole_table_against_sql(spark, duck, small):
    assert_same(op.round_trip(spark.read.parquet(f"{small}/pages.parquet")), duck, op.ORACLE)


def test_cases(spark):
    df = spark.createDataFrame([(*r, "e", 1) for r in ROWS], "page_id long, url string, html string, error string, offset int").repartition(3)
    got = [tuple(r) for r in op.round_trip(df).collect()]
    assert sorted(got, key=repr) == sorted([(*r, None) for r in ROWS], key=repr)
    assert op.round_trip(df.limit(0)).count() == 0


def packed(rows, **kw) -> bytes:
    out = io.BytesIO()
    assert op.write_archive(out, iter(rows), **kw) == len(rows)
    return out.getvalue()


def read(data):
    f = io.BytesIO(data)
    return [op.page_of(data[o : o + n]) for o, n, error in op.ranges(f, len(data)) if error is None]


def test_zip64_and_comment():
    plain = packed(ROWS[:3], zip64=True)
    assert sorted(map(repr, read(plain))) == sorted(map(repr, ROWS[:3]))
    with zipfile.ZipFile(buffer := io.BytesIO(plain), "a") as z:
        z.comment = b"note PK\x05\x06 inside"
    assert len(read(buffer.getvalue())) == 3
    # A ZIP64 directory: move the counts to a ZIP64 record, as writers of over 65,535 members or 4 GB do.
    end = plain.rfind(b"PK\x05\x06")
    count, size, offset = struct.unpack_from("<HII", plain, end + 10)
    record = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, size, offset)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1)
    tail = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    big = plain[:end] + record + locator + tail
    assert op.members(io.BytesIO(big), len(big)) == op.members(io.BytesIO(plain), len(plain))
    assert sorted(map(repr, read(big))) == sorted(map(repr, ROWS[:3]))


def test_members_agree_with_the_standard_library():
    data = packed(ROWS)
    mine = {m.name: (m.method, m.size, m.header) for m in op.members(io.BytesIO(data), len(data))}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert mine == {i.filename: (i.compress_type, i.file_size, i.header_offset) for i in z.infolist()}


def test_damaged_archives(spark, tmp_path):
    good = packed(ROWS[:2])
    with zipfile.ZipFile(squeezed := io.BytesIO(), "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(op.WARC, b"x" * 100)
        z.writestr(op.INDEX, b"")
    broken = bytearray(good)
    broken[good.index(b"\x1f\x8b") + 30] ^= 0xFF  # in the first record
    for name, data in {"a.zip": good, "b.zip": b"no archive", "c.zip": squeezed.getvalue(), "d.wacz": bytes(broken), "e.zip": b"", "f.zip": good[:-30], "skip.txt": b""}.items():
        (tmp_path / name).write_bytes(data)
    rows = op.read_archives(spark, [f"file://{tmp_path}"]).collect()
    by = lambda n: [r for r in rows if r["archive"].endswith(n)]
    assert len(by("a.zip")) == 2 and not any(r["error"] for r in by("a.zip"))
    for n in "bcef":
        (r,) = by(f"{n}.zip")
        assert r["error"] and r["page_id"] is None
    assert sorted(r["error"] is None for r in by("d.wacz")) == [False, True]
    assert not by("skip.txt")


def test_random_bytes_never_crash_the_parser(tmp_path):
    rng = random.Random(3)
    good = packed(ROWS[:1])
    for _ in range(300):
        data = bytearray(good)
        for _ in range(rng.randrange(1, 6)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        path = tmp_path / "x.zip"
        path.write_bytes(bytes(data))
        for offset, length, error in op._located(f"file://{path}"):
            assert (error is None) == (offset is not None)
            if error is None:
                try:
                    op.page_of(bytes(data)[offset : offset + length])
                except Exception as e:
                    assert not isinstance(e, AssertionError)


def test_missing_archive_is_an_error(spark):
    with pytest.raises(Exception):
        op.members(io.BytesIO(b""), 0)


def standard(url, body, digest=None, kind="response", record="urn:uuid:12345678-1234-5678-1234-567812345678", headers="Content-Type: text/html\r\n"):
    http = f"HTTP/1.1 200 OK\r\n{headers}\r\n".encode() + body
    said = "" if digest is None else f"WARC-Payload-Digest: {digest}\r\n"
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{record}>\r\nWARC-Target-URI: {url}\r\n{said}Content-Type: application/http; msgtype=response\r\nContent-Length: {len(http)}\r\n\r\n".encode() + http + b"\r\n\r\n"


def test_archives_of_other_writers(spark, tmp_path):
    """Two WARC members, one gzip and one plain, a gzip index and a plain one, base32 digests, no digest, uuid record ids, other record types, charsets, bad lines."""
    good = "sha1:" + base64.b32encode(hashlib.sha1(b"<p>one</p>").digest()).decode()
    a = [gzip.compress(x) for x in (standard("http://a/1", b"<p>one</p>", good), standard("http://a/2", b"two"), standard("http://a/3", b"x", kind="request"), standard("http://a/4", b"bad", "sha1:AAAA"))]
    b = [standard("http://b/1", "für".encode("latin-1"), headers="Content-Type: text/html; charset=ISO-8859-1\r\n"), standard("http://b/2", gzip.compress(b"packed"), headers="Content-Encoding: gzip\r\n"), standard("http://b/3", b"n", record="urn:page:77")]
    lines = lambda parts, name: [f"k {n} " + json.dumps({"offset": sum(map(len, parts[:n])), "length": len(parts[n]), "filename": name}) for n in range(len(parts))]
    bad = ['k 1 {"offset": null, "length": 5}', 'k 1 {"offset": [], "length": 5, "filename": "b.warc"}', 'k 1 {"offset": 1, "length": 99999999, "filename": "b.warc"}', "k 1 " + '{"a":' * 100_000, 'k 1 {"offset": 0, "length": 5, "filename": "none.warc"}']
    with zipfile.ZipFile(tmp_path / "a.wacz", "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/a.warc.gz", b"".join(a))
        z.writestr("archive/b.warc", b"".join(b))
        z.writestr("indexes/a.cdxj.gz", gzip.compress("\n".join(lines(a, "a.warc.gz")[:2]).encode() + b"\n") + gzip.compress("\n".join(lines(a, "a.warc.gz")[2:]).encode()))
        z.writestr("indexes/b.cdxj", "\n".join(["!header", *lines(b, "archive/b.warc"), *bad, ""]))
    rows = op.read_archives(spark, [f"file://{tmp_path}"]).collect()
    pages = {r["url"]: (r["page_id"], r["html"]) for r in rows if r["error"] is None}
    assert pages == {"http://a/1": (None, "<p>one</p>"), "http://a/2": (None, "two"), "http://b/1": (None, "für"), "http://b/2": (None, "packed"), "http://b/3": (77, "n")}
    assert len([r for r in rows if r["error"]]) == len(bad) + 1


def test_a_directory_of_any_length_is_one_error(spark, tmp_path):
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    record = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, 2**64 - 1, 0)
    (tmp_path / "x.zip").write_bytes(record + struct.pack("<4sIQI", b"PK\x06\x07", 0, 0, 1) + end)
    (r,) = op.read_archives(spark, [f"file://{tmp_path}"]).collect()
    assert r["error"]
