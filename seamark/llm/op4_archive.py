"""Reader and writer of WARC files packed in ZIP archives.

An archive holds WARC members below `archive/` (gzip members, one a record, or plain records) and indexes below `indexes/` (a line a record: key, time, JSON with
offset, length and filename; plain or gzip), all stored, so that a record is a byte range of the archive. The reader finds the end-of-directory record in the last
64 KB, follows the ZIP64 locator where there is one, reads the central directory, then streams the indexes, and deals the records' ranges to
tasks, each of which reads its own ranges, neighbours at once. Nothing is extracted. The ZIP structures are parsed here, by the public ZIP application note.

Writing is one file a task, under a name of its own attempt, in a folder that all executors share; a task that is repeated leaves an unused file.
The files are written as write_archives() is called, that is while round_trip() builds its query.

Defined results: null columns come back as null, empty ones as empty; pages of any length; repeated pages are records of their own. Of any archive, records of type
response, resource, conversion and revisit are pages, others give no row; page_id is the number of a `urn:page:` record id, null for others; a payload is checked against its digest (sha1,
md5 or sha256, in hex or base32) where the record has one that applies; text is decoded by the charset given, UTF-8 otherwise, what doesn't decode becomes U+FFFD. What can't be
read (no ZIP, a compressed member, a damaged directory, index line or record, whatever the exception) gives one row with `error` set where it is found, and everything else is read; failures of the storage
itself are raised, so that the task is tried again. An empty folder or table gives an empty result; only page_id, url, html are stored, other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from itertools import islice
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, whole

WARC, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Ranges of one archive no further apart than GAP are read at once, up to READ bytes.
GAP, READ = 1 << 16, 8 << 20
_NONE = "X-Null"


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


class Member(NamedTuple):
    name: str
    method: int
    size: int
    compressed: int
    header: int


def members(f: BinaryIO, size: int) -> list[Member]:
    """The central directory of the ZIP (or ZIP64) archive that f reads, by seek and read."""

    def at(offset: int, n: int) -> bytes:
        if not 0 <= offset <= offset + n <= size:
            raise ValueError("an offset lies outside of the archive")
        f.seek(offset)
        return f.read(n)

    base = max(0, size - 65557)
    tail = at(base, size - base)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end)  # a comment may hold the signature
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, offset = struct.unpack_from("<HII", tail, end + 10)
    where = base + end - 20
    locator = at(where, 20) if where >= 0 else b""
    if locator[:4] == b"PK\x06\x07":
        record = at(struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, offset = struct.unpack_from("<QQQ", record, 32)
    directory = at(offset, length)
    out, p = [], 0
    for _ in range(count):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        flags, method = struct.unpack_from("<HH", directory, p + 8)
        compressed, full, n, extra, comment = struct.unpack_from("<IIHHH", directory, p + 20)
        header = struct.unpack_from("<I", directory, p + 42)[0]
        name = directory[p + 46 : p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        x, stop = p + 46 + n, p + 46 + n + extra
        while x + 4 <= stop:
            tag, k = struct.unpack_from("<HH", directory, x)
            if tag == 1:  # the 64-bit values of those fields that are all ones, in this order
                values = iter(struct.unpack_from(f"<{k // 8}Q", directory, x + 4))
                full = next(values) if full == 0xFFFFFFFF else full
                compressed = next(values) if compressed == 0xFFFFFFFF else compressed
                header = next(values) if header == 0xFFFFFFFF else header
            x += 4 + k
        out.append(Member(name, method, full, compressed, header))
        p = stop + comment
    return out


def data_offset(f: BinaryIO, m: Member) -> int:
    """Where the bytes of a stored member begin."""
    if m.method != 0:
        raise ValueError(f"{m.name} is compressed, not stored")
    f.seek(m.header)
    local = f.read(30)
    if local[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header of {m.name}")
    return m.header + 30 + sum(struct.unpack_from("<HH", local, 26))


def _lines(f: BinaryIO, start: int, size: int, packed: bool) -> Iterator[bytes]:
    """The lines of a stored member, read piece by piece; packed: it is a sequence of gzip members."""
    at, rest, z = start, b"", None
    while at < start + size:
        f.seek(at)
        data = f.read(min(READ, start + size - at))
        if not data:
            raise ValueError("an index ends early")
        at += len(data)
        if packed:
            plain = []
            while data:
                z = z or zlib.decompressobj(31)
                plain.append(z.decompress(data))
                data = z.unused_data
                z = None if z.eof else z
            data = b"".join(plain)
        *whole_lines, rest = (rest + data).split(b"\n")
        yield from whole_lines
    yield rest


def ranges(f: BinaryIO, size: int) -> Iterator[tuple[int | None, int | None, str | None]]:
    """(offset in the archive, length, error) of each record, by the indexes."""
    every = members(f, size)
    warcs = {m.name: m for m in every if m.name.startswith("archive/") and ".warc" in m.name}
    indexes = [m for m in every if m.name.startswith("indexes/") and m.name.removesuffix(".gz").endswith((".cdxj", ".cdx"))]
    if not warcs or not indexes:
        raise ValueError("no WARC file below archive/ or no index below indexes/")
    starts: dict[str, int] = {}
    for index in indexes:
        for line in _lines(f, data_offset(f, index), index.size, index.name.endswith(".gz")):
            if b"{" not in line:
                continue  # a blank line, or a header
            try:
                entry = json.loads(line[line.index(b"{") :])
                offset, length, name = int(entry["offset"]), int(entry["length"]), entry.get("filename")
                if name is None and len(warcs) == 1:
                    (name,) = warcs
                member = warcs.get(name) or warcs.get(f"archive/{name}")
                if member is None:
                    raise ValueError("an index line names no member")
                if offset < 0 or length <= 0 or offset + length > member.size:
                    raise ValueError("an index line lies outside of its member")
                if member.name not in starts:
                    starts[member.name] = data_offset(f, member)
                yield starts[member.name] + offset, length, None
            except OSError:
                raise
            except Exception as e:  # whatever a damaged line does, it costs its own record only
                yield None, None, str(e) or type(e).__name__


def record_of(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """A WARC response record as a gzip member."""
    body = (html or "").encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    none = ",".join(k for k, v in (("page_id", page_id), ("url", url), ("html", html)) if v is None)
    clean = (url or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20")
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>\r\nWARC-Target-URI: {clean}\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:{hashlib.sha1(body).hexdigest()}\r\n{_NONE}: {none}\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: {len(http)}\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(head.encode() + http + b"\r\n\r\n") + z.flush()


PAGES = ("response", "resource", "conversion", "revisit")


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _digest_fits(said: str, body: bytes) -> bool:
    """Also true for digests of other kinds, which can't be checked."""
    kind, _, value = said.partition(":")
    if kind.lower() not in ("sha1", "md5", "sha256"):
        return True
    made = hashlib.new(kind.lower(), body)
    return value.lower() == made.hexdigest() or value.upper().rstrip("=") == base64.b32encode(made.digest()).decode().rstrip("=")


def page_of(data: bytes) -> tuple[int | None, str | None, str | None] | None:
    """The page of a record, None if the record is of another type; the payload's digest is checked."""
    raw = zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = _fields(lines[1:])
    kind = fields.get("warc-type", "response")
    if kind not in PAGES:
        return None
    length = int(fields["content-length"])
    if not 0 <= length <= len(rest):
        raise ValueError("a record ends early")
    body, http = rest[:length], {}
    if fields.get("content-type", "").startswith("application/http"):
        top, _, body = body.partition(b"\r\n\r\n")
        http = _fields(top.decode("utf-8", "replace").split("\r\n")[1:])
    coded = http.get("transfer-encoding", "identity") != "identity"  # such digests may be of either form
    if kind != "revisit" and not coded and not _digest_fits(fields.get("warc-payload-digest", ""), body):
        raise ValueError("a payload doesn't fit its digest")
    if http.get("content-encoding") in ("gzip", "deflate"):
        body = zlib.decompress(body, 47)
    none = set(fields.get(_NONE.lower(), "").split(","))
    own = _NONE.lower() in fields
    url = fields.get("warc-target-uri", "").strip("<>") if not own else fields["warc-target-uri"]
    for k, v in (("%0D", "\r"), ("%0A", "\n"), ("%20", " "), ("%25", "%")) if own else ():
        url = url.replace(k, v)
    record = fields.get("warc-record-id", "").strip("<>")
    number = record[len("urn:page:") :] if record.startswith("urn:page:") else ""
    charset = http.get("content-type", "").lower().partition("charset=")[2].strip("\"' ;") or "utf-8"
    try:
        text = body.decode(charset, "replace")
    except LookupError:
        text = body.decode("utf-8", "replace")
    return int(number) if number else None, None if "url" in none else url, None if "html" in none or kind == "revisit" and not body else text


def write_archive(out: BinaryIO, pages: Iterator[tuple], zip64: bool = False) -> int:
    """Writes an archive of (page_id, url, html); the number of records."""
    index, offset = [], 0
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        with z.open(WARC, "w", force_zip64=True) as w:
            for page in pages:
                data = record_of(*page)
                key = json.dumps(page[1] or "", ensure_ascii=True)[1:-1].replace(" ", "%20")
                index.append(f"{key} 20240101000000 " + json.dumps({"offset": str(offset), "length": str(len(data)), "filename": "data.warc.gz"}))
                w.write(data)
                offset += len(data)
        index.sort()
        with z.open(INDEX, "w", force_zip64=zip64) as w:
            w.write("".join(x + "\n" for x in index).encode())
        z.writestr("datapackage.json", json.dumps({"profile": "data-package", "resources": [{"path": WARC}, {"path": INDEX}]}))
    return len(index)


def write_archives(pages: DataFrame, folder: str) -> list[str]:
    """Packs pages, an archive for each task, below folder; their paths (as many as tasks that had pages)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(folder)
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        first = next(rows, None)
        if first is None:
            return
        name = f"{uuid.uuid4().hex}.wacz"
        with system.open_output_stream(f"{root}/{name}") as out:
            write_archive(out, (r for part in ((first,), rows) for r in part))
        yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    system, root = filesystem(folder)
    system.create_dir(root, recursive=True)
    named = pages.select(whole("page_id").alias("page_id"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(write, "name string")
    return [f"{folder}/{r['name']}" for r in named.collect()]


def _located(path: str) -> Iterator[tuple[int | None, int | None, str | None]]:
    try:
        system, p = filesystem(path)
        with system.open_input_file(p) as f:
            yield from ranges(f, f.size())
    except FileNotFoundError as e:
        yield None, None, str(e)
    except OSError:
        raise
    except Exception as e:  # whatever is wrong with an archive, it costs this archive only
        yield None, None, str(e) or type(e).__name__


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path in b.column(0).to_pylist():
            rows = _located(path)
            while part := list(islice(rows, 1 << 16)):
                offsets, lengths, errors = zip(*part)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), pa.array(errors, pa.string())], ["path", "offset", "length", "error"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by path and offset."""
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    names = ["archive", "page_id", "url", "html", "error"]
    out: list[tuple] = []
    size = 0
    for b in batches:
        rows = list(zip(*(c.to_pylist() for c in b.columns)))
        k = 0
        while k < len(rows):
            path, offset, length, error = rows[k]
            n = k + 1
            if error is None:
                end = offset + length
                while n < len(rows) and rows[n][0] == path and rows[n][3] is None and rows[n][1] - end <= GAP and rows[n][1] + rows[n][2] - offset <= READ:
                    end = max(end, rows[n][1] + rows[n][2])
                    n += 1
                system, p = filesystem(path)
                with system.open_input_file(p) as f:
                    f.seek(offset)
                    data = f.read(end - offset)
                size += len(data)
                for _, o, m, _ in rows[k:n]:
                    try:
                        page = page_of(data[o - offset : o - offset + m])
                        if page is not None:
                            out.append((path, *page, None))
                    except Exception as e:  # whatever is wrong with a record, it costs this record only
                        out.append((path, None, None, None, str(e) or type(e).__name__))
            else:
                out.append((path, None, None, None, error))
            k = n
            if size > READ:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)


def read_archives(spark: SparkSession, paths: list[str], parts: int | None = None) -> DataFrame:
    """(archive, page_id, url, html, error) of every record of these archives, or of those below the folders among them."""
    files = []
    for path in paths:
        system, p = filesystem(path)
        info = system.get_file_info(p)
        if info.type == fs.FileType.Directory:
            below = system.get_file_info(fs.FileSelector(p, recursive=True))
            files += [path.rstrip("/") + f.path[len(p.rstrip("/")) :] for f in below if f.is_file and f.path.endswith((".wacz", ".zip"))]
        else:
            files.append(path)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    archives = spark.createDataFrame([(f,) for f in sorted(files)], "path string").repartition(max(1, min(parts, len(files))))
    located = archives.mapInArrow(_locate, "path string, offset long, length long, error string")
    # Ranges go to tasks by blocks of an archive: a large archive is read by many tasks, each one its stretch.
    block = F.coalesce(F.floor(F.col("offset") / READ), F.lit(0))
    return located.repartition(parts, "path", block).sortWithinPartitions("path", "offset").mapInArrow(_read, "archive string, page_id long, url string, html string, error string")


def round_trip(pages: DataFrame) -> DataFrame:
    """pages, written to archives in the shared folder and read from there: (page_id, url, html, error)."""
    spark = pages.sparkSession
    return read_archives(spark, write_archives(pages, scratch(spark, "archives"))).select("page_id", "url", "html", "error")


ORACLE = "SELECT page_id, url, html, CAST(NULL AS VARCHAR) AS error FROM pages"
