"""Legacy archives: pages to ARC files, ARC to WARC, and WARC back to rows.

Payloads are bytes from end to end, in whatever encoding. Every record is a gzip member of its own; a file is closed
at FILE_BYTES, so that files stay small enough to be read as one value each unless a single record isn't. Files are
written and read by Spark's own text and binary sources, so every file system that Spark knows will do and the output
committer makes lost tasks harmless. An ARC file begins with a version block, whose number says how many fields a
record's header line has; records are cut out by their declared lengths alone, and read one at a time.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.llm._arrow import map_batches
from graphlake.llm._scratch import materialize, new_path, release

#: Fields of a record's header line by ARC version (fixed values).
ARC_FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: The WARC profile of revisits with an equal payload (fixed value).
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of gzipped records at which a file ends, and bytes of payloads that are passed on together.
FILE_BYTES, PASS_BYTES = 32 << 20, 4 << 20
#: The most repeated payloads whose owners are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
_DATE = "20240101000000"
_BLANK = re.compile(r"\s")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(data: bytes) -> bytes:
    """A gzip member."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


_EMPTY = _member(b"")


def _files(records: Iterable, make: Callable[..., bytes] = bytes, opening: Callable[[], bytes] | None = None) -> Iterator[pa.RecordBatch]:
    """Files of gzipped records, a row each. ``make`` gives a record's bytes once its file is begun, ``opening`` those of
    the record that a file begins with. The text writer ends a file with a separator, which can't be empty: it is the file's own last byte. That is 0 for records of less
    than 16 MB, by the length that ends a member; after a larger one an empty member ends the file."""
    held: list[bytes] = []
    size = 0

    def end() -> pa.RecordBatch:
        nonlocal held, size
        data = b"".join(held)
        held, size = [], 0
        if data[-1]:
            data += _EMPTY
        return pa.RecordBatch.from_arrays([pa.array([data[:-1]], pa.binary())], names=["value"])

    for record in records:
        if not held and opening:
            held.append(_member(opening()))
        held.append(_member(make(record)))
        size += len(held[-1])
        if size >= FILE_BYTES:
            yield end()
    if held:
        yield end()


def _write(files: DataFrame, path: str) -> None:
    """One file a row."""
    value = F.col("value").cast("string").alias("value")  # the bytes as they are
    files.select(value).write.option("encoding", "ISO-8859-1").option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def opened(data: bytes | BinaryIO) -> BinaryIO:
    """A stream over the bytes of a file, gzip members joined."""
    stream = io.BytesIO(data) if isinstance(data, (bytes, bytearray, memoryview)) else data
    head = stream.read(2)
    stream.seek(0)
    return gzip.GzipFile(fileobj=stream) if head == b"\x1f\x8b" else stream


def _exactly(stream: BinaryIO, n: int) -> bytes:
    out = stream.read(n)
    if len(out) != n:
        raise ValueError(f"{n} bytes are declared, {len(out)} are left")
    return out


def arc_header(version: str, name: str) -> bytes:
    """The version block that an ARC file begins with, without its last line end."""
    block = f"{version} 0 graphlake\n{ARC_FIELDS[version]}\n".encode()
    return arc_record(version, name, f"filedesc://{name}", "text/plain", block, "0.0.0.0")


def arc_record(version: str, name: str, url: str, mime: str, body: bytes, ip: str = "0.0.0.0") -> bytes:
    """One ARC record without its last line end."""
    middle = f" 200 - - 0 {name}" if version == "2" else ""
    return f"{url} {ip} {_DATE} {mime}{middle} {len(body)}\n".encode() + body


def _to_arc(batches):
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    number = -1

    def name() -> tuple[str, str]:
        return "12"[(part + number) % 2], f"pages-{part}-{number}.arc"

    def opening() -> bytes:
        nonlocal number
        number += 1
        return arc_header(*name()) + b"\n"

    def records():
        for batch in batches:
            for page, url, html in zip(*(batch.column(i) for i in range(3))):
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                own = "" if not page.is_valid else page.as_py()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\nX-Page-Id: {own}\r\n\r\n"
                at = _BLANK.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url.as_py() or "") if url.is_valid and url.as_py() else "-"
                yield at, head.encode() + payload

    yield from _files(records(), lambda r: arc_record(*name(), r[0], "text/html", r[1]) + b"\n", opening)


def write_arc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """One ARC record per page, the page's HTML (text in UTF-8, or bytes) as an HTTP response's payload.

    Defined cases: null HTML is an empty payload; a null or empty URL is ``-``, white space in one is percent-encoded;
    a null id has no page number; repeated rows are a record each; an empty table gives no record; other columns are
    not read. Files are of version 1 and 2 in turn.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("binary").alias("html"))
    _write(map_batches(rows, _to_arc, "value binary"), path)


def arc_records(data: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, body) of every record, version blocks included. Raises ValueError where a file doesn't
    begin with a version block, a declared length doesn't fit, or the file is cut off."""
    stream, fields = opened(data), None
    while line := stream.readline():
        if not line.strip(b"\r\n"):  # line ends between records
            continue
        if not line.endswith(b"\n"):
            raise ValueError("a record's header line has no end")
        words = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        if not re.fullmatch("[0-9]+", words[-1]):
            raise ValueError(f"no length in {words[:1]}")
        body = _exactly(stream, int(words[-1]))
        if words[0].startswith("filedesc://"):
            version = body[:1].decode("ascii", "replace")
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version}")
            fields = ARC_FIELDS[version].split(" ")
        elif fields is None:
            raise ValueError("a record stands before the version block")
        if len(words) != len(fields):
            raise ValueError(f"{len(words)} fields in a record of {len(fields)}")
        yield dict(zip(fields, words)), body


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """(head with its empty line, payload) of an HTTP response; a head may end with bare line feeds. What has no
    empty line is all head."""
    ends = [at + len(mark) for mark in (b"\r\n\r\n", b"\n\n") if (at := body.find(mark)) >= 0]
    cut = min(ends, default=len(body))
    return body[:cut], body[cut:]


def warc_date(archive_date: str) -> str:
    """The 14 digits of an ARC date (fewer: the rest as at its beginning) in the form of WARC."""
    d = re.sub(r"\D", "", archive_date)[:14]
    d += "00000101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _header(head: bytes, name: bytes) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode("utf-8", "replace") if m else None


def _page_of(head: bytes) -> int | None:
    v = _header(head, b"X-Page-Id")
    return int(v) if v and re.fullmatch(r"-?\d+", v) else None


_CONVERTED = "kind string, page long, record_id string, uri string, date string, mime string, digest string, bytes long, head binary, payload binary"
_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = [c.split(" ") for c in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def _converter(digests_only: bool):
    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not len(content.as_buffer()):
                    continue
                rows, size = [], 0
                for number, (fields, body) in enumerate(arc_records(content.as_buffer().to_pybytes())):
                    info = fields["URL"].startswith("filedesc://")
                    if info and digests_only:
                        continue
                    http = not info and body.startswith(b"HTTP/")
                    head, payload = split_http(body) if http else (b"", body)
                    digest = payload_digest(payload)
                    # of the file's name and the record's place in it, so that repeated records have ids of their own
                    key = uuid.uuid5(uuid.NAMESPACE_URL, f"{path.rsplit('/', 1)[-1]} {number} {fields['URL']} {fields['Archive-date']} {digest}")
                    kind = "warcinfo" if info else "response" if http else "resource"
                    rows.append((kind, _page_of(head), f"<urn:uuid:{key}>", fields["URL"], warc_date(fields["Archive-date"]), fields["Content-type"], digest, len(payload), None if digests_only else head, None if digests_only else payload))
                    size += 0 if digests_only else len(payload)
                    if size >= PASS_BYTES:
                        yield _batch(rows, _CONVERTED)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, _CONVERTED)

    return run


def _contents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_arc(spark: SparkSession, path: str, *, digests_only: bool = False) -> DataFrame:
    """The records of all ARC files under a path, gzipped or not, with the identifiers, dates and digests of their
    WARC forms: (kind, page, record_id, uri, date, mime, digest, bytes, head, payload).

    Defined cases: a record that isn't an HTTP response is a resource, all payload; an HTTP response without an empty
    line is all head; payloads are bytes and never decoded; a file without records gives no row; a file that is cut
    off, or breaks its declared lengths, raises ValueError. A file of 2 GB or more can't be read.
    """
    return map_batches(_contents(spark, path), _converter(digests_only), _CONVERTED)


def _to_warc(batches):
    def records():
        for batch in batches:
            for r in batch.to_pylist():
                revisit = r["owner_record"] is not None
                http = r["kind"] == "response"
                block = r["head"] + (b"" if revisit else r["payload"])
                lines = [("WARC-Type", "revisit" if revisit else r["kind"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", r["date"])]
                if r["kind"] == "warcinfo":
                    lines.append(("WARC-Filename", r["uri"]))
                else:
                    lines += [("WARC-Target-URI", r["uri"]), ("WARC-Payload-Digest", f"sha1:{r['digest']}")]
                if revisit:
                    lines += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", r["owner_record"]), ("X-Refers-To-Page-Id", str(r["owner"])), ("X-Payload-Length", str(r["bytes"]))]
                lines += [("Content-Type", "application/http; msgtype=response" if http else r["mime"]), ("Content-Length", str(len(block)))]
                yield "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in lines), "\r\n"]).encode() + block + b"\r\n\r\n"

    yield from _files(records())


def convert_arc(spark: SparkSession, arc_path: str, warc_path: str, *, least_bytes: int = 0) -> None:
    """Write the WARC equivalent of ARC files. Of responses whose payloads are equal and of at least
    ``least_bytes`` bytes, that of the largest page stays a response; the others become revisits of it.

    Defined cases: as in ``read_arc``; where no record of a group has a page number, all stay responses; records that
    share the largest page number all stay responses, and the others refer to the one of the largest id; a resource is
    never a revisit; version blocks become warcinfo records; no ARC file gives no WARC record.
    """
    owners = read_arc(spark, arc_path, digests_only=True).where((F.col("bytes") >= least_bytes) & (F.col("kind") == "response")).groupBy(F.col("digest").alias("of"))
    owners = owners.agg(F.max("page").alias("owner"), F.max_by("record_id", F.struct("page", "record_id")).alias("owner_record"), F.count("*").alias("n"))
    owners = materialize(owners.where("n > 1 and owner is not null").drop("n"), "owners")
    few = owners.count() <= BROADCAST_ROWS
    rows = read_arc(spark, arc_path)
    rows = rows.join(F.broadcast(owners) if few else owners, (F.col("digest") == F.col("of")) & (F.col("kind") == "response"), "left").drop("of")
    revisit = F.col("owner").isNotNull() & ~F.col("page").eqNullSafe(F.col("owner"))
    rows = rows.withColumn("payload", F.when(~F.coalesce(revisit, F.lit(False)), F.col("payload"))).withColumn("owner_record", F.when(revisit, F.col("owner_record")))
    _write(map_batches(rows, _to_warc, "value binary"), warc_path)
    release(owners)


def warc_records(data: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every WARC record, gzipped or not. Raises ValueError where a record doesn't begin as
    one, a declared length doesn't fit, or the file is cut off."""
    stream = opened(data)
    while line := stream.readline():
        if not line.startswith(b"WARC/") or not line.endswith(b"\r\n"):
            raise ValueError(f"no WARC record in {line[:20]!r}")
        fields = {}
        while (line := stream.readline()) != b"\r\n":
            if not line.endswith(b"\r\n"):
                raise ValueError("a record's header has no end")
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        if not re.fullmatch("[0-9]+", fields.get("content-length", "")):
            raise ValueError("a record has no length")
        block = _exactly(stream, int(fields["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a declared length doesn't fit")
        yield fields, block


_READ = "page_id long, uri string, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to_record string, refers_to long"


def _reader(batches):
    for batch in batches:
        for content in batch.column(1):
            if not len(content.as_buffer()):
                continue
            rows = []
            for f, block in warc_records(content.as_buffer().to_pybytes()):
                kind = f["warc-type"]
                if kind == "warcinfo":
                    continue
                head, payload = split_http(block) if f.get("content-type", "").startswith("application/http") else (b"", block)
                declared = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                if kind == "revisit":
                    size, to = int(f.get("x-payload-length") or _header(head, b"Content-Length") or 0), f.get("x-refers-to-page-id")
                else:
                    size, to, found = len(payload), None, payload_digest(payload)
                    if (declared or found) != found:
                        raise ValueError(f"{f.get('warc-record-id')}: the payload doesn't have the digest {declared}")
                    declared = found
                rows.append((_page_of(head), f.get("warc-target-uri"), f.get("warc-record-id"), kind, size, declared, f.get("warc-refers-to"), int(to) if to else None))
                if len(rows) == 4096:
                    yield _batch(rows, _READ)
                    rows = []
            if rows:
                yield _batch(rows, _READ)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row per record but warcinfo, the digests of all but revisits verified.

    Defined cases: a record without a digest gets its own, a revisit without one null; a response without X-Page-Id has
    a null page; a file without records gives no row; broken files and wrong digests raise ValueError. A file of 2 GB
    or more can't be read.
    """
    return map_batches(_contents(spark, path), _reader, _READ)


def archive_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Pages to ARC files, these to WARC files (both in the shared folder), and the WARC records read back.

    -> (page_id, uri, record_id, record_type, payload_bytes, payload_digest, refers_to_record, refers_to)

    Defined cases: null HTML is an empty payload; a null or empty URL is ``-``, white space in one is percent-
    encoded; a null id has no page number: its record revisits another of equal payload that has one, else
    it is a response; repeated rows of one id are all responses or all revisits; payloads of any length are
    kept whole, and may hold anything that looks like a header; an empty table gives an empty result; other
    columns are not read.
    """
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc, id_col=id_col, url_col=url_col, html_col=html_col)
    convert_arc(spark, arc, warc, least_bytes=least_bytes)
    return read_warc(spark, warc)
