"""WARC archives: a writer of one gzip member per record, and a reader that splits files anywhere.

Writer: pages with equal payloads of at least ``revisit_from`` bytes share one ``response`` record, that of the largest
page id; the others become ``revisit`` records that refer to it. A task writes one file under a name of its own attempt
and renames it when it is whole, so a retried task replaces it with the same bytes.

Reader: files are cut into byte ranges. A task looks in its range for the gzip magic and decodes candidate members: one
counts if it inflates to its end as a WARC record with a whole header block and the length that it names, and if further
such members follow, each at the end of the one before, to the end of the file or for more than 65,535 bytes. No chain
inside a payload goes on that long: its bytes stand as they are only in a stored block of the outer member, which holds
no more. The task owns the records that start inside its range, reads past its end to finish the last one, and follows
the chain as far again behind it, so that a damaged or missing member in the chain raises ValueError in one task or
another and is never skipped. Response payloads are checked against their digest. Archives of other writers are read,
too: where a record has no X-Payload-Length or no SHA-1 payload digest, size and digest are those of the payload; a
revisit without them has null. The payload of a response is what follows the HTTP headers of an HTTP block, otherwise and
in records of other types the whole block.

Defined cases: a null payload is empty and a ``response``; a null page id or URL is left out of the record and read as
null. Rows that repeat the largest id of equal payloads are all responses; if all their ids are null, all are. Control
characters in URLs are percent-encoded. No pages give no file and no record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, ship, shuffle_width, slices, stash, trimmed

REVISIT_FROM = 1000
SPLIT_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"
_MAGIC = b"\x1f\x8b\x08"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("8c0bfa0e-5a67-4a0b-9a3e-0f6f6c1a7d10")
_READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_CHUNK = 1 << 18
#: The most bytes that deflate stores in a block.
_STORED = 65_535


def _file(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; Hadoop writes local ones as file:/x."""
    if path.startswith("file:/") and not path.startswith("file:///"):
        path = "file:///" + path[6:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def _record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, str(page_id))}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, date: str = DATE, level: int = 4) -> bytes:
    """One gzip member with a WARC record; a revisit if it refers to another page's."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {f'<urn:uuid:{uuid.uuid4()}>' if page_id is None else _record_id(page_id)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}", f"WARC-Profile: {_PROFILE}"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if refers_to is None else b"")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    out = zlib.compressobj(level, zlib.DEFLATED, 31)
    return out.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + out.flush()


def _sha1(named: str | None) -> str | None:
    """A labelled digest in hex, if it is a SHA-1 in base 32 or 16."""
    label, _, value = (named or "").strip().partition(":")
    if label.lower() != "sha1":
        return None
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def parse(data: bytes) -> tuple:
    """The row of an inflated record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = re.sub(r"\r\n[ \t]+", " ", head.decode()).split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[: (length := int(fields["content-length"]))]
    if len(block) != length:
        raise ValueError(f"record {fields.get('warc-record-id')} ends before its content length")
    number = lambda name: int(fields[name]) if name in fields else None
    kind, payload = fields["warc-type"], None
    size, digest = number("x-payload-length"), _sha1(fields.get("warc-payload-digest"))
    if kind != "revisit":
        http = kind == "response" and block.startswith(b"HTTP/")
        payload = block.partition(b"\r\n\r\n")[2] if http else block
        found = hashlib.sha1(payload).hexdigest()
        if kind == "response" and (digest not in (None, found) or size not in (None, len(payload))):
            raise ValueError(f"payload of {fields.get('warc-record-id')} differs from its digest")
        size, digest = len(payload), found
    return number("x-page-id"), fields.get("warc-target-uri"), kind, number("x-refers-to-page-id"), size, digest, payload


def write_warc(pages: DataFrame, folder: str, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Write (page_id, url, html) to ``folder``, at once; returns path, records, bytes for each file."""
    spark = pages.sparkSession
    ship(spark)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    large = rows.select("page_id", F.octet_length("payload").alias("n"), F.sha1("payload").alias("digest")).where(F.col("n") >= revisit_from)
    groups = large.groupBy("digest", "n").agg(F.max("page_id").alias("kept"), F.count("*").alias("rows")).where("rows > 1")
    shared = stash(groups.select(F.col("digest").alias("_digest"), "kept"))  # as long as payloads repeat; Spark broadcasts it only if it is small
    if shared.isEmpty():
        rows = rows.withColumn("refers_to", F.lit(None).cast("long"))
    else:
        joined = rows.join(shared, (F.octet_length("payload") >= revisit_from) & (F.sha1("payload") == F.col("_digest")), "left")
        rows = joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept"))).select(*rows.columns, "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _file(folder)
        task = TaskContext.get()
        name, count, size, out = f"part-{task.partitionId():06d}.warc.gz", 0, 0, None
        draft = f"{top}/_{name}.{task.taskAttemptId()}"
        for batch in slices(batches, 256):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    fs.create_dir(top, recursive=True)
                    out = fs.open_output_stream(draft)
                out.write(data := record(*row))
                count, size = count + 1, size + len(data)
        if out is not None:
            out.close()
            fs.move(draft, f"{top}/{name}")
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [count], "bytes": [size]})

    return stash(rows.select("page_id", "url", "payload", "refers_to").mapInArrow(trimmed(run), "path string, records long, bytes long"))


def records_in(source, start: int, end: int) -> Iterator[bytes]:
    """Inflated records whose gzip member starts in [start, end) of a random-access file."""
    at = _boundary(source, start, end)
    if at is None:
        return
    while at < end and (found := _member(source, at, whole=True)):
        yield found[0]
        at += found[1]
    seen = 0
    while seen <= _STORED and (found := _member(source, at, whole=True)):
        at, seen = at + found[1], seen + found[1]


def _boundary(source, start: int, end: int) -> int | None:
    """The first member in [start, end) that a chain of records begins with."""
    at = start
    while at < end:
        source.seek(at)
        window = source.read(min(_CHUNK, end - at) + len(_MAGIC) - 1)
        hit = window.find(_MAGIC)
        if hit < 0 or at + hit >= end:
            at += max(1, len(window) - len(_MAGIC) + 1)
            continue
        at += hit
        # Nothing precedes the first byte of a file: what begins as a record there is one.
        if at == 0 and _begins(source, 0) or _chained(source, at):
            return at
        at += 1
    return None


def _chained(source, at: int) -> bool:
    """Whether records follow one another from here to the end of the file, or further than a stored block can hold."""
    seen = 0
    try:
        while seen <= _STORED:
            found = _member(source, at, whole=bool(seen))
            if found is None:
                return seen > 0
            at, seen = at + found[1], seen + found[1]
    except ValueError:
        return False
    return True


def _member(source, at: int, whole: bool) -> tuple[bytes, int] | None:
    """The inflated record at an offset and its member's length.

    None at the end of the file and, unless ``whole``, if no record begins here; otherwise ValueError.
    """
    inflate, out, read = zlib.decompressobj(31), [], 0
    source.seek(at)
    while not inflate.eof:
        piece = source.read(_CHUNK if out else 4096)
        if not piece and not read:
            return None
        try:
            if not piece:
                raise zlib.error("the file ends within it")
            data = inflate.decompress(piece)
        except zlib.error as e:
            if not whole and not out:
                return None
            raise ValueError(f"damaged WARC member at byte {at}: {e}") from e
        read += len(piece)
        if not out and data and not data.startswith(b"WARC/"[: len(data)]) and not whole:
            return None
        out += [data] if data else []
    record = b"".join(out)
    if not _whole_record(record):
        if not whole and not record.startswith(b"WARC/"):
            return None
        raise ValueError(f"no whole WARC record at byte {at}")
    return record, read - len(inflate.unused_data)


def _whole_record(data: bytes) -> bool:
    """Whether the header block is one and the block is as long as it says."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not re.fullmatch(rb"WARC/\d+\.\d+", lines[0].strip()) or not all(b":" in x or x[:1] in b" \t" for x in lines[1:] if x):
        return False
    length = next((x.partition(b":")[2].strip() for x in lines[1:] if x.lower().startswith(b"content-length")), b"")
    return length.isdigit() and len(rest) >= int(length)


def _begins(source, at: int) -> bool:
    """Whether what inflates of the first bytes of a member begins as a WARC record."""
    source.seek(at)
    inflate, out = zlib.decompressobj(31), b""
    try:
        for byte in source.read(4096):
            out += inflate.decompress(bytes([byte]))
            if len(out) >= 5:
                break
    except zlib.error:
        pass
    return out.startswith(b"WARC/")


def read_warc(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload of each record in ``folder``.

    ``payload`` is null for a revisit; its size and digest are those of the full payload, as far as the record has them.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "length").where("length > 0")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start"), "length")
    ranges = ranges.select("path", "start", F.least(F.col("start") + split_bytes, "length").alias("end")).repartition(shuffle_width(spark), "path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = [x.split()[0] for x in _READ.split(", ")]
        for batch in slices(batches, 16):
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                fs, name = _file(path)
                with fs.open_input_file(name) as source:
                    rows: list[tuple] = []
                    for data in records_in(source, start, end):
                        rows.append(parse(data))
                        if len(rows) == 64:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                            rows.clear()
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return ranges.mapInArrow(trimmed(run), _READ)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    written = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    if written.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), d AS (
  SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY h, n) AS kept FROM d
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN n < 1000 OR kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n < 1000 OR kept = page_id THEN NULL ELSE kept END AS refers_to
FROM g
"""
