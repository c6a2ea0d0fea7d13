"""WARC archives: writing with segmentation, chunked framing and revisits; reading with segment reassembly.

The writer is Spark's text sink with the records' blank lines as line separator,
so archives land wherever Spark can write. Blocks over ``segment`` bytes go on in
continuation records. The reader streams each archive, groups continuations by
their origin's identifier, orders them by segment number, verifies the total
length and undoes the chunked transfer framing.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir, table, with_row

#: Payloads under this many bytes are never revisits.
LEAST_REVISIT = 1_000
#: Bytes of a record's block before it goes on in a continuation record.
SEGMENT = 16_384
#: Bytes of a chunk of the transfer framing.
CHUNK = 4_096
#: Bytes of an archive's blocks at most, before compression; a record's block is a segment at most.
ARCHIVE_BYTES = 256_000_000
#: Bytes of blocks that a reader hands on at once.
AT_ONCE = 4_000_000

_SCHEMA = "record_id string, type string, segment int, origin_id string, total_length long, refers_to string, digest string, block binary"


def _record(kind: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in [("WARC-Type", kind), *fields, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head.encode("utf-8") + b"\r\n" + block


def _records(name: str, url: str, payload: bytes, digest: str, refers_to: str | None, segment: int) -> list[bytes]:
    """The records of one capture, without the blank lines that end each."""
    own = [("WARC-Record-ID", f"<{name}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        return [_record("revisit", [*own, profile, ("WARC-Refers-To", f"<{refers_to}>")], head + b"Content-Length: %d\r\n\r\n" % len(payload))]
    chunks = [payload[i : i + CHUNK] for i in range(0, len(payload), CHUNK)]
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in chunks) + b"0\r\n\r\n"
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    if len(parts) == 1:
        return [_record("response", own, block)]
    first = _record("response", [*own, ("WARC-Segment-Number", 1)], parts[0])
    rest = [
        _record("continuation", [("WARC-Record-ID", f"<{name}/{i}>"), ("WARC-Segment-Number", i), ("WARC-Segment-Origin-ID", f"<{name}>"), *([("WARC-Segment-Total-Length", len(block))] if i == len(parts) else [])], part)
        for i, part in enumerate(parts[1:], 2)
    ]
    return [first, *rest]


def write_warc(captures: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """Write ``record_id, url, payload binary, digest, refers_to`` rows as gzipped archives under ``path``.

    A null url is empty, a null payload an empty one. An archive ends after as
    many records as ``ARCHIVE_BYTES`` allows, so it can be read as one cell.
    """

    @F.arrow_udf("array<binary>")
    def records(name: pa.Array, url: pa.Array, payload: pa.Array, digest: pa.Array, refers_to: pa.Array) -> pa.Array:
        clean = lambda s: "".join((s or "").split())  # noqa: E731  a field is one line
        rows = zip(*(x.to_pylist() for x in (name, url, payload, digest, refers_to)))
        return pa.array([_records(n, clean(u), p or b"", d, r, segment) for n, u, p, d, r in rows], pa.list_(pa.binary()))

    made = captures.select(F.explode(records("record_id", "url", "payload", "digest", "refers_to")).alias("r"))
    made.select(F.col("r").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", max(1, ARCHIVE_BYTES // segment)).text(path)


def _parse(stream) -> Iterator[tuple]:
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            fields[name.lower()] = value.strip()
        block = stream.read(length := int(fields["content-length"]))
        if len(block) != length:
            raise ValueError(f"record {fields.get('warc-record-id')} is cut off")
        number = lambda key: int(fields[key]) if key in fields else None  # noqa: B023, E731
        plain = lambda key: fields[key].strip("<>") if key in fields else None  # noqa: B023, E731
        yield plain("warc-record-id"), fields["warc-type"], number("warc-segment-number"), plain("warc-segment-origin-id"), number("warc-segment-total-length"), plain("warc-refers-to"), fields.get("warc-payload-digest"), block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``, one row each; fails on a cut-off record."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [field.split()[0] for field in _SCHEMA.split(", ")]
        types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        flush = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)
        rows, held = [], 0
        for batch in batches:
            for content in batch.column(0):
                data = io.BytesIO(memoryview(content.as_buffer()))
                with gzip.GzipFile(fileobj=data) as stream:
                    for row in _parse(stream):
                        rows.append(row)
                        held += len(row[-1])
                        if held >= AT_ONCE:
                            yield flush(rows)
                            rows, held = [], 0
        if rows:
            yield flush(rows)

    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return archives.select("content").mapInArrow(parse, _SCHEMA)


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records: ``record_id, type, refers_to, digest, block, complete``.

    Records without a segment number are whole. The others are grouped by their
    origin's identifier; a group is the segments of one record, so its size is
    that record's. Repeated segments count once. A record that lacks a segment,
    or whose blocks don't add up to the total length, has a null block and
    ``complete`` false.
    """
    whole = records.where(F.col("segment").isNull()).select("record_id", "type", "refers_to", "digest", "block", F.lit(True).alias("complete"))
    cut = records.where(F.col("segment").isNotNull()).withColumn("origin", F.coalesce("origin_id", "record_id"))
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c)))
    parts = F.array_sort(F.collect_set(F.struct("segment", "block")))
    met = cut.groupBy("origin").agg(first("type").alias("type"), first("refers_to").alias("refers_to"), first("digest").alias("digest"), F.max("total_length").alias("total"), parts.alias("parts"))
    in_order = F.transform("parts", lambda p: p["segment"]) == F.sequence(F.lit(1), F.size("parts"))
    joined = F.aggregate("parts", F.expr("X''"), lambda a, p: F.concat(a, p["block"]))
    met = met.withColumn("complete", F.coalesce(in_order & (F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.length(p["block"])) == F.col("total")), F.lit(False)))
    return whole.unionByName(met.select(F.col("origin").alias("record_id"), "type", "refers_to", "digest", F.when(F.col("complete"), joined).alias("block"), "complete"))


def _http(block: bytes) -> tuple[bytes | None, int]:
    """Payload and its length of an HTTP response; of a bare head the length it names."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
    if fields.get(b"transfer-encoding") == b"chunked":
        at, out = 0, []
        while True:
            end = body.index(b"\r\n", at)
            size = int(body[at:end].split(b";")[0], 16)
            if not size:
                break
            piece = body[end + 2 : end + 2 + size]
            if len(piece) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
                raise ValueError("broken chunk")
            out.append(piece)
            at = end + 4 + size
        body = b"".join(out)
    elif not body and int(fields.get(b"content-length", b"0")):
        return None, int(fields[b"content-length"])
    return body, len(body)


def payload(block: Column) -> Column:
    """``struct<payload, bytes>`` of HTTP blocks, transfer framing undone; null for a null block."""

    @F.arrow_udf("struct<payload:binary,bytes:long>")
    def udf(blocks: pa.Array) -> pa.Array:
        found = [_http(b.as_py()) if b.is_valid else (None, None) for b in blocks]
        return pa.StructArray.from_arrays([pa.array([p for p, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], ["payload", "bytes"])

    return udf(block)


def captures_of(pages: DataFrame) -> DataFrame:
    """A capture for each row of ``pages``; equal payloads refer to the one with the largest page_id.

    Rows that repeat the largest page_id are each a response. A null html is an
    empty payload; a null page_id never answers for others. Digests are matched
    without the payloads; those are joined with what their rows refer to.
    """
    rows = with_row(pages.select("page_id", "url", "html"), "row")
    rows = rows.select("row", "page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha1("payload"))
    keys = materialize(rows.where(F.length("payload") >= LEAST_REVISIT).select("row", "page_id", F.unhex("digest").alias("key")))
    shared = materialize(keys.groupBy("key").agg(F.max("page_id").alias("best"), F.count("*").alias("n")).where("n > 1 AND best IS NOT NULL").select("key", "best"))
    answered = materialize(keys.join(shared, "key").where(~F.col("page_id").eqNullSafe(F.col("best"))).select(F.col("row").alias("revisit"), "best"))
    joined = rows.join(answered, rows["row"] == answered["revisit"], "left")
    name = F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("#"), F.col("row").cast("string"))
    return joined.select(name.alias("record_id"), "url", "payload", "digest", F.concat(F.lit("urn:page:"), F.col("best").cast("string")).alias("refers_to"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``pages`` through archives and back; odd rows as ``captures_of`` says. An empty table gives no rows."""
    path = shared_dir(spark)
    write_warc(captures_of(table(spark, sf_dir, "pages")), path)
    read = reassemble(read_warc(spark, path)).withColumn("p", payload(F.col("block")))
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?[0-9]+)", 1).try_cast("long")
    own = F.when(F.col("type") == "revisit", F.regexp_replace("digest", "^sha1:", "")).otherwise(F.sha1("p.payload"))
    return read.select(number("record_id").alias("page_id"), F.col("p.bytes").alias("payload_bytes"), own.alias("payload_digest"), F.col("type").alias("record_type"), number("refers_to").alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS d, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
b AS (SELECT d, max(page_id) AS best FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN best IS NULL OR best = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN best IS NULL OR best = page_id THEN NULL ELSE best END AS refers_to
FROM p LEFT JOIN b ON p.d = b.d
"""
