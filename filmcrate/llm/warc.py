"""Web archives written and read through Spark's text files, with payloads as rows of chunks.

A payload longer than a chunk is written as a segmented record (its first segment, then
continuation records), so no row, line or buffer holds more than a chunk of it beyond the
input column itself. Reading streams the files' lines and gives one row a chunk: record
identifier, chunk number, bytes, and the length and SHA-256 of the payload so far; the row
marked ``last`` has those of the whole. Files are gzip streams, hence read from their start
by one task each, at any size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CHUNK_BYTES = 64 << 10
#: Payloads shorter than this are always stored.
LEAST_REVISIT = 100
#: Given so that equal input gives equal archives.
DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "page_id long, record_type string, refers_to long, chunk_no long, chunk binary, payload_bytes long, payload_digest string, last boolean"


def _pages(pages: DataFrame) -> DataFrame:
    rows = common.pick(pages, "page_id", "url", "html")
    raw = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    return rows.select("page_id", "url", raw.alias("raw")).withColumn("size", F.octet_length("raw").cast("long")).withColumn("digest", F.sha2("raw", 256))


def with_origin(pages: DataFrame) -> DataFrame:
    """Pages with ``origin``: the page_id that a revisit refers to, null for responses.

    Groups of equal payloads are counted before anything is joined; only payloads that occur
    under several page_ids are joined back, by a join that Spark can split where a payload is
    very frequent.
    """
    rows = _pages(pages)
    groups = rows.where(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("origin"), F.max("page_id").alias("final"))
    groups = common.settle(groups.where("origin < final").select(F.col("digest").alias("d"), "origin"), "payloads")
    joined = rows.join(groups, rows["digest"] == groups["d"], "left")
    return joined.withColumn("origin", F.when(F.col("page_id") != F.col("origin"), F.col("origin"))).drop("d")


def write_archives(pages: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES) -> None:
    """One record a page under ``path``: a response, or a revisit of the smallest page_id with an equal payload of LEAST_REVISIT bytes or more.

    A null html is an empty payload, a null url an empty target. Null page_ids are written
    as responses without an identifier. Rows that repeat the smallest page_id are all
    responses. Line breaks inside a url are dropped.
    """
    rows = with_origin(pages)
    parts = F.when(F.col("origin").isNotNull(), 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("size") / chunk_bytes)))
    rows = rows.select("page_id", "url", "size", "digest", "origin", parts.cast("int").alias("parts"), F.when(F.col("origin").isNull(), F.col("raw")).alias("raw"))
    rows = rows.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("parts"))))
    body = F.coalesce(F.expr(f"substring(raw, (nth - 1) * {chunk_bytes} + 1, {chunk_bytes})"), F.lit(b""))
    rows = rows.withColumn("body", body)
    name = lambda c, nth=None: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("")), *([F.lit("/"), nth.cast("string")] if nth is not None else []), F.lit(">"))
    page = F.col("page_id")
    kind = F.when(F.col("origin").isNotNull(), "revisit").when(F.col("nth") > 1, "continuation").otherwise("response")
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    only = lambda when, *text: F.when(when, F.concat(*text)).otherwise("")
    many = F.col("parts") > 1
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.when(F.col("nth") > 1, name(page, F.col("nth"))).otherwise(name(page))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("X-Payload-Length", F.col("size").cast("string")),
        only(F.col("origin").isNotNull(), line("WARC-Profile", F.lit(_PROFILE)), line("WARC-Refers-To", name(F.col("origin")))),
        only(many, line("WARC-Segment-Number", F.col("nth").cast("string"))),
        only(F.col("nth") > 1, line("WARC-Segment-Origin-ID", name(page))),
        only(many & (F.col("nth") == F.col("parts")), line("WARC-Segment-Total-Length", F.col("size").cast("string"))),
        line("Content-Length", F.octet_length("body").cast("string")),
        F.lit("\r\n"),
    )
    record = F.concat(F.encode(head, "UTF-8"), F.col("body"), F.lit(b"\r\n")).cast("string")
    rows.select(record.alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def _identifier(value: bytes) -> int | None:
    inside = value.strip(b"<>").removeprefix(b"urn:x-page:").split(b"/")[0]
    return int(inside) if inside else None


class Reader:
    """Takes the lines of archives one by one; gives a row of CHUNKS for each segment."""

    def __init__(self) -> None:
        self.head: dict[bytes, bytes] | None = None
        self.missing = -1  # payload bytes of the open record still to come; -1 while in a head
        self.parts: list[bytes] = []
        self.digest, self.size, self.origin, self.nth = hashlib.sha256(), 0, None, 0

    def take(self, line: bytes) -> tuple | None:
        if self.missing >= 0:
            part = line[: self.missing]
            self.parts.append(part)
            self.missing -= len(part)
            if self.missing > 0:
                self.parts.append(b"\n")
                self.missing -= 1
            return self.close() if self.missing == 0 else None
        line = line.rstrip(b"\r")
        if self.head is None:
            if line.startswith(b"WARC/"):
                self.head = {}
            elif line:
                raise ValueError(f"not the beginning of a record: {line[:60]!r}")
            return None
        if line:
            key, _, value = line.partition(b": ")
            self.head[key] = value
            return None
        self.missing = int(self.head[b"Content-Length"])
        return self.close() if self.missing == 0 else None

    def close(self) -> tuple:
        head, chunk = self.head or {}, b"".join(self.parts)
        kind = head[b"WARC-Type"]
        if kind != b"continuation":
            self.digest, self.size, self.nth, self.origin = hashlib.sha256(), 0, 0, head[b"WARC-Record-ID"]
        elif head[b"WARC-Segment-Origin-ID"] != self.origin or int(head[b"WARC-Segment-Number"]) != self.nth + 1:
            raise ValueError(f"segment {head[b'WARC-Record-ID']!r} does not follow its record")
        self.nth += 1
        self.digest.update(chunk)
        self.size += len(chunk)
        said, whole = head[b"WARC-Payload-Digest"].removeprefix(b"sha256:").decode(), int(head[b"X-Payload-Length"])
        self.head, self.missing, self.parts = None, -1, []
        page = _identifier(self.origin or b"")
        if kind == b"revisit":
            return page, "revisit", _identifier(head[b"WARC-Refers-To"]), 0, b"", whole, said, True
        last = self.size == whole
        if last and self.digest.hexdigest() != said:
            raise ValueError(f"the payload of {self.origin!r} has another digest than its head")
        return page, "response", None, self.nth - 1, chunk, self.size, self.digest.copy().hexdigest(), last


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of archives written by ``write_archives``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
        names = [x.split()[0] for x in CHUNKS.split(", ")]
        reader, rows, held = Reader(), [], 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        for batch in batches:
            for line in batch.column(0):
                if row := reader.take(line.as_py()):
                    rows.append(row)
                    held += len(row[4])
                    if held > 4 << 20 or len(rows) >= 4096:
                        yield flush()
                        rows, held = [], 0
        if reader.head is not None:
            raise ValueError("an archive ends inside a record")
        if rows:
            yield flush()

    lines = spark.read.option("lineSep", "\n").schema("value string").text(path)
    return lines.select(F.col("value").cast("binary").alias("value")).mapInArrow(run, CHUNKS)


def op7_warc_round_trip(spark, sf_dir: str) -> DataFrame:
    """All ``pages`` written as archives and read back: payload length and digest, type and origin of each."""
    path = common.scratch(spark, "warc")
    write_archives(common.read(spark, sf_dir, "pages"), path)
    chunks = read_archives(spark, path).where("last")
    return chunks.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same rows without archives.
op7_sql = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
     g AS (SELECT html, min(page_id) AS origin FROM p WHERE n >= 100 GROUP BY html)
SELECT p.page_id, p.n AS payload_bytes, sha256(p.html) AS payload_digest,
       CASE WHEN g.origin <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.origin <> p.page_id THEN g.origin END AS refers_to
FROM p LEFT JOIN g ON g.html = p.html
"""
