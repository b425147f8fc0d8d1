"""WARC archives as a chunked record table.

A payload is never handled as one value on the way back: the writer cuts it into segments (the
``continuation`` records of the WARC format) and the reader streams an archive line by line into
(record id, chunk number) rows that carry the byte count and the SHA-1 so far.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condfuse.llm.common import cut

CHUNK_SCHEMA = (
    "record_id string, warc_type string, target_uri string, refers_to string, declared_digest string, "
    "chunk_no int, chunk binary, bytes_so_far long, sha1_so_far string, last boolean"
)


def write_warc(records: DataFrame, path: str, *, segment_chars: int = 65_536, date: str = "1970-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """Write ``records(record_id, target_uri, payload, payload_digest, refers_to)`` to archives in ``path``.

    One file per task, through Spark's own writer, so any store works and a lost task leaves no half
    archive.  A row with ``refers_to`` becomes a ``revisit`` without payload, any other a ``response``.  Payloads of more than
    ``segment_chars`` code points become a first segment and ``continuation`` records.  Null payloads
    are empty; line breaks in the URI are removed, a null URI is left out.  Compression keeps each
    archive in one reading task.
    """
    n_chars, end = F.length("payload"), "\r\n"
    rows = records.select(
        "record_id",
        F.regexp_replace("target_uri", "[\\r\\n]", "").alias("target_uri"),
        F.when(F.col("refers_to").isNull(), F.coalesce("payload", F.lit(""))).otherwise("").alias("payload"),
        "payload_digest",
        "refers_to",
    )
    # one pass over the payload, whatever its number of segments
    blocks = F.when(n_chars > segment_chars, F.regexp_extract_all("payload", F.lit(f"(?s).{{1,{segment_chars}}}"), F.lit(0))).otherwise(F.array("payload"))
    rows = rows.select("record_id", "target_uri", "payload_digest", "refers_to", F.octet_length("payload").alias("total"), blocks.alias("blocks"))
    rows = rows.select("*", F.size("blocks").alias("segments"), F.posexplode("blocks").alias("segment", "block")).drop("blocks")
    rows = rows.withColumn("segment", F.col("segment") + 1)

    def line(name: str, value, when=None):
        text = F.concat(F.lit(f"{name}: "), value, F.lit(end))
        return F.coalesce(text if when is None else F.when(when, text), F.lit(""))

    first, many = F.col("segment") == 1, F.col("segments") > 1
    kind = F.when(~first, "continuation").when(F.col("refers_to").isNotNull(), "revisit").otherwise("response")
    origin = F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))
    value = F.concat(
        F.lit(f"WARC/1.1{end}"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.when(first, origin).otherwise(F.concat(F.lit("<"), F.col("record_id"), F.lit(":segment:"), F.col("segment").cast("string"), F.lit(">")))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("target_uri"), F.col("target_uri").isNotNull()),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest")), first),
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), F.col("refers_to").isNotNull()),
        line("WARC-Refers-To", F.concat(F.lit("<"), F.col("refers_to"), F.lit(">")), F.col("refers_to").isNotNull()),
        line("WARC-Segment-Number", F.col("segment").cast("string"), many),
        line("WARC-Segment-Origin-ID", origin, ~first),
        line("WARC-Segment-Total-Length", F.col("total").cast("string"), many & (F.col("segment") == F.col("segments"))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit(end),
        F.col("block"),
        F.lit(end),
    )
    rows.select(value.alias("value")).write.option("lineSep", end).option("compression", compression).text(path)


class _Reader:
    """Bytes of one archive, line by line, to chunk rows; holds at most one chunk."""

    def __init__(self, chunk_bytes: int):
        self.chunk_bytes, self.headers, self.left, self.buffer = chunk_bytes, None, 0, bytearray()
        self.record = None

    def line(self, raw: bytes) -> Iterator[tuple]:
        if self.left:
            body = (raw + b"\n")[: self.left]
            self.left -= len(body)
            self.buffer += body
            while len(self.buffer) > self.chunk_bytes or (not self.left and self.buffer):
                part = bytes(self.buffer[: self.chunk_bytes])
                del self.buffer[: self.chunk_bytes]
                yield self.chunk(part, not self.left and not self.buffer)
            return
        text = raw.rstrip(b"\r")
        if self.headers is None:
            if text.startswith(b"WARC/"):
                self.headers = {}
            elif text:
                raise ValueError(f"no WARC record starts with {text[:40]!r}")
        elif text:
            name, _, value = text.decode("utf-8", "replace").partition(":")
            self.headers[name.strip().lower()] = value.strip()
        else:
            h, self.headers = self.headers, None
            name = h.get("warc-segment-origin-id", h["warc-record-id"]).strip("<>")
            if h["warc-type"] != "continuation":
                self.record = [name, h, 0, 0, hashlib.sha1()]
            elif self.record is None or self.record[0] != name:
                raise ValueError(f"segment of {name} without its first segment")
            self.ends = "warc-segment-number" not in h or "warc-segment-total-length" in h
            self.left = int(h["content-length"])
            if not self.left:
                yield self.chunk(b"", True)

    def chunk(self, part: bytes, block_done: bool) -> tuple:
        name, h, number, size, sha1 = self.record
        sha1.update(part)
        self.record[2:4] = number + 1, size + len(part)
        last = block_done and self.ends
        refers = h.get("warc-refers-to")
        return (name, h["warc-type"], h.get("warc-target-uri"), refers and refers.strip("<>"), h.get("warc-payload-digest", "").removeprefix("sha1:"), number, part, size + len(part), sha1.copy().hexdigest(), last)


def read_warc(spark: SparkSession, path: str, *, chunk_bytes: int = 1 << 20) -> DataFrame:
    """The chunk table of the compressed archives in ``path``, one row per record and chunk.

    ``bytes_so_far`` and ``sha1_so_far`` run along a record; the row with ``last`` has them for the
    whole payload.  A task reads an archive from its first byte, as compressed text is not split; it
    holds one line of the archive and one chunk.  In archives of ``write_warc`` a line is at most a segment; in others a
    payload without line ends is one line.  A broken archive raises ``ValueError``.
    """
    names = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, rows, held = _Reader(chunk_bytes), [], 0
        kinds = [pa.string()] * 5 + [pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for raw in batch.column(0):
                for row in reader.line(raw.as_py()):
                    rows.append(row)
                    held += len(row[6]) + 200
                    if held > 8 * chunk_bytes:
                        yield out()
                        rows, held = [], 0
        if reader.left or reader.headers is not None:
            raise ValueError("the archive ends inside a record")
        if rows:
            yield out()

    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("value"))
    return lines.mapInArrow(chunks, CHUNK_SCHEMA)


def archive_pages(pages: DataFrame, path: str, *, min_revisit_bytes: int = 1000) -> DataFrame:
    """Write one record per ``pages(page_id, url, html)`` row to ``path`` and return the records read back:
    ``page_id, payload_bytes, payload_digest, record_type, refers_to``.  The archives are read once, to a narrow table of
    their records, where revisits find their responses.

    Of records with equal payloads of at least ``min_revisit_bytes`` bytes the one with the largest
    ``page_id`` is the response and the others revisit it; a null ``page_id`` never is the one referred to
    unless the group has no id, then all its records are responses.  Repeated rows with that largest id
    are all responses.  A revisit's size and digest are those of the response it refers to, as read.
    Null html is an empty payload; an empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", F.col("url").alias("target_uri"), F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1(F.col("payload").cast("binary")))
    # the second hash keeps apart payloads made to share a SHA-1
    facts = rows.where(F.octet_length("payload") >= min_revisit_bytes).select("page_id", "payload_digest", F.xxhash64("payload").alias("h"))
    groups = facts.groupBy("payload_digest", "h").agg(F.max("page_id").alias("keep_id"), F.count(F.lit(1)).alias("n")).where("n > 1 AND keep_id IS NOT NULL")
    revisits = (
        facts.join(groups.drop("n"), ["payload_digest", "h"])
        .where(~F.col("page_id").eqNullSafe(F.col("keep_id")))
        .select(F.col("page_id").alias("r_id"), F.col("payload_digest").alias("r_digest"), F.col("h").alias("r_h"), "keep_id")
        .distinct()
    )
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    same = F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("payload_digest") == F.col("r_digest")) & (F.xxhash64("payload") == F.col("r_h"))
    records = rows.join(revisits, same, "left").select(
        urn("page_id").alias("record_id"), "target_uri", "payload", "payload_digest", F.when(F.col("keep_id").isNotNull(), urn("keep_id")).alias("refers_to")
    )
    write_warc(records, path)
    read = read_warc(spark, path).where("last").select("record_id", "warc_type", "refers_to", "declared_digest", "bytes_so_far", "sha1_so_far")
    read = cut(read, "warc")
    target = (
        read.where("warc_type = 'response'")
        .groupBy(F.col("record_id").alias("t_id"), F.col("sha1_so_far").alias("t_digest"))
        .agg(F.max("bytes_so_far").alias("t_bytes"))
    )
    found = read.join(target, (F.col("refers_to") == F.col("t_id")) & (F.col("declared_digest") == F.col("t_digest")), "left")
    number = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).try_cast("long")
    return found.select(
        number("record_id").alias("page_id"),
        F.when(F.col("warc_type") == "revisit", F.col("t_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        F.when(F.col("warc_type") == "revisit", F.col("t_digest")).otherwise(F.col("sha1_so_far")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        number("refers_to").alias("refers_to"),
    )
