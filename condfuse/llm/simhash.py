"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from condfuse.llm.common import components, cut

PIECE = 1 << 20  # bytes of a text split into words at once
BLOCK = 2048  # fingerprints of a crowded bucket compared at once
_SPACES = b" \t\n\r\x0b\x0c"


def _words(raw: bytes) -> Iterator[list[bytes]]:
    """The lower-cased words of a text in pieces; a word is never cut."""
    at = 0
    while at < len(raw):
        end = at + PIECE
        while end < len(raw) and raw[end] not in _SPACES:
            end += 1
        yield raw[at:end].lower().split()
        at = end


def fingerprint(raw: bytes, shingle: int = 3) -> int:
    """The 64-bit SimHash of a UTF-8 text; zero for a text without words."""
    ones, n, tail = np.zeros(64, np.int64), 0, []
    for words in _words(raw):
        words = tail + words
        if len(words) >= shingle:
            body = b" ".join(words)
            lens = np.fromiter(map(len, words), np.int64, len(words))
            starts = np.cumsum(lens + 1) - lens - 1
            ends = (starts + lens)[shingle - 1 :]
            digest = xxhash.xxh64_digest
            for k in range(0, len(ends), 1 << 16):
                h = b"".join([digest(body[a:b], 42) for a, b in zip(starts[k : k + (1 << 16)].tolist(), ends[k : k + (1 << 16)].tolist())])  # noqa: B905
                bits = np.unpackbits(np.frombuffer(h, np.uint8)).reshape(-1, 64)
                ones += bits.sum(0, dtype=np.uint32)
                n += len(bits)
            tail = words[len(words) - shingle + 1 :]
        else:
            tail = words
    if not n and tail:
        ones, n = np.unpackbits(np.frombuffer(xxhash.xxh64_digest(b" ".join(tail), 42), np.uint8)).astype(np.int64), 1
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big") if n else 0


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) of every whole text."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(raw.as_buffer().to_pybytes(), shingle) for raw in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))
    return rows.mapInArrow(run, f"doc_id {id_type}, fp long")


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """The 2**(radius+1) - 1 masks of a covering family, as signed longs.

    Bit i carries a non-zero vector of radius + 1 bits; mask v keeps the bits whose vector has an odd
    product with v.  ``radius`` vectors leave some v that all of them miss, so any two words that differ in at most ``radius`` bits are
    equal under some mask.
    """
    count = (1 << (radius + 1)) - 1
    masks = [sum(1 << i for i in range(bits) if ((i % count + 1) & v).bit_count() % 2) for v in range(1, count + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def flood(left: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(member, seed) for the groups of linked words among ``left``, groups of one left out."""
    out = []
    while len(left):
        seed, work, left = left[0], [left[0]], left[1:]
        while work and len(left):
            near = np.bitwise_count(left ^ work.pop()) <= radius
            if near.any():
                out += [(int(x), int(seed)) for x in left[near]]
                work += list(left[near])
                left = left[~near]
    return out


def _crowded(radius: int):
    """Rows sorted by (v, key, i, j) to the links inside each group, a group held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def links():
            pairs = flood(np.unique(np.concatenate(held)).view(np.uint64), radius) if held else []
            a = np.array([p[0] for p in pairs], np.uint64).view(np.int64)
            b = np.array([p[1] for p in pairs], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([c.to_numpy() for c in batch.columns[:4]], axis=1)
            fps = batch.column(4).to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if held and not (keys[lo] == key).all():
                    yield links()
                    held = []
                key = keys[lo]
                held.append(fps[lo:hi])
        if held:
            yield links()

    return run


def near_links(words: DataFrame, radius: int = 3) -> DataFrame:
    """Links ``(a, b)`` between the distinct ``words(fp)`` that connect all words within ``radius`` bits.

    Each word falls into one bucket per covering mask.  A bucket of two gives its pair, if near enough.  A
    bucket of more is flooded block by block: each word is compared with the rest until it is linked, and
    only a tree of links leaves the task, so no group emits all its pairs.  A bucket larger than a block goes to one task
    per pair of blocks.
    """
    masks = covering_masks(radius)
    table = words.select("fp", F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for v, m in enumerate(masks)])).alias("t"))
    table = table.select("fp", "t.v", "t.key")
    buckets = cut(table.groupBy("v", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "buckets")
    pairs = buckets.where("n = 2").select("a", "b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    crowd = buckets.where("n > 2").select(F.col("v").alias("_v"), F.col("key").alias("_key"), F.ceil(F.col("n") / F.lit(BLOCK)).cast("long").alias("nb"))
    rows = table.join(crowd, (F.col("v") == F.col("_v")) & (F.col("key") == F.col("_key")))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("nb"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    rows = rows.select(F.col("v").cast("long").alias("v"), "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    sorted_rows = rows.repartition("v", "key", "i", "j").sortWithinPartitions("v", "key", "i", "j")
    return pairs.union(sorted_rows.mapInArrow(_crowded(radius), "a long, b long")).distinct()


def simhash_groups(docs: DataFrame, *, shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (16 hex digits), ``component_id``.

    Words are the runs of other characters than ASCII white space, A-Z lower-cased; a fingerprint bit is set where over half
    of the XXH64 (seed 42) of all word shingles have it.  Fingerprints within ``radius`` bits are linked, without
    exception; ``component_id`` is the smallest id reachable.  Equal fingerprints are folded
    before any comparison.

    Null and empty texts have the zero fingerprint and are linked like others; a text of fewer words than
    ``shingle`` is one shingle.  A null ``doc_id`` is passed over when the smallest is sought (null if
    a group has no other).  Repeated rows give repeated results; an empty table none; other columns are not read.
    """
    rows = cut(fingerprints(docs, shingle), "fingerprints")
    words = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "words")
    roots = components(near_links(words, radius))
    placed = words.join(roots, words["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    member = placed.select(F.col("fp").alias("_fp"), "root").join(least, "root").select("_fp", "component_id")
    return rows.join(member, F.col("fp") == F.col("_fp")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
