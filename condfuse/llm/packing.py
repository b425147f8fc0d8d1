"""Best-fit packing of tokenised documents in bulk-synchronous sweeps."""

from __future__ import annotations

import base64
import contextlib
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from condfuse.llm.common import bucketed_rank, cut, text_of

PIECE = 1 << 18  # characters tokenised at once
PER_TASK = 500  # rows of one size ranked in one task
#: A blank between two ASCII letters begins a new word in any case, so a text may be cut before it.
_CUT = re.compile(r"[A-Za-z](?= [A-Za-z])")
_coders: dict[str, object] = {}


def _coder(name: str):
    """Token ids of a text by the vocabulary ``name`` of the public tokenizers, loaded once per process.

    ``tiktoken`` reads the same vocabulary as ranks and gives the ids of ``tokenizers`` (the tests compare them) in a
    quarter of the time.  Texts that it refuses, and texts with the string of a special token, which ``tokenizers``
    turns into that token, go to ``tokenizers``.
    """
    if name not in _coders:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        slow = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        special = [t.content for t in slow.get_added_tokens_decoder().values()]

        def encode(text: str) -> list[int]:
            if not any(t in text for t in special):
                with contextlib.suppress(Exception):  # the pattern engine gives up on very long runs
                    return fast.encode_ordinary(text)
            return slow.encode(text, add_special_tokens=False).ids

        _coders[name] = encode
    return _coders[name]


def token_ids(text: str, name: str) -> np.ndarray:
    """Ids of the whole text and the closing 0, as little-endian unsigned 32-bit numbers."""
    encode, parts, at = _coder(name), [], 0
    while at < len(text):
        m = _CUT.search(text, at + PIECE) if len(text) - at > PIECE else None
        end = m.end() if m else len(text)
        parts.append(np.array(encode(text[at:end]), "<u4"))
        at = end
    return np.concatenate([*parts, np.zeros(1, "<u4")])


def token_pieces(docs: DataFrame, capacity: int = 2048, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: documents of more than ``capacity`` ids in pieces of just that
    many, the first one shorter if need be; others in one piece."""
    id_type = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, out = [], []
            for i, text in enumerate(batch.column(1)):
                ids = token_ids(text_of(text), tokenizer)
                bounds = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    owner.append(i)
                    out.append((k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *columns], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type.simpleString()}, piece int, start long, length long, ids_crc32 long")


def _must_open(items: dict[int, int], gaps: dict[int, int], capacity: int) -> int:
    """Sequences that must still be opened: items of a size or more need room in gaps of that size or more."""
    need, least = 0, 0
    for size in sorted({*items, *gaps}, reverse=True):
        need += size * (items.get(size, 0) - gaps.get(size, 0))
        if items.get(size):
            least = max(least, -(-need // capacity))
    return least


def _sweep(state: DataFrame, items: dict[int, int], gaps: dict[int, int]) -> DataFrame:
    """One successor sweep over ``state(kind, id, size)``; kind 0 are gaps (slots of them), kind 1 items.

    Sizes fall along the sweep, a gap stands before the items of its size.  A gap opens a level and an item
    closes the innermost open one, that is the smallest gap left that holds it.  The level of a row is
    the count of its class's end (known from the histogram, at most two entries per size) and its rank in the class;
    inside a level gaps and items alternate, so an item's gap is the row before it.
    """
    classes, level = [], 0
    for size in sorted({*items, *gaps}, reverse=True):
        classes.append((0, size, level))
        level += gaps.get(size, 0)
        classes.append((1, size, level))
        level -= items.get(size, 0)
    ends = F.broadcast(state.sparkSession.createDataFrame(classes, "_kind int, _size long, level0 long"))
    spread = F.xxhash64("id", "slot")
    ranked = bucketed_rank(cut(state, "pack-wide"), ["kind", "size"], [spread, F.col("id"), F.col("slot")], spread, name="rank", per_task=PER_TASK)
    ranked = ranked.join(ends, (F.col("kind") == F.col("_kind")) & (F.col("size") == F.col("_size")))
    at = F.when(F.col("kind") == 0, F.col("level0") + F.col("rank") + 1).otherwise(F.col("level0") - F.col("rank"))
    line = Window.partitionBy("level").orderBy(F.col("size").desc(), "kind")
    met = ranked.withColumn("level", at).select(
        "kind", "id", "size", "gap", F.lag("kind").over(line).alias("k0"), F.lag("id").over(line).alias("id0"), F.lead("kind").over(line).alias("k1"), F.lead("size").over(line).alias("size1")
    )
    bin_id = F.when((F.col("kind") == 1) & (F.col("k0") == 0), F.col("id0"))
    took = F.when((F.col("kind") == 0) & (F.col("k1") == 1), F.col("size1")).otherwise(0)
    return met.select("kind", "id", "size", "gap", bin_id.alias("bin"), took.alias("took"))


def best_fit(items: DataFrame, capacity: int) -> DataFrame:
    """Sequences for ``items(uid, length)``, lengths 1 to ``capacity``: ``uid, sequence_id, step``.

    Items over half the capacity open a sequence each.  Then sweeps match items to gaps, both by size: each gap (each
    slot of it, while it holds several of the largest item left) takes at most one item per sweep, the smallest gap that holds it.
    Gaps shrink, and the next sweep has what is left.  Before a sweep just as many empty sequences join the gaps as the histograms
    prove to be needed.  The driver sees two histograms of at most ``capacity`` entries per sweep.
    """
    spark = items.sparkSession
    own = items.where(F.col("length") * 2 > capacity)
    placed = [own.select("uid", F.col("uid").alias("sequence_id"), F.lit(0).alias("step"))]
    gaps = own.where(F.col("length") < capacity).select(F.lit(0).alias("kind"), F.col("uid").alias("id"), (F.lit(capacity) - F.col("length")).cast("long").alias("size"))
    state = gaps.union(items.where(F.col("length") * 2 <= capacity).select(F.lit(1), "uid", F.col("length").cast("long")))
    opened, step = 0, 0
    while True:
        hist = {0: {}, 1: {}}
        for r in state.groupBy("kind", "size").count().collect():  # at most two per size
            hist[r["kind"]][r["size"]] = r["count"]
        if not hist[1]:
            break
        step += 1
        least, most = min(hist[1]), max(hist[1])
        room = {size: n for size, n in hist[0].items() if size >= least}
        new = _must_open(hist[1], room, capacity)
        usable = state.where((F.col("kind") == 1) | (F.col("size") >= least))
        if new:
            room[capacity] = room.get(capacity, 0) + new
            usable = usable.union(spark.range(opened, opened + new).select(F.lit(0), -F.col("id") - 1, F.lit(capacity).cast("long")))
            opened += new
        slots = F.when(F.col("kind") == 0, F.greatest(F.lit(1), F.floor(F.col("size") / most))).otherwise(1).cast("int")
        wide = usable.withColumn("slots", slots).withColumn("slot", F.explode(F.sequence(F.lit(1), "slots")))
        wide = wide.select("kind", "id", F.floor(F.col("size") / F.col("slots")).cast("long").alias("size"), "slot", F.col("size").alias("gap"))
        slotted: dict[int, int] = {}
        for size, n in room.items():
            k = max(1, size // most)
            slotted[size // k] = slotted.get(size // k, 0) + n * k
        met = cut(_sweep(wide, hist[1], slotted), "pack")
        placed.append(met.where("kind = 1 AND bin IS NOT NULL").select(F.col("id").alias("uid"), F.col("bin").alias("sequence_id"), F.lit(step).alias("step")))
        left = met.where("kind = 0").groupBy("kind", "id").agg((F.min("gap") - F.sum("took")).alias("size"))
        state = left.where("size > 0").union(met.where("kind = 1 AND bin IS NULL").select("kind", "id", "size"))
    return reduce(DataFrame.union, placed)


def pack(docs: DataFrame, *, capacity: int = 2048, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """All documents in sequences of at most ``capacity`` tokens, one row per piece:
    ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its token ids and a closing 0.  Only longer ones are cut.  Pieces of full length are sequences by
    themselves; the rest are packed by ``best_fit``.  ``offset`` runs gapless from 0 in a sequence.

    Null and empty texts are one closing token.  Repeated rows and ids are packed one by one; a null
    id is kept.  An empty table gives no rows; other columns are not read.
    """
    pieces = cut(token_pieces(docs, capacity, tokenizer).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    bins = best_fit(pieces.select("uid", "length"), capacity).withColumnRenamed("uid", "_uid")
    before = Window.partitionBy("sequence_id").orderBy("step", F.col("length").desc(), "uid").rowsBetween(Window.unboundedPreceding, -1)
    out = pieces.join(bins, F.col("uid") == F.col("_uid"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
