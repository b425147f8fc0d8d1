"""Line deduplication: pairwise patience alignment of documents that share rare lines."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from condfuse.llm.common import SPACE, carried, cut, released

PER_TASK = 64  # later documents that one copy of an earlier document meets
FOLDED = 200_000  # lines whose holders a task folds at a time
PATIENCE = 4  # rounds of patience diff; passages that they leave out of order are taken run by run
_PRIME, _BASE = (1 << 127) - 1, 0x9E3779B97F4A7C15F39CC0605CEDC835 % ((1 << 127) - 1)
_powers = [1]


def spans(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """The shortest runs of lines with ``min_words`` words: one from each line on, one up to each line."""
    ends = np.cumsum([0, *words])
    n, out = len(words), set()
    after = np.searchsorted(ends, ends[:-1] + min_words)  # first end that reaches the words
    before = np.searchsorted(ends, ends[1:] - min_words, side="right") - 1
    for i in range(n):
        if after[i] <= n:
            out.add((i, int(after[i])))
        if before[i] >= 0:
            out.add((int(before[i]), i + 1))
    return sorted(out)


def run_keys(lines: list[bytes], runs: list[tuple[int, int]]) -> list[int]:
    """A 127-bit key for each run (start, end) of lines, equal for equal lines: differences of a rolling sum, so a
    key costs the same however long its run."""
    sums = [0]
    for h in lines:
        sums.append((sums[-1] * _BASE + int.from_bytes(h[:16], "little") + 1) % _PRIME)
    longest = max((hi - lo for lo, hi in runs), default=0)
    while len(_powers) <= longest:
        _powers.append(_powers[-1] * _BASE % _PRIME)
    return [(sums[hi] - sums[lo] * _powers[hi - lo]) % _PRIME for lo, hi in runs]


def heaviest(pairs: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Of ``(i, j, weight)`` the chain that rises in both and weighs most (a Fenwick tree over j)."""
    pairs = sorted(pairs)
    places = {j: k + 1 for k, j in enumerate(sorted({j for _, j, _ in pairs}))}
    tree, best = [(0, -1)] * (len(places) + 1), []
    for at, (_, j, w) in enumerate(pairs):
        k, top = places[j] - 1, (0, -1)
        while k:
            top = max(top, tree[k])
            k -= k & -k
        best.append((top[0] + w, top[1]))
        k = places[j]
        while k < len(tree):
            tree[k] = max(tree[k], (best[at][0], at))
            k += k & -k
    at = max(range(len(best)), key=lambda x: best[x][0], default=-1)
    out = []
    while at >= 0:
        out.append(pairs[at][:2])
        at = best[at][1]
    return out[::-1]


def _anchors(a: list[bytes], b: list[bytes], ia: list[int], ib: list[int], words: list[int]) -> list[tuple[int, int]]:
    """Patience anchors: lines that occur once on both sides; without any, the k-th occurrence meets the k-th."""
    ca, cb = Counter(a[i] for i in ia), Counter(b[j] for j in ib)
    once = {h: i for i in ia if ca[h := a[i]] == 1 and cb[h] == 1}
    if once:
        return heaviest([(once[b[j]], j, words[j] + 1) for j in ib if b[j] in once])
    at = defaultdict(list)
    for i in ia:
        at[a[i]].append(i)
    seen: Counter = Counter()
    pairs = []
    for j in ib:
        if seen[b[j]] < len(at[b[j]]):
            pairs.append((at[b[j]][seen[b[j]]], j, words[j] + 1))
            seen[b[j]] += 1
    return heaviest(pairs)


def _grown(a: list[bytes], b: list[bytes], i: int, j: int) -> tuple[int, int]:
    """The lines of ``b`` around ``j`` that equal those of ``a`` around ``i``."""
    lo, hi = 0, 1
    while i - lo > 0 and j - lo > 0 and a[i - lo - 1] == b[j - lo - 1]:
        lo += 1
    while i + hi < len(a) and j + hi < len(b) and a[i + hi] == b[j + hi]:
        hi += 1
    return j - lo, j + hi


def _merged(blocks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[list[int]] = []
    for lo, hi in sorted(blocks):
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    return [(lo, hi) for lo, hi in merged]


def common_blocks(a: list[bytes], b: list[bytes], words_a: list[int], words_b: list[int], min_words: int) -> list[tuple[int, int]]:
    """Runs of lines of ``b`` (start, end) that stand in ``a`` as well, of ``min_words`` words or more.

    The lines of both that lie in shared runs are aligned by patience diff (the chain of anchors with the
    most words); anchors grow into blocks over equal neighbours.  What is left, such as passages in another order, is aligned
    again, a few times; then each shared run that is left grows by itself.  Work follows the number of lines, also where
    one line repeats throughout.
    """
    at_a = defaultdict(list)
    runs = spans(words_a, min_words)
    for k, run in zip(run_keys(a, runs), runs, strict=True):
        at_a[k].append(run)
    runs = spans(words_b, min_words)
    left = [(*run, k) for k, run in zip(run_keys(b, runs), runs, strict=True) if k in at_a]
    dead = np.zeros(len(b), bool)
    blocks = []

    def take(lo: int, hi: int) -> None:
        dead[lo:hi] = True
        blocks.append((lo, hi))

    for _ in range(PATIENCE):
        if not left:
            break
        in_a, in_b = np.zeros(len(a) + 1, int), np.zeros(len(b) + 1, int)
        for k in {k for *_, k in left}:
            for lo, hi in at_a[k]:
                in_a[lo] += 1
                in_a[hi] -= 1
        for lo, hi, _ in left:
            in_b[lo] += 1
            in_b[hi] -= 1
        ia = np.flatnonzero(np.cumsum(in_a[:-1]) > 0).tolist()
        ib = np.flatnonzero((np.cumsum(in_b[:-1]) > 0) & ~dead).tolist()
        upto = 0
        for i, j in _anchors(a, b, ia, ib, words_b):
            if j >= upto:
                lo, upto = _grown(a, b, i, j)
                if sum(words_b[lo:upto]) >= min_words:
                    take(lo, upto)
        left = _alive(left, dead)
    upto = 0  # runs rise, so lines before the end of the last block taken are dead if the next run starts inside it
    for lo, hi, k in left:
        if hi > upto and not dead[max(lo, upto) : hi].all():
            take(*_grown(a, b, at_a[k][0][0], lo))
            upto = blocks[-1][1]
    return _merged(blocks)


def _alive(runs: list[tuple[int, int, int]], dead: np.ndarray) -> list[tuple[int, int, int]]:
    """The runs with a line that is not dead."""
    gone = np.concatenate([[0], np.cumsum(dead)])
    return [x for x in runs if gone[x[1]] - gone[x[0]] < x[1] - x[0]]


def rare_blocks(a: list[bytes], b: list[bytes], words_b: list[int], rare: set[bytes]) -> list[tuple[int, int]]:
    """Runs of lines of ``b`` (start, end) that stand in ``a`` as well and hold a line of ``rare``, of any length.

    Patience diff over the rare lines chooses the blocks; what it leaves (passages in another order, a
    line that ``b`` has more often) grows from the copy in ``a`` with the same number, or the last one.
    """
    at_a, at_b = defaultdict(list), defaultdict(list)
    for i, h in enumerate(a):
        if h in rare:
            at_a[h].append(i)
    for j, h in enumerate(b):
        if h in at_a:
            at_b[h].append(j)
    ia, ib = sorted(i for x in at_a.values() for i in x), sorted(j for x in at_b.values() for j in x)
    rest = [(at_a[h][min(k, len(at_a[h]) - 1)], j) for h, where in at_b.items() for k, j in enumerate(where)]
    dead = np.zeros(len(b), bool)
    blocks = []
    for i, j in [*_anchors(a, b, ia, ib, words_b), *rest]:
        if not dead[j]:
            lo, hi = _grown(a, b, i, j)
            dead[lo:hi] = True
            blocks.append((lo, hi))
    return _merged(blocks)


def shared_blocks(a: list[bytes], b: list[bytes], words_a: list[int], words_b: list[int], min_words: int, rare: set[bytes]) -> list[tuple[int, int]]:
    """Blocks of ``b`` to delete: unbroken runs of ``min_words`` words, and blocks around rare lines if all have ``min_words`` together."""
    blocks = _merged(common_blocks(a, b, words_a, words_b, min_words) + rare_blocks(a, b, words_b, rare))
    return blocks if sum(sum(words_b[lo:hi]) for lo, hi in blocks) >= min_words else []


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """``doc_id, th, hashes, words, seeds, lines, long``: runs and lines as keys; ``long`` may lose a block."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, counts, seeds, keys, long = [], [], [], [], []
            for raw in batch.column(2):
                lines = raw.as_py().split(b"\n")
                words = [len(x.split()) for x in lines]
                digest = [xxhash.xxh3_128_digest(x) for x in lines]
                found = {(k & ((1 << 64) - 1)) - (1 << 63) for k in run_keys(digest, spans(words, min_words))}
                hashes.append(b"".join(digest))
                counts.append(np.array(words, "<i4").tobytes())
                seeds.append(sorted(found))
                keys.append(sorted({_key(h) for h, w in zip(digest, words, strict=True) if w}))
                long.append(sum(words) >= min_words)
            lists = pa.list_(pa.int64())
            columns = [pa.array(hashes, pa.binary()), pa.array(counts, pa.binary()), pa.array(seeds, lists), pa.array(keys, lists), pa.array(long, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "th", "hashes", "words", "seeds", "lines", "long"])

    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("raw"))
    return rows.mapInArrow(run, f"doc_id {id_type}, th long, hashes binary, words binary, seeds array<long>, lines array<long>, long boolean")


def _align(min_words: int):
    """Rows sorted by (f_id, f_th, salt, tag): an earlier document, then the later ones it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                raw = row["hashes"]
                hashes = [raw[k : k + 16] for k in range(0, len(raw), 16)]
                words = np.frombuffer(row["words"], "<i4").tolist()
                if row["tag"] == 0:
                    first = hashes, words
                    continue
                keys = set(row["rare"])
                rare = {h for h in hashes if _key(h) in keys} if keys else set()
                for lo, hi in shared_blocks(first[0], hashes, first[1], words, min_words, rare):
                    out.append((row["doc_id"], row["th"], row["f_id"], lo, hi, sum(words[lo:hi])))
            kinds = [batch.schema.field("doc_id").type, pa.int64(), batch.schema.field("f_id").type, pa.int32(), pa.int32(), pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "f_id", "lo", "hi", "n_words"])

    return run


def _holders(rare: int):
    """Rows of documents to ``line, n, held``: a line's holders in this task, none and ``rare`` + 1 where they are too many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, found = None, {}

        def folded() -> pa.RecordBatch:
            held = [x if len(x) <= rare else [] for x in found.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([len(x) for x in found.values()], pa.int64()), pa.array(held, kind)], ["line", "n", "held"])

        for batch in batches:
            kind = pa.list_(pa.struct([("doc_id", batch.schema.field("doc_id").type), ("th", pa.int64()), ("long", pa.bool_())]))
            for row in batch.to_pylist():
                who = {k: row[k] for k in ("doc_id", "th", "long")}
                for line in row["lines"]:
                    x = found.setdefault(line, [])
                    if len(x) <= rare:
                        x.append(who)
            if len(found) > FOLDED:
                yield folded()
                found.clear()
        if found:
            yield folded()

    return run


def _rare_pairs(facts: DataFrame, rare: int) -> DataFrame:
    """``doc_id, th, f_id, f_th, line`` for each rare line and each two documents that have it."""
    held = facts.select("doc_id", "th", "long", "lines")
    if not facts.groupBy("doc_id", "th").count().where("count > 1").isEmpty():
        held = held.dropDuplicates(["doc_id", "th"])  # a repeated row is one holder
    id_type = facts.schema["doc_id"].dataType.simpleString()
    held = cut(held.mapInArrow(_holders(rare), f"line long, n long, held array<struct<doc_id:{id_type},th:bigint,long:boolean>>"), "line-holders")
    # counted first: only the holders of rare lines, at most ``rare`` of each, are gathered
    counts = held.groupBy("line").agg(F.sum("n").alias("n")).where(F.col("n").between(2, rare)).select(F.col("line").alias("_line"))
    held = held.where(F.col("n") <= rare).join(counts, F.col("line") == F.col("_line"), "left_semi").groupBy("line").agg(F.flatten(F.collect_list("held")).alias("all"))
    late = held.select("line", "all", F.explode("all").alias("b")).where("b.long")
    early = late.select("line", "b", F.explode(F.filter("all", lambda f: f["doc_id"] < F.col("b.doc_id"))).alias("f"))
    return early.select("b.doc_id", "b.th", F.col("f.doc_id").alias("f_id"), F.col("f.th").alias("f_th"), "line")


def common_lines(docs: DataFrame, min_words: int = 50, rare: int = 5) -> DataFrame:
    """The blocks to delete: ``doc_id, th, f_id, lo, hi, n_words``, one row per block and earlier document.

    Documents are paired by two keys.  A line that at most ``rare`` documents have (counted over all of them, with
    map-side folding) pairs all its holders, so a pair that shares rare lines is never missed.  A run of lines with ``min_words``
    words, held by any number of documents, pairs every later document with the first one (smallest id) that has it:
    one pair per document and run, and each run it shares is in the document it is paired with.
    Pairs are folded, then aligned; an early document with many partners goes to several tasks.
    """
    facts = cut(_lines(docs, min_words), "lines")
    seeds = facts.select("doc_id", "th", F.explode("seeds").alias("seed"))
    first = seeds.groupBy("seed").agg(F.min(F.struct("doc_id", "th")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("seed").alias("_seed"), F.col("f.doc_id").alias("f_id"), F.col("f.th").alias("f_th"))
    pairs = seeds.join(first, F.col("seed") == F.col("_seed")).where("doc_id > f_id").select("doc_id", "th", "f_id", "f_th").distinct()
    pairs = pairs.withColumn("line", F.lit(None).cast("long")).union(_rare_pairs(facts, rare))
    pairs = pairs.groupBy("doc_id", "th", "f_id", "f_th").agg(F.collect_set("line").alias("rare"))
    pairs = cut(pairs, "line-pairs")
    groups = pairs.groupBy("f_id", "f_th").agg(F.ceil(F.count(F.lit(1)) / F.lit(PER_TASK)).cast("int").alias("nb"))
    known = facts.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "hashes", "words")
    early = groups.join(known, (F.col("f_id") == F.col("_id")) & (F.col("f_th") == F.col("_th"))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    early = early.select("f_id", "f_th", "salt", F.lit(0).alias("tag"), F.col("_id").alias("doc_id"), F.col("_th").alias("th"), "hashes", "words", F.array().cast("array<long>").alias("rare"))
    g = groups.select(F.col("f_id").alias("g_id"), F.col("f_th").alias("g_th"), "nb")
    late = pairs.join(g, (F.col("f_id") == F.col("g_id")) & (F.col("f_th") == F.col("g_th"))).withColumn("salt", F.pmod(F.xxhash64("doc_id", "th"), F.col("nb")).cast("int"))
    late = late.join(known, (F.col("doc_id") == F.col("_id")) & (F.col("th") == F.col("_th"))).select("f_id", "f_th", "salt", F.lit(1).alias("tag"), "doc_id", "th", "hashes", "words", "rare")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    keys = ["f_id", "f_th", "salt"]
    meet = early.union(late).repartition(*keys).sortWithinPartitions(*keys, "tag")
    return meet.mapInArrow(_align(min_words), f"doc_id {id_type}, th long, f_id {id_type}, lo int, hi int, n_words long")


def line_dedup(docs: DataFrame, min_words: int = 50, rare: int = 5) -> DataFrame:
    """``docs`` with the text less its blocks, and ``n_lines, n_removed, words_removed, found_in``.

    A block is a run of whole lines that an earlier document (smaller ``doc_id``) has in the same form and that has
    ``min_words`` words or more, or a line that at most ``rare`` documents have.  The blocks with rare lines go if all blocks of
    the two documents have ``min_words`` words together, a long run always; they go from the later document.  Other lines keep their order; a text that loses every line is empty.
    ``found_in`` lists the earlier documents (null where nothing was removed).  The first holder of a block
    always keeps it.

    Null texts and rows without id pass unchanged (``n_lines`` 0 for null).  Rows that repeat an id are not compared
    with each other.  An empty table gives no rows; columns with the names of the new ones are replaced.
    """
    new = ["n_lines", "n_removed", "words_removed", "found_in"]
    docs = docs.drop(*new)
    # blocks of two early documents may overlap; a line is in any of them or in none
    gone = common_lines(docs, min_words, rare).groupBy("doc_id", "th").agg(
        F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("runs"), F.array_sort(F.collect_set("f_id")).alias("found_in")
    )
    text = F.col("row.text")
    rows = carried(docs).withColumn("h", F.xxhash64(text)).join(gone, (F.col("row.doc_id") == F.col("doc_id")) & (F.col("h") == F.col("th")), "left")
    lines = F.split(text, "\n", -1)
    dead = lambda i: F.exists("runs", lambda r: (r["lo"] <= i) & (i < r["hi"]))
    kept = F.array_join(F.filter(lines, lambda _, i: ~dead(i)), "\n")
    lost = F.filter(lines, lambda _, i: dead(i))
    some = F.col("runs").isNotNull()
    found = [
        F.when(some, kept).otherwise(text).alias("text"),
        F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"),
        F.when(some, F.size(lost)).otherwise(0).alias("n_removed"),
        F.when(some, F.regexp_count(F.array_join(lost, "\n"), F.lit(f"[^{SPACE}]+"))).otherwise(0).alias("words_removed"),
        F.col("found_in"),
    ]
    rows = rows.select("row", F.struct(*found).alias("new"))
    return released(rows, [*docs.columns, *new], **{c: F.col(f"new.{c}") for c in ("text", *new)})
