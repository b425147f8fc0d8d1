"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from condfuse.llm.common import SPACE, cut

#: Weight of a document by its quality label; unlabelled ones weigh 1.
QUALITY_WEIGHT = {1: 2.0, 0: 0.5}


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def quality_weights(labels: DataFrame) -> DataFrame:
    """``labels(doc_id, quality)`` as ``(doc_id, weight)``, one row per id.  Repeated labels are
    averaged before the lookup; an unknown quality weighs 1."""
    known = F.create_map(*[F.lit(x) for kv in QUALITY_WEIGHT.items() for x in kv])
    quality = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("q"))
    return quality.select("doc_id", F.coalesce(F.try_element_at(known, F.col("q")), F.lit(1.0)).alias("weight"))


def source_targets(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), epochs: int = 3) -> DataFrame:
    """Add ``target`` to ``sources(source, source_size, ...)``, one row per source.

    Sources in code-point order (null last) get the weights of ``cycle`` in turn and share the sum of
    all sizes; a target stops at ``epochs`` times its source's size and what is over goes to the
    others by weight until none is above.  The share per weight is found by rounds of two sums, so the
    sources are never gathered; their position comes from a distributed sort and per-partition counts.
    """
    order = F.col("source").asc_nulls_last()
    ranked = cut(sources.orderBy(order).withColumn("_id", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("_id", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per sort partition
    starts = ranked.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in cycle]), (F.pmod(place, F.lit(len(cycle))) + 1).cast("int"))
    ranked = cut(ranked.join(F.broadcast(starts), part == F.col("_part")).withColumn("_w", weight).withColumn("_cap", F.lit(epochs) * F.col("source_size")), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    share, full = 0.0, -1
    while True:
        over = F.col("_cap") < F.col("_w") * share
        row = ranked.agg(F.count_if(over), F.sum(F.when(over, F.col("_cap"))), F.sum(F.when(~over, F.col("_w")))).first()
        if row[0] == full or not row[2]:
            break
        full, share = row[0], (total - (row[1] or 0)) / row[2]
    target = F.least(F.col("_cap").cast("double"), F.col("_w") * F.lit(float(share)))
    return ranked.withColumn("target", target).drop("_id", "_part", "_start", "_w", "_cap")


def uniform(doc_id: Column, seed: int) -> Column:
    """A number inside (0, 1) from the id alone, so that reruns and retried tasks agree."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 48))


def mix(docs: DataFrame, weights: DataFrame | None = None, *, seed: int = 7, cycle: tuple[int, ...] = (1, 2, 3), epochs: int = 3, per_task: int = 1024) -> DataFrame:
    """How often the mix takes each document: ``doc_id, source, text_hash, size, source_size, target, copies, taken``.

    ``size`` is the number of words.  A source is first taken in as many complete epochs as its target
    holds.  The rest goes to its documents in the order of the keys ``-ln(u) / weight`` (``u`` uniform
    from id and ``seed``, ``weights(doc_id, weight)``, 1 where missing): the document that crosses the
    budget is taken if more than half of it fits, so a source ends within half a document of its
    target.  Documents are taken whole.  ``taken`` is ``size * copies`` and at most ``epochs`` times the size.

    A hot source is split: keys fall into buckets of about ``per_task`` rows, bucket sums give the prefix
    at each bucket, and only the bucket in which the budget ends is sorted.  Null text counts no words
    and a null source is a source.  Equal ids share a key; they are then ordered by size, text hash
    and row copies are taken in any order, being equal.  An empty table gives no rows.
    """
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), word_count(F.col("text")).alias("size"))
    if weights is None:
        rows = rows.withColumn("weight", F.lit(1.0))
    else:
        w = weights.select(F.col("doc_id").alias("_w_id"), F.col("weight").alias("weight"))
        rows = rows.join(w, F.col("doc_id") == F.col("_w_id"), "left").drop("_w_id").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    rows = cut(rows.withColumn("key", -F.ln(uniform(F.col("doc_id"), seed)) / F.col("weight")), "mix")
    buckets = max(1, -(-rows.count() // per_task))
    # 1 - exp(-key) spreads the keys over (0, 1) and keeps their order
    rows = rows.withColumn("bucket", F.floor(F.lit(buckets) * (1 - F.exp(-F.col("key")))))
    sums = cut(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), cycle, epochs)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    t = targets.select(F.col("source").alias("_source"), "source_size", "target")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = (
        sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .join(t, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("full", full.cast("long"))
        .withColumn("budget", F.col("target") - F.col("full") * F.col("source_size"))
        .select("_source", F.col("bucket").alias("_bucket"), "words", "before", "source_size", "target", "full", "budget")
    )
    found = rows.join(plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    inside = (F.col("before") < F.col("budget")) & (F.col("before") + F.col("words") > F.col("budget"))
    by_key = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    edge = found.where(inside).withColumn("middle", F.col("before") + F.sum("size").over(by_key) - F.col("size") / 2)
    rest = found.where(~inside).withColumn("middle", F.col("before").cast("double"))
    picked = edge.union(rest).withColumn("copies", F.col("full") + (F.col("middle") < F.col("budget")).cast("long"))
    return picked.select("doc_id", "source", "text_hash", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("copies")).otherwise(F.greatest("full", F.lit(0))).alias("copies")).withColumn(
        "taken", F.col("size") * F.col("copies")
    )
