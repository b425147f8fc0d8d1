"""Sharding by balanced label propagation, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from condfuse.llm.common import bucketed_rank, cut

IDLE = 2  # rounds without a move after which cut links are released, or the rounds end
RELEASES = 2
BUCKETS = 128  # hash buckets in which a shard's arrivals are counted against its room


def shard_rows(docs: DataFrame, shards: int = 24, *, rounds: int = 24, links: list[str] | None = None, report: list[dict] | None = None) -> DataFrame:
    """Put documents into ``shards`` shards whose row counts differ by one at most (law ``rows``):
    ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Documents with an equal link key are linked: equal texts, and equal values of each column named in
    ``links``.  Linked documents start apart, each where the hash of its row points.  In each round a link counts its
    members by shard (pre-aggregated, so a hot link costs each task a few rows), every linked document adds up the counts of
    its links and wants the shard with most of its neighbours; ties go by the hash of link and shard, so both ends of
    a pair want the same one.  In every other round a small link only looks at shards that would have room for all of it, its
    neighbours' or another one, and a large one at shards with room.  What may move is
    counted by shard left, shard wanted and hash bucket of the unit (the members of a document's largest link or,
    where that is large, a part of them of about a quarter shard); each shard lets in as many buckets as it has room for, counting
    those who leave.  When two rounds move no one, small links
    that are still cut leave their shards and are placed anew as a whole; the second time after that the rounds end.  Then documents without links, and what found no
    shard, fill every shard to its exact quota.

    After the start all documents with the same links, unit and shard want and do the same, so the rounds work on such classes and
    their row counts, in two shuffles for the wishes (three with ``links``) and one for the counts; only a round that moves someone
    writes a table.  With the text as the only link, one
    link has at most ``shards + 1`` classes a unit, however many members.

    ``size`` is the UTF-8 length plus 8, ``slot`` a gapless number inside the shard, ``grown_shard`` null.  A null
    text has size 8 and is linked with nothing, empty texts are equal texts.  Repeated rows are rows like others.
    Null ids are allowed.  An empty table gives no rows; columns not named are not read.  A list given as
    ``report`` gets the linked pairs and those cut, before and after each round.
    """
    body = F.coalesce("text", F.lit(""))
    keys = [F.when(F.col("text").isNotNull(), F.concat(F.lit("text:"), F.md5("text")))]
    keys += [F.concat(F.lit(f"{c}:"), F.md5(F.col(c).cast("string"))) for c in links or []]
    facts = cut(
        docs.select(
            "doc_id", (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.array_compact(F.array(*keys)).alias("keys")
        ).withColumn("row", F.monotonically_increasing_id()),
        "shard-facts",
    )
    total = facts.count()
    room = total // shards
    # links with one member link nothing
    shared = facts.select("row", F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    member = facts.select("row", F.explode("keys").alias("key")).join(cut(shared, "shard-shared"), "key")
    link = F.struct("n", "key")
    linked = member.groupBy("row").agg(F.sort_array(F.collect_list(link)).alias("links")) if links else member.select("row", F.array(link).alias("links"))
    main = linked.select("row", "links", F.array_max("links").alias("m")).select("row", "links", "m.n", "m.key")
    quarters = F.when(F.col("n") * 2 > room, F.ceil(F.col("n") / F.lit(max(1, room))) * 4).otherwise(1)
    unit = F.xxhash64("key", F.pmod(F.xxhash64("row"), quarters))
    apart = main.withColumn("unit", unit).withColumn("want", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    units = cut(apart.withColumn("bucket", F.pmod(F.xxhash64(F.lit(-1), "row"), F.lit(BUCKETS))), "shard-units")
    loads: dict[int, int] = {}
    start = units.withColumns({"shard": F.lit(None).cast("int"), "rows": F.lit(1)})
    start, _ = _moved(start, _counts(start), loads, room, shards)
    start = start.withColumn("start", F.coalesce("shard", F.lit(-1)))
    state = cut(start.groupBy("links", "n", "key", "unit", "start", "shard").agg(F.count(F.lit(1)).alias("rows")), "shard-state")
    if report is not None:
        report.append(cut_pairs(state))
    idle = released = 0
    for k in range(rounds):
        spare = {s: room - loads.get(s, 0) for s in range(shards)}
        # a quarter shard holds any unit; less room is only tried when no shard has that much
        free = sorted((s for s in spare if spare[s] > 0 and spare[s] * 4 >= min(max(spare.values()) * 4, room)), key=lambda s: (-spare[s], s))
        wish = _wishes(state, k, spare, free, room, bool(links))
        counts = _counts(wish)
        if not counts:
            if k % 2 == 0:
                break
            continue
        moved, moves = _moved(wish, counts, loads, room, shards)
        if moves:
            state = cut(moved.select(state.columns), "shard-state")
        if report is not None:
            report.append({"moves": moves, **cut_pairs(state)})
        idle = 0 if moves else idle + 1
        if idle == IDLE and released == RELEASES:
            break
        if idle == IDLE:
            # small links that are still cut leave their shards, and look for one again as a whole
            idle, released = 0, released + 1
            leave = (F.col("n") * 2 <= room) & (F.col("most") < F.col("n"))
            stay = wish.withColumn("shard", F.when(~leave, F.col("shard"))).select(state.columns)
            held = dict(stay.where("shard IS NOT NULL").groupBy("shard").agg(F.sum("rows")).collect())  # one row per shard
            if sum(held.values()) < sum(loads.values()):
                state, loads = cut(stay, "shard-state"), held
    found = start.select("row", "links", "unit", "start").join(state.select("links", "unit", "start", "shard"), ["links", "unit", "start"])
    return _deal(facts, found.select("row", "shard"), loads, total, shards)


def _wishes(state: DataFrame, k: int, spare: dict[int, int], free: list[int], room: int, several: bool) -> DataFrame:
    """``state`` with the shard that each class wants in round ``k`` (null: none), its bucket, and the most members that its main link has in one shard."""
    shards = len(spare)
    near = F.array(*[F.coalesce(F.sum(F.when(F.col("shard") == s, F.col("rows"))), F.lit(0)) for s in range(shards)])
    held = state.withColumn("link", F.explode("links.key"))
    # a link's members by shard, summed up before the shuffle; then each class's neighbours by shard
    seen = held.join(held.groupBy("link").agg(near.alias("near")), "link")
    if several:
        most = F.max(F.when(F.col("link") == F.col("key"), F.array_max("near")))
        seen = seen.groupBy(*state.columns).agg(F.array(*[F.sum(F.col("near")[s]) for s in range(shards)]).alias("near"), most.alias("most"))
    else:
        seen = seen.drop("link").withColumn("most", F.array_max("near"))
    room_at = lambda shard: F.element_at(F.array(*[F.lit(spare[s]) for s in range(shards)]), shard + 1)
    small = F.col("n") * 2 <= room

    def choice(there, to):
        open_ = there > 0
        if k % 2:
            # a small link only looks where all of it would have room, a large one where there is any
            here = to.eqNullSafe(F.col("shard"))
            open_ &= F.when(small, room_at(to) >= F.col("n") - there).otherwise(here | (to.isin(free) if free else F.lit(False)))
        return F.when(open_, F.struct(there.alias("near"), F.xxhash64("key", to).alias("tie"), to.alias("to")))

    want = F.array_max(F.transform("near", choice))["to"]
    if free:
        # without such a shard a unit tries one of the emptier ones
        some = free[: max(1, len(free) // 2)]
        tries = F.element_at(F.array(*[F.lit(s) for s in some]), (F.pmod(F.xxhash64(F.lit(k), F.when(small, F.xxhash64("key")).otherwise(F.col("unit"))), F.lit(len(some))) + 1).cast("int"))
        lost = F.when(small, (F.col("shard").isNull() | F.lit(k % 2 == 1)) & (room_at(tries) >= F.col("n"))).otherwise(F.col("shard").isNull())
        want = F.coalesce(want, F.when(lost, tries))
    return seen.select(*state.columns, "most", want.alias("want"), F.pmod(F.xxhash64(F.lit(k), "unit"), F.lit(BUCKETS)).alias("bucket"))


def cut_pairs(state: DataFrame) -> dict[str, int]:
    """Linked pairs, and those of them that stand in different shards or have no shard yet."""
    spread = state.withColumn("link", F.explode("links.key")).groupBy("link", "shard").agg(F.sum("rows").alias("n"))
    pairs = lambda n: (n * (n - 1) / 2).cast("decimal(38,0)")
    whole = F.when(F.col("shard").isNotNull(), pairs(F.col("n"))).otherwise(F.lit(0).cast("decimal(38,0)"))
    r = spread.groupBy("link").agg(pairs(F.sum("n")).alias("all"), F.sum(whole).alias("whole")).agg(F.sum("all").alias("all"), F.sum("whole").alias("whole")).first()
    return {"pairs": int(r["all"] or 0), "cut": int((r["all"] or 0) - (r["whole"] or 0))}


def _limits(counts: list[tuple[int | None, int, int, int]], loads: dict[int, int], room: int, shards: int) -> tuple[list[int], int]:
    """How many buckets each shard lets in, and the moves that makes.  ``counts`` has the documents that
    want to go (from, to, bucket, n).  Limits only fall: one that lets in too many is lowered, which
    keeps others from leaving, until no shard holds more than ``room``."""
    upto: dict[tuple, list[int]] = {}
    for left, to, bucket, n in counts:
        upto.setdefault((left, to), [0] * (BUCKETS + 1))[bucket + 1] += n
    for sums in upto.values():
        for k in range(BUCKETS):
            sums[k + 1] += sums[k]
    limit, falls = [BUCKETS] * shards, True
    while falls:
        falls = False
        for to in range(shards):
            leaving = sum(sums[limit[t]] for (left, t), sums in upto.items() if left == to)
            spare = room - loads.get(to, 0) + leaving
            arriving = [sums for (_, t), sums in upto.items() if t == to]
            while limit[to] and sum(sums[limit[to]] for sums in arriving) > max(spare, 0):
                limit[to] -= 1
                falls = True
    return limit, sum(sums[limit[to]] for (_, to), sums in upto.items())


_GOES = "want IS NOT NULL AND NOT want <=> shard"


def _counts(wish: DataFrame) -> list[tuple[int | None, int, int, int]]:
    """The documents that want to go: from, to, bucket, how many; at most shards^2 * BUCKETS entries."""
    return [tuple(r) for r in wish.where(_GOES).groupBy("shard", "want", "bucket").agg(F.sum("rows")).collect()]


def _moved(wish: DataFrame, counts: list[tuple[int | None, int, int, int]], loads: dict[int, int], room: int, shards: int) -> tuple[DataFrame, int]:
    """``wish`` with as many of the units in ``counts`` moved as their wished shards let in, and how many rows that are.  ``loads`` is brought up to date."""
    limit, moves = _limits(counts, loads, room, shards)
    for left, to, bucket, n in counts:
        if bucket < limit[to]:
            loads[to] = loads.get(to, 0) + n
            if left is not None:
                loads[left] -= n
    let_in = F.expr(_GOES) & (F.col("bucket") < F.element_at(F.array(*[F.lit(x) for x in limit]), F.col("want") + 1))
    return wish.withColumn("shard", F.when(let_in, F.col("want")).otherwise(F.col("shard"))), moves


def _deal(facts: DataFrame, state: DataFrame, loads: dict[int, int], total: int, shards: int) -> DataFrame:
    """Fill the shards to quotas one apart with the documents not placed yet, and number the slots."""
    ends, end = [], 0
    for s in range(shards):
        end += total // shards + (s < total % shards) - loads.get(s, 0)
        ends.append(end)
    rows = cut(facts.drop("keys").join(state, "row", "left"), "shard-rows")
    spread = F.xxhash64("row")
    loose = bucketed_rank(rows.where("shard IS NULL").drop("shard").withColumn("all", F.lit(0)), ["all"], [spread, F.col("row")], spread, name="place").drop("all")
    pick = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("place")))
    placed = cut(rows.where("shard IS NOT NULL").unionByName(loose.withColumn("shard", pick.cast("int")).drop("place")), "shard-placed")
    out = bucketed_rank(placed, ["shard"], [spread, F.col("row")], spread, name="slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
