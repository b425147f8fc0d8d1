import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from condfuse.llm import mixing, packing, sharding, warc
from condfuse.llm.common import bucketed_rank
from tests.llm.cases import DOCS, odd_documents, odd_frame, prose

# ---------------------------------------------------------------- mixing


def words(t):
    return len((t or "").encode().split())


def brute_targets(sizes, epochs=3):
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    w = {s: k % 3 + 1 for k, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = [s for s in names if s not in capped]
        share = (total - sum(epochs * sizes[s] for s in capped)) / sum(w[s] for s in rest) if rest else 0
        more = {s for s in rest if w[s] * share > epochs * sizes[s]}
        if not more:
            return {s: epochs * sizes[s] if s in capped else w[s] * share for s in names}
        capped |= more


@pytest.mark.parametrize("per_task", [4096, 5])
def test_mix_against_brute_force(spark, per_task):
    rows = odd_documents()
    labels = spark.createDataFrame([(k, k % 2) for k in range(0, 40, 3)] + [(1, 1), (1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    weights = mixing.quality_weights(labels)
    got = mixing.mix(odd_frame(spark), weights, per_task=per_task).collect()
    again = mixing.mix(odd_frame(spark).repartition(7), weights, per_task=per_task).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert len(got) == len(rows) and Counter((r.doc_id, r.size) for r in got) == Counter((r[0], words(r[1])) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += words(r[1])
    target = brute_targets(dict(sizes))
    weight = {r.doc_id: r.weight for r in weights.collect()}
    by = defaultdict(list)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken == r.size * r.copies <= 3 * r.size
        by[r.source].append(r)
    for s, rs in by.items():
        full = math.floor(target[s] / sizes[s]) if sizes[s] else 0
        assert abs(sum(r.taken for r in rs) - target[s]) <= max(r.size for r in rs) / 2 + 1e-6
        key = {}
        for r in rs:
            h = hashlib.md5(f"7:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:12]
            key[r] = -math.log((int(h, 16) + 0.5) / 2**48) / weight.get(r.doc_id, 1.0)
        order = sorted((r for r in rs if r.size), key=lambda r: (key[r], r.size))
        picks = [r.copies - full for r in order]
        assert set(picks) <= {0, 1} and picks == sorted(picks, reverse=True)  # a prefix in key order


def test_mix_empty_and_wordless(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, None, "a", 1), (2, " ", None, "b", 1)], DOCS)).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


def test_targets_of_many_sources(spark):
    sizes = {f"s{k:03d}": (k * k * 7919) % 1000 + (0 if k % 9 else 90_000) for k in range(120)} | {None: 17}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = brute_targets(sizes)
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(sum(sizes.values()))


# ---------------------------------------------------------------- sharding


def check_rows_law(got, n, shards):
    assert len(got) == n
    count = Counter(r.shard for r in got)
    assert set(count) <= set(range(shards)) and max(count.values()) - min(count.get(s, 0) for s in range(shards)) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_are_even_and_keep_groups(spark):
    rows = odd_documents() + [(1000 + k, prose(k % 30, 9), "en", "s", 1) for k in range(180)]
    rows += [(2000 + k, "hot text", "en", "s", 1) for k in range(300)] + [(3000 + k, f"single {k}", "en", "s", 1) for k in range(900)]
    got = sharding.shard_rows(odd_frame(spark, rows)).collect()
    check_rows_law(got, len(rows), 24)
    text = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == text
    where, size = defaultdict(Counter), Counter(r[1] for r in rows)
    body = {zlib.crc32((r[1] or "").encode()): r[1] for r in rows if r[1] is not None}
    for r in got:
        if r.text_crc32:
            where[body[r.text_crc32]][r.shard] += 1
    room = len(rows) // 24
    for t, c in where.items():
        assert len(c) <= -(-size[t] // room) + (size[t] > room) * 2, (t[:20], c)
    split = sum(len(c) > 1 for t, c in where.items() if 1 < size[t] <= room)
    assert split <= 2


@pytest.mark.parametrize("n,shards", [(0, 24), (5, 24), (24, 24), (49, 24), (100, 7)])
def test_shards_of_few_rows(spark, n, shards):
    df = spark.createDataFrame([(k, f"t{k % 3}", None, None, 1) for k in range(n)], DOCS)
    got = sharding.shard_rows(df, shards).collect()
    if n:
        check_rows_law(got, n, shards)
    assert len(got) == n


def test_shards_follow_links_beside_the_text(spark):
    df = spark.createDataFrame([(k, f"text {k}", None, f"site {k // 6}", 1) for k in range(240)], DOCS)
    got = sharding.shard_rows(df, 8, links=["source"]).collect()
    check_rows_law(got, 240, 8)
    site = defaultdict(set)
    for r in got:
        site[r.doc_id // 6].add(r.shard)
    assert sum(len(s) > 1 for s in site.values()) <= 12  # 40 groups that fill all shards to the brim


def test_rounds_of_propagation_bring_links_together(spark):
    """Documents start apart; the rounds move them, and cut pairs, counted here from the result, fall to those of groups beyond a shard."""
    rows = [(k, f"pair {k // 2}", None, "s", 1) for k in range(200)] + [(1000 + k, f"group {k % 10}", None, "s", 1) for k in range(150)]
    rows += [(3000 + k, f"single {k}", None, "s", 1) for k in range(150)]
    report = []
    got = sharding.shard_rows(spark.createDataFrame(rows, DOCS), 10, report=report).collect()
    check_rows_law(got, len(rows), 10)
    where = defaultdict(Counter)
    for r in got:
        where[rows_by_id(rows)[r.doc_id]][r.shard] += 1
    pairs = lambda n: n * (n - 1) // 2
    every = sum(pairs(sum(c.values())) for c in where.values())
    left = every - sum(pairs(n) for c in where.values() for n in c.values())
    assert report[0]["pairs"] == every == 100 + 10 * pairs(15) and report[0]["cut"] > 0.8 * every
    assert report[1]["moves"] > 100 and report[-1]["cut"] == left <= 15


def rows_by_id(rows):
    return {r[0]: r[1] for r in rows}


def test_shards_full_of_links_still_swap(spark):
    """Every document has a link, so no shard has room: only those who leave make it."""
    rows = [(k, f"trio {k // 3}", None, "s", 1) for k in range(900)]
    report = []
    got = sharding.shard_rows(spark.createDataFrame(rows, DOCS), 6, report=report).collect()
    check_rows_law(got, 900, 6)
    assert report[-1]["cut"] <= 0.25 * report[0]["cut"]


def test_rounds_cost_few_jobs_and_rows(spark, monkeypatch):
    """A round costs a few jobs, and a hot link as many rows as it has units and shards, however many members."""
    rows = [(k, "hot text", None, "s", 1) for k in range(3000)] + [(5000 + k, f"single {k}", None, "s", 1) for k in range(1000)]
    df = spark.createDataFrame(rows, DOCS)
    context = spark.sparkContext

    def jobs(rounds):
        context.setJobGroup(f"shard-rounds-{rounds}", "")
        sharding.shard_rows(df, 8, rounds=rounds)
        context.setLocalProperty("spark.jobGroup.id", None)
        context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return len(context.statusTracker().getJobIdsForGroup(f"shard-rounds-{rounds}"))

    assert jobs(4) - jobs(0) <= 4 * 10
    sizes, keep = [], sharding.cut

    def counted(table, name):
        out = keep(table, name)
        sizes.extend([out.count()] if name == "shard-state" else [])
        return out

    monkeypatch.setattr(sharding, "cut", counted)
    check_rows_law(sharding.shard_rows(df, 8).collect(), 4000, 8)
    units = 3000 // 500 * 4
    assert 0 < max(sizes) <= units * 9


@pytest.mark.parametrize("seed", range(20))
def test_limits_never_overfill(seed):
    rng = np.random.default_rng(seed)
    shards, room = 5, 60
    loads = {s: int(rng.integers(0, room + 1)) for s in range(shards)}
    here = {s: n for s, n in loads.items()}
    counts = []
    for left in [None, *range(shards)]:
        for to in range(shards):
            for bucket in rng.choice(sharding.BUCKETS, 4, replace=False):
                n = int(rng.integers(0, 8))
                if left is None or (left != to and here[left] >= n):
                    if left is not None:
                        here[left] -= n
                    counts.append((left, to, int(bucket), n))
    limit, moves = sharding._limits(counts, loads, room, shards)
    taken = [c for c in counts if c[2] < limit[c[1]]]
    assert moves == sum(n for *_, n in taken)
    for s in range(shards):
        assert loads[s] + sum(n for _, to, _, n in taken if to == s) - sum(n for left, _, _, n in taken if left == s) <= room


def test_rank_does_not_depend_on_the_number_of_buckets(spark):
    df = spark.createDataFrame([(k, "hot" if k % 3 else None) for k in range(1000)], "id long, c string")
    spread = F.xxhash64("id")
    ranks = [{r.id: r.r for r in bucketed_rank(df, ["c"], [spread, F.col("id")], spread, name="r", per_task=n).collect()} for n in (20_000, 50, 3)]
    assert ranks[0] == ranks[1] == ranks[2]


def test_rank_of_a_split_class(spark):
    df = spark.createDataFrame([(k, "hot" if k % 3 else None) for k in range(1000)], "id long, c string")
    got = bucketed_rank(df, ["c"], [F.col("id")], F.xxhash64("id"), name="r", per_task=50).collect()
    by = defaultdict(list)
    for r in got:
        by[r.c].append(r.r)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(got) == 1000


# ---------------------------------------------------------------- packing

FULL = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return np.array([*FULL.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_ids_equal_those_of_tokenizers(monkeypatch):
    texts = [r[1] or "" for r in odd_documents()] + ["end<|endoftext|>of", "<|endoftext|> it's 12345  \n\n x", "a" * 3000, "é" * 999, "don't  stop\t\tnow 你好 \U0001f600"]
    for piece in (1 << 18, 50):
        monkeypatch.setattr(packing, "PIECE", piece)
        for t in texts:
            assert (packing.token_ids(t, "byte_bpe_50k") == ids_of(t)).all()


def check_packing(got, rows, capacity):
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    want, have = Counter(), Counter()
    for d, t, *_ in rows:
        ids = ids_of(t)
        cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
        want.update((d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    have.update((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    assert have == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(r.length for r in got) // capacity)


@pytest.mark.parametrize("per_task", [20_000, 7])
def test_packing(spark, monkeypatch, per_task):
    monkeypatch.setattr(packing, "PER_TASK", per_task)
    rows = odd_documents()
    got = packing.pack(odd_frame(spark), capacity=256).collect()
    used, least = check_packing(got, rows, 256)
    assert used <= least * 1.05 + 2


def test_best_fit_of_given_lengths(spark):
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(1, 101, 900), np.ones(1500, int), np.full(60, 51), rng.choice([1, 2, 40], 800), np.array([100]), np.array([], int)):
        items = spark.createDataFrame([(k, int(n)) for k, n in enumerate(lengths)], "uid long, length long")
        got = packing.best_fit(items, 100).collect()
        assert sorted(r.uid for r in got) == list(range(len(lengths)))
        load = Counter()
        for r in got:
            load[r.sequence_id] += int(lengths[r.uid])
        assert max(load.values(), default=0) <= 100
        # against sequential best-fit decreasing
        gaps = []
        for n in sorted(map(int, lengths), reverse=True):
            fit = min((g for g in gaps if g >= n), default=None)
            if fit is not None:
                gaps.remove(fit)
            gaps.append((100 if fit is None else fit) - n)
        assert len(load) <= len(gaps) * 1.02 + 1


def test_packing_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


# ---------------------------------------------------------------- WARC


def pages():
    same, big = "<p>" + prose(1, 300) + "</p>", "é\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" + prose(2, 30_000)
    rows = [(k, f"http://a/{k}", f"<html>{prose(k, 50 + k)}</html>\n") for k in range(20)]
    rows += [(100 + k, "http://same", same) for k in range(9)] + [(200, "u\r\nx: y", big), (201, None, big), (202, "http://s", "short"), (203, "http://s", "short")]
    rows += [(300, "n", None), (301, "n", ""), (302, "n", "\n"), (303, "n", "\r\n\r\n"), (304, "n", "x\r"), (-5, "neg", same)]
    return rows + [(150, "http://twice", same), (150, "http://twice", same), (None, "none", same), (None, "none", None)]


@pytest.mark.parametrize("segment,chunk", [(65_536, 1 << 20), (1000, 333)])
def test_archive_round_trip(spark, tmp_path, monkeypatch, segment, chunk):
    write, read = warc.write_warc, warc.read_warc
    monkeypatch.setattr(warc, "write_warc", lambda r, p: write(r, p, segment_chars=segment))
    monkeypatch.setattr(warc, "read_warc", lambda s, p: read(s, p, chunk_bytes=chunk))
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").withColumn("payload", F.lit("own")).withColumn("record_id", F.lit(1))
    got = warc.archive_pages(df, f"{tmp_path}/a").collect()
    groups = defaultdict(list)
    for p, _, html in pages():
        groups[html or ""].append(p)
    want = Counter()
    for p, _, html in pages():
        body = (html or "").encode()
        ids = [x for x in groups[html or ""] if x is not None]
        keep = max(ids, default=None) if len(body) >= 1000 and len(groups[html or ""]) > 1 else None
        revisit = keep is not None and p != keep
        want[(p, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", keep if revisit else None)] += 1
    assert Counter(map(tuple, got)) == want
    table = read(spark, f"{tmp_path}/a", chunk_bytes=chunk).collect()
    assert max(len(r.chunk) for r in table) <= chunk
    big = sorted((r for r in table if r.record_id == "urn:page:201"), key=lambda r: r.chunk_no)
    body = next(h for p, _, h in pages() if p == 201).encode()
    assert b"".join(r.chunk for r in big) == body and len(big) > (1 if chunk == 333 else 0)
    sofar = hashlib.sha1()
    for k, r in enumerate(big):
        sofar.update(r.chunk)
        assert r.chunk_no == k and r.sha1_so_far == sofar.hexdigest() and r.last == (k == len(big) - 1)
    assert big[-1].declared_digest == big[-1].sha1_so_far


def test_archive_of_no_pages_and_broken_archive(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_pages(empty, f"{tmp_path}/e").count() == 0
    spark.createDataFrame([("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nContent-Length: 9\r\n\r\nabc",)], "value string").coalesce(1).write.option("compression", "gzip").text(f"{tmp_path}/b")
    with pytest.raises(Exception, match="ends inside a record"):
        warc.read_warc(spark, f"{tmp_path}/b").collect()
