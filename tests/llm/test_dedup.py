import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from condfuse.llm import embeddup, exact, linedup, simhash
from condfuse.llm.common import components
from tests.llm.cases import DOCS, odd_documents, odd_frame, prose, runs_removed, smallest_reachable


# ---------------------------------------------------------------- exact dedup


def squeeze(t):
    return "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")


@pytest.mark.parametrize("content_hash", [F.md5, lambda c: F.substring(F.md5(c), 1, 1), lambda c: F.lit("one")])
def test_exact_against_brute_force(spark, content_hash):
    rows = odd_documents()
    got = exact.exact_dedup(odd_frame(spark), content_hash).collect()
    assert len(got) == len(rows)
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(squeeze(t), []).append((-len(t or ""), d is None, d))
    want = Counter()
    for d, t, *_ in rows:
        g = sorted(groups[squeeze(t)], key=lambda x: (x[0], x[1], x[2] or 0))
        want[(d, g[0][2], len(g), d == g[0][2] and -len(t or "") == g[0][0])] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == want
    assert all(len(r.text_sha256) == 64 for r in got)


def test_exact_empty_table(spark):
    assert exact.exact_dedup(spark.createDataFrame([], DOCS)).count() == 0


# ---------------------------------------------------------------- SimHash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for i in range(64):
            ones[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(shingles))


def test_simhash_against_brute_force(spark):
    rows = [r for r in odd_documents() if r[0] != 205]
    base = prose(99, 400).split()
    for k in range(30):  # a chain of near copies
        base[7 * k % 400] = f"w{k}"
        rows.append((300 + k, " ".join(base), "en", "s", 1))
    got = simhash.simhash_groups(odd_frame(spark, rows)).collect()
    fps = [brute_fingerprint(r[1]) for r in rows]
    low = smallest_reachable([r[0] for r in rows], lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, low, strict=True))
    assert simhash.simhash_groups(spark.createDataFrame([], DOCS)).count() == 0


def test_fingerprint_is_the_same_in_pieces(monkeypatch):
    text = prose(5, 3000)
    monkeypatch.setattr(simhash, "PIECE", 97)
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)
    assert simhash.fingerprint(b"One two") == brute_fingerprint("one  TWO")


def test_masks_cover_every_pair_within_the_radius():
    for radius in (1, 2, 3):
        masks = [m & (1 << 64) - 1 for m in simhash.covering_masks(radius)]
        rng = random.Random(radius)
        for _ in range(3000):
            flips = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(not flips & m for m in masks)


def test_links_in_crowded_buckets(spark, monkeypatch):
    """One ball of words with blocks of 40: all within a few bits of each other, several blocks a bucket."""
    monkeypatch.setattr(simhash, "BLOCK", 40)
    rng = random.Random(3)
    words = {sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(200)}
    words = sorted(w - (1 << 64) if w >> 63 else w for w in words)
    df = spark.createDataFrame([(w,) for w in words], "fp long")
    root = dict(components(simhash.near_links(df)).collect())
    want = smallest_reachable(words, lambda i, j: ((words[i] ^ words[j]) & (1 << 64) - 1).bit_count() <= 3)
    assert [root.get(w, w) for w in words] == want
    assert simhash.near_links(df).count() < 15 * len(words) * 8  # trees, not pairs


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 400)] + [(5, 5)]
    random.Random(1).shuffle(edges)
    root = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {root[k] for k in range(301)} == {0} and {root[1000 + k] for k in range(400)} == {1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- line dedup


def random_blocks(rng, n):
    return [tuple(" ".join(f"w{rng.randint(0, 30)}" for _ in range(rng.choice([0, 1, 4, 9, 30, 60]))) for _ in range(rng.randint(1, 5))) for _ in range(n)]


def test_common_blocks_equal_all_shared_runs():
    rng = random.Random(8)
    for _ in range(300):
        pool = random_blocks(rng, 5)
        texts = {k: "\n".join(x for b in rng.choices(pool, k=rng.randint(1, 6)) for x in (*b, *([f"own {k} {rng.random()}"] if rng.random() < 0.5 else []))) for k in range(2)}
        a, b = (t.split("\n") for t in texts.values())
        wa, wb = ([len(x.split()) for x in t] for t in (a, b))
        gone = linedup.common_blocks([x.encode() + b"\0" for x in a], [x.encode() + b"\0" for x in b], wa, wb, 50)
        kept = "\n".join(x for j, x in enumerate(b) if not any(lo <= j < hi for lo, hi in gone))
        assert kept == runs_removed(texts, 50)[1]


@pytest.mark.parametrize("case", range(6))
def test_long_texts_of_repeated_lines(case):
    """100,000 lines in seconds: one line throughout, blank lines, passages in reverse order."""
    block = [[f"line {i} of block {k} with words" for i in range(8)] for k in range(10_000)]
    flat = lambda q: [x for y in q for x in y]
    a, b, gone = [
        (["two words"] * 100_000, ["two words"] * 100_000, 100_000),
        (["two words"] * 100_000, ["two words"] * 70_000 + ["x"] + ["two words"] * 30_000, 100_000),
        (flat(block), flat(block[::-1]), 80_000),
        ([""] * 90_000 + ["one word"] * 30, ["one word"] * 30 + [""] * 90_000, 30),
        ((["w"] + [""] * 1000) * 90, (["w"] + [""] * 1000) * 90, 90 * 1001),
        (["a b c"] * 20, ["a b c"] * 90_000, 90_000),
    ][case]
    rare = {x.encode() for x in a[:1]}
    began = time.time()
    found = linedup.shared_blocks(*[[x.encode() + b"\0" for x in t] for t in (a, b)], *[[len(x.split()) for x in t] for t in (a, b)], 50, rare)
    assert time.time() - began < 30 and sum(hi - lo for lo, hi in found) == gone


def test_run_keys_are_those_of_the_lines():
    rng = random.Random(3)
    lines = [rng.choice([b"a", b"b", b"", b"ab"]) + b"\0" for _ in range(200)]
    runs = [(lo, lo + n) for lo in range(0, 190, 3) for n in (0, 1, 2, 7)]
    by_key, by_lines = defaultdict(set), defaultdict(set)
    for run, k in zip(runs, linedup.run_keys(lines, runs), strict=True):
        by_key[k].add(run)
        by_lines[tuple(lines[slice(*run)])].add(run)
    assert sorted(map(sorted, by_key.values())) == sorted(map(sorted, by_lines.values()))


def test_line_dedup_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(linedup, "PER_TASK", 3)
    rng = random.Random(4)
    pool = random_blocks(rng, 12)
    rows = []
    for k in range(60):
        lines = [x for b in rng.choices(pool, k=rng.randint(1, 5)) for x in (*b, *([f"own {k} {rng.random()}"] if rng.random() < 0.4 else []))]
        rows.append((k, "\n".join(lines), "en", "s", 1))
    got = {r.doc_id: r for r in linedup.line_dedup(odd_frame(spark, rows)).collect()}
    want = runs_removed({r[0]: r[1] for r in rows}, 50)
    assert {k: r.text for k, r in got.items()} == want
    for k, r in got.items():
        text = rows[k][1]
        assert r.n_lines == len(text.split("\n")) and (r.n_removed > 0) == (r.found_in is not None)
        assert r.words_removed == len(text.split()) - len(want[k].split())
        assert r.found_in is None or max(r.found_in) < k


def test_line_dedup_odd_rows(spark):
    docs = odd_frame(spark)
    got = linedup.line_dedup(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed", "words_removed", "found_in"]
    rows = got.collect()
    assert len(rows) == docs.count()
    assert all(r["row"] == "own row" and r["_id"] == "own _id" for r in rows)
    kept = {(r.doc_id, r.text) for r in rows}
    assert (200, None) in kept and (None, None) in kept and (5, "another text under a used id") in kept
    assert {r.text for r in rows if r.doc_id is not None and 100 <= r.doc_id < 112} == {""}
    assert sum(r.text == odd_documents()[3][1] for r in rows) == 1
    assert linedup.line_dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_rare_lines_broken_up_by_others(spark):
    """Lines of at most 5 documents count together, in any order; every pair that shares them is met."""
    a, b, c, d, e = (prose(900 + k, 60).split("\n") for k in range(5))  # five lines of 12 words each
    mixed = lambda k, lines: "\n".join(x for i, y in enumerate(lines) for x in (y, f"own {k} {i}"))
    texts = {
        1: mixed(1, a), 2: mixed(2, a), 3: mixed(3, a[:4]),  # 3 shares 48 words
        10: mixed(10, b[:2]), 11: mixed(11, b[2:4]), 12: mixed(12, b), 13: mixed(13, b[::-1]),  # 12 is the first holder of b[4] only
        20: "\n".join([*c, "own 20", *d[:2]]), 21: "\n".join([*d[:2], "own 21", *c]),
        30: "\n".join(e), **{40 + k: mixed(40 + k, e) for k in range(5)},  # six holders: not rare
    }
    rows = [(k, t, "en", "s", 1) for k, t in texts.items()]
    rows += [rows[1]] * 6  # a repeated row is one holder
    got = {r.doc_id: (r.text, r.found_in, r.words_removed) for r in linedup.line_dedup(odd_frame(spark, rows)).collect()}
    own = lambda k, n: "\n".join(f"own {k} {i}" for i in range(n))
    want = {k: (t, None, 0) for k, t in texts.items()}
    want[2], want[13], want[21] = (own(2, 5), [1], 60), (own(13, 5), [12], 60), ("own 21", [20], 84)
    assert got == want


# ---------------------------------------------------------------- embeddings


def planted(rng, n, dim):
    x = rng.standard_normal((n, dim))
    for k in range(0, n // 4):  # pairs on both sides of the limit, and two dense balls
        c = rng.uniform(0.86, 0.99)
        u = x[k] / np.linalg.norm(x[k])
        v = rng.standard_normal(dim)
        v -= v @ u * u
        x[n // 2 + k] = rng.uniform(0.1, 9) * (c * u + np.sqrt(1 - c * c) * v / np.linalg.norm(v))
    for k in range(n // 4 * 3, n):
        x[k] = x[k % 2] + 0.2 * rng.standard_normal(dim)
    return x


@pytest.mark.parametrize("block", [4096, 24])
def test_vectors_recall_and_no_false_link(spark, monkeypatch, block):
    monkeypatch.setattr(embeddup, "BLOCK", block)
    rng = np.random.default_rng(5)
    x = planted(rng, 600, 32)
    x[7] = x[3]
    rows = [(k, [float(a) for a in v]) for k, v in enumerate(x)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 32), (1003, [float("nan")] * 32), (1004, [float("inf"), *[1.0] * 31]), (1005, [None, *[1.0] * 31]), (1006, [1.0]), (1007, [2.0]), (None, rows[3][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({c: F.lit(c) for c in ("vec", "n", "low", "cid", "label")})
    got = {r.vec_id: r for r in embeddup.near_vectors(df).collect()}
    assert len(got) == len(rows) + len(odd)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    n = near.sum(1) - 1 + near[:, 3]  # and the row without id, equal to row 3
    found = np.array([got[k].n_links for k in range(len(x))])
    assert (found <= n).all() and found.sum() >= 0.95 * n.sum()
    for k in range(1000, 1006):
        assert got[k].n_links == 0 and got[k].component_id == k and got[k].kept
    assert got[1007].component_id == 1006 and got[1006].n_links == 1  # one direction, two lengths
    assert got[7].component_id == got[3].component_id and got[None].component_id == got[3].component_id and not got[None].kept
    roots = {r.component_id for r in got.values() if r.kept}
    assert roots == {r.component_id for r in got.values()}


def test_vectors_empty_table(spark):
    assert embeddup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_planted_pairs_at_the_limit_are_calibrated():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for count in (256, 4096):
        lines = embeddup.directions(64, count, 11)
        rule = embeddup.calibrate(x, lines, 0.9, 0.97, 11)
        other = embeddup.calibrate(x[:200], lines, 0.9, 0.97, 12)
        assert rule["count"] >= 1 and abs(rule["half"] - other["half"]) < 0.3


def test_vectors_travel_exactly():
    """Single precision where it is exact, double where not, and what is computed from them is the same."""
    rng = np.random.default_rng(5)
    x = np.vstack([rng.standard_normal((3, 8)).astype(np.float32).astype(float), rng.standard_normal((2, 8)), np.full((1, 8), 1e300), np.full((1, 8), 1e-300)])
    raw = embeddup.packed_rows(x)
    assert [len(r) for r in raw] == [32] * 3 + [64] * 4
    assert (embeddup.unpacked_rows(raw, 8) == x).all() and (embeddup.unpacked_rows(raw[:3], 8) == x[:3]).all()
    assert np.allclose(np.linalg.norm(embeddup.unit_rows(x), axis=1), 1)


def test_calibration_that_misses_the_recall_warns():
    x = np.random.default_rng(6).standard_normal((50, 512))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    with pytest.warns(UserWarning, match="fewer than the wanted"):
        embeddup.calibrate(x, embeddup.directions(512, 1 << 13, 11), 0.3, 0.999, 11)


def test_signs_keep_pairs_at_the_limit_and_part_random_ones():
    rng = np.random.default_rng(3)
    for dim in (16, 64, 512):
        x, noise = (embeddup.unit_rows(rng.standard_normal((4000, dim))) for _ in range(2))
        noise = embeddup.unit_rows(noise - (noise * x).sum(1, keepdims=True) * x)
        lines = embeddup.directions(dim, embeddup.SIGNS, 12)
        apart = lambda a, b: np.bitwise_count(embeddup.signs_of(a, lines) ^ embeddup.signs_of(b, lines)).sum(1)
        assert (apart(x, 0.9 * x + np.sqrt(1 - 0.81) * noise) <= embeddup.most_apart(0.9)).mean() > 0.998
        assert (apart(x, noise) > embeddup.most_apart(0.9)).mean() > 0.998
    assert embeddup.most_apart(1.0) == 0 and embeddup.most_apart(-1.0) == embeddup.SIGNS


def test_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    from condfuse.llm.common import shared_dir

    conf = {"spark.master": "spark://host:1"}
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(conf=conf))
    conf["spark.checkpoint.dir"] = "hdfs:///shared/"
    assert shared_dir(SimpleNamespace(conf=conf)) == "hdfs:///shared"
