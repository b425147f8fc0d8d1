"""Embedding near-duplicates by counting collisions in sorted one-dimensional projections."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from condfuse.llm.common import components, cut

SAMPLE = 512  # vectors that the collision count is calibrated on
BLOCK = 4096  # rows of one sorted line compared in one task
PAIRS = 1 << 17  # pairs held at once while counting
VALUES = 1 << 22  # projections held at once
SIGNS = 256  # further projections that a pair is counted on by their signs


def directions(dim: int, count: int, seed: int) -> np.ndarray:
    rng, out = np.random.default_rng([seed, dim, count]), np.empty((dim, count), np.float32)
    for row in out:  # one row in double precision at a time
        row[:] = rng.standard_normal(count)
    return out


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def packed_rows(x: np.ndarray) -> list[bytes]:
    """Each vector's bytes, in single precision where that is exact (as the components of a float column are)."""
    with np.errstate(over="ignore"):
        single = x.astype(np.float32)
    exact = (single == x).all(1)
    return [(s if e else v).tobytes() for s, v, e in zip(single, x, exact, strict=True)]


def unpacked_rows(raw: list[bytes], dim: int) -> np.ndarray:
    if all(len(r) == 4 * dim for r in raw):
        return np.frombuffer(b"".join(raw), np.float32).reshape(-1, dim).astype(float)
    return np.stack([np.frombuffer(r, np.float32 if len(r) == 4 * dim else float).astype(float) for r in raw])


def lines_of(unit: np.ndarray, lines: np.ndarray, tops: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``tops`` projections of each vector that are largest in size: line numbers (ascending; a direction has a line for either sign) and
    values."""
    step = max(16, VALUES // lines.shape[1])
    if len(unit) > step:
        parts = [lines_of(unit[at : at + step], lines, tops) for at in range(0, len(unit), step)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    value = unit.astype(np.float32) @ lines
    tops = min(tops, lines.shape[1])
    best = np.argpartition(-np.abs(value), tops - 1, axis=1)[:, :tops]
    got = np.take_along_axis(value, best, 1)
    line = best * 2 + (got < 0)
    order = np.argsort(line, axis=1)
    return np.take_along_axis(line, order, 1).astype(np.int32), np.take_along_axis(np.abs(got), order, 1)


def signs_of(unit: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """The signs of the projections, packed into bytes."""
    return np.packbits(unit.astype(np.float32) @ lines > 0, axis=1)


def most_apart(cosine: float) -> int:
    """How many of ``SIGNS`` signs may differ at ``cosine``: each does with the angle's share of a half turn; four deviations
    above the mean, which one in 30,000 pairs at the limit passes, and fewer of the closer ones."""
    share = float(np.arccos(np.clip(cosine, -1, 1)) / np.pi)
    return int(np.ceil(SIGNS * share + 4 * np.sqrt(SIGNS * share * (1 - share))))


def collisions(la: np.ndarray, va: np.ndarray, lb: np.ndarray, vb: np.ndarray, half: float) -> np.ndarray:
    """For pairs of rows, whether each line of the first collides: shared with the second and inside the window."""
    return ((la[:, :, None] == lb[:, None, :]) & (np.abs(va[:, :, None] - vb[:, None, :]) <= half)).any(2)


def calibrate(sample: np.ndarray, lines: np.ndarray, cosine: float, recall: float, seed: int) -> dict:
    """Lines per vector, window and collision count, from pairs planted at just ``cosine``.

    Each sampled vector gets a partner turned by the limit angle in a random direction.  The window holds 99.5 % of
    their distances on shared lines; the fewest lines are taken with which a count of two (or else one)
    keeps ``recall`` of the pairs.  A warning tells if none does.
    """
    noise = np.random.default_rng([seed, 1]).standard_normal(sample.shape)
    noise -= (noise * sample).sum(1, keepdims=True) * sample
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
    other = cosine * sample + np.sqrt(1 - cosine * cosine) * noise
    for tops in (8, 12, 16, 24, 32, 48):
        (la, va), (lb, vb) = lines_of(sample, lines, tops), lines_of(other, lines, tops)
        same = la[:, :, None] == lb[:, None, :]
        gaps = np.abs(va[:, :, None] - vb[:, None, :])[same]
        half = float(np.quantile(gaps, 0.995)) if len(gaps) else 1.0
        hits = collisions(la, va, lb, vb, half).sum(1)
        for count in (2, 1):
            if (hits >= count).mean() >= recall:
                return {"tops": tops, "half": half, "count": count}
    kept = float((hits >= 1).mean())
    warnings.warn(f"{kept:.3f} of the pairs planted at cosine {cosine} collide on 48 lines, fewer than the wanted {recall}", stacklevel=2)
    return {"tops": 48, "half": half, "count": 1}


def _handled(line, value, signs, own, here: int, i: int, j: int, rule: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one line (sorted by value) that collide often enough, in parts.

    Signs are counted first, as they tell most pairs apart at the least cost.  A pair is counted on all lines of its rows but handled on the first on which it collides, so once.
    """
    half, k = rule["half"], len(line)
    at = np.take_along_axis(value, (line == here).argmax(1)[:, None], 1)[:, 0]
    ends = np.searchsorted(at, at + np.float32(half), side="right")
    reach = ends - np.arange(k) - 1
    done = 0
    while done < k:
        upto = max(done + 1, int(np.searchsorted(np.cumsum(reach[done:]), PAIRS, side="right")) + done)
        first = np.repeat(np.arange(done, upto), reach[done:upto])
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(reach[done:upto]) - reach[done:upto], reach[done:upto])
        done = upto
        if i != j:
            cross = own[first] != own[second]
            first, second = first[cross], second[cross]
        for lo in range(0, len(first), PAIRS):
            a, b = first[lo : lo + PAIRS], second[lo : lo + PAIRS]
            close = np.bitwise_count(signs[a] ^ signs[b]).sum(1) <= rule["apart"]
            a, b = a[close], b[close]
            hit = collisions(line[a], value[a], line[b], value[b], half)
            mine = (hit.sum(1) >= rule["count"]) & (line[a, hit.argmax(1)] == here) & hit.any(1)
            yield a[mine], b[mine]


def _linked(vec, weight, cid, pairs, cosine: float):
    """Links among ``pairs`` of rows: (class, weight of its links) and a tree of links."""
    k = len(cid)
    total, root = np.zeros(k, np.int64), np.arange(k)
    for a, b in pairs:
        near = np.einsum("ij,ij->i", vec[a], vec[b]) >= cosine
        a, b = a[near], b[near]
        np.add.at(total, a, weight[b])
        np.add.at(total, b, weight[a])
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (root[root] != root).any():
                root = root[root]
    moved = np.flatnonzero(root != np.arange(k))
    some = np.flatnonzero(total)
    return (cid[some], total[some]), (cid[moved], cid[root[moved]])


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Runs of rows with equal values in the first ``keys`` columns, two rows or more."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        ks = np.stack([batch.column(c).to_numpy() for c in range(keys)], axis=1)
        cuts = np.flatnonzero((ks[1:] != ks[:-1]).any(1)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(ks)], strict=True):
            if held and not (ks[lo] == key).all():
                if sum(h.num_rows for h in held) > 1:
                    yield key, pa.Table.from_batches(held)
                held = []
            key = ks[lo]
            held.append(batch.slice(lo, hi - lo))
    if held and sum(h.num_rows for h in held) > 1:
        yield key, pa.Table.from_batches(held)


def _flat(t: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(name).to_pylist()), kind).reshape(t.num_rows, -1)


def _usable(vec: Column) -> Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def near_vectors(rows: DataFrame, *, cosine: float = 0.9, recall: float = 0.97, seed: int = 11) -> DataFrame:
    """One row per vector of ``rows(vec_id, embedding)``: ``vec_id, n_links, component_id, kept``.

    Equal vectors (by SHA-256 of their components) are folded to a class first.  Random directions give many sorted
    lines; a vector stands on those where its projection is largest in size, as there the lines are thin, and its window
    on a line holds the rows near its own value.  Pairs are counted over all lines and verified by their cosine in double precision if they
    collide as often as ``calibrate`` asks for the wanted recall, and if the signs of 256 further projections agree as often as
    they do at ``cosine`` (``most_apart``).  A row carries all its lines, so a pair is counted where it meets
    and leaves no row.  That happens twice: first without vectors, which gives the rows of each line that have a pair to verify
    there; only to those the vector is brought, and a task returns links per class and a tree of links.  The number of directions follows
    the number of vectors, so lines stay of one length; a line that is long all the same is split in blocks.

    Vectors that are null, empty, zero or hold null, NaN or infinite components link with nothing.  Vectors of
    different lengths never link.  A null ``vec_id`` counts as a link but is passed over as smallest id.  Repeated
    rows are equal vectors.  An empty table gives no rows; other columns are not read.
    """
    spark = rows.sparkSession
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("vec")).withColumn("vec", F.when(_usable(F.col("vec")), F.col("vec")))
    rows = rows.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))  # no negative zero
    rows = cut(rows.withColumn("key", F.sha2(F.col("vec").cast("string"), 256)).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"), F.min("rid").alias("cid"), F.min(F.size("vec")).alias("dim"))
    classes = cut(classes, "vector-classes")
    total = classes.count()
    # lines of about 64 rows: the directions double as the vectors do
    count = 1 << min(16, max(8, (max(total, 1) // 12).bit_length()))
    rules = {}
    for dim in [r["dim"] for r in classes.select("dim").distinct().collect()]:  # the lengths in use
        taken = classes.where(F.col("dim") == dim).orderBy("key").limit(SAMPLE).select("key", "cid")
        taken = rows.select("rid", "vec").join(F.broadcast(taken), F.col("rid") == F.col("cid")).orderBy("key").select("vec").collect()
        x = np.array([r["vec"] for r in taken], float)
        rules[dim] = calibrate(unit_rows(x), directions(dim, count, seed), cosine, recall, seed) | {"apart": most_apart(cosine)}

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: dict[int, np.ndarray] = {}
        sides: dict[int, np.ndarray] = {}
        step = max(16, VALUES // count)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                vecs = batch.column(0).to_pylist()
                for dim in sorted({len(v) for v in vecs}):
                    if dim not in lines:
                        lines[dim], sides[dim] = directions(dim, count, seed), directions(dim, SIGNS, seed + 1)
                    picked = [k for k, v in enumerate(vecs) if len(v) == dim]
                    x = np.array([vecs[k] for k in picked], float)
                    unit = unit_rows(x)
                    line, value = lines_of(unit, lines[dim], rules[dim]["tops"])
                    tops = line.shape[1]
                    owner, size = np.repeat(np.arange(len(picked)), tops), len(picked)
                    own = [batch.column(c).take(pa.array(picked, pa.int64())) for c in (1, 2)]
                    packed = [[a.tobytes() for a in m] for m in (line, value.astype(np.float32), signs_of(unit, sides[dim]))]
                    at_lines = [pa.array(line.reshape(-1)), pa.array(value.reshape(-1).astype(np.float32)), *(c.take(pa.array(owner)) for c in own)]
                    at_lines += [pa.array([m[o] for o in owner], pa.binary()) for m in packed]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(owner), dim, np.int32)), *at_lines, pa.nulls(len(owner), pa.binary())], spot.names)
                    nothing = [pa.nulls(size, f.type) for f in spot]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(size, dim, np.int32)), *nothing[1:3], own[0], *nothing[4:8], pa.array(packed_rows(x), pa.binary())], spot.names)

    spot = pa.schema([("dim", pa.int32()), ("line", pa.int32()), ("at", pa.float32()), ("cid", pa.int64()), ("n", pa.int64()), ("on", pa.binary()), ("values", pa.binary()), ("signs", pa.binary()), ("vec", pa.binary())])
    # one row per class and line without the vector, and one per class with it
    ones = rows.select("rid", "vec").join(classes.select("cid", "n"), F.col("rid") == F.col("cid")).select("vec", "cid", "n")
    written = cut(ones.mapInArrow(project, "dim int, line int, at float, cid long, n long, on binary, values binary, signs binary, vec binary"), "lines")
    spots, vectors = written.where("line IS NOT NULL").drop("vec"), written.where("line IS NULL").select(F.col("cid").alias("_cid"), "vec")
    long = spots.groupBy("dim", "line").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("nb")).where("nb > 1")
    long = long.select(F.col("dim").alias("_dim"), F.col("line").alias("_line"), "nb")  # at most rows * tops / BLOCK lines
    spots = spots.join(long, (F.col("dim") == F.col("_dim")) & (F.col("line") == F.col("_line")), "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
    spots = spots.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("nb")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    spots = spots.select("dim", "line", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "at", "own", "cid", "n", "on", "values", "signs")
    keys = ["dim", "line", "i", "j"]

    def pairs(key: np.ndarray, t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        dim, here, i, j = (int(v) for v in key)
        return _handled(_flat(t, "on", np.int32), _flat(t, "values", np.float32), _flat(t, "signs", np.uint64), t.column("own").to_numpy(), here, i, j, rules[dim])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, t in _groups(batches, 4):
            paired = np.zeros(t.num_rows, bool)
            for a, b in pairs(key, t):
                paired[a] = paired[b] = True
            if paired.any():
                yield from t.filter(pa.array(paired)).to_batches()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, t in _groups(batches, 4):
            vec = unit_rows(unpacked_rows(t.column("vec").to_pylist(), int(key[0])))
            (a, n), (b, root) = _linked(vec, t.column("n").to_numpy(), t.column("cid").to_numpy(), pairs(key, t), cosine)
            nothing = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())]), pa.concat_arrays([nothing, pa.array(root, pa.int64())]), pa.concat_arrays([pa.array(n, pa.int64()), pa.nulls(len(b), pa.int64())])],
                ["a", "b", "n"],
            )

    order = [*keys, "at", "cid"]
    paired = cut(spots.repartition(*keys).sortWithinPartitions(*order).mapInArrow(meet, spots.schema), "vector-pairs")
    paired = paired.join(vectors, F.col("cid") == F.col("_cid")).drop("_cid")
    found = cut(paired.repartition(*keys).sortWithinPartitions(*order).mapInArrow(verify, "a long, b long, n long"), "vector-links")
    links = found.where("b IS NULL").groupBy(F.col("a").alias("_cid")).agg(F.sum("n").alias("links"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    placed = classes.join(roots, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid")).drop("node")
    least = placed.groupBy("root").agg(F.min("low").alias("component"))
    known = placed.join(links, F.col("cid") == F.col("_cid"), "left").join(least, "root").select(F.col("key").alias("_key"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component")
    out = rows.select("vec_id", "key").join(known, F.col("key") == F.col("_key"), "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
