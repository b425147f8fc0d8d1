"""Per-point rank scores and their sums per training set.

At every point the configs are sorted by error, ascending (signed error by
default, ``abs`` optional); the best config scores n-1, the worst 0. NaN and
null sort last, ties go to the lower config_index.

Two engines compute the ranks:

* ``arrow`` (default): ``mapInArrow`` over the array-form cube; one stable
  numpy argsort per measure and Arrow batch. When ranks are summed, the task
  adds them up per membership key over all its batches and emits one block of
  (#keys x n_config) rows at its end, which is all that reaches the shuffle.
* ``sql``: built-in ``array_sort`` over (nan flag, value, index) structs and a
  second ``array_sort`` to invert the permutation. JVM-only, but about six
  times slower on the sf0.1 stand-in, so it is kept for cross-checks.

A scorer of the user's own can take the place of the rank (``Scorer``): it gets
the errors of one measure, points by configs, and returns a score for each.
Its sums are doubles, added with a carry for the rounding, so they do not
depend on how points are dealt to tasks beyond the last digits.

Training sums use the fold complement: a point's ranks do not depend on the
fold, so the sum over the training set of fold k is the class total minus
the sum over fold k. Every point is ranked once for all folds, instead of
k-1 times.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condfuse.functions.columns import MEASURES, score_cols
from condfuse.model import STATE_MERGED, ProtocolError
from condfuse.operators.points import state_of, usable
from condfuse.sources.binary import CubeFile
from condfuse.sources.cube import BuiltCube
from condfuse.sources.provenance import source_of
from condfuse._ship import by_value


by_value(__import__(__name__, fromlist=["_"]))

# Bytes of score sums one task may hold: #runs x folds x 2 classes x n_config x
# measures x 8 (123 KB for one 3-fold run of 320 configs); more is an error.
TASK_SUM_BYTES = 512 << 20

# (points, configs) errors of one measure, NaN where missing -> scores of that shape.
Scorer = Callable[[np.ndarray], np.ndarray]

# ---------------------------------------------------------------- numpy helpers

def list_matrix(arr: pa.Array) -> np.ndarray:
    """Arrow list<float> column with equal lengths -> (rows, n) float array; nulls become NaN."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    lens = pc.list_value_length(arr).to_numpy(zero_copy_only=False)
    if len(lens) == 0:
        return np.zeros((0, 0), dtype=np.float32)
    if np.any(np.isnan(lens.astype(float))) or lens.min() != lens.max():
        raise ValueError("every cube row needs the same, non-null number of configs per measure")
    vals = arr.flatten().to_numpy(zero_copy_only=False)
    return vals.reshape(len(lens), int(lens[0]))


def rank_matrix(values: np.ndarray, order: str = "raw") -> np.ndarray:
    """(rows, n) errors -> (rows, n) int32 scores, n-1 for the best config."""
    key = np.abs(values) if order == "abs" else values
    idx = np.argsort(key, axis=1, kind="stable")  # NaN last, ties by position
    n = values.shape[1]
    scores = np.empty(idx.shape, dtype=np.int32)
    np.put_along_axis(scores, idx, np.arange(n - 1, -1, -1, dtype=np.int32)[None, :], axis=1)
    return scores


def group_sum(values: np.ndarray, parent: np.ndarray, inv: np.ndarray, n_keys: int, chunk: int = 8192) -> np.ndarray:
    """Sums ``values[parent[i]]`` into row ``inv[i]`` of a (n_keys, n) array,
    of int64 or, for float values, of doubles. Memberships are sorted by key
    and reduced in chunks, so memory stays at ``chunk`` x n however many keys
    or memberships a batch has."""
    kind = np.float64 if values.dtype.kind == "f" else np.int64
    out = np.zeros((n_keys, values.shape[1]), dtype=kind)
    order = np.argsort(inv, kind="stable")
    for s in range(0, len(order), chunk):
        idx = order[s:s + chunk]
        keys = inv[idx]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        out[keys[starts]] += np.add.reduceat(values[parent[idx]].astype(kind), starts, axis=0)
    return out


def scored(values: np.ndarray, order: str, scorer: Scorer | None) -> np.ndarray:
    """Scores of one measure: ranks, or what the scorer makes of the errors."""
    if scorer is None:
        return rank_matrix(values, order)
    out = np.asarray(scorer(np.abs(values) if order == "abs" else values), dtype=np.float64)
    if out.shape != values.shape or not np.isfinite(out).all():
        raise ProtocolError(f"a scorer must return finite scores of shape {values.shape}, not {out.shape}"
                            f" with {int((~np.isfinite(out)).sum())} that are not finite")
    return out


def add_with_carry(total: np.ndarray, carry: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adds ``more`` to ``total``; what rounding loses goes to ``carry``."""
    new = total + more
    lost = np.where(np.abs(total) >= np.abs(more), (total - new) + more, (more - new) + total)
    return new, carry + lost


def memberships(batch: pa.RecordBatch, key_col: str, fields: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row number and int key fields of every membership in an Arrow batch."""
    mem = batch.column(key_col)
    lens = pc.fill_null(pc.list_value_length(mem), 0).to_numpy(zero_copy_only=False)
    parent = np.repeat(np.arange(batch.num_rows), lens)
    if len(parent) == 0:
        return parent, np.zeros((0, len(fields)), np.int64)
    flat = mem.flatten()
    return parent, np.stack([flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields], axis=1)


# ---------------------------------------------------------------- per-point ranks

def _rank_arrays_arrow(cube: DataFrame, measures: Sequence[str], order: str) -> DataFrame:
    scores = score_cols(measures)
    schema = T.StructType([T.StructField("global_index", T.LongType())]
                          + [T.StructField(s, T.ArrayType(T.IntegerType())) for s in scores])

    def fn(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            cols = [b.column("global_index")]
            for m in measures:
                r = rank_matrix(list_matrix(b.column(m)), order)
                n = r.shape[1]
                offsets = pa.array(np.arange(0, (r.shape[0] + 1) * n, n, dtype=np.int32))
                cols.append(pa.ListArray.from_arrays(offsets, pa.array(r.reshape(-1))))
            yield pa.RecordBatch.from_arrays(cols, names=["global_index", *scores])

    return cube.select("global_index", *measures).mapInArrow(fn, schema)


def _sql_rank(c: Column, order: str) -> Column:
    e = F.transform(c, lambda x: F.abs(x)) if order == "abs" else c
    bad = F.transform(e, lambda x: x.isNull() | F.isnan(x))
    val = F.transform(e, lambda x: F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(x.cast("double")))
    idx = F.sequence(F.lit(0), F.size(c) - 1)
    srt = F.array_sort(F.arrays_zip(bad.alias("bad"), val.alias("v"), idx.alias("i")))
    inv = F.array_sort(F.arrays_zip(srt.getField("i").alias("i"),
                                    F.sequence(F.size(c) - 1, F.lit(0), F.lit(-1)).alias("s")))
    return inv.getField("s")


def rank_scores(cube: DataFrame, measures: Sequence[str] = MEASURES, order: str = "raw",
                engine: str = "arrow") -> DataFrame:
    """Array form: ``(global_index, score_* ARRAY<INT>)``, element c = score of config c."""
    if engine == "arrow":
        return _rank_arrays_arrow(cube, measures, order)
    if engine == "sql":
        return cube.select("global_index", *[_sql_rank(F.col(m), order).alias(s)
                                             for m, s in zip(measures, score_cols(measures))])
    raise ValueError(f"unknown engine {engine!r}")


def rank_scores_long(cube: DataFrame, measures: Sequence[str] = MEASURES, order: str = "raw",
                     engine: str = "arrow") -> DataFrame:
    """Long form: ``(global_index, config_index, score_* INT)``."""
    scores = score_cols(measures)
    arr = rank_scores(cube, measures, order, engine)
    z = F.posexplode(F.arrays_zip(*[F.col(s).alias(s) for s in scores]))
    return (arr.select("global_index", z.alias("config_index", "z"))
            .select("global_index", F.col("config_index").cast("int"), *[F.col("z").getField(s).alias(s) for s in scores]))


# ---------------------------------------------------------------- sums per key

def membership_sums(keyed: DataFrame, key_col: str = "keys", measures: Sequence[str] = MEASURES,
                    order: str = "raw", engine: str = "arrow", scorer: Scorer | None = None) -> DataFrame:
    """Sums scores per membership key and config: ranks, or the scores of a ``scorer``.

    ``keyed`` is the array-form cube plus ``key_col``: an array of int structs
    (for example ``(fold, label)`` or ``(run, fold, label)``); a point adds
    its scores to every key it lists. Returns one row per (key fields,
    config_index) with ``n_points`` and ``score_*`` sums, BIGINT for ranks
    and DOUBLE for a scorer.
    """
    if scorer is not None and engine != "arrow":
        raise ValueError("a scorer needs the arrow engine")
    scores = score_cols(measures)
    key_type = keyed.schema[key_col].dataType.elementType
    fields = key_type.fieldNames()
    if engine == "sql":
        ranked = keyed.select(key_col, *[_sql_rank(F.col(m), order).alias(s) for m, s in zip(measures, scores)])
        z = F.posexplode(F.arrays_zip(*[F.col(s).alias(s) for s in scores]))
        long = (ranked.select(F.explode(key_col).alias("k"), *scores)
                .select(*[F.col("k").getField(f).alias(f) for f in fields], z.alias("config_index", "z")))
        return (long.groupBy(*fields, "config_index")
                .agg(F.count(F.lit(1)).alias("n_points"),
                     *[F.sum(F.col("z").getField(s)).cast("bigint").alias(s) for s in scores])
                .withColumn("config_index", F.col("config_index").cast("int")))
    if engine != "arrow":
        raise ValueError(f"unknown engine {engine!r}")

    out_schema = T.StructType(
        [T.StructField(f, T.IntegerType()) for f in fields]
        + [T.StructField("config_index", T.IntegerType()), T.StructField("n_points", T.LongType())]
        + [T.StructField(s, T.LongType() if scorer is None else T.DoubleType()) for s in scores])

    block = pa.schema([(f, pa.int32()) for f in fields] + [("config_index", pa.int32()), ("n_points", pa.int64())]
                      + [(s, pa.int64() if scorer is None else pa.float64()) for s in scores])

    def fn(batches):
        held: dict[tuple, list] = {}  # key -> [points, (measures, n_config) sums, carry of float sums]
        for b in batches:
            parent, keys = memberships(b, key_col, fields)
            if len(parent) == 0:
                continue
            uniq, inv = np.unique(keys, axis=0, return_inverse=True)
            inv = inv.reshape(-1)
            counts = np.bincount(inv, minlength=len(uniq))
            sums = np.stack([group_sum(scored(list_matrix(b.column(m)), order, scorer), parent, inv, len(uniq))
                             for m in measures], axis=1)
            for u, key in enumerate(map(tuple, uniq.tolist())):
                if key not in held:
                    held[key] = [0, np.zeros_like(sums[u]), np.zeros_like(sums[u]) if scorer else 0]
                elif held[key][1].shape != sums[u].shape:
                    raise ValueError("every cube row needs the same number of configs")
                held[key][0] += int(counts[u])
                if scorer:
                    held[key][1:] = add_with_carry(*held[key][1:], sums[u])
                else:
                    held[key][1] += sums[u]
            if len(held) * sums[0].nbytes > TASK_SUM_BYTES:
                raise ProtocolError(f"{len(held)} membership keys in a task; run fewer scenarios or fold counts at once")
        items = list(held.items())
        for at in range(0, len(items), 64):
            part = items[at:at + 64]
            n = part[0][1][1].shape[1]
            cols = [pa.array(np.repeat([k[i] for k, _ in part], n).astype(np.int32)) for i in range(len(fields))]
            cols.append(pa.array(np.tile(np.arange(n, dtype=np.int32), len(part))))
            cols.append(pa.array(np.repeat([v[0] for _, v in part], n).astype(np.int64)))
            cols += [pa.array(np.concatenate([(v[1] + v[2])[j] for _, v in part])) for j in range(len(scores))]
            yield pa.RecordBatch.from_arrays(cols, schema=block)

    partial = keyed.select(key_col, *measures).mapInArrow(fn, out_schema)
    return (partial.groupBy(*fields, "config_index")
            .agg(F.sum("n_points").alias("n_points"), *[F.sum(s).alias(s) for s in scores]))


def index_range(cube: DataFrame, points: DataFrame) -> DataFrame:
    """Cube rows between the first and the last usable point (one small
    aggregate over the narrow point table). The bounds reach the scan, so
    trimmed days are neither read nor shuffled; a read of a cube file becomes
    a narrower read, and of a built cube only these rows are built."""
    r = usable(points).agg(F.min("global_index").alias("lo"), F.max("global_index").alias("hi")).first()
    if r["lo"] is None:
        return cube.limit(0)
    file = source_of(cube)
    if isinstance(file, CubeFile):
        return file.between(r["lo"], r["hi"] + 1).frame(cube.sparkSession)
    if isinstance(file, BuiltCube):
        return file.between(r["lo"], r["hi"]).frame()
    return cube.filter(F.col("global_index").between(r["lo"], r["hi"]))


def membership(points: DataFrame, run_cols: Sequence[str] = (), keys: Column | None = None) -> DataFrame:
    """Usable points with their memberships: ``(global_index, keys)``, ``keys``
    an array of int structs ``(run..., fold, label)``. By default a row has
    the one membership of its columns; ``keys`` gives the array itself. With
    several runs the rows of a point are gathered first (one small shuffle of
    the point table, at most #runs entries per point)."""
    pts = usable(points)
    if keys is None:
        keys = F.array(F.struct(*[F.col(c).cast("int").alias(c) for c in (*run_cols, "fold", "label")]))
    if not run_cols:
        return pts.select("global_index", keys.alias("keys"))
    return (pts.groupBy("global_index", F.xxhash64("global_index").alias("_h"))
            .agg(F.flatten(F.collect_list(keys)).alias("keys")).drop("_h"))


def scoring_rows(cube: DataFrame, points: DataFrame, run_cols: Sequence[str] = (), keys: Column | None = None,
                 measures: Sequence[str] | None = None) -> DataFrame:
    """Cube rows of the points that enter scoring (label 0/1, not missing),
    each with its memberships ``keys = [(run..., fold, label)]`` (see
    ``membership``), so the cube is joined and ranked once for all runs.

    A cube file as ``read_binary_cube`` returns it is read by seeking: only
    the points are shuffled, to ranges of the index, and each task reads
    their blocks (``CubeFile.seek``). A built cube is joined by its narrow rows
    and built behind the join (``BuiltCube.joined``).

    Elsewhere the point side is the build side of a shuffled hash join: the cube is
    only streamed, never sorted or broadcast. A cube in a bucketed table (see
    ``sources.cube.write_cube``) is read in place and only the points are
    shuffled, to its buckets; any other cube is shuffled by its index.
    Memberships are gathered by the index and its hash, a grouping that does
    not serve the join: were the points already grouped by the index alone,
    into more partitions than the cube has buckets, Spark would shuffle the
    cube to them instead.
    """
    mem = membership(points, run_cols, keys)
    file = source_of(cube)
    if isinstance(file, CubeFile):
        return file.seek(mem, measures)
    if isinstance(file, BuiltCube):
        return file.joined(mem, measures)
    return cube.join(mem.hint("shuffle_hash"), "global_index")


def fold_sums(cube: DataFrame, points: DataFrame, measures: Sequence[str] = MEASURES, order: str = "raw",
              run_cols: Sequence[str] = (), engine: str = "arrow", keys: Column | None = None,
              scorer: Scorer | None = None) -> DataFrame:
    """Score sums per (run..., fold, label, config_index) over the points of each fold."""
    return membership_sums(scoring_rows(cube, points, run_cols, keys, measures), "keys", measures, order, engine, scorer)


def check_coverage(sums: DataFrame, points: DataFrame, run_cols: Sequence[str] = (), keys: Column | None = None) -> list:
    """Raises ``ProtocolError`` unless every usable point was ranked exactly once.

    Compares the point counts of ``fold_sums`` with those of the point table,
    per (run, fold, label); the cube is not read again. Fewer ranked points
    mean points without a cube row, more mean repeated cube rows. Returns the
    counts, (run..., fold, label, n) rows bounded by the parameters."""
    by = [*run_cols, "fold", "label"]
    got = sums.filter(F.col("config_index") == 0).select(*by, F.col("n_points").alias("_got"))
    pts = usable(points)
    if keys is None:
        want = pts.select(*[F.col(c).cast("int").alias(c) for c in by])
    else:
        want = pts.select(F.explode(keys).alias("_k")).select(*[F.col(f"_k.{c}").alias(c) for c in by])
    want = want.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    rows = want.join(got, by, "full").select(*by, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("_got", F.lit(0)).alias("_got")).collect()
    if absent := sum(max(r["n"] - r["_got"], 0) for r in rows):
        raise ProtocolError(f"{absent} points have no cube row")
    if extra := sum(max(r["_got"] - r["n"], 0) for r in rows):
        raise ProtocolError(f"{extra} cube rows repeat a point index")
    return rows


def check_covered(cube: DataFrame, points: DataFrame) -> None:
    """Raises ``ProtocolError`` unless every usable point has exactly one cube
    row. Reads the index column of the cube only; nothing of a cube file, where the
    bounds decide."""
    pts = usable(points).select("global_index")
    file = source_of(cube)
    if isinstance(file, CubeFile):
        lo, hi = file.bounds()
        found = pts.select(F.col("global_index").between(lo, hi - 1).cast("long").alias("n"))
    else:
        rows = file.rows if isinstance(file, BuiltCube) else cube
        found = (rows.select("global_index", F.lit(1).alias("_c")).join(pts.distinct(), "global_index", "right")
                 .groupBy("global_index").agg(F.count("_c").alias("n")))
    r = found.agg(F.count_if(F.col("n") == 0).alias("absent"), F.coalesce(F.sum(F.greatest(F.col("n") - 1, F.lit(0))), F.lit(0)).alias("extra")).first()
    if r["absent"]:
        raise ProtocolError(f"{r['absent']} points have no cube row")
    if r["extra"]:
        raise ProtocolError(f"{r['extra']} cube rows repeat a point index")


def train_sums(sums: DataFrame, k: int | DataFrame, measures: Sequence[str] = MEASURES,
               run_cols: Sequence[str] = ()) -> DataFrame:
    """Fold complement: training sums of every fold from per-fold sums.

    ``sums`` is the output of ``fold_sums``; ``k`` is the fold count, or a
    small run table ``(run..., cv_fold_nr)`` when runs differ in fold count.
    Each fold's sums are scattered to the training sets they belong to (every
    other fold, under the own class and under ``merged``) and added up, so
    the small sum table is read once. Returns ``(run..., fold, state,
    config_index, n_points, score_*)`` with states labelled / non_labelled /
    merged; training sets without points have no rows. Inputs and output are
    small (#runs x k x 2 x n_config rows in, k-1 times that before the sum).
    """
    scores = score_cols(measures)
    run_cols = list(run_cols)
    if isinstance(k, int):
        src, kcol = sums, F.lit(k)
    else:
        runs = F.broadcast(k.select(*run_cols, F.col("cv_fold_nr").alias("_k")))
        src, kcol = sums.join(runs, run_cols), F.col("_k")
    others = F.filter(F.sequence(F.lit(1), kcol), lambda f: f != F.col("fold"))
    own = state_of(F.col("label"))
    targets = F.flatten(F.transform(others, lambda f: F.array(
        F.struct(f.alias("tf"), own.alias("state")), F.struct(f.alias("tf"), F.lit(STATE_MERGED).alias("state")))))
    spread = src.select(*run_cols, "config_index", "n_points", *scores, F.explode(targets).alias("_t"))
    return (spread.groupBy(*run_cols, F.col("_t.tf").cast("int").alias("fold"), F.col("_t.state").alias("state"),
                           "config_index")
            .agg(F.sum("n_points").alias("n_points"), *[F.sum(s).cast(sums.schema[s].dataType).alias(s) for s in scores]))
