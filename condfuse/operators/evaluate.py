"""Test pass: weighted errors of held-out points and the seven report states.

Each usable point (label 0/1, not missing) is a test point of exactly one
fold, and is scored there with two weight vectors: its own class's
(``own``) and the merged one (``merged``). All seven report states are
unions of these results, so the cube is read once for testing.

The weight vectors are bounded by the parameters (#runs x #modes x folds x 3
vectors of n_config x #measures doubles). That size is checked before they
are collected; they then travel with the task, and each Arrow batch does one
matrix product per measure and membership group. ``weighted_errors`` returns
the errors per point; ``error_moments`` adds them up inside the task and
returns a few rows of mergeable moments per task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condfuse._ship import by_value
from condfuse.functions.columns import MEASURES, param_string, weight_cols, weighted_cols
from condfuse.model import ProtocolError
from condfuse.operators.metrics import merge_moments, moment_cols
from condfuse.operators.scoring import list_matrix, memberships

by_value(__import__(__name__, fromlist=["_"]))

# Bytes of weight vectors that may travel with a task; more is an error.
WEIGHT_BYTES = 256 << 20

# Report states fed by each (weights, label) combination.
STATE_MEMBERSHIP: dict[tuple[str, int], tuple[str, ...]] = {
    ("own", 1): ("labelled_aware", "both_aware", "mixed"),
    ("own", 0): ("non_labelled_aware", "both_aware"),
    ("merged", 1): ("labelled_unaware", "both_unaware"),
    ("merged", 0): ("non_labelled_unaware", "mixed", "both_unaware"),
}
REPORT_STATES = ("labelled_aware", "non_labelled_aware", "both_aware", "labelled_unaware",
                 "non_labelled_unaware", "mixed", "both_unaware")
# States kept in the prediction table (the non-overlapping ones).
PREDICTION_STATES: dict[tuple[str, int], str] = {
    ("own", 1): "labelled_aware", ("own", 0): "non_labelled_aware",
    ("merged", 1): "labelled_unaware", ("merged", 0): "non_labelled_unaware",
}
OWN_STATE = {1: "labelled", 0: "non_labelled"}


# ---------------------------------------------------------------- weight vectors

def collect_weights(warrays: DataFrame, n_vectors: int, n_config: int, measures: Sequence[str] = MEASURES,
                    run_cols: Sequence[str] = (), weight_keys: Sequence[str] = ()) -> dict:
    """Weight vectors as {(run..., fold, state): [(extra keys, (n_config, measures) array)]}.

    ``n_vectors`` bounds the rows of ``warrays`` (#runs x #modes x folds x 3,
    known from the parameters); ``ProtocolError`` if the vectors would exceed
    ``WEIGHT_BYTES``. Null weights (nothing to normalise) count as 0.
    """
    size = n_vectors * n_config * len(measures) * 8
    if size > WEIGHT_BYTES:
        raise ProtocolError(f"{n_vectors} weight vectors take {size} bytes, more than {WEIGHT_BYTES}; "
                            "run fewer scenarios, fold counts or modes at once")
    wc = weight_cols(measures)
    keys = [*run_cols, *weight_keys, "fold", "state"]
    tbl = warrays.select(*keys, *wc).toArrow()
    if tbl.num_rows == 0:
        return {}
    mats = np.stack([np.nan_to_num(list_matrix(tbl.column(w)).astype(np.float64), nan=0.0) for w in wc], axis=2)
    kv = {c: tbl.column(c).to_pylist() for c in keys}
    table: dict = {}
    for i in range(tbl.num_rows):
        key = (*[int(kv[c][i]) for c in run_cols], int(kv["fold"][i]), kv["state"][i])
        table.setdefault(key, []).append((tuple(kv[k][i] for k in weight_keys), mats[i]))
    return table


# ---------------------------------------------------------------- test pass

def batch_errors(batch: pa.RecordBatch, table: dict, measures: Sequence[str], fields: Sequence[str]):
    """Weighted errors of one Arrow batch: per membership group the group's
    key, its row numbers and, for each (kind, extra keys), a
    (rows, measures) block. NaN and null products are skipped; 0 when
    nothing is left."""
    parent, keys = memberships(batch, "keys", fields)
    if len(parent) == 0:
        return
    mats = [list_matrix(batch.column(m)) for m in measures]
    uniq, inv = np.unique(keys, axis=0, return_inverse=True)
    inv = inv.reshape(-1)
    for u, key in enumerate(map(tuple, uniq.tolist())):
        run_fold, label = key[:-1], key[-1]
        entries = [("own", *e) for e in table.get((*run_fold, OWN_STATE.get(label)), [])]
        entries += [("merged", *e) for e in table.get((*run_fold, "merged"), [])]
        if not entries:
            continue
        rows = parent[inv == u]
        out = np.empty((len(entries), len(rows), len(measures)))
        for j, mat in enumerate(mats):
            err = mat[rows].astype(np.float64)
            w = np.stack([e[2][:, j] for e in entries], axis=1)  # (n_config, entries)
            out[:, :, j] = (np.where(np.isnan(err), 0.0, err) @ w).T
            odd = ~np.isfinite(err).all(axis=1)
            if odd.any():  # products that may be NaN one by one (NaN or infinite errors)
                out[:, odd, j] = np.nansum(err[odd][None, :, :] * w.T[:, None, :], axis=2)
        yield key, rows, [(kind, extra, out[i]) for i, (kind, extra, _) in enumerate(entries)]


def _key_fields(run_cols: Sequence[str], weight_keys: Sequence[str]) -> list[T.StructField]:
    return ([T.StructField(c, T.IntegerType()) for c in run_cols] + [T.StructField(k, T.StringType()) for k in weight_keys]
            + [T.StructField("fold", T.IntegerType()), T.StructField("label", T.IntegerType()),
               T.StructField("kind", T.StringType())])


def _key_arrays(key: tuple, extra: tuple, kind: str, n: int, n_runs: int) -> list[pa.Array]:
    cols = [pa.array(np.full(n, x, np.int32)) for x in key[:n_runs]] + [pa.array([x] * n, pa.string()) for x in extra]
    return cols + [pa.array(np.full(n, x, np.int32)) for x in key[n_runs:]] + [pa.array([kind] * n, pa.string())]


def weighted_errors(keyed: DataFrame, table: dict, measures: Sequence[str] = MEASURES,
                    run_cols: Sequence[str] = (), weight_keys: Sequence[str] = ()) -> DataFrame:
    """Weighted error of every test point under its own and the merged
    weights: ``(global_index, run..., extra keys, fold, label, kind,
    weighted_err_*)``. ``keyed`` is ``scoring_rows`` output, ``table`` that
    of ``collect_weights``."""
    out = weighted_cols(measures)
    fields = [*run_cols, "fold", "label"]
    schema = T.StructType([T.StructField("global_index", T.LongType()), *_key_fields(run_cols, weight_keys),
                           *[T.StructField(o, T.DoubleType()) for o in out]])

    def fn(batches):
        for b in batches:
            gi = b.column("global_index").to_numpy(zero_copy_only=False)
            for key, rows, blocks in batch_errors(b, table, measures, fields):
                for kind, extra, err in blocks:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(gi[rows]), *_key_arrays(key, extra, kind, len(rows), len(run_cols)),
                         *[pa.array(np.ascontiguousarray(err[:, j])) for j in range(len(out))]], schema.names)

    return keyed.select("global_index", "keys", *measures).mapInArrow(fn, schema)


def add_moments(held: np.ndarray | None, err: np.ndarray) -> np.ndarray:
    """Moments (n, mean, M2, sum of absolute values; one column per measure)
    of ``held`` and the rows of ``err`` together. NaN is skipped."""
    ok = ~np.isnan(err)
    n = ok.sum(0)
    x = np.where(ok, err, 0.0)
    mean = x.sum(0) / np.maximum(n, 1)
    m2 = (np.where(ok, err - mean, 0.0) ** 2).sum(0)
    new = np.stack([n, mean, m2, np.abs(x).sum(0)])
    if held is None:
        return new
    total = held[0] + n
    delta = mean - held[1]
    share = n / np.maximum(total, 1)
    return np.stack([total, held[1] + delta * share, held[2] + m2 + delta * delta * held[0] * share, held[3] + new[3]])


def error_moments(keyed: DataFrame, table: dict, measures: Sequence[str] = MEASURES,
                  run_cols: Sequence[str] = (), weight_keys: Sequence[str] = ()) -> DataFrame:
    """Moments of the weighted errors per (run..., extra keys, fold, label,
    kind): ``n_points`` and for each measure n, mean, M2 and sum of absolute
    values. A task emits one row per group; the rows of all tasks are merged
    on the group key."""
    out = weighted_cols(measures)
    fields = [*run_cols, "fold", "label"]
    names = [c for o in out for c in moment_cols(o)]
    schema = T.StructType([*_key_fields(run_cols, weight_keys), T.StructField("n_points", T.LongType()),
                           *[T.StructField(c, T.DoubleType()) for c in names]])

    def fn(batches):
        held: dict[tuple, list] = {}
        for b in batches:
            for key, rows, blocks in batch_errors(b, table, measures, fields):
                for kind, extra, err in blocks:
                    at = held.setdefault((key, extra, kind), [0, None])
                    at[0] += len(rows)
                    at[1] = add_moments(at[1], err)
        for (key, extra, kind), (n, m) in held.items():
            yield pa.RecordBatch.from_arrays(
                [*_key_arrays(key, extra, kind, 1, len(run_cols)), pa.array([n], pa.int64()),
                 *[pa.array([float(m[i, j])]) for j in range(len(out)) for i in range(4)]], schema.names)

    parts = keyed.select("keys", *measures).mapInArrow(fn, schema)
    return merge_moments(parts, [f.name for f in _key_fields(run_cols, weight_keys)], measures)


# ---------------------------------------------------------------- states and tables

def _by_combination(values: dict):
    expr = None
    for (kind, label), value in values.items():
        cond = (F.col("kind") == kind) & (F.col("label") == label)
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return expr


def report_states(moments: DataFrame, measures: Sequence[str] = MEASURES, keys: Sequence[str] = ("fold",)) -> DataFrame:
    """Moments per report state from the moments per (kind, label): each of
    the four disjoint groups of a run and fold feeds the states it belongs
    to. Works on the small moment table, not on points."""
    states = F.explode(_by_combination({k: F.array(*[F.lit(s) for s in v]) for k, v in STATE_MEMBERSHIP.items()}))
    return merge_moments(moments.withColumn("label_state", states), [*keys, "label_state"], measures)


def prediction_table(pred: DataFrame, measures: Sequence[str] = MEASURES, keys: Sequence[str] = (),
                     params: Sequence[int | str] | None = None) -> DataFrame:
    """Per-point predictions of the four non-overlapping states; ``params``
    (fold count, anomaly method, score method, search mode, top-k mode ids)
    are joined with ``_`` into a ``param_string`` column."""
    state = _by_combination({k: F.lit(v) for k, v in PREDICTION_STATES.items()})
    extra = [param_string(*[F.lit(x) for x in params]).alias("param_string")] if params is not None else []
    return pred.select(F.col("global_index").alias("test_index"), *keys, "fold",
                       state.alias("label_state"), *weighted_cols(measures), *extra)
