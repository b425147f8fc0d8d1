"""PCA whitening with an exact integer scatter matrix from bit planes.

Entries become integers; every sum over rows is exact, so neither the order of rows nor a large common
offset touches the result.  A task shifts each dimension by its minimum over all rows, packs each bit
plane of the shifted values over a block of rows into 64-bit words, and adds up weighted popcounts of the
ANDs of two planes: the cross products of the two dimensions.  Only the centred matrix, exact
too, is turned into doubles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from condfuse.llm.common import cut

SCALE, OFFSET = 64, 1_000_000
BLOCK = 4096  # rows whose bits are packed together
_EXACT = 1 << 62


@dataclass(frozen=True)
class Whitening:
    """Fitted on ``n`` different rows: their ``sums`` per dimension, eigenvalues and unit ``components``
    (columns) by falling eigenvalue, ``explained`` shares, and how far the whitened rows are from unit covariance."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None


def usable(vector: Column) -> Column:
    """True for a vector that is not null and holds no null and no non-finite entry."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(math.inf)))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def integers(vector: Column) -> Column:
    """Each entry ``c`` as ``floor(64 * c) + 1000000``; beyond 64-bit integers is an error of the cast."""
    return F.transform(vector, lambda c: F.floor(F.lit(SCALE) * c.cast("double")).cast("long") + F.lit(OFFSET))


def matrix(column: pa.Array) -> np.ndarray:
    """Arrow lists of equal length as rows of a matrix."""
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, len(flat) // rows) if rows else flat.reshape(0, 0)


# ---------------------------------------------------------------- exact scatter


def packed_planes(y: np.ndarray, bits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes of the non-negative ``y`` (rows, dims) as 64-bit words over the rows: (planes, words), and
    the dimension of each plane.  ``bits`` is the number of planes of each dimension, least significant first."""
    rows = -(-len(y) // 64) * 64
    owner = np.repeat(np.arange(y.shape[1]), bits)
    level = np.concatenate([np.arange(b) for b in bits]) if len(owner) else np.zeros(0, int)
    planes = np.zeros((len(owner), rows), np.uint8)
    planes[:, : len(y)] = (y.T[owner] >> level[:, None]) & 1
    return np.packbits(planes, axis=1).view(np.uint64), owner


def cross_products(y: np.ndarray, bits: list[int]) -> np.ndarray:
    """Sums over the rows of ``y[i] * y[j]`` for every pair of dimensions, as 64-bit integers.

    The popcount of the AND of planes p of i and q of j counts the rows where both bits are set; it weighs
    2 to the power p + q.  ``bits`` must leave room: rows times 4 to the power of the bits within 2^62.
    """
    words, owner = packed_planes(y, bits)
    level = np.concatenate([np.arange(b) for b in bits]) if len(owner) else np.zeros(0, int)
    dims = len(bits)
    out = np.zeros((dims, dims), np.int64)
    if not len(owner):
        return out
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    for k in range(len(owner)):
        # planes of the same and later dimensions only: the matrix is symmetric
        low = starts[np.searchsorted(owner[starts], owner[k])]
        counts = np.bitwise_count(words[low:] & words[k]).sum(axis=1, dtype=np.int64) << (level[low:] + level[k])
        out[owner[k], owner[starts[starts >= low]]] += np.add.reduceat(counts, starts[starts >= low] - low)
    return np.triu(out) + np.triu(out, 1).T


def scatter(fit: DataFrame, low: list[int], high: list[int]) -> dict[tuple[int, int], int]:
    """Exact sums of ``(x_i - low_i) (x_j - low_j)`` over the rows of ``fit(x)`` for i <= j.

    A task adds up its blocks and emits one row per pair of dimensions; Spark adds the rows of all tasks.
    The matrix, whose size is the square of the dimension, is all that reaches the driver.
    """
    bits = [(h - a).bit_length() for a, h in zip(low, high, strict=True)]
    wide = max(bits, default=0)
    if 2 * wide + BLOCK.bit_length() > 62:
        raise ValueError(f"a dimension spans {wide} bits; at most {(62 - BLOCK.bit_length()) // 2} can be multiplied")
    first, second = np.triu_indices(len(bits))
    base = np.array(low, np.int64)
    kinds = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("s", pa.decimal128(38, 0))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = None, np.zeros((len(bits), len(bits)), np.int64)
        room = blocks = _EXACT >> (2 * wide + BLOCK.bit_length())  # blocks whose sum surely fits
        for batch in batches:
            x = matrix(batch.column(0)) - base
            for at in range(0, len(x), BLOCK):
                if not blocks:
                    total, held, blocks = held.astype(object) + (0 if total is None else total), np.zeros_like(held), room
                held += cross_products(x[at : at + BLOCK], bits)
                blocks -= 1
        sums = held[first, second].astype(object) + (0 if total is None else total[first, second])
        if any(sums):
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), pa.array(second, pa.int32()), pa.array([int(s) for s in sums], pa.decimal128(38, 0))], schema=kinds)

    rows = fit.select("x").mapInArrow(run, "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    return {(r.i, r.j): int(r.s) for r in rows}


# ---------------------------------------------------------------- fit and apply


def _profile(fit: DataFrame) -> tuple[int, list[int], list[int], list[int]]:
    """Number of rows, and sum, smallest and largest value of each dimension (one row per dimension reaches the driver)."""
    lengths = fit.agg(F.count(F.lit(1)), F.min(F.size("x")), F.max(F.size("x"))).first()
    if lengths[1] != lengths[2]:
        raise ValueError(f"vectors of {lengths[1]} to {lengths[2]} entries have no covariance")
    each = fit.select(F.posexplode("x").alias("i", "x")).groupBy("i")
    rows = each.agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("i").collect()
    return lengths[0], [int(r.s) for r in rows], [r.lo for r in rows], [r.hi for r in rows]


def fit_whitening(fit: DataFrame, components: int = 16) -> Whitening | None:
    """Fit on the rows of ``fit(x)``, which should be a written table of different vectors of integers; None where it is empty."""
    n, sums, low, high = _profile(fit)
    if not n:
        return None
    dims = len(sums)
    sxy = scatter(fit, low, high)
    shifted = [s - n * a for s, a in zip(sums, low, strict=True)]
    centred = np.empty((dims, dims), object)  # n^2 times the covariance, exact
    for i in range(dims):
        for j in range(i, dims):
            centred[i, j] = centred[j, i] = n * sxy.get((i, j), 0) - shifted[i] * shifted[j]
    cov = (centred / (n * n)).astype(np.float64) if dims else np.zeros((0, 0))
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    # the largest entry of a component is positive, so that reruns agree
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(dims)]) if dims else np.ones(0)
    k = min(components, dims)
    trace = float(sum(centred[i, i] for i in range(dims)) / (n * n)) if dims else 0.0
    model = Whitening(n, sums, values[:k].copy(), (vectors * sign)[:, :k].copy(), values[:k] / trace if trace else np.zeros(k))
    flat = values <= max(trace, 0) * dims * np.finfo(float).eps
    model.eigenvalues[flat[:k]] = 0.0  # directions in which the rows do not differ
    return Whitening(model.n, model.sums, model.eigenvalues, model.components, model.explained, _identity_error(fit, model))


def project(x: np.ndarray, model: Whitening) -> np.ndarray:
    """Whitened rows: ``x - S / n`` on the components over the square root of the eigenvalue; NaN where that is zero.
    ``n * x - S`` is exact, so a large common offset costs no digits."""
    root = np.sqrt(np.where(model.eigenvalues > 0, model.eigenvalues, np.nan))
    return (_away(x, model).astype(np.float64) / model.n) @ model.components / root


def _away(x: np.ndarray, model: Whitening) -> np.ndarray:
    """``n * x - S``, in 64-bit integers where they hold it and in Python's otherwise."""
    top = max(model.n * int(np.abs(x).max(initial=0)), max(map(abs, model.sums), default=0))
    kind = np.int64 if top < _EXACT else object
    return model.n * x.astype(kind) - np.array(model.sums, kind)


def _identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest entry of the covariance of the whitened rows of ``fit`` less the identity, over the components
    with an eigenvalue above zero.  Tasks emit the sums of products, Spark adds them up."""
    live = np.flatnonzero(model.eigenvalues > 0)
    first, second = np.triu_indices(len(live))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = np.zeros((len(live), len(live))), np.zeros(len(live))
        for batch in batches:
            if batch.num_rows:
                w = project(matrix(batch.column(0)), model)[:, live]
                total += w.T @ w
                sums += w.sum(axis=0)
        products = [total[first, second], sums]
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[first, np.arange(len(live))], pa.int32()), pa.array(np.r_[second, np.full(len(live), -1)], pa.int32()), pa.array(np.concatenate(products))], ["i", "j", "s"])

    if not len(live):
        return 0.0
    rows = fit.select("x").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    got = {(r.i, r.j): r.s / model.n for r in rows}
    return max(abs(s - got[i, -1] * got[j, -1] - (i == j)) for (i, j), s in got.items() if j >= 0)


def whiten(vectors: DataFrame, components: int = 16) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: one row per usable vector and component.

    ``vectors(vec_id, embedding)``: rows whose vector is null or holds null or non-finite entries are dropped.
    The fit list is each different integer vector once, so copies, however many, weigh one; they are folded per
    task before the shuffle.  ``deviation`` is the exact sum of ``(n * x - S)^2`` and an error where it
    exceeds 64 bits.  Components are numbered from 1 by falling eigenvalue, up to the dimension; equal
    eigenvalues leave the choice of components open.  Where an eigenvalue is zero (fewer different vectors than
    components) ``whitened`` is null, ``explained`` about zero, and ``identity_error`` is that of
    the others.  Repeated rows and ids stay, a null ``vec_id`` stays null, an empty table (or vectors without
    entries) gives no rows, vectors of unequal length are an error; other columns are not read.
    """
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    rows = vectors.select("vec_id", "embedding").where(usable(F.col("embedding"))).select("vec_id", integers(F.col("embedding")).alias("x"))
    model = fit_whitening(cut(rows.select("x").distinct(), "whitening-fit"), components)
    shape = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], shape)
    k = len(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            x = matrix(batch.column(1))
            away = _away(x, model)
            if away.dtype != object and float(np.abs(away).max()) ** 2 * away.shape[1] >= _EXACT:
                away = away.astype(object)
            n = len(x)
            w = project(x, model).ravel()
            yield pa.RecordBatch.from_arrays(
                [pc.take(batch.column(0), pa.array(np.repeat(np.arange(n), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, model.n, np.int64)),
                 pa.array(np.repeat((away * away).sum(axis=1), k).tolist(), pa.int64()), pa.array(w, mask=np.isnan(w)), pa.array(np.tile(model.explained, n)),
                 pa.array(np.full(n * k, model.identity_error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, shape)
