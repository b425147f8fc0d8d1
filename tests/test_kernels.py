"""Property tests of the per-batch numpy kernels (no Spark)."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from condfuse.operators.scoring import group_sum, list_matrix, rank_matrix
from tests import brute

values = st.one_of(st.floats(-5, 5, allow_nan=False, width=32), st.just(float("nan")),
                   st.sampled_from([0.0, 1.0, -1.0]))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6).flatmap(lambda n: st.lists(st.lists(values, min_size=n, max_size=n), min_size=1, max_size=8)),
       st.sampled_from(["raw", "abs"]))
def test_rank_matrix_matches_brute(rows, order):
    a = np.array(rows, dtype=np.float32)
    assert (rank_matrix(a, order) == brute.ranks(a.astype(float), order)).all()
    n = a.shape[1]
    assert (rank_matrix(a, order).sum(axis=1) == n * (n - 1) // 2).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 5), st.integers(1, 7), st.integers(1, 9), st.data())
def test_group_sum_matches_loop(n_rows, n_cols, n_keys, chunk, data):
    vals = np.array(data.draw(st.lists(st.lists(st.integers(0, 50), min_size=n_cols, max_size=n_cols),
                                       min_size=n_rows, max_size=n_rows)), dtype=np.int32)
    m = data.draw(st.integers(0, 60))
    parent = np.array(data.draw(st.lists(st.integers(0, n_rows - 1), min_size=m, max_size=m)), dtype=np.int64)
    inv = np.array(data.draw(st.lists(st.integers(0, n_keys - 1), min_size=m, max_size=m)), dtype=np.int64)
    want = np.zeros((n_keys, n_cols), dtype=np.int64)
    for p_, k_ in zip(parent, inv):
        want[k_] += vals[p_]
    assert (group_sum(vals, parent, inv, n_keys, chunk=chunk) == want).all()


def test_list_matrix_nulls_and_slices():
    arr = pa.array([[1.0, None, 3.0], [4.0, 5.0, 6.0], [7.0, 8.0, 9.0]], type=pa.list_(pa.float32()))
    m = list_matrix(arr.slice(1, 2))
    assert m.shape == (2, 3) and m[0, 0] == 4.0
    m = list_matrix(arr)
    assert np.isnan(m[0, 1]) and m[2, 2] == 9.0
