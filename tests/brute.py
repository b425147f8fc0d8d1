"""Brute-force loop implementation of the weighting protocol for tiny
inputs (numpy only), used to check the Spark plans."""

from __future__ import annotations

import numpy as np

STATES = {1: "labelled", 0: "non_labelled"}


def ranks(errors: np.ndarray, order: str = "raw") -> np.ndarray:
    """errors (points, configs) -> scores, best config n-1, NaN last, ties by index."""
    n = errors.shape[1]
    out = np.zeros(errors.shape, dtype=np.int64)
    for p in range(errors.shape[0]):
        key = np.abs(errors[p]) if order == "abs" else errors[p]
        idx = sorted(range(n), key=lambda c: (np.isnan(key[c]), 0.0 if np.isnan(key[c]) else key[c], c))
        for pos, c in enumerate(idx):
            out[p, c] = n - 1 - pos
    return out


def weights(sums: np.ndarray, k_keep: int | None, min_zero: bool = True):
    """sums (configs, measures) -> (weights, last_rank positions 0-based)."""
    n, nm = sums.shape
    w = np.full((n, nm), np.nan)
    last_pos = None
    for m in range(nm):
        s = sums[:, m].astype(float).copy()
        if min_zero:
            s -= s.min()
        order = sorted(range(n), key=lambda c: (-s[c], c))
        pos = np.empty(n, dtype=int)
        pos[order] = np.arange(n)
        if k_keep is not None:
            s[pos >= k_keep] = 0
        tot = s.sum()
        if tot != 0:
            w[:, m] = s / tot
        last_pos = pos
    return w, last_pos


def evaluate(errors: dict[int, np.ndarray], labels: dict[int, int], missing: dict[int, int], fold: dict[int, int],
             k: int, k_keep, align: str = "config", order: str = "raw"):
    """errors: gi -> (configs, measures). Returns {(fold, gi, kind): weighted errors array}."""
    usable = [g for g in errors if labels[g] in (0, 1) and missing[g] != 1]
    sc = {g: np.stack([ranks(errors[g][:, m][None, :], order)[0] for m in range(errors[g].shape[1])], axis=1)
          for g in usable}
    out = {}
    for f in range(1, k + 1):
        wts = {}
        for lab in (0, 1):
            tr = [g for g in usable if fold[g] != f and labels[g] == lab]
            if tr:
                wts[lab] = sum(sc[g] for g in tr)
        if not wts:
            continue
        merged = sum(wts.values())
        fitted = {lab: weights(s, k_keep) for lab, s in wts.items()}
        fitted["merged"] = weights(merged, k_keep)
        for g in usable:
            if fold[g] != f:
                continue
            for kind, key in (("own", labels[g]), ("merged", "merged")):
                if key not in fitted:
                    continue
                w, lastpos = fitted[key]
                e = errors[g].astype(float)
                if align == "last_rank":
                    aligned = np.zeros_like(w)
                    for c in range(w.shape[0]):
                        aligned[lastpos[c]] = w[c]
                    w = aligned
                prod = w * e
                out[(f, g, kind)] = np.where(np.isnan(prod), 0.0, prod).sum(axis=0)
    return out


def report(weighted: dict, labels: dict[int, int], k: int):
    """Rows {(fold, state): (n, avg, std, mae)} of the seven states from ``evaluate`` output."""
    parts = {"labelled_aware": [("own", 1)], "non_labelled_aware": [("own", 0)], "both_aware": [("own", 1), ("own", 0)],
             "labelled_unaware": [("merged", 1)], "non_labelled_unaware": [("merged", 0)],
             "both_unaware": [("merged", 1), ("merged", 0)], "mixed": [("own", 1), ("merged", 0)]}
    out = {}
    for f in range(1, k + 1):
        for state, groups in parts.items():
            rows = [v for (ff, g, kind), v in weighted.items() if ff == f and (kind, labels[g]) in groups]
            if rows:
                x = np.stack(rows)
                std = x.std(axis=0, ddof=1) if len(x) > 1 else np.full(x.shape[1], np.nan)
                out[(f, state)] = (len(x), x.mean(axis=0), std, np.abs(x).mean(axis=0))
    return out
