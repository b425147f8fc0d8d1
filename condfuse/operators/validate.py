"""Input validation: cube shape, point coverage, class sizes.

Parameter checks are driver-side (``Protocol``). A run validates its inputs
in passing (``CubeWatch``, ``class_notes``): the ranking pass counts the
cube rows it reads, and its score sums tell which points were covered, so the
cube is not read again. ``validate_inputs`` looks at the inputs before a run, at
the price of a scan of the cube.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from dataclasses import replace

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from condfuse.functions.columns import MEASURES
from condfuse.model import Protocol, ProtocolError, ProtocolWarning
from condfuse.operators.folds import class_fold_check, class_sizes_warnings, empty_set_warnings
from condfuse.operators.points import index_gaps
from condfuse.sources.binary import CubeFile
from condfuse.sources.cube import BuiltCube, cube_stats, row_sizes
from condfuse.sources.provenance import source_of


def warn(text: str) -> None:
    warnings.warn(text, ProtocolWarning, stacklevel=3)


class CubeWatch:
    """Counts the cube rows of one scan while another job reads them.

    ``on(cube)`` adds the counters to the scan; after the job ``notes`` says
    what they found: indexes without a row, repeated ones, configs of
    unequal number (a ``ProtocolError``). A cube file needs no counters, as its
    length fixes all of that; of a built cube the narrow rows are counted.
    """

    def __init__(self, measures: Sequence[str] = MEASURES):
        self.measures, self.seen = measures, None

    def on(self, cube: DataFrame) -> DataFrame:
        source = source_of(cube)
        if isinstance(source, CubeFile):
            return cube
        self.seen = Observation()
        if isinstance(source, BuiltCube):
            return replace(source, rows=self._observed(source.rows, F.lit(source.n_config), F.lit(source.n_config))).frame()
        return self._observed(cube, *row_sizes(self.measures))

    def _observed(self, rows: DataFrame, least: Column, most: Column) -> DataFrame:
        return rows.observe(self.seen, F.count(F.lit(1)).alias("n"), F.min("global_index").alias("lo"),
                            F.max("global_index").alias("hi"), F.min(least).alias("least"), F.max(most).alias("most"))

    def _counts(self) -> dict | None:
        try:
            self.seen._jo.getOrEmpty()  # get alone would wait for ever where the scan was optimised away
        except (AttributeError, Py4JError):
            return None
        return self.seen.get

    def notes(self) -> list[str]:
        got = self._counts() if self.seen is not None else None
        if not got or not got["n"]:
            return []
        if got["least"] != got["most"]:
            raise ProtocolError(f"config counts differ between rows/measures: {got['least']}..{got['most']}")
        width = got["hi"] - got["lo"] + 1
        if got["n"] < width:
            return [f"the cube index has gaps: {width - got['n']} or more of {got['lo']}..{got['hi']} have no row"]
        return [f"the cube repeats {got['n'] - width} or more indexes of {got['lo']}..{got['hi']}"] if got["n"] > width else []


def class_notes(counts: Sequence[Row], run_cols: Sequence[str], k_of: Callable[[Row], int]) -> list[str]:
    """Class sizes of every run from the point counts per (run..., fold, label):
    ``ProtocolError`` where the fold count exceeds every class; small
    classes and empty test or training sets are returned as notes."""
    runs: dict[tuple, dict] = {}
    for r in counts:
        classes = runs.setdefault(tuple(r[c] for c in run_cols), {"k": k_of(r), "n": {}})["n"]
        classes.setdefault(r["label"], []).append(r["n"])
    out = []
    for run, found in sorted(runs.items()):
        k, sizes = found["k"], {label: [n for n in ns if n] for label, ns in found["n"].items()}
        totals = [sum(ns) for ns in sizes.values()]
        notes = class_sizes_warnings(k, min(totals), max(totals))
        for label, ns in sorted(sizes.items()):
            notes += empty_set_warnings(label, len(ns), k)
        out += [f"run {run}: {text}" if run else text for text in notes]
    return out


def input_profile(cube: DataFrame, points: DataFrame, measures=MEASURES) -> DataFrame:
    """One row: ``cube_stats`` and the points without a cube row (``n_uncovered``)."""
    uncovered = points.select("global_index").join(cube.select("global_index"), "global_index", "left_anti")
    lost = uncovered.agg(F.count(F.lit(1)).alias("n_uncovered")).scalar()
    return cube_stats(cube, measures).withColumn("n_uncovered", lost)


def validate_inputs(cube: DataFrame, points: DataFrame, p: Protocol, min_points: int | None = None) -> list[str]:
    """Raises ``ProtocolError`` on unusable inputs; returns warnings.

    Errors: an empty cube, repeated indexes, measures of unequal length,
    fewer points than ``min_points``, points without cube rows, k above every
    class size. Warnings: index gaps (the first is named), small classes.
    """
    warnings: list[str] = []
    s = input_profile(cube, points, p.measures).first()
    if s["n_points"] == 0:
        raise ProtocolError("the cube is empty")
    if s["n_distinct"] != s["n_points"]:
        raise ProtocolError(f"the cube has {s['n_points'] - s['n_distinct']} duplicate point indexes")
    if s["min_configs"] != s["max_configs"]:
        raise ProtocolError(f"config counts differ between rows/measures: {s['min_configs']}..{s['max_configs']}")
    if s["n_points"] != s["max_index"] - s["min_index"] + 1:
        gap = index_gaps(cube, s["min_index"], s["max_index"] + 1).agg(F.min("global_index")).first()[0]
        warnings.append(f"the cube index has gaps, the first at {gap}")
    if min_points is not None and s["n_points"] < min_points:
        raise ProtocolError(f"the cube has {s['n_points']} points, fewer than {min_points}")
    if s["n_uncovered"]:
        raise ProtocolError(f"{s['n_uncovered']} points have no cube row")
    warnings += class_fold_check(points.filter(F.col("label").isNotNull()), p.folds)
    return warnings
