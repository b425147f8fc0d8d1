"""Sinks: written score sums with a read-through cache, report writers.

Paths are folders on the cluster's shared storage; nothing is written to
executor-local disks.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from condfuse.model import ProtocolError
from condfuse.session import shared_dir
from condfuse.sources.provenance import digest, file_state, identity


def cache_key(params: dict, inputs: Sequence[DataFrame], sources: Sequence[str] = ()) -> str:
    """Folder name for cached sums: the parameters and the content of every
    input. An input that a reader of this package returned as it stands is
    known by its files (names, sizes, times) or its table version; any other,
    for example in-memory rows or a derived cube, by a checksum of its rows,
    which takes one pass over it. ``sources`` adds files that Spark does not
    list itself. Neither plans nor names of variables matter."""
    parts = [identity(df) for df in inputs]
    if sources:
        parts.append(file_state(inputs[0].sparkSession, sources))
    return digest({"params": params, "inputs": parts})


MANIFEST = "manifest"


def materialize(build: Callable[[], DataFrame], cache: str | None = None, params: dict | None = None,
                inputs: Sequence[DataFrame] = (), sources: Sequence[str] = ()) -> DataFrame:
    """Writes the (small) table of ``build`` to shared storage and reads it
    back, which also cuts the lineage: later jobs do not repeat the work
    behind it, also after an executor loss.

    With ``cache`` the table is looked up first. It is written to a fresh
    folder, and only then named in the one-row ``current`` table of its key;
    a folder that no ``current`` names (a job that failed half-way) is never
    read.
    """
    if cache is None:
        df = build()
        path = f"{shared_dir(df.sparkSession)}/condfuse/table-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)
    spark = inputs[0].sparkSession
    base = f"{cache.rstrip('/')}/{cache_key(params or {}, inputs, sources)}"
    try:
        return spark.read.parquet(spark.read.parquet(f"{base}/current").first()["path"])
    except AnalysisException:
        pass
    path = f"{base}/{uuid.uuid4().hex}"
    build().write.parquet(path)
    spark.createDataFrame([(path,)], "path string").coalesce(1).write.mode("overwrite").parquet(f"{base}/current")
    return spark.read.parquet(path)


def run_name(params: Sequence[int | float | str], started: datetime | None = None) -> str:
    """Folder name of one run's outputs: parameters and UTC start time."""
    when = (started or datetime.now(timezone.utc)).strftime("%Y%m%dT%H%M%SZ")
    return f"run-{'-'.join(str(p) for p in params)}-{when}"


def run_folder(out: str, params: Sequence[int | float | str]) -> str:
    """A folder of its own for one run's outputs under ``out``."""
    return f"{out.rstrip('/')}/{run_name(params)}-{uuid.uuid4().hex[:8]}"


def write_manifest(spark: SparkSession, folder: str, info: dict) -> None:
    """Marks a run as complete: writes ``info`` (JSON) to its folder, after
    all other outputs. A folder without it belongs to a run that goes on or
    was killed."""
    text = json.dumps(info, sort_keys=True, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{folder}/{MANIFEST}")


def complete_runs(spark: SparkSession, out: str) -> dict[str, dict]:
    """The manifests of all complete runs under ``out``, by folder."""
    try:
        rows = spark.read.text(f"{out.rstrip('/')}/run-*/{MANIFEST}", wholetext=True).select("value", "_metadata.file_path").collect()
    except AnalysisException:  # no run has a manifest
        return {}
    return {r["file_path"].rsplit(f"/{MANIFEST}/", 1)[0]: json.loads(r["value"]) for r in rows}


def write_report(df: DataFrame, path: str, fmt: str = "parquet", single_file: bool = False) -> None:
    """Writes a table as Parquet or CSV (with header). ``single_file`` moves
    the rows of a small report to one file by a shuffle, so the work behind
    it keeps its parallelism."""
    w = (df.repartition(1) if single_file else df).write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def report_csv(df: DataFrame, order_by: Sequence[str] = (), max_rows: int = 10_000) -> str:
    """A small report as CSV text, e.g. for the console; an error beyond
    ``max_rows`` rows instead of an unbounded collect."""
    pdf = (df.orderBy(*order_by) if order_by else df).limit(max_rows + 1).toPandas()
    if len(pdf) > max_rows:
        raise ProtocolError(f"the report has more than {max_rows} rows; write it to a folder instead")
    return pdf.to_csv(index=False)
