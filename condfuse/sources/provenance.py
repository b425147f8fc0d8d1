"""What a table was read from, and a checksum of what it holds.

A reader notes its source on the DataFrame it returns. The note is lost with
any step on that DataFrame, so it never stands for other rows than those of
the source; a DataFrame without a note is known by the checksum of its rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol as Interface

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NOTE = "_condfuse_source"


class Source(Interface):
    """Where rows come from; ``identity`` differs when their content may."""

    def identity(self, spark: SparkSession) -> str: ...


def noted(df: DataFrame, source: Source) -> DataFrame:
    df.__dict__[_NOTE] = source
    return df


def source_of(df: DataFrame) -> Source | None:
    return df.__dict__.get(_NOTE)


def file_state(spark: SparkSession, files: Sequence[str]) -> str:
    """Count, sizes, times and names of files as one short text, added up by
    Spark; file contents are not read."""
    if not files:
        return "none"
    info = spark.read.format("binaryFile").load(list(files)).select("path", "modificationTime", "length")
    r = info.agg(F.count(F.lit(1)), F.sum("length"),
                 F.sum(F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)"))).first()
    return ":".join(str(x) for x in r)


@dataclass(frozen=True)
class Files:
    """Parquet files: known by their names, sizes and times, and the columns read."""

    files: tuple[str, ...]
    columns: tuple[str, ...]

    def identity(self, spark: SparkSession) -> str:
        return f"files {file_state(spark, self.files)} {','.join(self.columns)}"


@dataclass(frozen=True)
class TableVersion:
    """A table whose writer gave it a version when it was complete."""

    name: str
    version: str
    columns: tuple[str, ...]

    def identity(self, spark: SparkSession) -> str:
        return f"table {self.name} {self.version} {','.join(self.columns)}"


def _hashed(name: str, kind: T.DataType) -> list[Column]:
    """The columns to hash for one column. A hash passes over nulls, so where
    they stand is hashed as well."""
    c = F.col(f"`{name}`")
    if isinstance(kind, T.ArrayType):
        return [c, F.size(c), F.when(F.exists(c, lambda x: x.isNull()), F.transform(c, lambda x: x.isNull()))]
    return [c, c.isNull()]


def checksum(df: DataFrame) -> str:
    """Checksum of the rows of ``df`` whatever their order and partitioning:
    column names and types, the row count and two 64-bit hashes per row,
    added up. One pass with a partial sum per task."""
    cols = [h for f in sorted(df.schema, key=lambda f: f.name) for h in _hashed(f.name, f.dataType)]
    sums = [F.sum(F.xxhash64(F.lit(seed), *cols).cast("decimal(38,0)")) for seed in (1, 2)]
    r = df.agg(F.count(F.lit(1)), *sums).first()
    shape = ",".join(sorted(f"{f.name} {f.dataType.simpleString()}" for f in df.schema))
    return f"rows {':'.join(str(x) for x in r)} {shape}"


def identity(df: DataFrame) -> str:
    """The identity of the noted source, or the checksum of the rows."""
    source = source_of(df)
    return checksum(df) if source is None else source.identity(df.sparkSession)


def digest(parts: object) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:24]
