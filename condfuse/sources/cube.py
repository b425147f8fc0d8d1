"""Error cube in array form (one row per point) and its long form.

Array form: ``global_index BIGINT`` plus one ``ARRAY<FLOAT>`` column per
measure, element c = config c. One row per point keeps every per-point
operation (ranking, weighting) inside one task with no shuffle, and Parquet
column pruning still works per measure.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condfuse._ship import by_value
from condfuse.functions.columns import MEASURES
from condfuse.sources.binary import CubeFile, file_info
from condfuse.sources.provenance import Files, TableVersion, checksum, digest, noted, source_of

by_value(__import__(__name__, fromlist=["_"]))

# Table properties of a cube table: its version, and the file it was made from.
VERSION = "condfuse.version"
SOURCE = "condfuse.source"


def cube_schema(measures: Sequence[str] = MEASURES) -> T.StructType:
    return T.StructType(
        [T.StructField("global_index", T.LongType(), False)]
        + [T.StructField(m, T.ArrayType(T.FloatType(), True), True) for m in measures]
    )


def read_cube(spark: SparkSession, path: str, measures: Sequence[str] = MEASURES) -> DataFrame:
    """Reads an array-form cube (only the listed measures) from a Parquet
    folder, or from a catalog table when ``path`` has no slash (for example
    a bucketed cube written by ``write_cube(..., table=..., buckets=...)``)."""
    columns = ("global_index", *measures)
    if "/" not in path:
        version = table_properties(spark, path).get(VERSION)
        df = spark.table(path).select(*columns)
        return noted(df, TableVersion(path, version, columns)) if version else df
    df = spark.read.parquet(path)
    return noted(df.select(*columns), Files(tuple(df.inputFiles()), columns))


# Bytes of arrays that a built cube gives out at once.
BUILT_BYTES = 16 << 20


@dataclass(frozen=True, eq=False)
class BuiltCube:
    """A cube whose arrays are built from narrow rows, one cube row from each.

    ``rows`` has ``global_index`` and what ``build`` needs besides; ``build``
    takes an Arrow batch of them and a list of measures and returns a list array of ``n_config``
    floats per row for each of these. A pass over the cube joins ``rows`` with
    the points and builds the arrays in the task that uses them, so a
    shuffle carries narrow rows only.
    """

    rows: DataFrame
    build: Callable[[pa.RecordBatch, Sequence[str]], list[pa.Array]]
    n_config: int
    measures: tuple[str, ...]

    def frame(self) -> DataFrame:
        """The cube in array form, noted as this one."""
        return noted(self._built(self.rows, ["global_index"], self.measures), self)

    def identity(self, spark: SparkSession) -> str:
        return checksum(self.frame())

    def between(self, lo: int, hi: int) -> BuiltCube:
        """The cube rows from index ``lo`` to ``hi``."""
        return replace(self, rows=self.rows.filter(F.col("global_index").between(lo, hi)))

    def joined(self, points: DataFrame, measures: Sequence[str] | None = None) -> DataFrame:
        """The cube rows of ``points`` with their columns; the points are the
        build side of a shuffled hash join and go where ``rows`` are."""
        return self._built(self.rows.join(points.hint("shuffle_hash"), "global_index"), points.columns, measures or self.measures)

    def _built(self, rows: DataFrame, kept: Sequence[str], measures: Sequence[str]) -> DataFrame:
        build, step = self.build, max(1, BUILT_BYTES // max(1, 4 * self.n_config * len(measures)))
        kept, measures = list(kept), list(measures)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *build(part, measures)], names=[*kept, *measures])

        fields = {f.name: f for f in rows.schema.fields}
        schema = T.StructType([*[fields[c] for c in kept], *[T.StructField(m, T.ArrayType(T.FloatType())) for m in measures]])
        return rows.mapInArrow(run, schema)


def bucket_count(n_points: int, n_config: int, n_measures: int = len(MEASURES), bucket_bytes: int = 256 << 20) -> int:
    """Buckets of about ``bucket_bytes`` each. The join with the point table
    builds a hash map of one bucket's points (a few dozen bytes per 10 KB of
    cube row), so this also bounds its memory."""
    return max(1, -(-n_points * n_config * n_measures * 4 // bucket_bytes))


def write_cube(cube: DataFrame, path: str | None = None, measures: Sequence[str] = MEASURES,
               files: int | None = None, table: str | None = None, buckets: int | None = None,
               source: str | None = None) -> None:
    """Writes an array-form cube.

    ``table`` and ``buckets`` (see ``bucket_count``) save it as a table
    bucketed by ``global_index``: the layout to use, as ranking and testing
    then read the cube in place and shuffle only the points. With ``path``
    alone it becomes a plain Parquet folder: rows are range-partitioned and
    sorted on ``global_index``, so min/max statistics prune row groups for
    index filters, but a join with points shuffles the cube. A table gets
    a version, and the text ``source`` says what it was made from, as
    table properties; they are set last, so a table without a version is one
    whose write did not end.
    """
    out = cube.select("global_index", *measures)
    if table is not None:
        if not buckets:
            raise ValueError("a bucketed cube table needs a bucket count")
        # hash-partition by the bucket key first: each task then writes one
        # file per bucket instead of a file into every bucket
        w = out.repartition(buckets, "global_index").write.mode("overwrite").format("parquet")
        if path is not None:
            w = w.option("path", path)
        w.bucketBy(buckets, "global_index").sortBy("global_index").saveAsTable(table)
        marks = {VERSION: uuid.uuid4().hex, **({SOURCE: source} if source else {})}
        pairs = ", ".join("'{}' = '{}'".format(k, v.replace("\\", "\\\\").replace("'", "\\'")) for k, v in marks.items())
        out.sparkSession.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ({pairs})")
        return
    if path is None:
        raise ValueError("a path or a table name is needed")
    if files:
        out = out.repartitionByRange(files, "global_index")
    out.sortWithinPartitions("global_index").write.mode("overwrite").parquet(path)


def table_properties(spark: SparkSession, table: str) -> dict[str, str]:
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}


def stored_cube(spark: SparkSession, name: str, file: CubeFile, buckets: int | None = None) -> DataFrame:
    """A cube file as a bucketed table, written where it is not there yet.

    Every file has a table of its own, ``name`` and a hash of path and layout.
    The file's size and time and the bucket count are properties of the table and
    compared on every read; where they differ, or a write did not end, the
    table is written anew, to a fresh folder of the warehouse.
    """
    size, time = file_info(file.path)
    buckets = buckets or bucket_count(size // file.stride, file.n_config, len(file.layout))
    table = f"{name}_{digest([file.path, file.n_config, file.layout])[:12]}"
    made_from = json.dumps({"path": file.path, "bytes": size, "modified": time, "n_config": file.n_config,
                            "layout": file.layout, "buckets": buckets})
    found = table_properties(spark, table) if spark.catalog.tableExists(table) else {}
    if VERSION not in found or found.get(SOURCE) != made_from:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{table}-{uuid.uuid4().hex[:8]}"
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        whole = CubeFile(file.path, file.n_config, file.layout)
        write_cube(whole.frame(spark), folder, file.layout, table=table, buckets=buckets, source=made_from)
    return read_cube(spark, table, file.wanted)


def cube_to_long(cube: DataFrame, measures: Sequence[str] = MEASURES) -> DataFrame:
    """Array form -> (global_index, config_index, one FLOAT column per measure)."""
    z = F.posexplode(F.arrays_zip(*[F.col(m).alias(m) for m in measures]))
    return (cube.select("global_index", z.alias("config_index", "z"))
            .select("global_index", F.col("config_index").cast("int").alias("config_index"),
                    *[F.col("z").getField(m).alias(m) for m in measures]))


def long_to_cube(long: DataFrame, measures: Sequence[str] = MEASURES) -> DataFrame:
    """Long form -> array form. Groups by point: each group is one point's
    configs (bounded by the config count), ordered by config_index."""
    srt = F.array_sort(F.collect_list(F.struct("config_index", *measures)))
    return (long.groupBy("global_index").agg(srt.alias("rows"))
            .select("global_index", *[F.col("rows").getField(m).alias(m) for m in measures]))


def select_points(cube: DataFrame, points: DataFrame) -> DataFrame:
    """Cube rows of the given points (left semi join on ``global_index``)."""
    return cube.join(points.select("global_index"), "global_index", "left_semi")


def cube_stats(cube: DataFrame, measures: Sequence[str] = MEASURES) -> DataFrame:
    """One-row profile used by input validation: point count, index range,
    number of index gaps, and the smallest/largest array length."""
    least, most = row_sizes(measures)
    return cube.agg(
        F.count(F.lit(1)).alias("n_points"),
        F.min("global_index").alias("min_index"),
        F.max("global_index").alias("max_index"),
        F.countDistinct("global_index").alias("n_distinct"),
        F.min(least).alias("min_configs"),
        F.max(most).alias("max_configs"),
    )


def row_sizes(measures: Sequence[str]) -> tuple[Column, Column]:
    """Smallest and largest array length of a cube row; a null measure counts as -1."""
    sizes = F.array(*[F.coalesce(F.size(m), F.lit(-1)) for m in measures])
    return F.array_min(sizes), F.array_max(sizes)


def config_count(cube: DataFrame, measure: str) -> int:
    """Configs per point: of the file's layout, as built, or of one row of the cube (0 where it has none)."""
    file = source_of(cube)
    if isinstance(file, (CubeFile, BuiltCube)):
        return file.n_config
    row = cube.select(F.size(measure).alias("n")).first()
    return max(row["n"] or 0, 0) if row else 0
