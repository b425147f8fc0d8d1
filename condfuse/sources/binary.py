"""Fixed-stride binary error cube and flag vectors as Spark Python data sources.

Cube layout: float32, native byte order, no header; point after point, each
point holding ``n_config`` rows of one value per measure of the file
(row-major), so point ``gi`` starts at byte ``gi * n_config * n_measures * 4``.

Files are opened through ``pyarrow.fs``, so a path may be a plain path or a
URI of any file system it knows (``file://``, ``s3://``, ``gs://``,
``hdfs://``); executors and driver must see the same file. The index range
and the measures are options of the read, so every scan of a DataFrame reads
the same rows whatever query it stands in. A file whose length does not fit
the layout is an error.

``CubeFile`` describes such a file. A read with bounds or fewer measures is a
new description and a new scan, so narrowing one leaves the others alone.
``CubeFile.seek`` takes the rows of given points: the points are dealt to
tasks by ranges of the index, and each task reads just their blocks of the
file, so no row of the cube is ever shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from condfuse._ship import by_value
from condfuse.functions.columns import MEASURES
from condfuse.model import ProtocolError
from condfuse.sources.provenance import noted

FLOAT_BYTES = 4
PARTITION_BYTES = 128 << 20
BATCH_BYTES = 16 << 20
# A seek reads on over this many unneeded bytes instead of starting anew.
GAP_BYTES = 64 << 10

by_value(__import__(__name__, fromlist=["_"]))


def open_fs(path: str):
    """File system and path inside it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def file_info(path: str) -> tuple[int, str]:
    """Size and modification time (nanoseconds, as text) of a file."""
    files, inner = open_fs(path)
    info = files.get_file_info(inner)
    if not info.is_file:
        raise ProtocolError(f"no file {path}")
    return info.size, str(info.mtime_ns)


def file_size(path: str) -> int:
    return file_info(path)[0]


@dataclass
class IndexRange(InputPartition):
    lo: int
    hi: int  # exclusive


def _ranges(lo: int, hi: int, step: int) -> list[IndexRange]:
    return [IndexRange(a, min(a + step, hi)) for a in range(lo, hi, step)] or [IndexRange(lo, lo)]


def _index_range(options, n: int) -> tuple[int, int]:
    lo, hi = int(options.get("start", 0)), int(options.get("end", n))
    if not 0 <= lo <= hi <= n:
        raise ProtocolError(f"index range [{lo}, {hi}) outside the file's {n} points")
    return lo, hi


class _CubeReader(DataSourceReader):
    def __init__(self, options, layout, measures):
        self.path, self.layout, self.measures = options["path"], layout, measures
        self.n_config = int(options["n_config"])
        self.stride = self.n_config * len(layout) * FLOAT_BYTES
        size = file_size(self.path)
        if size % self.stride:
            raise ProtocolError(f"{self.path} has {size} bytes, not a multiple of {self.stride} "
                                f"({self.n_config} configs x {len(layout)} measures x {FLOAT_BYTES})")
        self.lo, self.hi = _index_range(options, size // self.stride)
        self.step = max(1, int(options.get("partition_bytes", PARTITION_BYTES)) // self.stride)

    def partitions(self):
        return _ranges(self.lo, self.hi, self.step)

    def read(self, partition: IndexRange):
        import pyarrow as pa

        files, inner = open_fs(self.path)
        step = max(1, BATCH_BYTES // self.stride)
        with files.open_input_file(inner) as file:
            for a in range(partition.lo, partition.hi, step):
                b = min(a + step, partition.hi)
                cols = [pa.array(np.arange(a, b, dtype=np.int64))]
                if self.measures:
                    raw = file.read_at((b - a) * self.stride, a * self.stride)
                    cols += measure_lists(raw, self.n_config, self.layout, self.measures)
                yield pa.RecordBatch.from_arrays(cols, names=["global_index", *self.measures])


def measure_lists(raw, n_config: int, layout: Sequence[str], measures: Sequence[str], rows=None) -> list:
    """The measures of a stretch of the file as Arrow lists, one per point
    (or per entry of ``rows``, positions in the stretch)."""
    import pyarrow as pa

    block = np.frombuffer(raw, np.float32).reshape(-1, n_config, len(layout))
    if rows is not None:
        block = block[rows]
    offsets = pa.array(np.arange(0, (len(block) + 1) * n_config, n_config, dtype=np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(block[:, :, layout.index(m)]).reshape(-1)))
            for m in measures]


def seek_blocks(index: np.ndarray, stride: int, batch_bytes: int = BATCH_BYTES, gap_bytes: int = GAP_BYTES) -> Iterator[tuple[int, int]]:
    """Cuts sorted point indexes into stretches ``a:b`` that are read at once:
    of at most ``batch_bytes`` (one point at least), without a gap of more
    than ``gap_bytes`` inside."""
    a = 0
    breaks = set((np.flatnonzero(np.diff(index) > 1 + gap_bytes // stride) + 1).tolist())
    for b in range(1, len(index) + 1):
        if b == len(index) or b in breaks or (index[b] - index[a] + 1) * stride > batch_bytes:
            yield a, b
            a = b


@dataclass(frozen=True)
class CubeFile:
    """A fixed-stride cube file, the measures wanted of it and the bounds of its index.

    ``layout``: measures in the file, in order; ``measures``: those wanted
    (None for all); ``start``/``end``: index range."""

    path: str
    n_config: int
    layout: tuple[str, ...] = MEASURES
    measures: tuple[str, ...] | None = None
    start: int | None = None
    end: int | None = None
    partition_bytes: int | None = None

    @property
    def wanted(self) -> tuple[str, ...]:
        return self.layout if self.measures is None else self.measures

    @property
    def stride(self) -> int:
        return self.n_config * len(self.layout) * FLOAT_BYTES

    def bounds(self) -> tuple[int, int]:
        """First index and the one after the last, within the file."""
        n = file_size(self.path) // self.stride
        return self.start or 0, n if self.end is None else self.end

    def between(self, lo: int, hi: int) -> CubeFile:
        """The part of it with lo <= index < hi."""
        first, last = self.bounds()
        lo = min(max(lo, first), last)
        return replace(self, start=lo, end=max(min(hi, last), lo))

    def identity(self, spark: SparkSession | None = None) -> str:
        """Path, size, time, layout and the part that is read."""
        fields = [self.path, *file_info(self.path), self.n_config, self.layout, self.wanted, *self.bounds()]
        return "cube file " + json.dumps(fields)

    def frame(self, spark: SparkSession) -> DataFrame:
        options = {"n_config": self.n_config, "layout": ",".join(self.layout), "start": self.start, "end": self.end,
                   "measures": None if self.measures is None else ",".join(self.measures), "partition_bytes": self.partition_bytes}
        return noted(_load(spark, BinaryCubeSource, self.path, options), self)

    def seek(self, points: DataFrame, measures: Sequence[str] | None = None) -> DataFrame:
        """The rows of ``points`` (needs ``global_index``) with the measures of their cube rows added.

        Only ``points`` are shuffled, to ranges of the index of about
        ``partition_bytes`` of the file each; a task sorts its points and
        reads their blocks. Points outside the file or its bounds have no
        cube row and drop out, as in a join.
        """
        wanted = list(self.wanted if measures is None else measures)
        if unknown := [m for m in wanted if m not in self.layout]:
            raise ProtocolError(f"the file has no measures {unknown}")
        lo, hi = self.bounds()
        path, n_config, layout, stride = self.path, self.n_config, self.layout, self.stride
        names = points.columns
        at = names.index("global_index")

        def fn(batches):
            import pyarrow as pa

            files, inner = open_fs(path)
            with files.open_input_file(inner) as file:
                for batch in batches:
                    index = batch.column(at).to_numpy(zero_copy_only=False)
                    first, last = np.searchsorted(index, [lo, hi])
                    index = index[first:last]
                    for a, b in seek_blocks(index, stride):
                        raw = file.read_at(int(index[b - 1] - index[a] + 1) * stride, int(index[a]) * stride)
                        cols = measure_lists(raw, n_config, layout, wanted, index[a:b] - index[a])
                        own = batch.slice(first + a, b - a)
                        yield pa.RecordBatch.from_arrays([*own.columns, *cols], names=[*names, *wanted])

        tasks = max(1, -(-(hi - lo) * stride // (self.partition_bytes or PARTITION_BYTES)))
        placed = points.where("global_index IS NOT NULL").repartitionByRange(tasks, "global_index").sortWithinPartitions("global_index")
        schema = T.StructType([*points.schema.fields, *[T.StructField(m, T.ArrayType(T.FloatType())) for m in wanted]])
        return placed.mapInArrow(fn, schema)


class BinaryCubeSource(DataSource):
    """``spark.read.format("errorcube").option("n_config", 320).load(path)``.

    ``layout``: measures in the file, in order; ``measures``: those wanted
    (default all; empty for the index alone, which reads no bytes);
    ``start``/``end``: index range; ``partition_bytes``."""

    @classmethod
    def name(cls):
        return "errorcube"

    def _names(self) -> tuple[list[str], list[str]]:
        listed = lambda key, default: [m for m in self.options.get(key, ",".join(default)).split(",") if m]
        layout = listed("layout", MEASURES)
        measures = listed("measures", layout)
        if unknown := [m for m in measures if m not in layout]:
            raise ProtocolError(f"the file has no measures {unknown}")
        return layout, measures

    def schema(self):
        return ", ".join(["global_index bigint", *(f"{m} array<float>" for m in self._names()[1])])

    def reader(self, schema):
        return _CubeReader(dict(self.options), *self._names())


def _vector(path: str, dtype: str):
    """(dtype, byte offset, length) of a 1-D int vector, from the header only."""
    size = file_size(path)
    if not path.endswith(".npy"):
        kind, offset = np.dtype(dtype), 0
        if size % kind.itemsize:
            raise ProtocolError(f"{path} has {size} bytes, not a multiple of {kind.itemsize}")
        return kind, offset, size // kind.itemsize
    files, inner = open_fs(path)
    with files.open_input_file(inner) as file:
        version = np.lib.format.read_magic(file)
        header = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, _, kind = header(file)
        offset = file.tell()
    if len(shape) != 1 or kind.kind not in "iub":
        raise ProtocolError(f"{path} is no vector of integers (shape {shape}, {kind})")
    if size - offset != shape[0] * kind.itemsize:
        raise ProtocolError(f"{path} holds {size - offset} bytes for {shape[0]} values of {kind.itemsize}")
    return kind, offset, shape[0]


def vector_length(path: str, dtype: str = "int32") -> int:
    return _vector(path, dtype)[2]


class _FlagReader(DataSourceReader):
    """Vectors of equal positions, read side by side."""

    def __init__(self, options):
        self.vectors = [(column, path, *_vector(path, dtype)) for column, path, dtype in _listed(options)]
        lengths = {path: n for _, path, _, _, n in self.vectors}
        if "end" not in options and len(set(lengths.values())) > 1:
            raise ProtocolError(f"vectors of unequal length need an end: {lengths}")
        self.lo, self.hi = _index_range(options, min(lengths.values()))
        self.step = max(1, int(options.get("partition_bytes", PARTITION_BYTES)) // (16 * len(self.vectors)))

    def partitions(self):
        return _ranges(self.lo, self.hi, self.step)

    def read(self, partition: IndexRange):
        import pyarrow as pa

        n = partition.hi - partition.lo
        cols = [pa.array(np.arange(partition.lo, partition.hi, dtype=np.int64))]
        for _, path, dtype, offset, _ in self.vectors:
            files, inner = open_fs(path)
            with files.open_input_file(inner) as file:
                raw = file.read_at(n * dtype.itemsize, offset + partition.lo * dtype.itemsize)
            cols.append(pa.array(np.frombuffer(raw, dtype).astype(np.int32)))
        yield pa.RecordBatch.from_arrays(cols, names=["global_index", *[v[0] for v in self.vectors]])


def _listed(options) -> list[tuple[str, str, str]]:
    """Column, path and dtype of every vector of a read."""
    if "vectors" in options:
        return [tuple(v) for v in json.loads(options["vectors"])]
    return [(options.get("column", "flag"), options["path"], options.get("dtype", "int32"))]


class FlagVectorSource(DataSource):
    """``spark.read.format("flagvector").option("column", "missing").load(path)``:
    a 1-D int vector (``.npy`` or raw ``dtype``) by position; ``start``/``end``.
    ``vectors``, a JSON list of [column, path, dtype], reads several side by
    side in one scan, so they need no join."""

    @classmethod
    def name(cls):
        return "flagvector"

    def schema(self):
        return ", ".join(["global_index bigint", *(f"{v[0]} int" for v in _listed(self.options))])

    def reader(self, schema):
        return _FlagReader(dict(self.options))


def _load(spark: SparkSession, source: type[DataSource], path: str | None, options: dict) -> DataFrame:
    spark.dataSource.register(source)
    reader = spark.read.format(source.name())
    for key, value in options.items():
        if value is not None:
            reader = reader.option(key, str(value))
    return reader.load(path)


def read_binary_cube(spark: SparkSession, path: str, n_config: int, measures: Sequence[str] | None = None,
                     layout: Sequence[str] = MEASURES, start: int | None = None, end: int | None = None,
                     partition_bytes: int | None = None) -> DataFrame:
    """The cube of a file (see ``CubeFile``, which is noted on the DataFrame)."""
    measures = None if measures is None else tuple(measures)
    return CubeFile(path, n_config, tuple(layout), measures, start, end, partition_bytes).frame(spark)


def read_flags(spark: SparkSession, path: str, column: str = "flag", dtype: str = "int32",
               start: int | None = None, end: int | None = None) -> DataFrame:
    return _load(spark, FlagVectorSource, path, {"column": column, "dtype": dtype, "start": start, "end": end})


def read_vectors(spark: SparkSession, paths: Mapping[str, str], dtype: str = "int32",
                 start: int | None = None, end: int | None = None) -> DataFrame:
    """``(global_index, <column>...)`` of several vectors by position, in one
    scan: ``paths`` names the file of each column. Vectors of unequal length
    need an ``end`` that all of them reach."""
    vectors = json.dumps([[column, path, dtype] for column, path in paths.items()])
    return _load(spark, FlagVectorSource, None, {"vectors": vectors, "start": start, "end": end})
