"""Spark data sources for binary vector files.

A vector file starts with two little-endian int32, the number of vectors and
their dimension, followed by the components row by row. ``fbin`` holds float32,
``ibin`` int32, ``u8bin`` uint8; ``npy`` reads two-dimensional NumPy files.

``tolerant`` reads the whole vectors of a file that ends before its header says,
which is an error otherwise.

A directory of part files is one table: rows are numbered from 0 over the part
files in name order. Each input partition is a range of rows of one file, read
with a seek. Each writing task makes one complete file of its own.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StructField, StructType

from nearfield.session import qualified

HEADER = 8
BATCH_ROWS = 8192
PARTITION_BYTES = 64 << 20

# Component types of the formats.
FORMATS = {"fbin": "<f4", "ibin": "<i4", "u8bin": "u1"}
DTYPES = {"float32": "<f4", "int32": "<i4", "uint8": "u1"}


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """Any file system pyarrow knows by its URI; plain paths are local."""
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:/") and not path.startswith("file://"):
            path = "file://" + path[len("file:") :]
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def part_files(path: str) -> list[str]:
    fs, root = filesystem(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.File:
        return [root]
    if info.type != pafs.FileType.Directory:
        raise FileNotFoundError(path)
    listed = fs.get_file_info(pafs.FileSelector(root))
    names = [i.path for i in listed if i.type == pafs.FileType.File]
    return sorted(n for n in names if not n.rsplit("/", 1)[-1].startswith(("_", ".")))


@dataclass
class Layout:
    """Where the vectors of one file are."""

    file: str
    n: int
    dim: int
    dtype: str
    offset: int


def binary_layout(fs: pafs.FileSystem, file: str, dtype: str) -> Layout:
    with fs.open_input_file(file) as f:
        n, dim = struct.unpack("<ii", f.read(HEADER))
    return Layout(file, n, dim, dtype, HEADER)


def npy_layout(fs: pafs.FileSystem, file: str) -> Layout:
    from numpy.lib import format as npy

    with fs.open_input_file(file) as f:
        version = npy.read_magic(f)
        reader = npy.read_array_header_1_0 if version == (1, 0) else npy.read_array_header_2_0
        shape, fortran, dtype = reader(f)
        if fortran or len(shape) != 2 or dtype.kind != "f":
            raise ValueError(f"{file}: need a two-dimensional float array in C order")
        return Layout(file, shape[0], shape[1], dtype.str, f.tell())


@dataclass
class RowRange(InputPartition):
    layout: Layout
    first: int  # row in the file
    count: int
    start_id: int  # id of that row


class VectorReader(DataSourceReader):
    def __init__(self, options: dict, kind: str):
        self.path = options["path"]
        self.kind = kind
        self.dtype = DTYPES[options["dtype"]] if "dtype" in options else FORMATS.get(kind)
        self.start = int(options.get("startidx", 0))
        self.chunk = int(options["chunksize"]) if "chunksize" in options else None
        self.max_rows = int(options["maxrows"]) if "maxrows" in options else None
        self.tolerant = options.get("tolerant", "false").lower() == "true"
        self.header_only = options.get("headeronly", "false").lower() == "true"
        self.rows_per_partition = int(options["rowsperpartition"]) if "rowsperpartition" in options else None
        self.low, self.high = 0, None  # id bounds from filters, high exclusive
        self.integral = self.dtype is not None and self.dtype != "<f4"

    def layouts(self) -> list[Layout]:
        fs, _ = filesystem(self.path)
        if self.kind == "npy":
            return [npy_layout(fs, file) for file in part_files(self.path)]
        return [binary_layout(fs, file, self.dtype) for file in part_files(self.path)]

    def pushFilters(self, filters: list[Filter]):
        """Conditions on ``id`` narrow the row ranges; Spark still applies all of them."""
        for f in filters:
            if getattr(f, "attribute", None) == ("id",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, GreaterThanOrEqual):
                    self.low = max(self.low, f.value)
                elif isinstance(f, GreaterThan):
                    self.low = max(self.low, f.value + 1)
                elif isinstance(f, LessThan):
                    self.high = f.value if self.high is None else min(self.high, f.value)
                elif isinstance(f, LessThanOrEqual):
                    self.high = f.value + 1 if self.high is None else min(self.high, f.value + 1)
                elif isinstance(f, EqualTo):
                    self.low = max(self.low, f.value)
                    self.high = f.value + 1 if self.high is None else min(self.high, f.value + 1)
            yield f

    def partitions(self) -> Sequence[InputPartition]:
        if self.header_only:  # headers are opened by the tasks
            return [RowRange(Layout(file, 0, 0, self.dtype or "<f4", 0), 0, 0, 0) for file in part_files(self.path)] or [self._nothing()]
        layouts = self.layouts()
        total = sum(layout.n for layout in layouts)
        low = max(self.start, self.low)
        high = total if self.chunk is None else min(total, self.start + self.chunk)
        if self.max_rows is not None:
            high = min(high, self.start + self.max_rows)
        if self.high is not None:
            high = min(high, self.high)
        out, base = [], 0
        for layout in layouts:
            width = max(1, layout.dim * np.dtype(layout.dtype).itemsize)
            step = self.rows_per_partition or max(1, PARTITION_BYTES // width)
            first, last = max(low, base), min(high, base + layout.n)
            for row in range(first, last, step):
                out.append(RowRange(layout, row - base, min(step, last - row), row))
            base += layout.n
        # Spark needs a partition to plan; an empty one reads nothing.
        return out or [self._nothing()]

    def _nothing(self) -> RowRange:
        return RowRange(Layout("", 0, 0, self.dtype or "<f4", 0), 0, 0, 0)

    def read(self, part: RowRange) -> Iterator[pa.RecordBatch]:
        layout = part.layout
        if self.header_only:
            if not layout.file:
                return
            fs, _ = filesystem(self.path)
            layout = npy_layout(fs, layout.file) if self.kind == "npy" else binary_layout(fs, layout.file, layout.dtype)
            yield pa.RecordBatch.from_arrays(
                [pa.array([layout.n], pa.int64()), pa.array([layout.dim], pa.int32())], names=["n", "dim"]
            )
            return
        if part.count == 0:
            return
        fs, _ = filesystem(self.path)
        kind = np.dtype(layout.dtype)
        out_type = pa.int32() if self.integral else pa.float32()
        with fs.open_input_file(layout.file) as f:
            f.seek(layout.offset + part.first * layout.dim * kind.itemsize)
            for done in range(0, part.count, BATCH_ROWS):
                rows = min(BATCH_ROWS, part.count - done)
                wanted = rows * layout.dim * kind.itemsize
                data = f.read(wanted)
                if len(data) < wanted:
                    if not self.tolerant:
                        raise ValueError(f"{layout.file}: payload ends early, {wanted - len(data)} bytes missing")
                    rows = len(data) // (layout.dim * kind.itemsize)
                    data = data[: rows * layout.dim * kind.itemsize]
                values = np.frombuffer(data, kind).astype(np.int32 if self.integral else np.float32)
                ids = np.arange(rows, dtype=np.int64) + part.start_id + done
                offsets = pa.array(np.arange(rows + 1) * layout.dim, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.ListArray.from_arrays(offsets, pa.array(values, out_type))], names=["id", "vector"]
                )


class VectorStreamReader(DataSourceStreamReader):
    """Vector files as they arrive, in the order of their names, with ids that go on over all of them.

    An offset says how many files are read, the last one's name and their rows, so
    a batch knows the ids of its first row without a look at earlier ones, after a
    restart too. New files need names after those that were read, as numbered or
    dated files have; one that turns up before them is an error, as it would be lost.
    """

    def __init__(self, options: dict, kind: str):
        self.files = VectorReader(options, kind)
        self.known: dict[str, Layout] = {}

    def _layouts(self) -> list[Layout]:
        """Headers of all files; a file's header is read once per run."""
        fs, _ = filesystem(self.files.path)
        for file in part_files(self.files.path):
            if file not in self.known:
                self.known[file] = npy_layout(fs, file) if self.files.kind == "npy" else binary_layout(fs, file, self.files.dtype)
        return [self.known[file] for file in sorted(self.known)]

    def initialOffset(self) -> dict:
        return {"files": 0, "last": "", "rows": 0}

    def latestOffset(self) -> dict:
        layouts = self._layouts()
        return {"files": len(layouts), "last": layouts[-1].file if layouts else "", "rows": sum(x.n for x in layouts)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        layouts = self._layouts()
        for offset in (start, end):
            if offset["files"] and [x.file for x in layouts[offset["files"] - 1 : offset["files"]]] != [offset["last"]]:
                raise RuntimeError(f"a file has come in, or is gone, before {offset['last']}, which was read already")
        out, base = [], start["rows"]
        for layout in layouts[start["files"] : end["files"]]:
            width = max(1, layout.dim * np.dtype(layout.dtype).itemsize)
            step = self.files.rows_per_partition or max(1, PARTITION_BYTES // width)
            out += [RowRange(layout, row, min(step, layout.n - row), base + row) for row in range(0, layout.n, step)]
            base += layout.n
        return out

    def read(self, part: RowRange) -> Iterator[pa.RecordBatch]:
        return self.files.read(part)


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str


class VectorWriter(DataSourceArrowWriter):
    """One file per task, under a temporary name until the whole job commits."""

    def __init__(self, options: dict, kind: str, schema: StructType, overwrite: bool):
        self.path = options["path"]
        self.kind = kind
        self.dtype = DTYPES[options["dtype"]] if "dtype" in options else FORMATS[kind]
        self.overwrite = overwrite
        self.prefix = options.get("prefix", "")
        self.vector = schema.names[-1] if "vector" not in schema.names else "vector"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        from nearfield.operators.blocks import matrix

        blocks: list[np.ndarray] = []
        for batch in iterator:
            if batch.num_rows:
                column = batch.column(self.vector)
                if column.null_count or column.flatten().null_count:
                    raise ValueError("a vector or a component is missing")
                blocks.append(matrix(column, np.dtype(self.dtype)))
        if not blocks:
            return Written("", "")
        if len({b.shape[1] for b in blocks}) > 1:
            raise ValueError("vectors of different dimensions in one column")
        task = TaskContext.get()
        name = f"{self.prefix}part-{task.partitionId():05d}-{uuid.uuid4().hex}.{self.kind}"
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        temporary = f"{root}/_{name}.{task.taskAttemptId()}"
        with fs.open_output_stream(temporary) as out:
            out.write(struct.pack("<ii", sum(len(b) for b in blocks), blocks[0].shape[1]))
            for block in blocks:
                out.write(np.ascontiguousarray(block).tobytes())
        return Written(temporary, f"{root}/{name}")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        if self.overwrite:
            for old in part_files(self.path):
                fs.delete_file(old)
        for message in messages:
            if message is not None and message.temporary:
                fs.move(message.temporary, message.final)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, _ = filesystem(self.path)
        for message in messages:
            if message is not None and message.temporary:
                fs.delete_file(message.temporary)


class VectorFiles(DataSource):
    kind = "fbin"

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def _options(self) -> dict:
        return {str(k).lower(): v for k, v in dict(self.options).items()}

    def schema(self) -> StructType:
        options = self._options()
        if options.get("headeronly", "false").lower() == "true":
            return StructType([StructField("n", LongType()), StructField("dim", IntegerType())])
        dtype = DTYPES.get(options.get("dtype", ""), FORMATS.get(self.kind, "<f4"))
        item = FloatType() if dtype == "<f4" else IntegerType()
        return StructType([StructField("id", LongType()), StructField("vector", ArrayType(item))])

    def reader(self, schema: StructType) -> DataSourceReader:
        return VectorReader(self._options(), self.kind)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return VectorStreamReader(self._options(), self.kind)

    def writer(self, schema: StructType, overwrite: bool):
        return VectorWriter(self._options(), self.kind, schema, overwrite)


class IntVectorFiles(VectorFiles):
    kind = "ibin"


class ByteVectorFiles(VectorFiles):
    kind = "u8bin"


class NpyFiles(VectorFiles):
    kind = "npy"

    def writer(self, schema: StructType, overwrite: bool):
        raise NotImplementedError("npy files are read only")


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, and let conditions on ``id`` reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (VectorFiles, IntVectorFiles, ByteVectorFiles, NpyFiles):
        spark.dataSource.register(source)


FILE_BYTES = 256 << 20  # of a written file: a task holds one in memory


def write_vectors(df: DataFrame, path: str, fmt: str = "fbin", id: str = "id", vec: str = "vector", files: int | None = None, prefix: str = "") -> None:
    """Write vectors in id order, one file per range of ids. Names of files begin with ``prefix``.

    A task holds one file in memory; unless ``files`` is given, rows and their
    width are counted for files of FILE_BYTES at most on average.
    """
    spark = df.sparkSession
    register(spark)
    rows = df.select(id, F.col(vec).alias("vector"))
    if files is None:
        files = max(1, -(-(rows.agg(F.sum(F.size("vector"))).first()[0] or 0) * 4 // FILE_BYTES))
    ranged = rows.repartitionByRange(files, F.col(id))
    ranged.sortWithinPartitions(id).select("vector").write.format(fmt).option("prefix", prefix).mode("append").save(qualified(spark, path))


def read_vectors(spark: SparkSession, path: str, fmt: str = "fbin", **options) -> DataFrame:
    register(spark)
    return spark.read.format(fmt).options(**options).load(qualified(spark, path))


def stream_vectors(spark: SparkSession, path: str, fmt: str = "fbin", **options) -> DataFrame:
    """Vector files of a folder as a stream of ``(id, vector)``; ids count from 0 over all files."""
    register(spark)
    return spark.readStream.format(fmt).options(**options).load(qualified(spark, path))


def vector_count(spark: SparkSession, path: str, fmt: str = "fbin") -> int:
    """Number of vectors, from the file headers only."""
    return read_vectors(spark, path, fmt, headerOnly="true").agg(F.sum("n")).first()[0]


def write_tsv(df: DataFrame, path: str, total: int, vec: str = "vector", id: str = "id") -> None:
    """The first ``total`` vectors (ids from 0) as tab-separated text, one line each, in id order per file."""
    cells = F.transform(F.col(vec).cast("array<double>"), lambda x: F.format_string("%.18e", x))
    first = df.where((F.col(id) >= 0) & (F.col(id) < total))
    lines = first.repartitionByRange(F.col(id)).sortWithinPartitions(id).select(F.array_join(cells, "\t").alias("value"))
    lines.write.text(path)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split("value", "\t").cast("array<double>").alias("vector"))


def synthetic(spark: SparkSession, n: int, dim: int, seed: int = 0) -> DataFrame:
    """``(id, vector)`` with components uniform in [0, 1), repeatable from md5."""
    from nearfield.functions.hashing import hash32

    cell = lambda i: hash32(F.concat_ws(":", F.lit(seed), "id", i)) / float(1 << 32)
    return spark.range(n).select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), cell).alias("vector"))
