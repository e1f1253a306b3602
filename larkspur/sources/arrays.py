"""Array files and matrices in row-range files as data sources.

``array_files`` reads .npy files that share their first dimension (images, labels):
one partition for every stretch of rows, each of which reads just its rows of just
the columns asked for.  ``row_matrix`` writes a matrix as files of consecutive
rows of one client each and a manifest; a reader opens only the files that hold
rows asked for, by options or by pushed-down filters on client_id and row.

A write becomes visible with its manifest, which ``commit`` puts in place last.
Tasks write below a folder of their job; what a failed task or job leaves there
is in no manifest and goes with that folder.  Paths are of any file system that
Arrow can open (a plain path is local, or shared by all machines).
"""

from __future__ import annotations

import ast
import json
import math
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

_ROWS = "rows_per_partition"


def _fs(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


# -- array files


@dataclass
class ArrayFile:
    path: str
    dtype: str
    shape: tuple[int, ...]
    offset: int

    @classmethod
    def of(cls, path: str) -> ArrayFile:
        """The header of a .npy file (versions 1 to 3, rows first in memory)."""
        fs, at = _fs(path)
        with fs.open_input_file(at) as f:
            start = f.read(8)
            if start[:6] != b"\x93NUMPY":
                raise ValueError(f"{path} is no array file")
            wide = 2 if start[6] == 1 else 4
            n = int.from_bytes(f.read(wide), "little")
            head = ast.literal_eval(f.read(n).decode("latin-1" if start[6] < 3 else "utf-8"))
        if head["fortran_order"] and len(head["shape"]) > 1:
            raise ValueError(f"{path} holds columns first")
        if np.dtype(head["descr"]).kind not in "iufb":
            raise ValueError(f"{path} holds no numbers")
        return cls(path, head["descr"], tuple(head["shape"]), 8 + wide + n)

    def rows(self, first: int, end: int) -> np.ndarray:
        kind = np.dtype(self.dtype)
        size = math.prod(self.shape[1:]) * kind.itemsize
        fs, at = _fs(self.path)
        with fs.open_input_file(at) as f:
            data = f.read_at((end - first) * size, self.offset + first * size)
        return np.frombuffer(data, kind).reshape(end - first, -1)

    def spark_type(self) -> str:
        kind = np.dtype(self.dtype)
        name = {"f": "float" if kind.itemsize <= 4 else "double", "b": "boolean"}.get(kind.kind)
        name = name or {1: "short" if kind.kind == "u" else "byte", 2: "int" if kind.kind == "u" else "short", 4: "long" if kind.kind == "u" else "int"}.get(kind.itemsize, "long")
        return name if len(self.shape) == 1 else f"array<{name}>"


@dataclass
class _Stretch(InputPartition):
    first: int = 0
    end: int = 0


def _row_range(filters: list[Filter], low: int, high: int) -> tuple[int, int, list[Filter]]:
    """(first row, end, filters that this doesn't settle)."""
    rest = []
    for f in filters:
        one = getattr(f, "attribute", None) == ("row",) and getattr(f, "value", None) is not None
        if one and isinstance(f, EqualTo):
            low, high = max(low, f.value), min(high, f.value + 1)
        elif one and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            low = max(low, f.value + isinstance(f, GreaterThan))
        elif one and isinstance(f, (LessThan, LessThanOrEqual)):
            high = min(high, f.value + isinstance(f, LessThanOrEqual))
        else:
            rest.append(f)
    return low, max(low, high), rest


class ArrayFiles(DataSource):
    """Options: ``files`` (JSON: column name to path), ``rows_per_partition``.  Columns: row, then those of the files; arrays are flat."""

    @classmethod
    def name(cls) -> str:
        return "array_files"

    def _files(self) -> dict[str, ArrayFile]:
        found = {c: ArrayFile.of(p) for c, p in json.loads(self.options["files"]).items()}
        if len({x.shape[:1] for x in found.values()}) > 1 or any(not x.shape for x in found.values()):
            raise ValueError("files of different numbers of rows")
        return found

    def schema(self) -> str:
        return ", ".join(["row long", *[f"{c} {x.spark_type()}" for c, x in self._files().items()]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ArrayReader(self._files(), schema.names, int(self.options.get(_ROWS, 65536)))


class _ArrayReader(DataSourceReader):
    def __init__(self, files: dict[str, ArrayFile], names: list[str], step: int):
        self.files, self.names, self.step = files, names, step
        self.low, self.high = 0, next(iter(files.values())).shape[0]

    def pushFilters(self, filters: list[Filter]):
        self.low, self.high, rest = _row_range(filters, self.low, self.high)
        yield from rest

    def partitions(self) -> list[_Stretch]:
        return [_Stretch(a, min(a + self.step, self.high)) for a in range(self.low, self.high, self.step)] or [_Stretch(0, 0)]

    def read(self, part: _Stretch) -> Iterator[pa.RecordBatch]:
        if part.end <= part.first:
            return
        columns = {}
        for c in self.names:
            if c == "row":
                columns[c] = pa.array(np.arange(part.first, part.end))
                continue
            x = self.files[c].rows(part.first, part.end)
            kind = {"u1": np.int16, "u2": np.int32, "u4": np.int64, "u8": np.int64, "f2": np.float32}.get(x.dtype.str[1:], x.dtype.newbyteorder("="))
            flat = pa.array(x.astype(kind).ravel())
            columns[c] = flat if len(self.files[c].shape) == 1 else pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), flat)
        yield pa.RecordBatch.from_pydict(columns)


def _registered(spark: SparkSession, source: type[DataSource]) -> None:
    # Sources that take filters need this switch, from here on in the session; sources that don't are not touched by it.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    # Planning and reading run in processes of their own, without packages sent by addPyFile: the code goes along.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(source)


def array_files(spark: SparkSession, files: dict[str, str], rows_per_partition: int = 65536) -> DataFrame:
    """(row, a column for each file), rows lined up; name only the files whose columns are needed."""
    _registered(spark, ArrayFiles)
    return spark.read.format("array_files").options(files=json.dumps(files), **{_ROWS: rows_per_partition}).load()


def image_samples(images: DataFrame, image: str, label: str, top: float = 255.0, classes: int | None = None) -> DataFrame:
    """(row, x: the flat image scaled to 0..1, y: the label, or one-hot with ``classes``)."""
    y = F.col(label).cast("int")
    if classes is not None:
        y = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.when(k == F.col(label), 1).otherwise(0))
    return images.select("row", F.transform(image, lambda v: v.cast("double") / top).alias("x"), y.alias("y"))


def attributes(spark: SparkSession, path: str) -> DataFrame:
    """(name, attribute, value: 0 or 1) of a text file: a count, the attributes' names, then a name and +-1 values a line."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("w"), F.monotonically_increasing_id().alias("k")).where(F.size("w") > 1)
    names = spark.read.text(path).limit(2).collect()[1]["value"].split()
    rows = lines.where((F.size("w") == len(names) + 1) & F.try_element_at("w", F.lit(2)).rlike("^-?1$"))
    pairs = F.arrays_zip(F.array(*map(F.lit, names)).alias("attribute"), F.slice("w", 2, len(names)).alias("value"))
    return rows.select(F.col("w")[0].alias("name"), F.explode(pairs).alias("p")).select("name", F.col("p.attribute").alias("attribute"), F.when(F.col("p.value") == "1", 1).otherwise(0).alias("value"))


def identities(spark: SparkSession, path: str) -> DataFrame:
    """(name, owner) of lines of a name and a number."""
    w = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(w[0].alias("name"), w[1].cast("long").alias("owner")).where("owner is not null")


def labelled_images(images: DataFrame, attributes_: DataFrame, identities_: DataFrame, attribute: str) -> DataFrame:
    """Images (name, ...) with their owner and the value of one attribute as y."""
    chosen = attributes_.where(F.col("attribute") == attribute).select("name", F.col("value").alias("y"))
    return images.join(chosen, "name").join(identities_, "name")


# -- matrices in row-range files


@dataclass
class _Part:
    client: int
    first: int
    rows: int
    width: int
    file: str


@dataclass
class _Written(WriterCommitMessage):
    parts: list[_Part] = field(default_factory=list)


class RowMatrix(DataSource):
    """Columns client_id, row, x (doubles, of one length for a client).  Options: path; for reading client, first, end, rows_per_partition."""

    @classmethod
    def name(cls) -> str:
        return "row_matrix"

    def schema(self) -> str:
        return "client_id long, row long, x array<double>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _MatrixReader(self.options, schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _MatrixWriter(self.options["path"], overwrite, int(self.options.get("rows_per_file", 1 << 20)))


def _manifests(fs: pa.fs.FileSystem, at: str) -> list[str]:
    found = fs.get_file_info(pa.fs.FileSelector(at, allow_not_found=True))
    return sorted(x.path for x in found if x.base_name.startswith("manifest-") and x.base_name.endswith(".json"))


def _parts(path: str) -> list[_Part]:
    fs, at = _fs(path)
    out = []
    for m in _manifests(fs, at):
        with fs.open_input_stream(m) as f:
            out += [_Part(**x) for x in json.loads(f.read())]
    return out


class _MatrixReader(DataSourceReader):
    def __init__(self, options: dict[str, str], names: list[str]):
        self.path, self.names, self.step = options["path"], names, int(options.get(_ROWS, 65536))
        self.clients = {int(options["client"])} if "client" in options else None
        self.low, self.high = int(options.get("first", 0)), int(options.get("end", 1 << 62))

    def pushFilters(self, filters: list[Filter]):
        self.low, self.high, rest = _row_range(filters, self.low, self.high)
        for f in rest:
            if getattr(f, "attribute", None) == ("client_id",) and isinstance(f, (EqualTo, In)):
                asked = set(f.value) if isinstance(f, In) else {f.value}
                self.clients = asked if self.clients is None else self.clients & asked
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        out = []
        for p in _parts(self.path):
            if self.clients is not None and p.client not in self.clients:
                continue
            a, b = max(self.low, p.first), min(self.high, p.first + p.rows)
            out += [InputPartition((p, k, min(k + self.step, b))) for k in range(a, b, self.step)]
        return out or [InputPartition(None)]

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        if part.value is None:
            return
        p, first, end = part.value
        fs, at = _fs(self.path)
        with fs.open_input_file(f"{at}/{p.file}") as f:
            data = f.read_at((end - first) * p.width * 8, (first - p.first) * p.width * 8)
        n = end - first
        columns = {"client_id": pa.array([p.client] * n, pa.int64()), "row": pa.array(np.arange(first, end))}
        columns["x"] = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * p.width, pa.int32()), pa.array(np.frombuffer(data, "<f8")))
        yield pa.RecordBatch.from_pydict({c: columns[c] for c in self.names})


class _MatrixWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, most: int):
        self.path, self.overwrite, self.most, self.job = path, overwrite, most, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        fs, at = _fs(self.path)
        fs.create_dir(f"{at}/data-{self.job}", recursive=True)
        done, out = _Written(), None
        try:
            for b in batches:
                lists = b.column("x")
                x, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
                ends = np.cumsum(np.maximum(sizes, 0))
                for client, row, width, end in zip(b.column("client_id").to_pylist(), b.column("row").to_pylist(), sizes.tolist(), ends.tolist()):
                    last = done.parts[-1] if done.parts else None
                    if width < 0 or (last is not None and last.client == client and last.width != width):
                        raise ValueError("a client's rows of different lengths, or null")
                    if last is None or (client, row) != (last.client, last.first + last.rows) or last.rows >= self.most:
                        if out is not None:
                            out.close()
                        last = _Part(client, row, 0, width, f"data-{self.job}/{uuid.uuid4().hex}.bin")
                        done.parts.append(last)
                        out = fs.open_output_stream(f"{at}/{last.file}")
                    out.write(x[end - width : end].astype("<f8").tobytes())
                    last.rows += 1
        except BaseException:
            if out is not None:
                out.close()
            for p in done.parts:
                fs.delete_file(f"{at}/{p.file}")
            raise
        if out is not None:
            out.close()
        return done

    def commit(self, messages: list[_Written | None]) -> None:
        fs, at = _fs(self.path)
        kept = [p for m in messages if m is not None for p in m.parts]
        fs.create_dir(at, recursive=True)
        old = _manifests(fs, at)
        # Files of attempts that Spark gave up on are in no message.
        names = {p.file for p in kept}
        for x in fs.get_file_info(pa.fs.FileSelector(f"{at}/data-{self.job}", allow_not_found=True)):
            if f"data-{self.job}/{x.base_name}" not in names:
                fs.delete_file(x.path)
        with fs.open_output_stream(f"{at}/new-{self.job}") as f:
            f.write(json.dumps([p.__dict__ for p in kept]).encode())
        fs.move(f"{at}/new-{self.job}", f"{at}/manifest-{len(old):08d}-{self.job}.json")
        if self.overwrite:
            for m in old:
                fs.delete_file(m)
            for x in fs.get_file_info(pa.fs.FileSelector(at)):
                if x.base_name.startswith("data-") and x.base_name != f"data-{self.job}":
                    fs.delete_dir(x.path)

    def abort(self, messages: list[_Written | None]) -> None:
        fs, at = _fs(self.path)
        if fs.get_file_info(f"{at}/data-{self.job}").type == pa.fs.FileType.Directory:
            fs.delete_dir(f"{at}/data-{self.job}")


def save_matrix(rows: DataFrame, path: str, mode: str = "overwrite", rows_per_file: int = 1 << 20) -> None:
    """Writes (client_id, row, x): each task holds a range of clients and rows in order, so that its files are long."""
    _registered(rows.sparkSession, RowMatrix)
    cells = rows.select(F.col("client_id").cast("long").alias("client_id"), F.col("row").cast("long").alias("row"), F.col("x").cast("array<double>").alias("x"))
    ordered = cells.repartitionByRange("client_id", "row").sortWithinPartitions("client_id", "row")
    ordered.write.format("row_matrix").options(path=path, rows_per_file=rows_per_file).mode(mode).save()


def load_matrix(spark: SparkSession, path: str, client: int | None = None, first: int | None = None, end: int | None = None, rows_per_partition: int = 65536) -> DataFrame:
    """(client_id, row, x), of one client and a range of rows if asked; other files are not opened."""
    _registered(spark, RowMatrix)
    chosen = {k: v for k, v in (("client", client), ("first", first), ("end", end)) if v is not None}
    return spark.read.format("row_matrix").options(path=path, **{_ROWS: rows_per_partition}, **chosen).load()
