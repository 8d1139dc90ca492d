"""A data source for ``.npz`` archives: zip files whose members are arrays.

``spark.read.format("npz")`` has two layouts.

* ``members``: a row for each member, with ``path``, ``key`` (the member's name),
  ``kind`` (numpy's name of its type), ``shape``, ``data`` (bytes in C order) and
  ``error``.  A schema without ``data`` reads headers only, one without ``kind``
  and ``shape`` besides reads only the zip directory.  Large archives are cut by
  members, so one archive is read by many tasks.
* ``rows``: the members are columns and their first axis the rows.  The schema
  names the members wanted, no others are opened; ``path``, ``row`` (the number
  along the axis), ``opened`` (members opened in this archive) and ``error`` are
  the reader's own.  A scalar column takes one value of a row, an array column
  all of them, flattened.  Rows are streamed, some at a time.

Members are looked up in the zip directory by the options ``keys`` (a JSON list)
and ``prefix``; no others are opened, and one task looks up many archives.
``lookup`` fills them in.  They are options and not filters that Spark pushes
down, because Spark 4.1 keeps what was pushed with the table: the same
DataFrame, used again without the filter, would miss rows.

Other options: ``layout``; ``pattern`` of file names (``*.npz``); ``index``, the
member whose length is the number of rows (``frame_indices``; without it, the
longest of the members wanted); ``target_mb`` of a task (64); ``damaged``:
``fail`` (default) or ``report``.

Defined results: a member that an archive lacks is null in all its rows, and so
are rows beyond a shorter member's end; a member without axes has the same value
in every row; an archive without members has no rows; what is damaged (a
truncated archive, a wrong checksum, pickled objects, a type that does not fit)
ends the read with its path, or with ``report`` gives one row that has ``path``
and ``error`` only, after the rows before it.  Duplicate names count as the last.
"""

from __future__ import annotations

import fnmatch
import io
import json
import uuid
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import IO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

MEMBERS = "path string, key string, kind string, shape array<int>, data binary, error string"
#: Rows of the ``rows`` layout that a task holds at a time, and at most so many bytes.
ROWS, BYTES = 1024, 32 << 20
_OWN = ("path", "row", "opened", "error")
_DAMAGE = (zipfile.BadZipFile, zlib.error, EOFError, ValueError, OSError, NotImplementedError, TypeError, KeyError)


def register(spark: SparkSession) -> None:
    """Make ``npz`` a format of this session."""
    spark.dataSource.register(ArchiveSource)


def lookup(spark: SparkSession, root: str, keys: list[str] | None = None, prefix: str = "", pattern: str = "*.npz") -> DataFrame:
    """Members by their names: those in ``keys`` (all, if None) that begin with ``prefix``."""
    register(spark)
    rows = spark.read.format("npz").option("pattern", pattern).option("prefix", prefix)
    return (rows if keys is None else rows.option("keys", json.dumps(keys))).load(root)


@dataclass
class Slice(InputPartition):
    """(path, number, count): of ``count`` equal parts of an archive's members this one."""

    pieces: list[tuple[str, int, int]] = field(default_factory=list)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        if self.options.get("layout", "members") != "members":
            raise ValueError("the layout rows needs a schema that names the members wanted")
        return MEMBERS

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(schema, dict(self.options))


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, which may be a URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def found(path: str, pattern: str) -> list[tuple[str, int]]:
    """Paths and sizes of the files below a folder (or the file itself) that match, in order."""
    path = path.rstrip("/")
    where, inner = store(path)
    front = path.removesuffix(inner)  # what a URI has before the path: scheme and host
    info = where.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    infos = [info] if info.is_file else where.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted((front + i.path, i.size) for i in infos if i.is_file and (info.is_file or fnmatch.fnmatch(i.base_name, pattern)))


def header(stream: IO[bytes]) -> tuple[tuple[int, ...], bool, np.dtype]:
    """Shape, Fortran order and type of an array, read from its first bytes."""
    version = np.lib.format.read_magic(stream)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(stream)
    if kind.hasobject:
        raise ValueError("pickled objects are not read")
    return shape, fortran, kind


class Seekable(io.RawIOBase):
    """A file of a file system as Python's own libraries want it: a seek before its start is an OSError."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size = file, file.size()

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        at = offset + (0, self.file.tell(), self.size)[whence]
        if at < 0:
            raise OSError("before the start of the file")
        self.file.seek(at)
        return at

    def readinto(self, into) -> int:
        raw = self.file.read(len(into))
        into[: len(raw)] = raw
        return len(raw)


def exactly(stream: IO[bytes], size: int) -> bytes:
    raw = stream.read(size)
    if len(raw) != size:
        raise EOFError(f"{size} bytes expected, {len(raw)} there")
    return raw


def members(archive: zipfile.ZipFile) -> dict[str, str]:
    """The zip directory: the name of each array, and of its member."""
    return {n.removesuffix(".npy"): n for n in archive.namelist() if n.endswith(".npy")}


class Member:
    """One member as a stream of rows."""

    def __init__(self, archive: zipfile.ZipFile, name: str, kind: pa.DataType):
        self.stream = archive.open(name)
        self.shape, fortran, self.dtype = header(self.stream)
        self.kind = kind
        self.width = int(np.prod(self.shape[1:], dtype=np.int64)) if self.shape else 1
        if not pa.types.is_list(kind) and self.width != 1:
            raise ValueError(f"{name}: a row has {self.width} values, the column takes one")
        self.whole = None
        if fortran or not self.shape:
            count = int(np.prod(self.shape, dtype=np.int64))
            flat = np.frombuffer(exactly(self.stream, count * self.dtype.itemsize), self.dtype)
            self.whole = flat.reshape(self.shape, order="F" if fortran else "C").reshape(-1, self.width)
        self.at = 0

    def __len__(self) -> int:
        return self.shape[0] if self.shape else 0

    def take(self, n: int) -> pa.Array:
        """The next ``n`` rows; null beyond the end."""
        if not self.shape:
            rows = np.repeat(self.whole, n, 0)
        else:
            have = max(0, min(n, len(self) - self.at))
            rows = self.whole[self.at : self.at + have] if self.whole is not None else np.frombuffer(exactly(self.stream, have * self.width * self.dtype.itemsize), self.dtype).reshape(have, self.width)
            self.at += have
            if self.at >= len(self) and self.whole is None and self.stream.read(1):  # reads to the end, where the checksum is compared
                raise ValueError("more bytes than the header says")
        values = pa.array(np.ascontiguousarray(rows).reshape(-1).astype(self.dtype.newbyteorder("=")))
        if pa.types.is_list(self.kind):
            out = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * self.width), values.cast(self.kind.value_type, safe=False))
        else:
            out = values.cast(self.kind, safe=False)
        return pa.concat_arrays([out, pa.nulls(n - len(rows), out.type)]) if len(rows) < n else out


class ArchiveReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options = schema, options
        self.by_rows = options.get("layout", "members") == "rows"
        self.keys = set(json.loads(options["keys"])) if "keys" in options else None
        self.prefix = options.get("prefix", "")
        if not self.by_rows:
            known = {f.split()[0] for f in MEMBERS.split(", ")}
            if unknown := [f.name for f in schema.fields if f.name not in known]:
                raise ValueError(f"the layout members has no {unknown}")

    def wanted(self, key: str) -> bool:
        return (self.keys is None or key in self.keys) and key.startswith(self.prefix)

    def partitions(self) -> Sequence[Slice]:
        """Archives by size: small ones share a task, the members of large ones are dealt out."""
        target = max(1, int(float(self.options.get("target_mb", "64")) * (1 << 20)))
        out, held, size = [], [], 0
        for path, length in found(self.options["path"], self.options.get("pattern", "*.npz")):
            count = 1 if self.by_rows or self.keys is not None else max(1, -(-length // target))
            if count > 1:
                out += [Slice([(path, k, count)]) for k in range(count)]
                continue
            if held and size + length > target:
                out.append(Slice(held))
                held, size = [], 0
            held.append((path, 0, 1))
            size += length
        if held:
            out.append(Slice(held))
        return out or [Slice([])]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        for path, number, count in partition.pieces:
            where, inner = store(path)
            directory_read = False
            try:
                with where.open_input_file(inner) as raw, zipfile.ZipFile(io.BufferedReader(Seekable(raw), 1 << 16)) as archive:
                    directory_read = True
                    yield from self.row_batches(archive, path, schema) if self.by_rows else self.member_rows(archive, path, schema, number, count)
            except _DAMAGE as e:
                said = f"{path}: {type(e).__name__}: {e}"
                if self.options.get("damaged", "fail") != "report":
                    raise ValueError(f"damaged archive {said}") from e
                # every task finds that the directory is damaged: it is told once
                if number == 0 or directory_read:
                    yield self.batch(schema, 1, {"path": [path], "error": [said]})

    @staticmethod
    def batch(schema: pa.Schema, n: int, columns: dict) -> pa.RecordBatch:
        """Columns that are not given are null."""
        return pa.record_batch([columns[f.name] if isinstance(columns.get(f.name), pa.Array) else pa.array(columns.get(f.name, [None] * n), f.type) for f in schema], schema=schema)

    def member_rows(self, archive: zipfile.ZipFile, path: str, schema: pa.Schema, number: int, count: int) -> Iterator[pa.RecordBatch]:
        names = members(archive)
        order = sorted(names)
        some = [k for k in order[len(order) * number // count : len(order) * (number + 1) // count] if self.wanted(k)]
        with_data, with_header = "data" in schema.names, "kind" in schema.names or "shape" in schema.names
        for key in some:
            row: dict = {"path": [path], "key": [key]}
            if with_data or with_header:
                with archive.open(names[key]) as stream:
                    shape, fortran, kind = header(stream)
                    row |= {"kind": [kind.str], "shape": [list(shape)]}
                    if with_data:
                        raw = exactly(stream, int(np.prod(shape, dtype=np.int64)) * kind.itemsize)
                        if stream.read(1):
                            raise ValueError("more bytes than the header says")
                        row["data"] = [np.frombuffer(raw, kind).reshape(shape, order="F").tobytes() if fortran else raw]
            yield self.batch(schema, 1, row)

    def row_batches(self, archive: zipfile.ZipFile, path: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        names = members(archive)
        columns = {f.name: Member(archive, names[f.name], f.type) for f in schema if f.name in names and f.name not in _OWN}
        index = self.options.get("index", "frame_indices")
        opened = len(columns)
        if index in columns:
            total = len(columns[index])
        elif index in names:
            with archive.open(names[index]) as stream:
                shape, _, _ = header(stream)
                total, opened = (shape[0] if shape else 0), opened + 1
        else:
            total = max(map(len, columns.values()), default=0)
        wide = sum(c.width * max(c.dtype.itemsize, 8) for c in columns.values())
        step = max(1, min(ROWS, BYTES // max(wide, 1)))
        for s in range(0, total, step):
            n = min(step, total - s)
            own = {name: c.take(n) for name, c in columns.items()}
            own |= {"path": pa.array([path] * n), "row": pa.array(np.arange(s, s + n)), "opened": pa.array([opened] * n)}
            yield self.batch(schema, n, {f.name: own[f.name].cast(f.type) if f.name in _OWN else own[f.name] for f in schema if f.name in own})




def write_rows(rows: DataFrame, root: str, keys: list[str], order: str, fields: list[str], name: Column) -> DataFrame:
    """One archive for each group of ``keys``: members are ``fields``, rows in ``order``.

    ``name`` is the archive's path below ``root``.  A scalar field becomes an array
    of one axis, an array field one of two; a field that is null in some row of
    a group, or whose arrays differ in length, is left out of its archive.  Each
    archive is written aside and renamed, so a task that is run again replaces
    what it wrote.  Returns ``path`` and ``n_rows`` of the archives; they are there
    once these rows have been read.
    """
    wanted = rows.select(F.concat(F.lit(root.rstrip("/") + "/"), name).alias("path"), *{*keys} - {*fields, order}, *dict.fromkeys([order, *fields]))
    placed = wanted.repartition(*keys).sortWithinPartitions("path", order).select("path", *fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out():
            table = pa.Table.from_batches(held)
            path = held[0].column(0)[0].as_py()
            held.clear()
            _write(path, {f: a for f in fields if (a := dense(table[f].combine_chunks())) is not None})
            return pa.record_batch([pa.array([path]), pa.array([len(table)], pa.int64())], names=["path", "n_rows"])

        for b in batches:
            paths = b.column(0).to_pylist()
            cuts = [0, *(k for k in range(1, len(paths)) if paths[k] != paths[k - 1]), len(paths)]
            for a, e in zip(cuts, cuts[1:]):
                if held and held[0].column(0)[0].as_py() != paths[a]:
                    yield out()
                held.append(b.slice(a, e - a))
        if held:
            yield out()

    return placed.mapInArrow(run, "path string, n_rows long")


def dense(values: pa.Array) -> np.ndarray | None:
    """A column as an array of one axis or, from lists of one length, of two."""
    if values.null_count:
        return None
    if not pa.types.is_list(values.type):
        return values.to_numpy(zero_copy_only=False)
    sizes = np.diff(np.asarray(values.offsets))
    flat = values.flatten()
    if len(sizes) == 0 or (sizes != sizes[0]).any() or flat.null_count:
        return None
    return flat.to_numpy(zero_copy_only=False).reshape(len(sizes), sizes[0])


def _write(path: str, arrays: dict[str, np.ndarray]) -> None:
    where, inner = store(path)
    where.create_dir(inner.rpartition("/")[0], recursive=True)
    aside = f"{inner}.{uuid.uuid4().hex}.part"
    with where.open_output_stream(aside) as raw, zipfile.ZipFile(raw, "w", compression=zipfile.ZIP_DEFLATED) as archive:
        for name, a in arrays.items():
            with archive.open(f"{name}.npy", "w", force_zip64=True) as out:
                np.lib.format.write_array(out, np.ascontiguousarray(a), allow_pickle=False)
    where.move(aside, inner)
