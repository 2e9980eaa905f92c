"""Python data sources for files that Spark has no format for.

matrix_file    big-endian matrix files, read by ranges of rows, written as complete
               files of bounded size
archive_lines  the lines of the members of tar archives, streamed
numbered_files a sink of text files, each with a header and a number in its name

Files are opened through the file system that a path names. Writers name their
files anew; the driver's commit makes them known (by a manifest, or by giving them
their names), so files of lost or repeated tasks are never read.
"""

from __future__ import annotations

import fnmatch
import json
import os
import struct
import tarfile
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of values or lines that are read, or written as one matrix file, at once.
CHUNK_BYTES = 16 << 20
MANIFEST = "manifest.json"


def absolute(path: str) -> str:
    """A path that means the same to the driver and to tasks: relative ones start from the driver's folder."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return path if "://" in path else os.path.abspath(path)


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an absolute path or URI, and the path in it."""
    found, place = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return found, place.rstrip("/")


def files_of(path: str) -> list[str]:
    """The files that a file's path, a folder or a pattern in a folder stands for; a manifest in the folder chooses."""
    files, place = open_path(path)
    info = files.get_file_info(place)
    if info.type == fs.FileType.File:
        return [path]
    base, folder, pattern = path.rstrip("/"), place, "*"
    if info.type != fs.FileType.Directory:
        (base, pattern), folder = path.rsplit("/", 1), place.rsplit("/", 1)[0]
    found = sorted(x.base_name for x in files.get_file_info(fs.FileSelector(folder)) if x.type == fs.FileType.File)
    if MANIFEST in found:
        with files.open_input_stream(f"{folder}/{MANIFEST}") as f:
            found = json.loads(f.read())
    names = [n for n in found if fnmatch.fnmatch(n, pattern) and n[0] not in "._"]
    if not names and info.type != fs.FileType.Directory:
        raise FileNotFoundError(path)
    return [f"{base}/{n}" for n in names]


class Buffered:
    """Reads a file from an offset on, in chunks."""

    def __init__(self, f: pa.NativeFile, at: int):
        f.seek(at)
        self.f, self.at, self.held, self.used = f, at, b"", 0

    def take(self, n: int) -> bytes:
        if len(self.held) - self.used < n:
            self.held = self.held[self.used :] + self.f.read(max(n, 1 << 20))
            self.used = 0
            if len(self.held) < n:
                raise ValueError("the file ends in its names")
        self.used += n
        self.at += n
        return self.held[self.used - n : self.used]

    def name(self) -> str:
        return self.take(struct.unpack(">i", self.take(4))[0]).decode()


# ---------------------------------------------------------------- matrix files


@dataclass
class Rows(InputPartition):
    path: str
    first: int
    end: int
    columns: int
    names_at: int | None
    data_at: int


@dataclass
class Named(WriterCommitMessage):
    names: list = field(default_factory=list)


def matrix_header(rows: int, columns: Sequence[str], width: int, ids: Sequence[str]) -> bytes:
    out = [struct.pack(">8i", rows, 0, width, 0, 1, int(bool(columns)), 0, 0)]
    for name in [*ids, *columns]:
        raw = name.encode()
        out += [struct.pack(">i", len(raw)), raw]
    return b"".join(out)


class MatrixFiles(DataSource):
    """Format matrix_file: (id string, values array<double>). Options: path; rows_per_task for reads; columns, a comma list, for writes."""

    @classmethod
    def name(cls) -> str:
        return "matrix_file"

    def schema(self) -> str:
        return "id string, values array<double>"

    def reader(self, schema: Any) -> DataSourceReader:  # noqa: ARG002
        return MatrixReader(self.options["path"], int(self.options.get("rows_per_task", 0)))

    def writer(self, schema: Any, overwrite: bool) -> DataSourceArrowWriter:  # noqa: ARG002
        return MatrixWriter(self.options["path"], [c for c in self.options.get("columns", "").split(",") if c])


class MatrixReader(DataSourceReader):
    def __init__(self, path: str, step: int):
        self.path, self.step = path, step

    def partitions(self) -> list[Rows]:
        out = []
        for path in files_of(self.path):
            files, place = open_path(path)
            with files.open_input_file(place) as f:
                rows, _, columns, _, has_ids, has_columns, _, _ = struct.unpack(">8i", f.read(32))
                step = self.step or max(1, CHUNK_BYTES // max(8 * columns, 1))
                names, starts = Buffered(f, 32), []
                for r in range(rows if has_ids else 0):
                    if r % step == 0:
                        starts.append(names.at)
                    names.name()
                for _ in range(columns if has_columns else 0):
                    names.name()
                if f.size() != names.at + 8 * rows * columns:
                    raise ValueError(f"{path} has not the size of {rows} x {columns} values")
                out += [Rows(path, r, min(r + step, rows), columns, starts[r // step] if has_ids else None, names.at) for r in range(0, rows, step)]
        return out or [Rows("", 0, 0, 0, None, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        p = partition
        if p.first == p.end:
            return
        files, place = open_path(p.path)
        step = max(1, CHUNK_BYTES // max(8 * p.columns, 1))
        with files.open_input_file(place) as f, files.open_input_file(place) as g:
            names = None if p.names_at is None else Buffered(g, p.names_at)
            f.seek(p.data_at + 8 * p.columns * p.first)
            for lo in range(p.first, p.end, step):
                n = min(step, p.end - lo)
                x = np.frombuffer(f.read(8 * p.columns * n), ">f8").astype(float)
                ids = [str(lo + k) if names is None else names.name() for k in range(n)]
                offsets = np.arange(n + 1, dtype=np.int32) * p.columns
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(x))], names=["id", "values"])


class MatrixWriter(DataSourceArrowWriter):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Named:
        from pyspark import TaskContext

        files, place = open_path(self.path)
        files.create_dir(place, recursive=True)
        part, done = TaskContext.get().partitionId(), Named()
        ids: list[str] = []
        values: list[np.ndarray] = []

        def flush() -> None:
            name = f"part-{part:06d}-{len(done.names):06d}-{uuid.uuid4().hex}.bin"
            with files.open_output_stream(f"{place}/{name}") as f:
                f.write(matrix_header(len(ids), self.columns, len(values[0]), ids))
                for v in values:
                    f.write(v.astype(">f8").tobytes())
            done.names.append(name)
            ids.clear()
            values.clear()

        for batch in iterator:
            for i, v in zip(batch.column("id").to_pylist(), batch.column("values"), strict=True):
                x = np.array(v.values.to_numpy(zero_copy_only=False), float)
                if self.columns and len(x) != len(self.columns) or values and len(x) != len(values[0]):
                    raise ValueError(f"row {i} has {len(x)} values, not {len(self.columns) or len(values[0])}")
                ids.append(i)
                values.append(x)
                if 8 * len(x) * len(values) >= CHUNK_BYTES:
                    flush()
        if ids:
            flush()
        return done

    def commit(self, messages: list[Any]) -> None:
        files, place = open_path(self.path)
        files.create_dir(place, recursive=True)
        with files.open_output_stream(f"{place}/{MANIFEST}") as f:
            f.write(json.dumps(sorted(n for m in messages if m for n in m.names)).encode())

    def abort(self, messages: list[Any]) -> None:
        files, place = open_path(self.path)
        for n in (n for m in messages if m for n in m.names):
            files.delete_file(f"{place}/{n}")


# ---------------------------------------------------------------- archives


@dataclass
class Archive(InputPartition):
    path: str


class ArchiveLines(DataSource):
    """Format archive_lines: (name string, value string). Options: path, suffixes (a comma list)."""

    @classmethod
    def name(cls) -> str:
        return "archive_lines"

    def schema(self) -> str:
        return "name string, value string"

    def reader(self, schema: Any) -> DataSourceReader:  # noqa: ARG002
        return ArchiveReader(self.options["path"], tuple(self.options.get("suffixes", "").split(",")))


class ArchiveReader(DataSourceReader):
    """A compressed archive is one stream, so one task reads it, holding a few MB of it at a time."""

    def __init__(self, path: str, suffixes: tuple[str, ...]):
        self.path, self.suffixes = path, suffixes

    def partitions(self) -> list[Archive]:
        return [Archive(p) for p in files_of(self.path)]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        files, place = open_path(partition.path)
        batch = lambda name, lines: pa.RecordBatch.from_arrays([pa.array([name] * len(lines), pa.string()), pa.array(lines, pa.string())], names=["name", "value"])
        with files.open_input_stream(place, compression=None) as raw, tarfile.open(fileobj=raw, mode="r|*") as tar:
            for member in tar:
                if not member.isfile() or not member.name.lower().endswith(self.suffixes):
                    continue
                lines, held = [], 0
                for line in tar.extractfile(member):
                    lines.append(line.decode().rstrip("\r\n"))
                    held += len(line)
                    if held >= CHUNK_BYTES // 4 or len(lines) == 10_000:
                        yield batch(member.name, lines)
                        lines, held = [], 0
                yield batch(member.name, lines)


# ---------------------------------------------------------------- numbered files


class NumberedFiles(DataSource):
    """Format numbered_files, a sink of (file_no long, line string); rows of a number come together, in one task.

    Options: path (a folder), prefix, suffix, header (a line). File k is named
    prefix, k, suffix.
    """

    @classmethod
    def name(cls) -> str:
        return "numbered_files"

    def writer(self, schema: Any, overwrite: bool) -> DataSourceArrowWriter:  # noqa: ARG002
        return NumberedWriter(dict(self.options))


class NumberedWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.prefix, self.suffix, self.header = options["path"], options.get("prefix", ""), options.get("suffix", ""), options.get("header")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Named:
        files, place = open_path(self.path)
        files.create_dir(place, recursive=True)
        done, out, here = Named(), None, None
        try:
            for batch in iterator:
                numbers, lines = batch.column("file_no").to_numpy(), batch.column("line").to_pylist()
                cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(lines)]
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    if lo == hi:
                        continue
                    if numbers[lo] != here:
                        if out is not None:
                            out.close()
                        here = int(numbers[lo])
                        name = f"._{here}-{uuid.uuid4().hex}"
                        out = files.open_output_stream(f"{place}/{name}")
                        done.names.append((here, name))
                        if self.header is not None:
                            out.write(f"{self.header}\n".encode())
                    out.write("".join(f"{x}\n" for x in lines[lo:hi]).encode())
        finally:
            if out is not None:
                out.close()
        return done

    def commit(self, messages: list[Any]) -> None:
        files, place = open_path(self.path)
        for number, name in (n for m in messages if m for n in m.names):
            files.move(f"{place}/{name}", f"{place}/{self.prefix}{number}{self.suffix}")

    def abort(self, messages: list[Any]) -> None:
        files, place = open_path(self.path)
        for _, name in (n for m in messages if m for n in m.names):
            files.delete_file(f"{place}/{name}")


def registered(spark: SparkSession) -> SparkSession:
    """spark with these formats."""
    for source in (MatrixFiles, ArchiveLines, NumberedFiles):
        spark.dataSource.register(source)
    return spark


def write_matrix_files(df: DataFrame, path: str, columns: Sequence[str] = ()) -> None:
    """(id, values) as a folder of complete matrix files; NULL cells are NaN."""
    rows = df.selectExpr("cast(id as string) as id", "transform(values, x -> coalesce(cast(x as double), double('NaN'))) as values")
    registered(df.sparkSession)
    rows.write.format("matrix_file").mode("append").option("path", absolute(path)).option("columns", ",".join(columns)).save()
