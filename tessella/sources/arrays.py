"""Arrays as tables: a data source for .npy and .npz files, and a stream of the lines of growing logs.

    spark.dataSource.register(ArraySource)
    spark.read.format("array").option("rows", 10_000).load("/shared/vectors.npy")
    df.write.format("array").option("vector", "embedding").mode("append").save("/shared/folder")

Files are opened by executors, so a path has to be one that all of them share.
"""

from __future__ import annotations

import glob
import json
import os
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Rows of one partition of a read, and of one batch of it.
ROWS, BATCH = 100_000, 4096


def _files(path: str) -> list[str]:
    if os.path.isdir(path):
        # what a writer has not committed is not there
        found = sorted(glob.glob(os.path.join(path, "part-*.npy")))
        listed = os.path.join(path, "_committed.json")
        if os.path.exists(listed):
            with open(listed) as f:
                known = set(json.load(f))
            found = [p for p in found if os.path.basename(p) in known]
        return found
    return sorted(glob.glob(path)) or [path]


def _header(file) -> tuple[tuple[int, ...], bool, np.dtype]:
    version = np.lib.format.read_magic(file)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    return read(file)


@dataclass
class Rows(InputPartition):
    """Rows start to end of one array; first is the number of its row 0 over all files."""

    path: str
    member: str
    start: int
    end: int
    first: int

    def read(self) -> Iterator[np.ndarray]:
        if not self.member:
            whole = np.load(self.path, mmap_mode="r")
            for a in range(self.start, self.end, BATCH):
                yield np.asarray(whole[a : min(a + BATCH, self.end)])
            return
        # a member of an archive is read as a stream: what stands before the range is skipped, nothing is kept
        with zipfile.ZipFile(self.path) as z, z.open(self.member) as f:
            shape, _, dtype = _header(f)
            size = int(np.prod(shape[1:], dtype=np.int64)) * dtype.itemsize
            left = self.start * size
            while left:
                left -= len(f.read(min(left, 1 << 20)))
            for a in range(self.start, self.end, BATCH):
                n = min(a + BATCH, self.end) - a
                yield np.frombuffer(f.read(n * size), dtype).reshape(n, *shape[1:])


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("rows", ROWS))
        self.name, self.dim, self.finite = options.get("array", ""), int(options.get("dim", 0)), options.get("finite", "false").lower() == "true"

    def partitions(self) -> list[Rows]:
        """Ranges of rows; the shape is checked here, before any row is read."""
        out, first = [], 0
        for path in _files(self.path):
            members = [""]
            if path.endswith(".npz"):
                with zipfile.ZipFile(path) as z:
                    members = [m for m in z.namelist() if m.endswith(".npy") and self.name in ("", m.removesuffix(".npy"))]
                if len(members) != 1:
                    raise ValueError(f"{path}: name one of its arrays by the option array")
            for member in members:
                if member:
                    with zipfile.ZipFile(path) as z, z.open(member) as f:
                        shape, fortran, _ = _header(f)
                    if fortran:
                        raise ValueError(f"{path}: an archived array has to stand row by row")
                else:
                    shape = np.load(path, mmap_mode="r").shape
                if len(shape) != 2 or (self.dim and shape[1] != self.dim):
                    raise ValueError(f"{path}: an array of shape {shape}, where (rows, {self.dim or 'dim'}) is expected")
                out += [Rows(path, member, a, min(a + self.step, shape[0]), first) for a in range(0, shape[0], self.step)]
                first += shape[0]
        return out or [Rows("", "", 0, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        at = partition.first + partition.start
        for block in partition.read() if partition.path else ():
            x = np.ascontiguousarray(block, np.float32)
            if self.finite and not np.isfinite(x).all():
                bad = at + int(np.flatnonzero(~np.isfinite(x).all(axis=1))[0])
                raise ValueError(f"{partition.path}: row {bad} has a value that is no number")
            offsets = pa.array(np.arange(0, x.size + 1, max(x.shape[1], 1), dtype=np.int32)[: len(x) + 1])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(x))), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], ["row", "vector"])
            at += len(x)


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int


class ArrayWriter(DataSourceArrowWriter):
    """Each task writes one file of the vectors it has; a commit lists the files, and replaces what was there if asked."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.column, self.overwrite = options["path"], options.get("vector", "vector"), overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        import uuid

        os.makedirs(self.path, exist_ok=True)
        name, rows, dim = f"part-{uuid.uuid4().hex}.npy", 0, 0
        raw = os.path.join(self.path, f"_{name}")
        with open(raw, "wb") as body:
            for b in batches:
                column = b.column(self.column)
                if column.null_count:
                    raise ValueError("a vector is missing")
                if not b.num_rows:
                    continue
                x = column.flatten().to_numpy(zero_copy_only=False).astype("<f4")
                if dim and x.size != dim * b.num_rows:
                    raise ValueError("vectors of different lengths")
                dim = dim or x.size // b.num_rows
                if np.any(column.value_lengths().to_numpy() != dim):
                    raise ValueError("vectors of different lengths")
                body.write(x.tobytes())
                rows += b.num_rows
        if not rows:
            os.remove(raw)
            return Part("", 0)
        # the header needs the number of rows, which is known at the end
        with open(raw, "rb") as body, open(os.path.join(self.path, name), "wb") as f:
            np.lib.format.write_array_header_1_0(f, {"descr": "<f4", "fortran_order": False, "shape": (rows, dim)})
            while chunk := body.read(1 << 20):
                f.write(chunk)
        os.remove(raw)
        return Part(name, rows)

    def commit(self, messages: list) -> None:
        new = [m.name for m in messages if m is not None and m.rows]
        listed = os.path.join(self.path, "_committed.json")
        os.makedirs(self.path, exist_ok=True)
        old = [os.path.basename(p) for p in _files(self.path)] if os.path.exists(listed) else []
        with open(f"{listed}.new", "w") as f:
            json.dump(sorted(new if self.overwrite else [*old, *new]), f)
        os.replace(f"{listed}.new", listed)
        for name in old if self.overwrite else ():
            os.remove(os.path.join(self.path, name))

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and m.name:
                os.remove(os.path.join(self.path, m.name))


class ArraySource(DataSource):
    """(row long, vector array<float>) of .npy files, an array of an .npz file, or a folder that this source has written.

    Options: rows, of a partition; array, the name in an .npz file; dim, the number of columns to insist on; finite, to
    refuse what is no number; vector, the column to write.
    """

    @classmethod
    def name(cls) -> str:
        return "array"

    def schema(self) -> str:
        return "row long, vector array<float>"

    def reader(self, schema: StructType) -> ArrayReader:
        return ArrayReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(self.options, overwrite)


@dataclass
class Bytes(InputPartition):
    path: str
    start: int
    end: int


class LogReader(DataSourceStreamReader):
    """Whole lines of files that grow; an offset has the length read of each file. A batch takes what is there, in pieces."""

    PIECE = 8 << 20

    def __init__(self, options: dict):
        self.path = options["path"]
        self.from_end = options.get("start", "begin") == "end"

    def _ends(self) -> dict[str, int]:
        """The place behind the last line break of each file."""
        out = {}
        for path in sorted(glob.glob(self.path)):
            with open(path, "rb") as f:
                at = f.seek(0, os.SEEK_END)
                while at:
                    a = max(at - 65536, 0)
                    f.seek(a)
                    cut = f.read(at - a).rfind(b"\n")
                    if cut >= 0:
                        out[path] = a + cut + 1
                        break
                    at = a
        return out

    def initialOffset(self) -> dict:
        return self._ends() if self.from_end else {}

    def latestOffset(self) -> dict:
        return self._ends()

    def partitions(self, start: dict, end: dict) -> list[Bytes]:
        return [Bytes(p, a, min(a + self.PIECE, z)) for p, z in end.items() for a in range(start.get(p, 0), z, self.PIECE)] or [Bytes("", 0, 0)]

    def read(self, partition: Bytes) -> Iterator[tuple]:
        """Lines that begin in the piece, whole."""
        if not partition.path:
            return
        with open(partition.path, "rb") as f:
            if partition.start:
                f.seek(partition.start - 1)
                if f.read(1) != b"\n":
                    f.readline()
            while (at := f.tell()) < partition.end:
                line = f.readline()
                yield os.path.basename(partition.path), at, line.rstrip(b"\r\n").decode("utf-8", "replace")

    def commit(self, end: dict) -> None:
        pass


class LogSource(DataSource):
    """(file, at, line): a stream of the lines of logs that match a path; an unfinished last line waits."""

    @classmethod
    def name(cls) -> str:
        return "log"

    def schema(self) -> str:
        return "file string, at long, line string"

    def streamReader(self, schema: StructType) -> LogReader:
        return LogReader(self.options)


def register(spark) -> None:
    """Make formats array and log known to the session."""
    spark.dataSource.register(ArraySource)
    spark.dataSource.register(LogSource)
    # formats are looked up in the thread's active session, which this makes the given one
    spark.createDataFrame([], "x int")
