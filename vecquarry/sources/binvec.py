"""Binary vector files as a Python data source: a header of two little-endian u32 (rows, width), then rows of f32 or i32.

``spark.read.format("binvec")`` splits a file into row ranges, so one large file is read by many tasks; rows cut off at
the end of a file are dropped. ``write`` makes one file for each partition.
"""

from __future__ import annotations

import glob
import os
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage


def header(path: str) -> tuple[int, int]:
    """Rows and width; rows are at most those that the file holds."""
    with open(path, "rb") as f:
        raw = f.read(8)
    if len(raw) < 8:
        raise ValueError(f"{path} has no header")
    n, width = struct.unpack("<II", raw)
    whole = (os.path.getsize(path) - 8) // (4 * width) if width else 0
    return min(n, whole), width


def block(path: str, start: int, count: int, width: int, dtype: str) -> np.ndarray:
    with open(path, "rb") as f:
        f.seek(8 + 4 * width * start)
        raw = np.fromfile(f, dtype, count * width)
    return raw[: len(raw) // width * width].reshape(-1, width)


class Range(InputPartition):
    def __init__(self, path: str, offset: int, start: int, count: int, width: int):
        super().__init__(None)
        self.path, self.offset, self.start, self.count, self.width = path, offset, start, count, width


def _local(path: str) -> str:
    return path.removeprefix("file://")


class BinVec(DataSource):
    """Options: ``path`` (file, folder or pattern), ``kind`` (f32 or i32, by default after the extension), ``rows`` a task."""

    @classmethod
    def name(cls) -> str:
        return "binvec"

    def kind(self) -> str:
        path = self.options.get("path", "")
        return self.options.get("kind", "i32" if path.endswith(".ibin") else "f32")

    def schema(self) -> str:
        return f"id bigint, vec array<{'int' if self.kind() == 'i32' else 'float'}>"

    def reader(self, schema) -> DataSourceReader:
        return Reader(dict(self.options), self.kind())

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return Writer(_local(self.options["path"]), self.kind(), overwrite)


class Reader(DataSourceReader):
    def __init__(self, options: dict, kind: str):
        self.path, self.kind = _local(options["path"]), kind
        self.rows = int(options.get("rows", 500_000))

    def files(self) -> list[str]:
        if os.path.isdir(self.path):
            return sorted(p for p in glob.glob(os.path.join(self.path, "*")) if p.endswith((".fbin", ".ibin")))
        return sorted(glob.glob(self.path))

    def partitions(self):
        out, offset = [], 0
        for path in self.files():
            n, width = header(path)
            out += [Range(path, offset, s, min(self.rows, n - s), width) for s in range(0, n, self.rows)]
            offset += n
        return out or [Range("", 0, 0, 0, 1)]

    def read(self, part: Range):
        vec, ids = (pa.int32(), "<i4") if self.kind == "i32" else (pa.float32(), "<f4")
        for at in range(part.start, part.start + part.count, 10_000):
            x = block(part.path, at, min(10_000, part.start + part.count - at), part.width, ids)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, part.width, dtype=np.int32)), pa.array(x.ravel(), vec))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x), dtype=np.int64) + part.offset + at), lists], names=["id", "vec"])


class Written(WriterCommitMessage):
    def __init__(self, temporary: str, final: str):
        self.temporary, self.final = temporary, final


class Writer(DataSourceWriter):
    def __init__(self, path: str, kind: str, overwrite: bool):
        self.path, self.kind, self.overwrite = path, kind, overwrite

    def write(self, rows) -> WriterCommitMessage:
        os.makedirs(self.path, exist_ok=True)
        ext = ".ibin" if self.kind == "i32" else ".fbin"
        # Names follow the partitions, so a sorted table is read in its order.
        context = TaskContext.get()
        final = os.path.join(self.path, f"part-{context.partitionId() if context else 0:06d}-{uuid.uuid4().hex}{ext}")
        temporary, n, width = final + ".tmp", 0, 0
        with open(temporary, "wb") as f:
            f.write(struct.pack("<II", 0, 0))
            for r in rows:
                v = np.asarray(r.vec, "<i4" if self.kind == "i32" else "<f4")
                if n and len(v) != width:
                    raise ValueError("all vectors must have the same width")
                width, n = len(v), n + 1
                f.write(v.tobytes())
            f.seek(0)
            f.write(struct.pack("<II", n, width))
        return Written(temporary, final)

    def commit(self, messages) -> None:
        if self.overwrite:
            for p in glob.glob(os.path.join(self.path, "*.?bin")):
                os.remove(p)
        for m in messages:
            if m is not None:
                os.replace(m.temporary, m.final)

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.temporary):
                os.remove(m.temporary)


def register(spark) -> None:
    spark.dataSource.register(BinVec)
