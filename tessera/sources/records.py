"""Files of fixed-width records, read and written by byte ranges.

A file is a few sections; record k of each belongs to row k. Readers split the
rows, not the file: a task opens the file and reads its rows' bytes of every
section, a batch at a time. Writers number the rows first, so every task knows
where its rows' bytes go and writes them there; nothing passes through the
driver but the few bytes between sections. A file gets its name when it is
complete, and a task that runs twice writes the same bytes.

Files are opened through pyarrow's file systems. Writing at a place needs a
folder that all nodes have mounted.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tessera.operators.blocks import dense_rank
from tessera.session import ship

#: Bytes of all sections that a task reads, and that it holds at a time.
PART_BYTES, BATCH_BYTES = 64_000_000, 4_000_000

#: Spark's names of numpy's numbers; small unsigned ones widen.
_SQL = {"i1": "tinyint", "u1": "smallint", "i2": "smallint", "u2": "int", "i4": "int", "u4": "bigint", "i8": "bigint", "f2": "float", "f4": "float", "f8": "double"}
_ARROW = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}


@dataclass(frozen=True)
class Section:
    """Records that begin at ``offset``: fields are (column, numpy type, width);
    a width of 0 is a number, any other an array of so many."""

    offset: int
    fields: tuple[tuple[str, str, int], ...]

    @property
    def dtype(self) -> np.dtype:
        return np.dtype([(c, "<" + t, (w,)) if w else (c, "<" + t) for c, t, w in self.fields])

    def ddl(self) -> list[str]:
        return [f"`{c}` array<{_SQL[t]}>" if w else f"`{c}` {_SQL[t]}" for c, t, w in self.fields]


def _open(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system, inner


def head(path: str, size: int = 65_536) -> bytes:
    """The first bytes of a file."""
    system, inner = _open(path)
    with system.open_input_file(inner) as f:
        return f.read_at(min(size, f.size()), 0)


def number(path: str, at: int, kind: str = "<i4") -> int:
    """A number in the middle of a file."""
    system, inner = _open(path)
    with system.open_input_file(inner) as f:
        return int(np.frombuffer(f.read_at(np.dtype(kind).itemsize, at), kind)[0])


def _column(values: np.ndarray, kind: str, width: int) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(values).ravel().astype(values.dtype.newbyteorder("=")).astype(_ARROW[_SQL[kind]].to_pandas_dtype()), _ARROW[_SQL[kind]])
    if not width:
        return flat
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * width), flat)


@dataclass
class Rows(InputPartition):
    first: int
    stop: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, sections: list[Section], count: int, skip: int, part: int, batch: int) -> None:
        self.path, self.sections, self.count, self.skip = path, sections, count, skip
        width = sum(s.dtype.itemsize for s in sections)
        self.part, self.batch = max(1, part // width), max(1, batch // width)

    def partitions(self) -> list[Rows]:
        return [Rows(a, min(a + self.part, self.count)) for a in range(self.skip, self.count, self.part)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        system, inner = _open(self.path)
        with system.open_input_file(inner) as f:
            for a in range(partition.first, partition.stop, self.batch):
                n = min(self.batch, partition.stop - a)
                columns, names = [pa.array(np.arange(a, a + n))], ["id"]
                for s in self.sections:
                    raw = f.read_at(n * s.dtype.itemsize, s.offset + a * s.dtype.itemsize)
                    if len(raw) < n * s.dtype.itemsize:
                        raise ValueError(f"{self.path} ends before its last record")
                    records = np.frombuffer(raw, s.dtype)
                    columns += [_column(records[c], t, w) for c, t, w in s.fields]
                    names += [c for c, _, _ in s.fields]
                yield pa.RecordBatch.from_arrays(columns, names=names)


class FixedRecords(DataSource):
    """``spark.read.format("fixed_records")`` with options path, sections (JSON), count, skip, part_bytes and batch_bytes."""

    @classmethod
    def name(cls) -> str:
        return "fixed_records"

    def _sections(self) -> list[Section]:
        return [Section(o, tuple(map(tuple, fields))) for o, fields in json.loads(self.options["sections"])]

    def schema(self) -> str:
        return ", ".join(["id bigint", *(c for s in self._sections() for c in s.ddl())])

    def reader(self, schema: StructType) -> _Reader:
        o = self.options
        return _Reader(o["path"], self._sections(), int(o["count"]), int(o.get("skip", 0)), int(o.get("part_bytes", PART_BYTES)), int(o.get("batch_bytes", BATCH_BYTES)))


def read_records(spark: SparkSession, path: str, sections: list[Section], count: int, skip: int = 0) -> DataFrame:
    """id (the number of the record) and the sections' fields of records ``skip`` to ``count``."""
    ship(spark)
    spark.dataSource.register(FixedRecords)
    said = json.dumps([[s.offset, s.fields] for s in sections])
    return spark.read.format("fixed_records").options(path=path, sections=said, count=str(count), skip=str(skip), part_bytes=str(PART_BYTES), batch_bytes=str(BATCH_BYTES)).load()


def write_records(path: str, frames: list[DataFrame], layout: Callable[[list[int]], tuple[list[tuple[int, bytes]], list[list[Section]]]], finite: bool = True) -> list[int]:
    """One file of several tables, each in the order of its unique ids; returns their row counts.

    ``layout`` maps the counts to the bytes between sections, with their places, and to each
    table's sections. With ``finite``, a number that isn't is an error. An
    array of another length than its field's is an error too.
    """
    from pyarrow import fs

    system, inner = _open(path)
    if not isinstance(system, fs.LocalFileSystem):
        raise ValueError(f"{path} is not in a folder that is mounted on all nodes")
    spark = frames[0].sparkSession
    ship(spark)
    ranked = [dense_rank(f, ["id"], "_at") for f in frames]
    counts = [f.count() for f in ranked]
    pieces, parts = layout(counts)
    temporary = f"{inner}.{uuid.uuid4().hex}"
    ends = [a + len(b) for a, b in pieces] + [s.offset + n * s.dtype.itemsize for n, sections in zip(counts, parts, strict=True) for s in sections]
    os.makedirs(os.path.dirname(inner), exist_ok=True)
    with open(temporary, "wb") as f:
        f.truncate(max(ends))
        for at, raw in pieces:
            f.seek(at)
            f.write(raw)

    def writer(sections: list[Section]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            written = 0
            with open(temporary, "r+b") as f:
                for b in batches:
                    at = b.column(0).to_numpy()
                    order = np.argsort(at)
                    starts = np.concatenate(([0], np.flatnonzero(np.diff(at[order]) != 1) + 1, [len(at)])) if len(at) else [0]
                    k = 1
                    for s in sections:
                        records = np.zeros(len(at), s.dtype)
                        for c, t, w in s.fields:
                            column = b.column(k)
                            k += 1
                            if w and len(column) and not (np.diff(column.offsets.to_numpy()) == w).all():
                                raise ValueError(f"{c} has not {w} numbers in every row")
                            values = (column.flatten() if w else column).to_numpy(zero_copy_only=False)
                            if finite and values.dtype.kind == "f" and not np.isfinite(values).all():
                                raise ValueError("a row is not finite")
                            records[c] = values.reshape(len(at), w) if w else values
                        records = records[order]
                        for a, z in zip(starts[:-1], starts[1:], strict=True):
                            f.seek(s.offset + int(at[order[a]]) * s.dtype.itemsize)
                            f.write(records[a:z].tobytes())
                    written += len(at)
            yield pa.RecordBatch.from_arrays([pa.array([written])], names=["n"])

        return run

    try:
        for frame, n, sections in zip(ranked, counts, parts, strict=True):
            chosen = [F.col(c).cast(kind.split(" ", 1)[1]) for s in sections for (c, _, _), kind in zip(s.fields, s.ddl(), strict=True)]
            done = frame.select("_at", *chosen).mapInArrow(writer(sections), "n long").agg(F.sum("n")).first()[0] or 0
            if done != n:
                raise RuntimeError(f"{done} of {n} rows were written")
        os.replace(temporary, inner)
    except BaseException:
        os.unlink(temporary)
        raise
    return counts
