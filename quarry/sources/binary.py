"""Binary vector and token shards as Spark sources and sinks.

`fbin`: a shard is a header (rows and dimension, unsigned 32-bit, little-endian), then rows of 32-bit floats; beside it `.docids.txt` has a line a row.
`tokens`: a shard is `.ids.u32` (all token ids), `.len.i16` (tokens of each row) and `.docids.txt`. Rows of a folder count through its shards in the order of
their names. Readers cut shards into ranges of about RANGE bytes, so that a large shard is read by many tasks, and check headers and lengths before
any row is read. Writers write one shard a task under a name of its own, and only a committed job's shards get their final names.

Folders are reached by pyarrow's file systems (local, HDFS, object stores).
"""

from __future__ import annotations

import struct
import sys
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

HEADER, HEAD = "<II", 8
#: Bytes of vectors or tokens that a task reads, and rows of an Arrow batch.
RANGE, ROWS = 64 << 20, 4_096
DOCIDS = ".docids.txt"


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listing(path: str, suffix: str) -> list[tuple[str, int]]:
    """(name without suffix, bytes) of the shards of a folder, in order."""
    system, root = place(path)
    found = system.get_file_info(fs.FileSelector(root))
    return sorted((f.base_name.removesuffix(suffix), f.size) for f in found if f.is_file and f.base_name.endswith(suffix) and not f.base_name.startswith("_"))


def _slice(system: fs.FileSystem, file: str, begin: int, size: int) -> bytes:
    with system.open_input_file(file) as f:
        f.seek(begin)
        out = f.read(size)
    if len(out) != size:
        raise ValueError(f"{file}: {len(out)} of {size} bytes at {begin}")
    return out


def _lines(system: fs.FileSystem, file: str, begin: int, rows: int) -> list[str]:
    """Some lines of a file of ids; lines before them are passed over, not kept."""
    out: list[str] = []
    with system.open_input_stream(file) as f:
        rest, n = b"", 0
        while len(out) < rows and (block := f.read(1 << 20)):
            *whole, rest = (rest + block).split(b"\n")
            out += [x.decode() for x in whole[max(0, begin - n) :]][: rows - len(out)]
            n += len(whole)
        if len(out) < rows and rest and n >= begin:
            out.append(rest.decode())
    if len(out) != rows:
        raise ValueError(f"{file}: fewer ids than rows")
    return out


def _count_lines(system: fs.FileSystem, file: str) -> int:
    n, last = 0, b"\n"
    with system.open_input_stream(file) as f:
        while block := f.read(1 << 20):
            n, last = n + block.count(b"\n"), block[-1:]
    return n + (last != b"\n")


@dataclass
class Part(InputPartition):
    """Rows of a shard: the first, how many, the number of the first in the folder; start: token before them."""

    name: str
    first: int
    rows: int
    row: int
    dim: int = 0
    start: int = 0


class Fbin(DataSource):
    """spark.read.format("fbin").load(folder): row long, docid string, vec array<float>."""

    @classmethod
    def name(cls) -> str:
        return "fbin"

    def schema(self) -> str:
        return "row long, docid string, vec array<float>"

    def reader(self, schema: StructType) -> FbinReader:
        return FbinReader(self.options["path"], int(self.options.get("range", RANGE)))

    def writer(self, schema: StructType, overwrite: bool) -> FbinWriter:
        return FbinWriter(self.options["path"])


class FbinReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> Sequence[InputPartition]:
        system, root = place(self.path)
        out, row, dim = [], 0, None
        for name, size in listing(self.path, ".fbin"):
            n, d = struct.unpack(HEADER, _slice(system, f"{root}/{name}.fbin", 0, HEAD))
            if size != HEAD + 4 * n * d:
                raise ValueError(f"{name}.fbin: {n} rows of {d} entries take {HEAD + 4 * n * d} bytes, it has {size}")
            if dim not in (None, d):
                raise ValueError(f"{name}.fbin: dimension {d}, the shards before have {dim}")
            if (ids := _count_lines(system, f"{root}/{name}{DOCIDS}")) != n:
                raise ValueError(f"{name}: {n} rows and {ids} ids")
            dim, step = d, max(1, self.size // max(1, 4 * d))
            out += [Part(name, k, min(step, n - k), row + k, d) for k in range(0, n, step)]
            row += n
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        system, root = place(self.path)
        ids = _lines(system, f"{root}/{part.name}{DOCIDS}", part.first, part.rows)
        for k in range(0, part.rows, ROWS):
            n = min(ROWS, part.rows - k)
            data = _slice(system, f"{root}/{part.name}.fbin", HEAD + 4 * part.dim * (part.first + k), 4 * part.dim * n)
            vec = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * part.dim), pa.array(np.frombuffer(data, "<f4")))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.row + k, part.row + k + n)), pa.array(ids[k : k + n]), vec], names=["row", "docid", "vec"])


@dataclass
class Written(WriterCommitMessage):
    name: str
    task: int
    rows: int
    dim: int


class _Writer(DataSourceArrowWriter):
    """Shards of a job: written under `_job-...` names, renamed when all tasks are done, deleted if the job fails."""

    SUFFIXES: tuple[str, ...] = ()

    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex[:12]

    def begin(self) -> tuple[fs.FileSystem, str, str, int]:
        from pyspark import TaskContext

        system, root = place(self.path)
        system.create_dir(root, recursive=True)
        task = TaskContext.get()
        return system, root, f"_{self.job}-{task.partitionId():05d}-{task.taskAttemptId()}", task.partitionId()

    def commit(self, messages: list[Written | None]) -> None:
        system, root = place(self.path)
        done = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.task)
        if len(dims := {m.dim for m in done}) > 1:
            self.abort(messages)
            raise ValueError(f"vectors of several dimensions: {sorted(dims)}")
        first = len(listing(self.path, self.SUFFIXES[0]))
        for k, m in enumerate(done, first):
            for s in self.SUFFIXES:
                system.move(f"{root}/{m.name}{s}", f"{root}/shard_{k:05d}{s}")
        self._sweep(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = place(self.path)
        self._sweep(system, root)

    def _sweep(self, system: fs.FileSystem, root: str) -> None:
        for f in system.get_file_info(fs.FileSelector(root)):
            if f.base_name.startswith(f"_{self.job}"):
                system.delete_file(f.path)


def _texts(column: pa.Array) -> bytes:
    texts = column.to_pylist()
    if any(t is None or "\n" in t for t in texts):
        raise ValueError("a docid is null or has a line end")
    return "".join(f"{t}\n" for t in texts).encode()


class FbinWriter(_Writer):
    """Writes (docid string, vec array<float>) rows in their order."""

    SUFFIXES = (".fbin", DOCIDS)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, root, name, task = self.begin()
        rows, dim = 0, 0
        body = f"{root}/{name}.body"
        with system.open_output_stream(body) as vectors, system.open_output_stream(f"{root}/{name}{DOCIDS}") as ids:
            for b in batches:
                if not b.num_rows:
                    continue
                vec = b.column(b.schema.get_field_index("vec"))
                sizes = set(np.diff(np.asarray(vec.offsets)).tolist()) if not vec.null_count else {None}
                if len(sizes) != 1 or None in sizes or (rows and sizes != {dim}):
                    raise ValueError("vectors of several dimensions, or null")
                dim, rows = sizes.pop(), rows + b.num_rows
                vectors.write(np.asarray(vec.flatten(), "<f4").tobytes())
                ids.write(_texts(b.column(b.schema.get_field_index("docid"))))
        with system.open_output_stream(f"{root}/{name}.fbin") as out, system.open_input_stream(body) as rest:
            out.write(struct.pack(HEADER, rows, dim))  # known only now; object stores can't go back
            while block := rest.read(16 << 20):
                out.write(block)
        system.delete_file(body)
        return Written(name, task, rows, dim)


class Tokens(DataSource):
    """spark.read.format("tokens").load(folder): row long, docid string, start long (tokens of the shard before it), ids array<long>."""

    @classmethod
    def name(cls) -> str:
        return "tokens"

    def schema(self) -> str:
        return "row long, docid string, start long, ids array<long>"

    def reader(self, schema: StructType) -> TokensReader:
        return TokensReader(self.options["path"], int(self.options.get("range", RANGE)))

    def writer(self, schema: StructType, overwrite: bool) -> TokensWriter:
        return TokensWriter(self.options["path"])


class TokensReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> Sequence[InputPartition]:
        system, root = place(self.path)
        out, row = [], 0
        sizes = dict(listing(self.path, ".ids.u32"))
        for name, size in listing(self.path, ".len.i16"):
            lens = np.frombuffer(_slice(system, f"{root}/{name}.len.i16", 0, size), "<i2").astype(np.int64)
            if (ids := _count_lines(system, f"{root}/{name}{DOCIDS}")) != len(lens):
                raise ValueError(f"{name}: {len(lens)} lengths and {ids} ids")
            offsets = np.concatenate([[0], np.cumsum(lens)])
            if (lens < 0).any() or sizes.get(name) != 4 * offsets[-1]:
                raise ValueError(f"{name}: lengths sum to {offsets[-1]} tokens, the store has {sizes.get(name, 0) // 4}")
            k = 0
            while k < len(lens):
                end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + self.size // 4, "right")) - 1)
                out.append(Part(name, k, min(end, len(lens)) - k, row + k, start=int(offsets[k])))
                k = min(end, len(lens))
            row += len(lens)
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        system, root = place(self.path)
        docids = _lines(system, f"{root}/{part.name}{DOCIDS}", part.first, part.rows)
        lens = np.frombuffer(_slice(system, f"{root}/{part.name}.len.i16", 2 * part.first, 2 * part.rows), "<i2").astype(np.int64)
        starts = part.start + np.concatenate([[0], np.cumsum(lens)])
        for k in range(0, part.rows, ROWS):
            n = min(ROWS, part.rows - k)
            data = np.frombuffer(_slice(system, f"{root}/{part.name}.ids.u32", 4 * int(starts[k]), 4 * int(starts[k + n] - starts[k])), "<u4").astype(np.int64)
            ids = pa.ListArray.from_arrays(pa.array((starts[k : k + n + 1] - starts[k]).astype(np.int32)), pa.array(data))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.row + k, part.row + k + n)), pa.array(docids[k : k + n]), pa.array(starts[k : k + n]), ids], names=["row", "docid", "start", "ids"])


class TokensWriter(_Writer):
    """Writes (docid string, ids array<int or long>) rows in their order; a row has 32,767 tokens at most."""

    SUFFIXES = (".len.i16", ".ids.u32", DOCIDS)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, root, name, task = self.begin()
        rows = 0
        with system.open_output_stream(f"{root}/{name}.ids.u32") as out, system.open_output_stream(f"{root}/{name}.len.i16") as lens, system.open_output_stream(f"{root}/{name}{DOCIDS}") as docids:
            for b in batches:
                ids = b.column(b.schema.get_field_index("ids"))
                n = np.diff(np.asarray(ids.offsets)) if b.num_rows else np.zeros(0, np.int64)
                flat = np.asarray(ids.flatten(), np.int64)
                if ids.null_count or (n > 32_767).any() or (flat < 0).any() or (flat >= 1 << 32).any():
                    raise ValueError("token lists must be there, of 32,767 ids at most, of 32 bits each")
                out.write(flat.astype("<u4").tobytes())
                lens.write(n.astype("<i2").tobytes())
                docids.write(_texts(b.column(b.schema.get_field_index("docid"))))
                rows += b.num_rows
        return Written(name, task, rows, 0)


def register(spark: SparkSession) -> SparkSession:
    """Make both formats known to a session; the planner's process needn't find this package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    for source in (Fbin, Tokens):
        spark.dataSource.register(source)
    return spark


def write(df: DataFrame, form: str, path: str) -> None:
    """Write rows in their partitions' order: shards follow the partitions."""
    register(df.sparkSession)
    df.write.format(form).mode("append").save(path)


def read(spark: SparkSession, form: str, path: str, size: int = RANGE) -> DataFrame:
    return register(spark).read.format(form).option("range", str(size)).load(path)
