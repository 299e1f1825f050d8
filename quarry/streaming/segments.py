"""A segmented, append-only log as a stream with a resume point.

Segments are files of JSON lines, read in the order of their names; only the last grows. The offset is (segment, line, byte): all segments before are
done, and of this one so many lines. A last line without its end is left for later while its segment is the last; in a closed segment it is what a
crash has torn, and skipped. Any other line that isn't JSON is an error that names it.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of a segment that one task reads at most, about, and lines of an Arrow batch.
RANGE, LINES = 32 << 20, 2_000
START = {"segment": "", "line": 0, "byte": 0}


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Piece(InputPartition):
    """Bytes of a segment from the start of a line; line: the number of lines before; closed: whether a torn line ends it."""

    segment: str
    line: int
    begin: int
    end: int
    closed: bool


class SegmentReader(DataSourceStreamReader):
    def __init__(self, path: str, schema: StructType, size: int):
        self.path, self.schema, self.size = path, schema, size

    def initialOffset(self) -> dict:
        return START

    def _segments(self) -> list[tuple[str, int]]:
        system, root = place(self.path)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted((f.base_name, f.size) for f in found if f.is_file and f.base_name[0] not in "._")

    def _cuts(self, segment: str, line: int, begin: int, end: int) -> list[tuple[int, int]]:
        """(byte, line) of ends of lines, about every `size` bytes, the last of them the last whole line's."""
        system, root = place(self.path)
        cuts, at, done, last = [], begin, line, (begin, line)
        with system.open_input_file(f"{root}/{segment}") as f:
            f.seek(begin)
            while at < end and (block := f.read(min(1 << 20, end - at))):
                k = block.rfind(b"\n") + 1
                if k:
                    last = (at + k, done + block.count(b"\n"))
                    if last[0] - (cuts[-1][0] if cuts else begin) >= self.size:
                        cuts.append(last)
                at, done = at + len(block), done + block.count(b"\n")
        if last[0] > (cuts[-1][0] if cuts else begin):
            cuts.append(last)
        return cuts

    def latestOffset(self) -> dict:
        found = self._segments()
        if not found:
            return START
        name, size = found[-1]
        known = getattr(self, "_tail", START)
        begin, line = (known["byte"], known["line"]) if known["segment"] == name else (0, 0)
        for byte, n in self._cuts(name, line, begin, size)[-1:]:
            begin, line = byte, n
        self._tail = {"segment": name, "line": line, "byte": begin}
        return self._tail

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out = []
        for name, size in self._segments():
            if not start["segment"] <= name <= end["segment"]:
                continue
            line, begin = (start["line"], start["byte"]) if name == start["segment"] else (0, 0)
            closed = name != end["segment"]
            stop = size if closed else end["byte"]
            for byte, n in self._cuts(name, line, begin, stop):
                out.append(Piece(name, line, begin, byte, closed))
                line, begin = n, byte
            if closed and begin < stop:  # a line without its end
                out.append(Piece(name, line, begin, stop, closed))
        return out

    def read(self, part: Piece) -> Iterator[pa.RecordBatch]:
        system, root = place(self.path)
        kinds = to_arrow_schema(self.schema)
        held: list[dict] = []
        with system.open_input_file(f"{root}/{part.segment}") as f:
            f.seek(part.begin)
            rest, at, number = b"", part.begin, part.line
            while at < part.end and (block := f.read(min(1 << 20, part.end - at))):
                at += len(block)
                *whole, rest = (rest + block).split(b"\n")
                for text in whole:
                    number += 1
                    if text.strip():
                        held.append(_record(text, part.segment, number))
                    if len(held) >= LINES:
                        yield pa.RecordBatch.from_pylist(held, kinds)
                        held = []
        if rest.strip() and part.closed:
            try:
                held.append(json.loads(rest))
            except ValueError:
                pass  # torn
        if held:
            yield pa.RecordBatch.from_pylist(held, kinds)


def _record(text: bytes, segment: str, number: int) -> dict:
    try:
        return json.loads(text)
    except ValueError as e:
        raise ValueError(f"damaged record: {segment}, line {number}: {e}") from None


class Segments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_segments"

    def streamReader(self, schema: StructType) -> SegmentReader:
        return SegmentReader(self.options["path"], schema, int(self.options.get("range", RANGE)))


def follow(spark: SparkSession, path: str, schema: StructType | str, size: int = RANGE) -> DataFrame:
    """A stream of a log's records."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the planner's process needn't find this package
    spark.dataSource.register(Segments)
    return spark.readStream.format("log_segments").option("range", str(size)).schema(schema).load(path)


def append(path: str, segment: str, data: bytes) -> None:
    """Add bytes to a segment of a log on a file system that can append."""
    system, root = place(path)
    system.create_dir(root, recursive=True)
    with system.open_append_stream(f"{root}/{segment}") as f:
        f.write(data)


def move_in(staged: str, path: str, name: str) -> None:
    """Make the parts of a folder that Spark wrote segments of a log."""
    system, source = place(staged)
    _, root = place(path)
    system.create_dir(root, recursive=True)
    for f in sorted(system.get_file_info(fs.FileSelector(source)), key=lambda f: f.base_name):
        if f.is_file and f.base_name.startswith("part-"):
            system.move(f.path, f"{root}/{name}-{f.base_name}")


def metered(spark: SparkSession, state: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Run a stream of sums over a log to its end; the sums so far live in the stream's state, the last of them is returned."""
    from quarry.streaming.store import folders

    q = state.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/{number}")).start().awaitTermination()
    return spark.read.schema(state.schema).parquet(f"{out}/{max(folders(spark, out))}")
