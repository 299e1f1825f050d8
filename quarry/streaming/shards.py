"""Shards with ready markers as a stream: `x.jsonl` may be read once `x.jsonl.ready` stands beside it.

The producer ends with `.prepare_done`, or gives up with `.prepare_fail`. The source's offset is the list of markers seen, so a shard is read once, also over
restarts, and one without a marker not at all. Folders are reached by pyarrow's file systems (local, HDFS, object stores), lines are
read in blocks: a task holds no shard whole.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

READY, DONE, FAIL = ".ready", ".prepare_done", ".prepare_fail"
#: Lines of an Arrow batch.
LINES = 2_000


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def names(path: str) -> set[str]:
    """Names of the files in a folder, markers too."""
    system, root = place(path)
    return {f.base_name for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.is_file}


def mark(path: str, name: str) -> None:
    """Put an empty file in a folder: a shard's marker, or the end."""
    system, root = place(path)
    with system.open_output_stream(f"{root}/{name}"):
        pass


class Shard(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class ReadyReader(DataSourceStreamReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def initialOffset(self) -> dict:
        return {"seen": []}

    def latestOffset(self) -> dict:
        found = names(self.path)
        if FAIL in found:
            raise RuntimeError(f"{self.path}: the producer has given up ({FAIL})")
        return {"seen": sorted(n.removesuffix(READY) for n in found if n.endswith(READY))}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [Shard(n) for n in sorted({*end["seen"]} - {*start["seen"]})]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, root = place(self.path)
        kinds = to_arrow_schema(self.schema)
        with system.open_input_stream(f"{root}/{partition.name}") as stream:
            held: list[dict] = []
            for number, line in enumerate(_lines(stream), 1):
                try:
                    held.append(json.loads(line))
                except ValueError as e:
                    raise ValueError(f"{partition.name}, line {number}: {e}") from None
                if len(held) == LINES:
                    yield pa.RecordBatch.from_pylist(held, kinds)
                    held = []
            if held:
                yield pa.RecordBatch.from_pylist(held, kinds)


def _lines(stream: pa.NativeFile) -> Iterator[bytes]:
    rest = b""
    while block := stream.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        yield from (x for x in whole if x.strip())
    if rest.strip():
        yield rest


class ReadyShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ready_shards"

    def streamReader(self, schema: StructType) -> ReadyReader:
        return ReadyReader(self.options["path"], schema)


def ready(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A stream of the rows of a folder's ready shards."""
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the planner's process needn't find this package
    spark.dataSource.register(ReadyShards)
    return spark.readStream.format("ready_shards").schema(schema).load(path)


def watch(spark: SparkSession, path: str, schema: StructType | str, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, pause: float = 1.0) -> DataFrame:
    """Process ready shards as they come, until the producer is done; an error if it has given up.

    After the end has been seen the folder is looked at once more, as a marker may have come just before.
    """
    from quarry.streaming.pipes import drain

    while True:
        found = names(path)
        drain(step(ready(spark, path, schema)), out, checkpoint)
        if DONE in found:
            return spark.read.parquet(out)
        time.sleep(pause)
