"""Streams to the end of what is there: sinks, and compaction of a judgment log in tiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from quarry.operators.judging import latest
from quarry.streaming.store import folders, remove, written


def drain(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append a stream to a Parquet folder, exactly once, until its source is exhausted."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


#: Runs of one tier that are merged into one of the next.
FAN = 4
RUNS = "number long, tier int, rows long"


def live_runs(spark: SparkSession, out: str) -> tuple[int, list[tuple[int, int, int]]]:
    """Number of the last manifest in a folder, and its runs (number, tier, rows); -1 and none before the first."""
    known = [n for n in folders(spark, f"{out}/manifest") if written(spark, f"{out}/manifest/{n}")]
    if not known:
        return -1, []
    rows = spark.read.schema(RUNS).parquet(f"{out}/manifest/{max(known)}").collect()
    return max(known), sorted((r["number"], r["tier"], r["rows"]) for r in rows)


def add_run(spark: SparkSession, out: str, number: int, rows: DataFrame, newest: Callable[[DataFrame], DataFrame]) -> None:
    """Add a micro-batch's records to a folder of runs; FAN runs of a tier become one of the next, so a record is rewritten once a tier.

    A run is a folder by number and tier, and counts once a manifest names it: a batch that is run again after a failure writes the same folders anew.
    """
    before, runs = live_runs(spark, out)
    if number <= before:
        return  # its manifest was written before the checkpoint

    def write(df: DataFrame, tier: int) -> None:
        path = f"{out}/runs/{number}-{tier}"
        newest(df).select(*rows.columns).write.mode("overwrite").parquet(path)
        runs.append((number, tier, spark.read.parquet(path).count()))

    write(rows, 0)
    tier, gone = 0, []
    while len(full := [r for r in runs if r[1] == tier]) >= FAN:
        write(spark.read.schema(rows.schema).parquet(*(f"{out}/runs/{n}-{t}" for n, t, _ in full)), tier + 1)
        runs, gone, tier = [r for r in runs if r not in full], gone + full, tier + 1
    spark.createDataFrame(runs, RUNS).coalesce(1).write.mode("overwrite").parquet(f"{out}/manifest/{number}")
    # what the manifest before this one names may still be read; older folders go
    kept = {(n, t) for n, t, _ in runs} | {(n, t) for n, t, _ in gone}
    for old in (m for m in folders(spark, f"{out}/manifest") if m < before):
        for r in spark.read.schema(RUNS).parquet(f"{out}/manifest/{old}").collect():
            if (r["number"], r["tier"]) not in kept:
                remove(spark, f"{out}/runs/{r['number']}-{r['tier']}")
        remove(spark, f"{out}/manifest/{old}")


def merged(spark: SparkSession, out: str, schema: StructType | str, newest: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The newest record of each key over all live runs."""
    _, runs = live_runs(spark, out)
    if not runs:
        return spark.createDataFrame([], schema)
    return newest(spark.read.schema(schema).parquet(*(f"{out}/runs/{n}-{t}" for n, t, _ in runs)))


def compact_log(spark: SparkSession, source: str, schema: StructType | str, out: str, checkpoint: str, files: int = 2) -> DataFrame:
    """Newest success per key over a streamed log, kept in runs by size."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    each = stream.writeStream.foreachBatch(lambda batch, number: add_run(spark, out, number, batch, latest))
    each.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return merged(spark, out, schema, latest)
