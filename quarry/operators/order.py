"""Order: global ranks without one task, and samples that are the same in every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.streaming.store import scratch


def global_rank(df: DataFrame, order: list[Column], into: str = "place") -> DataFrame:
    """1-based place in a total order: range partitions are ranked each, and start after the sizes of those before.

    Only one count per partition meets in a single task.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    path = scratch(df.sparkSession, "ranked")  # written once: range bounds are sampled, and need not be the same in a second run
    sorted_.select("*", (F.col("_i") - F.shiftleft(F.col("_p").cast("long"), 33)).alias("_n")).drop("_i").write.parquet(path)
    ranked = df.sparkSession.read.parquet(path)
    sizes = ranked.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = sizes.select("_p", F.coalesce(F.sum("_c").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return ranked.join(F.broadcast(before), "_p").withColumn(into, F.col("_b") + F.col("_n") + 1).drop("_p", "_n", "_b")


def seeded(seed: int, key: str) -> list[Column]:
    return [F.sha2(F.concat(F.lit(str(seed)), F.col(key).cast("string")), 256), F.col(key)]


def seeded_sample(df: DataFrame, by: list[str], key: str, n: int, seed: int) -> DataFrame:
    """n rows of each stratum, by the order of a seeded hash of the key."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*seeded(seed, key)))).filter(F.col("_r") <= n).drop("_r")


def round_robin(df: DataFrame, topic: str, cls: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows, one of each topic and class a round, rarer classes first."""
    freq = df.groupBy(cls).agg(F.count(F.lit(1)).alias("_f"))
    r = df.withColumn("_round", F.row_number().over(W.partitionBy(topic, cls).orderBy(*seeded(seed, key)))).filter(F.col("_round") <= n).join(freq, cls)
    return r.orderBy("_round", "_f", cls, topic, key).limit(n).drop("_round", "_f")
