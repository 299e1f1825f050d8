"""Judgment logs, pools, consensus and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GRADES = 4


def latest(log: DataFrame, key: str = "jkey", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The newest successful record of each key; a failure never replaces a success. One max_by, combined map-side."""
    ok = log.filter(~F.col("failed") & F.col("grade").isNotNull())
    rest = [c for c in log.columns if c != key]
    return ok.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def histogram(grades: DataFrame, by: str) -> DataFrame:
    """Counts of grades 0 to 3 with zeros, one row per group and grade; no join needed."""
    h = grades.groupBy(by).agg(*(F.count_if(F.col("grade") == g).alias(f"g{g}") for g in range(GRADES)))
    return h.select(by, F.posexplode(F.array(*(f"g{g}" for g in range(GRADES)))).alias("grade", "n"))


def shape(hist: DataFrame, by: str) -> DataFrame:
    """Entropy in bits, modal grade (the smaller on ties) and its share."""
    t = hist.groupBy(by).agg(F.collect_list(F.struct("grade", "n")).alias("x"), F.sum("n").alias("total"), F.max_by("grade", F.struct("n", (-F.col("grade")).alias("m"))).alias("modal"), F.max("n").alias("top"))
    p = F.transform(F.filter("x", lambda s: s["n"] > 0), lambda s: s["n"] / F.col("total"))
    return t.select(by, (-F.aggregate(p, F.lit(0.0), lambda a, q: a + q * F.log2(q))).alias("entropy"), "modal", F.try_divide(F.col("top"), F.col("total")).alias("modal_share"), "total")


def consensus(a: Column, b: Column, t: Column) -> list[Column]:
    """Two judges within one grade: the floor of their mean; else the median with a third, or pending. One judge alone counts."""
    near = F.abs(a - b) < 2
    grade = F.when(a.isNull() | b.isNull(), F.coalesce(a, b)).when(near, F.floor((a + b) / 2)).when(t.isNotNull(), F.get(F.sort_array(F.array(a, b, t)), F.lit(1)))
    return [grade.alias("grade"), (~near & t.isNull()).alias("pending")]


def held_out(full: DataFrame, sample: DataFrame, key: str) -> DataFrame:
    """Keys outside the sample; a sample key that isn't in full is an error."""
    stray = sample.join(full, key, "left_anti").select(F.raise_error(F.concat(F.lit("not in the full set: "), F.col(key).cast("string"))).cast(full.schema[key].dataType).alias(key))
    return full.join(sample, key, "left_anti").union(stray)


def reweight(counts: DataFrame, mix: DataFrame) -> DataFrame:
    """Shares of grades over classes (cls, grade, n) weighted by a mix (cls, w), renormalised over the classes present."""
    total = W.partitionBy("cls")
    share = counts.withColumn("p", F.col("n") / F.sum("n").over(total)).join(mix, "cls")
    present = share.select("cls", "w").distinct().agg(F.sum("w").alias("_s"))
    return share.join(F.broadcast(present)).groupBy("grade").agg(F.sum(F.col("p") * F.col("w") / F.col("_s")).alias("share"))
