"""Aggregations of rubrics, costs, percentiles, arenas and support judgments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def percentiles(df: DataFrame, by: list[str], value: str, qs: list[float], rule: str) -> DataFrame:
    """Percentiles by index into the sorted values, one row per group and q.

    floor: index floor(q n), the last at most. ceil: nearest rank ceil(q n). lower: index int(q (n - 1)).
    Ranks come from a window, so no group is collected into an array.
    """
    q = F.explode(F.array(*map(F.lit, qs)))
    n = df.groupBy(*by).agg(F.count(value).alias("_n")).withColumn("q", q)
    at = {"floor": F.least(F.floor(F.col("q") * F.col("_n")), F.col("_n") - 1), "ceil": F.greatest(F.ceil(F.col("q") * F.col("_n")), F.lit(1)) - 1, "lower": F.floor(F.col("q") * (F.col("_n") - 1))}[rule]
    ranked = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("value"), (F.row_number().over(W.partitionBy(*by).orderBy(value)) - 1).alias("_i"))
    return n.withColumn("_i", at.cast("int")).join(ranked, [*by, "_i"]).select(*by, "q", "value")


def coverage(rubric: DataFrame, by: list[str], threshold: int, grades: tuple[str, ...] = ("grade_a", "grade_b")) -> DataFrame:
    """Weighted share of positive criteria whose best grade reaches the threshold."""
    best = F.greatest(*grades)
    w = F.when(F.col("weight") > 0, F.col("weight")).otherwise(0)
    return rubric.groupBy(*by).agg(F.try_divide(F.sum(F.when(best >= threshold, w).otherwise(0)), F.sum(w)).alias("coverage"))


def signed_score(rubric: DataFrame, by: list[str], value: Column) -> DataFrame:
    """Sum of weight times value over the sum of positive weights, and the number of severe penalties incurred."""
    severe = (F.col("weight") <= -4) & (value > 0)
    return rubric.groupBy(*by).agg(F.try_divide(F.sum(F.col("weight") * value), F.sum(F.when(F.col("weight") > 0, F.col("weight")).otherwise(0))).alias("score"), F.count_if(severe).alias("severe"))


def call_cost(tokens_in: Column, cached: Column, written: Column, out: Column, rate_in: float, rate_cached: float, rate_out: float) -> Column:
    """Price of a call per 1000 tokens, each part rounded half-even to 8 places, then the sum."""
    fresh = F.bround((tokens_in - cached + written) / 1000 * F.lit(rate_in), 8)
    return F.bround(fresh + F.bround(cached / 1000 * F.lit(rate_cached), 8) + F.bround(out / 1000 * F.lit(rate_out), 8), 8)


def waste(usd: Column) -> list[Column]:
    """Overlapping kinds of waste, each on its own, and their union once."""
    failed, repeated = F.col("failed"), F.col("repeated")
    return [F.sum(usd).alias("usd"), F.sum(F.when(failed, usd).otherwise(0.0)).alias("failed_usd"), F.sum(F.when(repeated, usd).otherwise(0.0)).alias("repeated_usd"), F.sum(F.when(failed | repeated, usd).otherwise(0.0)).alias("waste_usd")]


def arena_outcome(votes: DataFrame, by: list[str]) -> DataFrame:
    """1 where a side won in both orders, 0 where it lost both, else a half; both orders must be there."""
    return votes.groupBy(*by).agg(F.countDistinct("order").alias("orders"), F.bool_and(F.col("won")).alias("all"), F.bool_or(F.col("won")).alias("any")).filter("orders = 2").select(*by, F.when(F.col("all"), 1.0).when(~F.col("any"), 0.0).otherwise(0.5).alias("outcome"))


def support_rates(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Weighted precision over judged pairs, recall over all sentences: full 1, partial .5, none 0; unjudged leave both sums but recall's count of sentences."""
    v = F.when(F.col("label") == "FS", 1.0).when(F.col("label") == "PS", 0.5).when(F.col("label") == "NS", 0.0)
    best = pairs.withColumn("v", v).groupBy(*by, "sentence").agg(F.sum("v").alias("s"), F.count("v").alias("n"), F.max("v").alias("best"))
    return best.groupBy(*by).agg(F.try_divide(F.sum("s"), F.sum("n")).alias("precision"), F.try_divide(F.sum(F.coalesce("best", F.lit(0.0))), F.count(F.lit(1))).alias("recall"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """old with rows replaced by new of the same key, in the place of the first."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    rest = [c for c in old.columns if c not in key and c != order]
    return both.groupBy(*key).agg(F.min_by(order, F.struct("_v", order)).alias(order), F.max_by(F.struct(*rest), F.struct("_v", order)).alias("_r")).select(*key, order, "_r.*")


def obligations(items: DataFrame, by: list[str], audit: str, order: str, most: int = 14) -> DataFrame:
    """Additions of several audits of a group, in the order of the audits and then their own, without near repeats, `most` at most.

    What tells a requirement is its first six words of more than three characters and its sorted mentions, in small letters.
    """
    words = F.slice(F.filter(F.regexp_extract_all(F.lower("requirement"), F.lit(r"\S+"), F.lit(0)), lambda x: F.length(x) > 3), 1, 6)
    mentions = F.sort_array(F.transform(F.filter("mentions", lambda x: x != ""), lambda x: F.lower(F.trim(x))))
    d = items.filter(F.trim("requirement") != "").withColumn("words", F.array_join(words, " ")).withColumn("mentions", mentions)
    rest = [c for c in d.columns if c not in (*by, "words", "mentions", audit, order)]
    first = d.groupBy(*by, "words", "mentions").agg(F.min(F.struct(audit, order, *rest)).alias("_f")).select(*by, "words", "mentions", "_f.*")
    place = F.row_number().over(W.partitionBy(*by).orderBy(audit, order))
    return first.withColumn("place", place.cast("long")).filter(F.col("place") <= most)
