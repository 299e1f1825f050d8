"""Graded relevance metrics. Unjudged counts as grade 0; a metric without a denominator is null, never 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DEPTH = 30


def gain(grade: Column, kind: str = "exp") -> Column:
    """exp: 2**g - 1; lin: g; bin1, bin2: whether g reaches the threshold."""
    if kind == "exp":
        return F.pow(F.lit(2.0), grade) - 1
    if kind == "lin":
        return grade.cast("double")
    return F.when(grade >= int(kind[3:]), 1.0).otherwise(0.0)


def discount(rank: Column) -> Column:
    return 1.0 / F.log2(rank + F.lit(1.0))


def graded(runs: DataFrame, qrels: DataFrame) -> DataFrame:
    """Runs with grade (0 if unjudged) and whether judged."""
    g = qrels.select("topic_id", "chunk_id", F.col("grade").alias("_g"))
    return runs.join(g, ["topic_id", "chunk_id"], "left").withColumn("judged", F.col("_g").isNotNull()).withColumn("grade", F.coalesce("_g", F.lit(0))).drop("_g")


def dcg(k: int, kind: str = "exp") -> Column:
    """Aggregate over graded rows of one ranking."""
    return F.sum(F.when(F.col("rnk") <= k, gain(F.col("grade"), kind) * discount(F.col("rnk"))).otherwise(0.0))


def ideals(qrels: DataFrame, ks: tuple[int, ...] = (10,), kinds: tuple[str, ...] = ("exp", "lin", "bin2")) -> DataFrame:
    """Per topic: ideal DCG of all its judged grades, and its numbers of relevant units."""
    r = qrels.withColumn("rnk", F.row_number().over(W.partitionBy("topic_id").orderBy(F.desc("grade"), "chunk_id")))
    return r.groupBy("topic_id").agg(
        *(dcg(k, kind).alias(f"idcg{k}_{kind}") for k in ks for kind in kinds),
        F.count_if(F.col("grade") >= 1).alias("rel1"),
        F.count_if(F.col("grade") >= 2).alias("rel2"),
    )


def query_metrics(runs: DataFrame, qrels: DataFrame, k: int = 10, depth: int = DEPTH) -> DataFrame:
    """All metrics of every (config, qkey) in one aggregation; only the ideals come from a second, small one."""
    w = W.partitionBy("config", "qkey").orderBy("rnk").rowsBetween(W.unboundedPreceding, 0)
    g = graded(runs.filter(F.col("rnk") <= depth), qrels)
    for t in (1, 2):
        g = g.withColumn(f"hit{t}", F.sum((F.col("grade") >= t).cast("int")).over(w))
    top = F.col("rnk") <= k
    q = g.groupBy("config", "topic_id", "qkey").agg(
        *(dcg(k, kind).alias(f"dcg_{kind}") for kind in ("exp", "lin", "bin2")),
        (F.count_if(top & (F.col("grade") >= 2)) / k).alias("p10_bin2"),
        (F.sum(F.when(top, F.col("grade")).otherwise(0)) / (3 * k)).alias("gp10"),
        F.count_if(top & (F.col("grade") >= 2)).alias("hits10"),
        *(F.sum(F.when(F.col("grade") >= t, F.col(f"hit{t}") / F.col("rnk")).otherwise(0.0)).alias(f"ap_{t}") for t in (1, 2)),
        F.count_if(top & F.col("judged")).alias("judged10"),
        F.least(F.count(F.lit(1)), F.lit(k)).alias("shown10"),
    )
    q = q.join(ideals(qrels, (k,)), "topic_id", "left")
    ratio = lambda a, b: F.col(a) / F.nullif(F.col(b).cast("double"), F.lit(0.0))
    return q.select(
        "config", "topic_id", "qkey",
        *(ratio(f"dcg_{kind}", f"idcg{k}_{kind}").alias(f"ndcg10_{kind}") for kind in ("exp", "lin", "bin2")),
        "gp10", "p10_bin2",
        ratio("hits10", "rel2").alias("recall10_bin2"),
        ratio("ap_1", "rel1").alias("map30_bin1"),
        ratio("ap_2", "rel2").alias("map30_bin2"),
        "judged10",
        (F.col("judged10") / F.col("shown10")).alias("coverage10"),
    )


METRICS = ("ndcg10_exp", "ndcg10_lin", "ndcg10_bin2", "gp10", "p10_bin2", "recall10_bin2", "map30_bin1", "map30_bin2")


def config_scores(per_query: DataFrame) -> DataFrame:
    """Per configuration: mean, mean of topic means and defined count of each metric."""
    topics = per_query.groupBy("config", "topic_id").agg(*(F.avg(m).alias(f"{m}_topic") for m in METRICS), *(F.sum(m).alias(f"{m}_sum") for m in METRICS), *(F.count(m).alias(f"{m}_n") for m in METRICS))
    return topics.groupBy("config").agg(
        *(F.try_divide(F.sum(f"{m}_sum"), F.sum(f"{m}_n")).alias(m) for m in METRICS), *(F.avg(f"{m}_topic").alias(f"{m}_topics") for m in METRICS), *(F.sum(f"{m}_n").alias(f"{m}_n") for m in METRICS)
    )


def self_ideal_ndcg(graded_rows: DataFrame, k: int = 10, kind: str = "lin") -> DataFrame:
    """nDCG against the best order of the retrieved list itself, 0 where that has no gain."""
    w = W.partitionBy("config", "qkey").orderBy(F.desc("grade"), "rnk")
    best = graded_rows.withColumn("best", F.row_number().over(w))
    own = F.sum(F.when(F.col("rnk") <= k, gain(F.col("grade"), kind) * discount(F.col("rnk"))).otherwise(0.0))
    ideal = F.sum(F.when(F.col("best") <= k, gain(F.col("grade"), kind) * discount(F.col("best"))).otherwise(0.0))
    return best.groupBy("config", "qkey").agg(own.alias("dcg"), ideal.alias("idcg")).select("config", "qkey", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def average_ranks(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Rank of each value within `by`, ties sharing their mean rank."""
    return df.withColumn("avg_rank", F.rank().over(W.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(W.partitionBy(*by, value)) - 1) / 2.0)


def auc(df: DataFrame, grade: str, positive: Column, by: list[str]) -> DataFrame:
    """Share of (positive, negative) pairs in right order, ties a half, by rank sums: no pair is formed."""
    r = average_ranks(df.withColumn("_pos", positive), grade, by)
    p = F.count_if(F.col("_pos")).cast("double")
    n = F.count_if(~F.col("_pos")).cast("double")
    return r.groupBy(*by).agg(F.try_divide(F.sum(F.when(F.col("_pos"), F.col("avg_rank")).otherwise(0.0)) - p * (p + 1) / 2, p * n).alias("auc"))
