"""Paired statistics: tests, intervals and the battery that puts them together."""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quarry.operators.order import global_rank

RESAMPLES, SEED, CONFIDENCE = 10_000, 13, 0.95


def paired(scores: DataFrame, candidate: str, baseline: str, metric: str) -> DataFrame:
    """(qkey, topic_id, delta) over the same queries; a query that one side lacks is an error."""
    side = lambda c: F.max(F.when(F.col("config") == c, F.struct(F.col(metric).alias("x"))))
    g = scores.filter(F.col("config").isin(candidate, baseline)).groupBy("qkey", "topic_id").agg(side(candidate).alias("a"), side(baseline).alias("b"))
    lacking = F.col("a").isNull() | F.col("b").isNull()
    return g.select("qkey", "topic_id", F.when(lacking, F.raise_error(F.concat(F.lit("scored by one side only: "), F.col("qkey")))).otherwise(F.col("a.x") - F.col("b.x")).alias("delta"))


def log_gamma_ratio(a: float, b: float) -> float:
    return math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if not 0.0 <= x <= 1.0:
        raise ValueError(x)
    if x in (0.0, 1.0):
        return x
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1.0 - x)
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    else:
        raise ArithmeticError(f"no convergence at a={a}, b={b}, x={x}")
    return math.exp(log_gamma_ratio(a, b) + a * math.log(x) + b * math.log1p(-x)) * f / a


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def t_two_sided(t: float, df: float) -> float:
    return 1.0 if t == 0 else min(1.0, beta_inc(df / 2.0, 0.5, df / (df + t * t)))


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) or b <= 0 else 0.0 if math.isinf(a) else t_two_sided(a, b) for a, b in zip(t, df)], dtype=float)


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return z.map(lambda x: None if pd.isna(x) else min(1.0, 2.0 * normal_sf(abs(x)))).astype(float)


def t_statistics(deltas: DataFrame, by: list[str]) -> DataFrame:
    """n, mean, sd, effect size (null at sd 0), t and two-sided p; without spread t is 0 and p is 1."""
    g = deltas.groupBy(*by).agg(F.count("delta").alias("n"), F.avg("delta").alias("mean"), F.stddev_samp("delta").alias("sd"), F.median("delta").alias("median"))
    sd = F.nullif(F.col("sd"), F.lit(0.0))
    g = g.withColumn("d_z", F.col("mean") / sd).withColumn("t", F.coalesce(F.col("mean") / (sd / F.sqrt(F.col("n").cast("double"))), F.lit(0.0))).withColumn("df", (F.col("n") - 1).cast("double"))
    return g.withColumn("p", F.when(sd.isNull(), F.lit(1.0)).otherwise(t_p("t", "df")))


def wilcoxon(deltas: DataFrame, by: list[str]) -> DataFrame:
    """Signed ranks without zeros: W, tie-corrected z and two-sided p."""
    d = deltas.filter("delta != 0").withColumn("a", F.abs("delta"))
    ties = W.partitionBy(*by, "a")
    r = d.withColumn("k", F.count(F.lit(1)).over(ties)).withColumn("r", F.rank().over(W.partitionBy(*by).orderBy("a")) + (F.col("k") - 1) / 2.0)
    g = r.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.when(F.col("delta") > 0, F.col("r")).otherwise(0.0)).alias("plus"), F.sum(F.when(F.col("delta") < 0, F.col("r")).otherwise(0.0)).alias("minus"), F.sum((F.col("k") * F.col("k") - 1).cast("double")).alias("ties"))
    n = F.col("n")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    z = F.when(var > 0, (F.least("plus", "minus") - n * (n + 1) / 4) / F.sqrt(var)).otherwise(0.0)
    return g.withColumn("w", F.least("plus", "minus")).withColumn("z", z).withColumn("p", normal_p("z")).select(*by, F.col("n").cast("long").alias("n"), "w", "z", "p")


#: Modulus of the draws: numbers of a resample and of a draw are multiplied below a prime of 31 bits, so that products fit in 64.
PRIME = (1 << 31) - 1
#: Rows of a group that are drawn from in one task.
LEAF = 4_096


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % PRIME


def shares(n: int, leaf: int, resamples: int, seed: int, size: int = LEAF) -> np.ndarray:
    """How many of a resample's n draws fall into a leaf of `size` rows, for every resample.

    The draws are split in halves of the leaves, again and again, by binomial numbers that hang on the seed and the halves alone: leaves
    agree on them without a word, and together have n draws.
    """
    m = np.full(resamples, n, np.int64)
    lo, hi = 0, -(-n // size)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rows, left = min(hi * size, n) - lo * size, (mid - lo) * size
        drawn = np.random.default_rng([seed, lo, hi]).binomial(m, left / rows)
        m, lo, hi = (drawn, lo, mid) if leaf < mid else (m - drawn, mid, hi)
    return m


def drawn_sums(x: np.ndarray, m: np.ndarray, leaf: int, seed: int) -> np.ndarray:
    """Sum of m[r] draws from x with replacement, for each resample r; the place of a draw is a product of two hashed numbers."""
    a = np.array([_number(f"r{r}") for r in range(len(m))], np.int64)
    b = np.array([_number(f"{seed}:{leaf}:{j}") for j in range(int(m.max(initial=0)))], np.int64)
    out = np.zeros(len(m))
    for lo in range(0, len(m), 256):
        part = slice(lo, lo + 256)
        at = (a[part, None] * b) % PRIME % len(x)
        out[part] = np.where(np.arange(len(b)) < m[part, None], x[at], 0.0).sum(1)
    return out


def bootstrap(deltas: DataFrame, by: list[str], resamples: int = RESAMPLES, seed: int = SEED, confidence: float = CONFIDENCE, leaf: int = LEAF) -> DataFrame:
    """Percentile interval of the mean delta: each resample draws as many rows as a group has, with replacement; fewer than 2 are an error.

    A group's rows are dealt, in the order of qkey, to leaves of bounded size; a leaf is a task, which draws its share of every resample
    and hands on one sum for each. Draws hang on seed and places alone, so that any engine and any run repeats them.
    """
    order = [F.col(c) for c in (*by, "qkey", "delta")]
    rows = global_rank(deltas.filter("delta IS NOT NULL").select(*by, "qkey", "delta"), order)
    few = F.raise_error(F.concat(F.lit("a bootstrap needs 2 values, "), F.to_json(F.struct(*by)), F.lit(" has one")))
    sizes = rows.groupBy(*by).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).select(*by, "first", F.when(F.col("n") < 2, few).otherwise(F.col("n")).alias("n"))
    sizes = sizes.withColumnsRenamed({c: f"_{c}" for c in by})
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by))
    i = F.col("place") - F.col("first")
    dealt = rows.join(sizes, same).select(*by, "delta", "n", i.alias("i"), F.floor(i / leaf).alias("leaf"))
    schema = ", ".join([*(f"{c} {deltas.schema[c].dataType.simpleString()}" for c in by), "n long, id int, s double"])

    def draw(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        n, k = int(g["n"].iloc[0]), int(key[-1])
        sums = drawn_sums(g.sort_values("i")["delta"].to_numpy(np.float64), shares(n, k, resamples, seed, leaf), k, seed)
        return pd.DataFrame({**{c: [v] * resamples for c, v in zip(by, key)}, "n": n, "id": np.arange(resamples, dtype=np.int32), "s": sums})

    means = dealt.groupBy(*by, "leaf").applyInPandas(draw, schema).groupBy(*by, "id").agg((F.sum("s") / F.max("n")).alias("mean"))
    means = means.groupBy(*by).agg(F.sort_array(F.collect_list("mean")).alias("m"))
    cut = lambda q: F.get("m", F.least(F.floor(F.lit(q) * F.size("m")), F.size("m") - 1).cast("int"))
    return means.select(*by, cut((1 - confidence) / 2).alias("low"), cut((1 + confidence) / 2).alias("high"))


def bonferroni(p: Column, comparisons: int) -> Column:
    return F.least(F.lit(1.0), p * comparisons)


def battery(deltas: DataFrame, by: list[str], comparisons: int = 25, alpha: float = 0.05) -> DataFrame:
    """Wins, losses, ties, t, Wilcoxon, interval and verdict, by query and by topic means."""
    counts = deltas.groupBy(*by).agg(F.count_if(F.col("delta") > 0).alias("wins"), F.count_if(F.col("delta") < 0).alias("losses"), F.count_if(F.col("delta") == 0).alias("ties"))
    t = t_statistics(deltas, by)
    w = wilcoxon(deltas, by).select(*by, F.col("p").alias("wilcoxon_p"))
    topics = deltas.groupBy(*by, "topic_id").agg(F.avg("delta").alias("delta"))
    tt = t_statistics(topics, by).select(*by, F.col("p").alias("topic_p"))
    out = counts.join(t, by).join(w, by, "left").join(tt, by).join(bootstrap(deltas, by), by)
    return out.withColumn("adjusted_p", bonferroni(F.col("p"), comparisons)).withColumn("significant", F.col("p") <= alpha / comparisons)
