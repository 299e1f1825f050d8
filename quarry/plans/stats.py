"""Queries of paired statistics and diversity (M15-M26)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.fixtures import Views
from quarry.operators import dense as D
from quarry.operators import neighbours as N
from quarry.operators import stats as S
from quarry.operators.aggregate import support_rates
from quarry.plans.aggregates import SUPPORT, support
from quarry.plans.metrics import PER_QUERY, per_query, r6
from quarry.registry import query

DELTAS = f"{PER_QUERY}, dl AS (SELECT a.qkey, a.topic_id, a.ndcg10_exp - b.ndcg10_exp AS delta FROM (SELECT * FROM m WHERE config = 'len') a JOIN (SELECT * FROM m WHERE config = 'id') b ON a.qkey = b.qkey)"


def boot_sql(rows: str, by: str, seed: int) -> str:
    """Views ending in bt (by, low, high): the bootstrap of a view (by, qkey, delta) of groups that fit in one leaf."""
    number = lambda x: f"CAST('0x' || substr(md5({x}), 1, 8) AS BIGINT) % {S.PRIME}"
    cut = lambda q: f"m[least(CAST(floor({q}::DOUBLE * len(m)) AS BIGINT), len(m) - 1) + 1]"
    return f"""dr AS (SELECT id, {number("'r' || id")} AS a FROM (SELECT unnest(range(0, {S.RESAMPLES})) AS id)),
hs AS (SELECT {by}, delta, row_number() OVER (PARTITION BY {by} ORDER BY qkey, delta) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n FROM {rows} WHERE delta IS NOT NULL),
wt AS (SELECT {by}, i AS j, n, {number(f"'{seed}:0:' || i")} AS b FROM hs), pl AS (SELECT {by}, id, a * b % {S.PRIME} % n AS i FROM wt, dr),
me AS (SELECT pl.{by}, id, sum(delta) / max(n) AS mean FROM pl JOIN hs ON pl.{by} = hs.{by} AND pl.i = hs.i GROUP BY 1, 2), so AS (SELECT {by}, list_sort(list(mean)) AS m FROM me GROUP BY 1),
bt AS (SELECT {by}, round({cut((1 - S.CONFIDENCE) / 2)}, 6) AS low, round({cut((1 + S.CONFIDENCE) / 2)}, 6) AS high FROM so)"""


def t_p_sql(t: str, df: str) -> str:
    """Two-sided p of t for a whole number of degrees of freedom, by the finite sums in sine and cosine of its angle."""
    a = f"atan(abs({t}) / sqrt({df}))"
    odd = f"2 / pi() * ({a} + sin({a}) * coalesce(list_sum(list_transform(range(0, CAST(({df} - 1) / 2 AS BIGINT)), lambda k: sqrt(pi()) / 2 * exp(lgamma(k + 1) - lgamma(k + 1.5)) * pow(cos({a}), 2 * k + 1))), 0))"
    even = f"sin({a}) * list_sum(list_transform(range(0, CAST({df} / 2 AS BIGINT)), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * pow(cos({a}), 2 * k)))"
    return f"(1 - CASE WHEN CAST({df} AS BIGINT) % 2 = 1 THEN {odd} ELSE {even} END)"


def normal_p_sql(z: str) -> str:
    """Two-sided p of a normal variable, by a series without cancellation."""
    return f"(CASE WHEN {z} = 0 THEN 1.0 ELSE 1 - 2 * exp(-pow({z}, 2) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 200), lambda k: exp((2 * k + 1) * ln(abs({z})) - (k + 1) * ln(2) - lgamma(k + 1.5) + ln(pi()) / 2))) END)"


def deltas(v: Views) -> DataFrame:
    return S.paired(per_query(v), "len", "id", "ndcg10_exp")


@query("m15_spread", f"WITH {DELTAS} SELECT topic_id, count(delta) AS n, round(avg(delta), 6) AS mean, round(stddev_samp(delta), 6) AS sd, round(median(delta), 6) AS median, round(avg(delta) / nullif(stddev_samp(delta), 0), 6) AS d_z FROM dl GROUP BY 1")
def m15(v: Views) -> DataFrame:
    return S.t_statistics(deltas(v), ["topic_id"]).select("topic_id", "n", *r6("mean", "sd", "median", "d_z"))


@query("m16_paired_t", f"WITH {DELTAS} SELECT topic_id, round(coalesce(avg(delta) / (nullif(stddev_samp(delta), 0) / sqrt(count(delta))), 0), 6) AS t, CAST(count(delta) - 1 AS DOUBLE) AS df FROM dl GROUP BY 1")
def m16(v: Views) -> DataFrame:
    return S.t_statistics(deltas(v), ["topic_id"]).select("topic_id", *r6("t"), "df")


@query("m17_distribution_tails", f"WITH x AS (SELECT doc_id, (length(text) % 399 + 1) / 50.0::DOUBLE AS x, CAST(doc_id % 30 + 1 AS DOUBLE) AS df FROM documents) SELECT doc_id, x, df, round({t_p_sql('x', 'df')}, 9) AS t_p, round({normal_p_sql('x')}, 9) AS normal_p FROM x")
def m17(v: Views) -> DataFrame:
    """Two-sided tails at a statistic of each document."""
    x = v.documents.select("doc_id", ((F.length("text") % 399 + 1) / F.lit(50.0)).alias("x"), (F.col("doc_id") % 30 + 1).cast("double").alias("df"))
    return x.select("doc_id", "x", "df", F.round(S.t_p("x", "df"), 9).alias("t_p"), F.round(S.normal_p("x"), 9).alias("normal_p"))


@query("m18_wilcoxon", f"""WITH {DELTAS}, z AS (SELECT topic_id, delta, abs(delta) AS a FROM dl WHERE delta <> 0), r AS (SELECT *, count(*) OVER (PARTITION BY topic_id, a) AS k, rank() OVER (PARTITION BY topic_id ORDER BY a) AS r0 FROM z),
wx AS (SELECT topic_id, count(*) AS n, least(sum(CASE WHEN delta > 0 THEN r0 + (k - 1) / 2.0 ELSE 0 END), sum(CASE WHEN delta < 0 THEN r0 + (k - 1) / 2.0 ELSE 0 END)) AS w, sum(k * k - 1) AS ties FROM r GROUP BY 1)
SELECT topic_id, n, w, round((w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0), 6) AS z FROM wx""")
def m18(v: Views) -> DataFrame:
    return S.wilcoxon(deltas(v), ["topic_id"]).select("topic_id", "n", "w", *r6("z"))


@query("m19_bootstrap_interval", f"WITH {DELTAS}, {boot_sql('dl', 'topic_id', S.SEED)} SELECT topic_id, low, high FROM bt")
def m19(v: Views) -> DataFrame:
    return S.bootstrap(deltas(v), ["topic_id"]).select("topic_id", *r6("low", "high"))


@query("m20_bonferroni", """WITH x AS (SELECT doc_id, (length(text) % 100) / 1000.0::DOUBLE AS p FROM documents), n AS (SELECT count(DISTINCT source) AS n FROM documents)
SELECT doc_id, p, least(1.0, p * n) AS adjusted, p <= 0.05 / n AS significant FROM x, n""")
def m20(v: Views) -> DataFrame:
    """A p-value of each document, adjusted for as many comparisons as there are sources."""
    n = v.documents.agg(F.countDistinct("source")).collect()[0][0]
    p = (F.length("text") % 100) / F.lit(1000.0)
    return v.documents.select("doc_id", p.alias("p"), S.bonferroni(p, n).alias("adjusted"), (p <= 0.05 / max(1, n)).alias("significant"))


def _t_sql(rows: str) -> str:
    """SELECT of mean, t and p over a view's delta."""
    return f"""SELECT mean, t, CASE WHEN sd IS NULL THEN 1.0 ELSE {t_p_sql('t', 'df')} END AS p FROM (SELECT avg(delta) AS mean, nullif(stddev_samp(delta), 0) AS sd, count(delta) - 1 AS df,
      coalesce(avg(delta) / (nullif(stddev_samp(delta), 0) / sqrt(count(delta))), 0) AS t FROM {rows})"""


@query("m21_comparison_battery", f"""WITH {DELTAS}, dc AS (SELECT 'len' AS candidate, * FROM dl), tp AS (SELECT topic_id, avg(delta) AS delta FROM dl GROUP BY 1), t1 AS ({_t_sql('dl')}), t2 AS ({_t_sql('tp')}),
nz AS (SELECT delta, abs(delta) AS a FROM dl WHERE delta <> 0), rk AS (SELECT *, count(*) OVER (PARTITION BY a) AS k, rank() OVER (ORDER BY a) AS r0 FROM nz),
wx AS (SELECT count(*) AS n, least(sum(CASE WHEN delta > 0 THEN r0 + (k - 1) / 2.0 ELSE 0 END), sum(CASE WHEN delta < 0 THEN r0 + (k - 1) / 2.0 ELSE 0 END)) AS w, sum(k * k - 1) AS ties FROM rk),
wz AS (SELECT (w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0) AS z FROM wx), wp AS (SELECT {normal_p_sql('z')} AS wilcoxon_p FROM wz), {boot_sql('dc', 'candidate', S.SEED)}
SELECT bt.candidate, (SELECT count(*) FROM dl WHERE delta > 0) AS wins, (SELECT count(*) FROM dl WHERE delta < 0) AS losses, (SELECT count(*) FROM dl WHERE delta = 0) AS ties,
round(t1.mean, 6) AS mean, round(t1.t, 6) AS t, round(t1.p, 6) AS p, round(wilcoxon_p, 6) AS wilcoxon_p, round(t2.p, 6) AS topic_p, low, high, round(least(1.0, t1.p * 25), 6) AS adjusted_p, t1.p <= 0.05 / 25 AS significant FROM bt, t1, t2, wp""")
def m21(v: Views) -> DataFrame:
    return S.battery(deltas(v).withColumn("candidate", F.lit("len")), ["candidate"]).select("candidate", "wins", "losses", "ties", *r6("mean", "t", "p", "wilcoxon_p", "topic_p", "low", "high", "adjusted_p"), "significant")


@query("m22_paired_support_interval", f"""WITH {SUPPORT}, sv AS (SELECT run, conv_id, CASE label WHEN 'FS' THEN 1.0::DOUBLE WHEN 'PS' THEN 0.5 WHEN 'NS' THEN 0.0 END AS v FROM p),
rt AS (SELECT run, CAST(conv_id AS VARCHAR) AS qkey, coalesce(sum(v) / nullif(count(v), 0), 0) - sum(coalesce(v, 0)) / count(*) AS delta FROM sv GROUP BY run, conv_id), {boot_sql('rt', 'run', 20260805)} SELECT run, low, high FROM bt""")
def m22(v: Views) -> DataFrame:
    s = support_rates(support(v), ["run", "conv_id"]).select(F.col("run"), F.col("conv_id").cast("string").alias("qkey"), (F.coalesce("precision", F.lit(0.0)) - F.col("recall")).alias("delta"))
    return S.bootstrap(s, ["run"], seed=20260805).select("run", *r6("low", "high"))


@query("m23_vendi")
def m23(v: Views) -> DataFrame:
    return D.vendi(v.embeddings.select("label", "embedding"), ["label"]).select("label", "n", F.round("vendi", 5).alias("vendi"))


_COSINES = "e AS (SELECT vec_id, label, vec_id % 3 AS arm, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query("m24_pair_similarity", f"""WITH {_COSINES}, p AS (SELECT a.label, a.vec_id, a.vec_id < b.vec_id AS once, list_cosine_similarity(a.v, b.v) AS s FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id),
m AS (SELECT label, count(*) AS pairs, avg(s) AS mean FROM p WHERE once GROUP BY 1), t AS (SELECT label, vec_id, max(s) AS twin FROM p GROUP BY 1, 2)
SELECT label, n, coalesce(pairs, 0) AS pairs, round(mean, 5) AS mean, round(coalesce(twins, 0) / n, 6) AS near FROM (SELECT label, count(*) AS n FROM e GROUP BY 1) LEFT JOIN m USING (label) LEFT JOIN (SELECT label, count(*) AS twins FROM t WHERE twin >= 0.9 GROUP BY 1) USING (label)""")
def m24(v: Views) -> DataFrame:
    """Mean cosine over the pairs of a group, and the share of its vectors that have a twin: another one of cosine 0.9 or more."""
    e = v.embeddings.select("label", "vec_id", "embedding")
    twins = N.nearest(e, ["label"], at_least=0.9).groupBy("label").agg(F.avg(F.col("nearest").isNotNull().cast("double")).alias("near"))
    return D.mean_cosine(e, ["label"]).join(twins, "label").select("label", "n", "pairs", F.round("mean", 5).alias("mean"), *r6("near"))


@query("m25_unique_contribution", f"""WITH {_COSINES}, n AS (SELECT a.vec_id, max(list_cosine_similarity(a.v, b.v)) AS nearest FROM e a JOIN e b ON a.label = b.label AND a.arm <> b.arm GROUP BY 1)
SELECT label, arm, count(*) AS n, count(*) FILTER (WHERE coalesce(nearest, -1) < 0.9) AS alone, round(count(*) FILTER (WHERE coalesce(nearest, -1) < 0.9) / count(*), 6) AS "unique" FROM e LEFT JOIN n USING (vec_id) GROUP BY 1, 2""")
def m25(v: Views) -> DataFrame:
    """How many of an arm's vectors no other arm of the group has anything like; all, if there is no other arm."""
    g = N.nearest(_arms(v), ["label"], "arm", at_least=0.9).groupBy("label", "arm").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("nearest").isNull()).alias("alone"))
    return g.select("*", F.round(F.col("alone") / F.col("n"), 6).alias("unique"))


@query("m25_vendi_gain")
def m25_gain(v: Views) -> DataFrame:
    """What the other arms add to an arm's effective number of vectors."""
    return D.vendi_gain(_arms(v), ["label"], "arm").select("label", "arm", "n", *(F.round(c, 5).alias(c) for c in ("vendi", "together", "gain")))


def _arms(v: Views) -> DataFrame:
    return v.embeddings.select("label", (F.col("vec_id") % 3).alias("arm"), "vec_id", "embedding")


@query("m26_gate_distance", """WITH s AS (SELECT topic_id, max(n) / sum(n) AS modal FROM (SELECT topic_id, grade, count(*) AS n FROM qrels GROUP BY 1, 2) GROUP BY 1) SELECT topic_id, round(greatest(0.3 - modal, modal - 0.75, 0), 6) AS distance FROM s""")
def m26(v: Views) -> DataFrame:
    n = v.qrels.groupBy("topic_id", "grade").count().groupBy("topic_id").agg((F.max("count") / F.sum("count")).alias("m"))
    return n.select("topic_id", F.round(F.greatest(F.lit(0.3) - F.col("m"), F.col("m") - 0.75, F.lit(0.0)), 6).alias("distance"))
