"""Queries of aggregations (section A)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.fixtures import Views
from quarry.functions import text as T
from quarry.operators import aggregate as A
from quarry.operators import judging as J
from quarry.operators import metrics as M
from quarry.plans.metrics import PER_QUERY, per_query, r6
from quarry.registry import query



@query("a01_mean", "SELECT user_id, round(avg(value), 6) AS mean, round(avg(value) FILTER (WHERE event_type = 'none'), 6) AS empty FROM events GROUP BY 1")
def a01(v: Views) -> DataFrame:
    return v.events.groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.avg(F.when(F.col("event_type") == "none", F.col("value"))), 6).alias("empty"))


@query("a02_mean_of_topic_means", f"WITH {PER_QUERY} SELECT config, round(avg(t), 6) AS mean FROM (SELECT config, topic_id, avg(ndcg10_exp) AS t FROM m GROUP BY 1, 2) GROUP BY 1")
def a02(v: Views) -> DataFrame:
    return per_query(v).groupBy("config", "topic_id").agg(F.avg("ndcg10_exp").alias("t")).groupBy("config").agg(F.round(F.avg("t"), 6).alias("mean"))


@query("a03_defined_counts", f"WITH {PER_QUERY} SELECT config, {', '.join(f'count({c}) AS {c}' for c in M.METRICS)} FROM m GROUP BY 1")
def a03(v: Views) -> DataFrame:
    return per_query(v).groupBy("config").agg(*(F.count(c).alias(c) for c in M.METRICS))


LATEST = "l AS (SELECT jkey, arg_max(grade, (ts, event_id)) AS grade, arg_max(event_id, (ts, event_id)) AS event_id, any_value(topic_id) AS topic_id FROM log WHERE NOT failed AND grade IS NOT NULL GROUP BY 1)"


@query("a04_latest_wins", f"WITH {LATEST} SELECT jkey, grade, event_id FROM l")
def a04(v: Views) -> DataFrame:
    return J.latest(v.log).select("jkey", "grade", "event_id")


@query("a05_cache_rebuild", "SELECT event_id % 2 AS version, count(*) AS records, count(*) FILTER (WHERE failed) AS failures, count(DISTINCT jkey) FILTER (WHERE NOT failed) AS cached FROM log GROUP BY 1")
def a05(v: Views) -> DataFrame:
    return v.log.groupBy((F.col("event_id") % 2).alias("version")).agg(F.count(F.lit(1)).alias("records"), F.count_if("failed").alias("failures"), F.countDistinct(F.when(~F.col("failed"), F.col("jkey"))).alias("cached"))


@query("a06_incremental_cache", f"WITH {LATEST} SELECT jkey, grade, event_id FROM l")
def a06(v: Views) -> DataFrame:
    cut = F.col("event_id") % 3 == 0
    snapshot = J.latest(v.log.filter(cut))
    return J.latest(snapshot.unionByName(v.log.filter(~cut))).select("jkey", "grade", "event_id")


@query("a07_grade_histogram", "SELECT t.topic_id, g.grade, count(q.grade) AS n FROM (SELECT DISTINCT topic_id FROM qrels) t CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS grade) g LEFT JOIN qrels q ON q.topic_id = t.topic_id AND q.grade = g.grade GROUP BY 1, 2")
def a07(v: Views) -> DataFrame:
    return J.histogram(v.qrels, "topic_id")


HIST = "h AS (SELECT topic_id, grade, count(*) AS n FROM qrels GROUP BY 1, 2), s AS (SELECT topic_id, sum(n) AS total, max(n) AS top, arg_max(grade, (n, -grade)) AS modal FROM h GROUP BY 1)"


@query("a08_entropy", f"WITH {HIST} SELECT h.topic_id, round(-sum(n / total * log2(n / total)), 6) AS entropy FROM h JOIN s ON h.topic_id = s.topic_id GROUP BY 1")
def a08(v: Views) -> DataFrame:
    return J.shape(J.histogram(v.qrels, "topic_id"), "topic_id").select("topic_id", *r6("entropy"))


@query("a09_modal_gate", f"WITH {HIST} SELECT topic_id, CAST(modal AS INT) AS modal, round(top / total, 6) AS share, CASE WHEN top / total < 0.3 THEN 'low' WHEN top / total > 0.75 THEN 'high' ELSE 'pass' END AS verdict FROM s")
def a09(v: Views) -> DataFrame:
    s = J.shape(J.histogram(v.qrels, "topic_id"), "topic_id")
    m = F.col("modal_share")
    return s.select("topic_id", F.col("modal").cast("int").alias("modal"), F.round(m, 6).alias("share"), F.when(m < 0.3, "low").when(m > 0.75, "high").otherwise("pass").alias("verdict"))


@query("a10_reweighting", """WITH c AS (SELECT source AS cls, grade, count(*) AS n FROM qrels JOIN corpus ON docid = chunk_id GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY cls) AS p FROM c),
m AS (SELECT source AS cls, count(*) AS w FROM corpus GROUP BY 1), s AS (SELECT sum(w) AS s FROM m WHERE cls IN (SELECT cls FROM c)) SELECT grade, round(sum(p * w / s), 6) AS share FROM p JOIN m USING (cls), s GROUP BY 1""")
def a10(v: Views) -> DataFrame:
    c = v.qrels.join(v.corpus, F.col("docid") == F.col("chunk_id")).groupBy(F.col("source").alias("cls"), "grade").agg(F.count(F.lit(1)).alias("n"))
    return J.reweight(c, v.corpus.groupBy(F.col("source").alias("cls")).agg(F.count(F.lit(1)).alias("w"))).select("grade", *r6("share"))


@query("a11_pool_statistics", """WITH p AS (SELECT DISTINCT topic_id, qkey, chunk_id FROM runs WHERE rnk <= 5), q AS (SELECT qkey, count(*) AS n FROM p GROUP BY 1), t AS (SELECT topic_id, count(DISTINCT chunk_id) AS n FROM p GROUP BY 1)
SELECT (SELECT count(*) FROM q) AS queries, (SELECT count(*) FROM t) AS topics, (SELECT CAST(sum(n) AS BIGINT) FROM t) AS pairs, round((SELECT avg(n) FROM q), 6) AS per_query, round((SELECT avg(n) FROM t), 6) AS per_topic, round((SELECT sum(n) FROM q) / (SELECT sum(n) FROM t), 6) AS inflation""")
def a11(v: Views) -> DataFrame:
    p = v.runs.filter("rnk <= 5").select("topic_id", "qkey", "chunk_id").distinct()
    q = p.groupBy("topic_id", "qkey").agg(F.count(F.lit(1)).alias("n")).groupBy("topic_id").agg(F.count(F.lit(1)).alias("queries"), F.sum("n").alias("total"))
    t = p.groupBy("topic_id").agg(F.countDistinct("chunk_id").alias("pairs"))
    return q.join(t, "topic_id").agg(F.sum("queries").alias("queries"), F.count(F.lit(1)).alias("topics"), F.sum("pairs").alias("pairs"), F.round(F.sum("total") / F.sum("queries"), 6).alias("per_query"), F.round(F.avg("pairs"), 6).alias("per_topic"), F.round(F.sum("total") / F.sum("pairs"), 6).alias("inflation"))


@query("a12_rubric_coverage", """SELECT coalesce(qid, 'all') AS qid, round(coalesce(count(*) FILTER (WHERE weight >= 3 AND grade_a = 2) / nullif(count(*) FILTER (WHERE weight >= 3), 0), 0), 4) AS vital_strict, round(count(*) FILTER (WHERE grade_a = 2) / count(*), 4) AS all_strict
FROM rubric GROUP BY ROLLUP (qid)""")
def a12(v: Views) -> DataFrame:
    vital, hit = F.col("weight") >= 3, F.col("grade_a") == 2
    g = v.rubric.rollup("qid").agg(F.round(F.coalesce(F.try_divide(F.count_if(vital & hit), F.count_if(vital)), F.lit(0.0)), 4).alias("vital_strict"), F.round(F.count_if(hit) / F.count(F.lit(1)), 4).alias("all_strict"))
    return g.withColumn("qid", F.coalesce("qid", F.lit("all")))


@query("a13_template_consistency", "WITH t AS (SELECT qid, cid % 2 AS run, md5(string_agg(axis, ',' ORDER BY axis)) AS template FROM (SELECT DISTINCT qid, cid % 2 AS cid, axis FROM rubric) GROUP BY 1, 2) SELECT qid, count(DISTINCT template) = 1 AS consistent FROM t GROUP BY 1")
def a13(v: Views) -> DataFrame:
    t = v.rubric.groupBy("qid", (F.col("cid") % 2).alias("run")).agg(F.md5(F.array_join(F.array_sort(F.collect_set("axis")), ",")).alias("template"))
    return t.groupBy("qid").agg((F.countDistinct("template") == 1).alias("consistent"))


@query("a14_weighted_coverage", """SELECT qid, axis, round(sum(CASE WHEN greatest(grade_a, grade_b) >= 1 AND weight > 0 THEN weight ELSE 0 END) / nullif(sum(CASE WHEN weight > 0 THEN weight ELSE 0 END), 0), 6) AS lenient,
round(sum(CASE WHEN greatest(grade_a, grade_b) >= 2 AND weight > 0 THEN weight ELSE 0 END) / nullif(sum(CASE WHEN weight > 0 THEN weight ELSE 0 END), 0), 6) AS strict FROM rubric GROUP BY 1, 2""")
def a14(v: Views) -> DataFrame:
    a = A.coverage(v.rubric, ["qid", "axis"], 1).withColumnRenamed("coverage", "lenient")
    b = A.coverage(v.rubric, ["qid", "axis"], 2).withColumnRenamed("coverage", "strict")
    return a.join(b, ["qid", "axis"]).select("qid", "axis", *r6("lenient", "strict"))


@query("a15_breakdown", "SELECT label, value, engine, round(avg(g), 6) AS mean FROM (SELECT 'axis' AS label, axis AS value, 'a' AS engine, grade_a AS g FROM rubric UNION ALL SELECT 'axis', axis, 'b', grade_b FROM rubric UNION ALL SELECT 'qid', qid, 'a', grade_a FROM rubric UNION ALL SELECT 'qid', qid, 'b', grade_b FROM rubric) GROUP BY 1, 2, 3")
def a15(v: Views) -> DataFrame:
    s = v.rubric.selectExpr("stack(4, 'axis', axis, 'a', grade_a, 'axis', axis, 'b', grade_b, 'qid', qid, 'a', grade_a, 'qid', qid, 'b', grade_b) AS (label, value, engine, g)")
    return s.groupBy("label", "value", "engine").agg(F.round(F.avg("g"), 6).alias("mean"))


@query("a16_signed_score", "SELECT qid, round(sum(weight * grade_a / 2.0) / nullif(sum(greatest(weight, 0)), 0), 6) AS score, count(*) FILTER (WHERE weight <= -4 AND grade_a > 0) AS severe FROM rubric GROUP BY 1")
def a16(v: Views) -> DataFrame:
    return A.signed_score(v.rubric, ["qid"], F.col("grade_a") / 2).select("qid", *r6("score"), "severe")


@query("a17_axis_score", "SELECT qid, axis, round(sum(weight * grade_a / 2.0) / sum(abs(weight)), 6) AS score FROM rubric GROUP BY 1, 2")
def a17(v: Views) -> DataFrame:
    return v.rubric.groupBy("qid", "axis").agg(F.round(F.sum(F.col("weight") * F.col("grade_a") / 2) / F.sum(F.abs("weight")), 6).alias("score"))


@query("a18_criterion_tally", "SELECT axis, count(*) FILTER (WHERE sign(weight) * (grade_a - grade_b) > 0) AS a_better, count(*) FILTER (WHERE grade_a = grade_b) AS tied, CAST(sum(abs(weight) * abs(grade_a - grade_b)) AS BIGINT) AS magnitude FROM rubric GROUP BY 1")
def a18(v: Views) -> DataFrame:
    d = F.col("grade_a") - F.col("grade_b")
    return v.rubric.groupBy("axis").agg(F.count_if(F.signum("weight") * d > 0).alias("a_better"), F.count_if(d == 0).alias("tied"), F.sum(F.abs("weight") * F.abs(d)).alias("magnitude"))


@query("a19_candidate_score", "SELECT qid, round((sum(CASE WHEN weight > 0 THEN weight * (grade_a = 2)::INT ELSE 0 END) - sum(CASE WHEN weight < 0 THEN -weight * (grade_a = 2)::INT ELSE 0 END)) / nullif(sum(greatest(weight, 0)), 0), 6) AS score FROM rubric GROUP BY 1")
def a19(v: Views) -> DataFrame:
    return A.signed_score(v.rubric, ["qid"], (F.col("grade_a") == 2).cast("int")).select("qid", *r6("score"))


@query("a20_criteria_fingerprint", "SELECT qid, sha256(string_agg(cid || ':' || axis, '|' ORDER BY cid)) AS fingerprint FROM rubric GROUP BY 1")
def a20(v: Views) -> DataFrame:
    x = F.array_sort(F.collect_list(F.struct("cid", "axis")))
    return v.rubric.groupBy("qid").agg(F.sha2(F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["cid"].cast("string"), s["axis"])), "|"), 256).alias("fingerprint"))


_RULES = {"a21_percentile_floor": ("floor", "least(CAST(floor(q * n) AS BIGINT), n - 1)"), "a22_percentile_ceil": ("ceil", "greatest(CAST(ceil(q * n) AS BIGINT), 1) - 1"), "a23_percentile_lower": ("lower", "CAST(floor(q * (n - 1)) AS BIGINT)")}
for _name, (_rule, _sql) in _RULES.items():
    query(_name, f"""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(value) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
    q AS (SELECT unnest([0.5, 0.95, 0.99]::DOUBLE[]) AS q) SELECT event_type, q, value FROM r JOIN q ON i = {_sql}""")(lambda v, rule=_rule: A.percentiles(v.events, ["event_type"], "value", [0.5, 0.95, 0.99], rule))

query("a24_chunk_percentiles", f"""WITH r AS (SELECT doc_id % 4 AS part, length(contents) AS value, row_number() OVER (PARTITION BY doc_id % 4 ORDER BY length(contents)) - 1 AS i, count(*) OVER (PARTITION BY doc_id % 4) AS n FROM chunks),
q AS (SELECT unnest([0.5, 0.9]::DOUBLE[]) AS q) SELECT part, q, CAST(any_value(value) AS INT) AS value FROM r JOIN q ON i = {_RULES['a21_percentile_floor'][1]} GROUP BY 1, 2""")(
    lambda v: A.percentiles(v.chunks.select((F.col("doc_id") % 4).alias("part"), F.length("contents").alias("value")), ["part"], "value", [0.5, 0.9], "floor"))


@query("a25_bootstrap_percentile", """WITH r AS (SELECT topic_id, value, row_number() OVER (PARTITION BY topic_id ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY topic_id) AS n FROM log),
q AS (SELECT unnest([0.025, 0.975]::DOUBLE[]) AS q) SELECT topic_id, q, value FROM r JOIN q ON i = least(CAST(floor(q * n) AS BIGINT), n - 1)""")
def a25(v: Views) -> DataFrame:
    return A.percentiles(v.log, ["topic_id"], "value", [0.025, 0.975], "floor")


@query("a26_histogram", "SELECT CAST(least(floor(length(contents) / 500) * 500, 5000) AS BIGINT) AS bucket, count(*) AS n FROM corpus GROUP BY 1")
def a26(v: Views) -> DataFrame:
    return v.corpus.groupBy(F.least(F.floor(F.length("contents") / 500) * 500, F.lit(5000)).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("a27_latency_summary", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
p AS (SELECT event_type, max(value) FILTER (WHERE i = CAST(floor(0.5::DOUBLE * (n - 1)) AS BIGINT)) AS p50, max(value) FILTER (WHERE i = CAST(floor(0.95::DOUBLE * (n - 1)) AS BIGINT)) AS p95 FROM r GROUP BY 1)
SELECT e.event_type, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, any_value(p50) AS p50, any_value(p95) AS p95 FROM events e JOIN p ON e.event_type = p.event_type GROUP BY 1""")
def a27(v: Views) -> DataFrame:
    p = A.percentiles(v.events, ["event_type"], "value", [0.5, 0.95], "lower").groupBy("event_type").agg(F.max(F.when(F.col("q") == 0.5, F.col("value"))).alias("p50"), F.max(F.when(F.col("q") == 0.95, F.col("value"))).alias("p95"))
    s = v.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean"))
    return s.join(p, "event_type")


COST = "c AS (SELECT *, round_even(value / 1000, 8) AS usd, row_number() OVER (PARTITION BY jkey ORDER BY ts, event_id) > 3 AS repeated FROM log)"


def costs(v: Views) -> DataFrame:
    w = W.partitionBy("jkey").orderBy("ts", "event_id")
    return v.log.withColumn("usd", F.bround(F.col("value") / 1000, 8)).withColumn("repeated", F.row_number().over(w) > 3)


@query("a28_cost_report", f"WITH {COST} SELECT event_type, count(*) AS calls, count(DISTINCT jkey) AS keys, round(sum(usd), 6) AS usd, round(sum(usd * failed::INT), 6) AS failed_usd, round(sum(usd * repeated::INT), 6) AS repeated_usd, round(sum(usd * (failed OR repeated)::INT), 6) AS waste_usd FROM c GROUP BY 1")
def a28(v: Views) -> DataFrame:
    g = costs(v).groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("jkey").alias("keys"), *A.waste(F.col("usd")))
    return g.select("event_type", "calls", "keys", *r6("usd", "failed_usd", "repeated_usd", "waste_usd"))


@query("a29_pilot_extrapolation", f"WITH {COST} SELECT topic_id, round(avg(usd) * 12840, 6) AS projected, avg(usd) * 12840 > 600 AS over_cap FROM c GROUP BY 1")
def a29(v: Views) -> DataFrame:
    return costs(v).groupBy("topic_id").agg((F.avg("usd") * 12840).alias("x")).select("topic_id", F.round("x", 6).alias("projected"), (F.col("x") > 600).alias("over_cap"))


TOK = "(event_id % 5000) AS tin, (event_id % 1000) AS cached, (event_id % 300) AS written, (event_id % 700) AS tout"


@query("a30_call_cost", f"WITH t AS (SELECT event_id, {TOK} FROM events) SELECT event_id, round(round_even((tin - cached + written) / 1000.0 * 0.003::DOUBLE, 8) + round_even(cached / 1000.0 * 0.0003::DOUBLE, 8) + round_even(tout / 1000.0 * 0.015::DOUBLE, 8), 8) AS usd FROM t")
def a30(v: Views) -> DataFrame:
    m = lambda n: (F.col("event_id") % n).cast("double")
    return v.events.select("event_id", F.round(A.call_cost(m(5000), m(1000), m(300), m(700), 0.003, 0.0003, 0.015), 8).alias("usd"))


@query("a31_cache_aware_cost", f"WITH t AS (SELECT event_id, {TOK} FROM events) SELECT event_id, round((greatest(tin - cached - written, 0) * 3.0 + cached * 0.3 + written * 3.75 + tout * 15.0) / 1e6, 8) AS usd FROM t")
def a31(v: Views) -> DataFrame:
    m = lambda n: F.col("event_id") % n
    return v.events.select("event_id", F.round((F.greatest(m(5000) - m(1000) - m(300), F.lit(0)) * 3.0 + m(1000) * 0.3 + m(300) * 3.75 + m(700) * 15.0) / 1e6, 8).alias("usd"))


@query("a32_spend_rollup", "SELECT coalesce(CAST(topic_id AS VARCHAR), 'all') AS system, round(sum(CASE WHEN NOT failed THEN value END), 4) AS usd, count(*) FILTER (WHERE NOT failed) AS priced, count(*) FILTER (WHERE failed) AS unpriced FROM log GROUP BY ROLLUP (topic_id)")
def a32(v: Views) -> DataFrame:
    g = v.log.rollup("topic_id").agg(F.round(F.sum(F.when(~F.col("failed"), F.col("value"))), 4).alias("usd"), F.count_if(~F.col("failed")).alias("priced"), F.count_if("failed").alias("unpriced"))
    return g.select(F.coalesce(F.col("topic_id").cast("string"), F.lit("all")).alias("system"), "usd", "priced", "unpriced")


@query("a33_token_totals", f"WITH t AS (SELECT user_id, {TOK} FROM events) SELECT user_id, CAST(sum(tin + tout) AS BIGINT) AS logical, CAST(sum(greatest(tin - cached, 0) + tout) AS BIGINT) AS processed, CAST(sum(tin + written + tout) AS BIGINT) AS total FROM t GROUP BY 1")
def a33(v: Views) -> DataFrame:
    m = lambda n: F.col("event_id") % n
    return v.events.groupBy("user_id").agg(F.sum(m(5000) + m(700)).alias("logical"), F.sum(F.greatest(m(5000) - m(1000), F.lit(0)) + m(700)).alias("processed"), F.sum(m(5000) + m(300) + m(700)).alias("total"))


@query("a34_run_cost", "SELECT conv_id, round(sum(length(text) / 1000.0) FILTER (WHERE role = 'assistant'), 6) AS usd, count(*) FILTER (WHERE role = 'assistant') AS priced, count(*) FILTER (WHERE role <> 'assistant') AS unpriced FROM steps GROUP BY 1 HAVING count(*) FILTER (WHERE role = 'assistant') > 0")
def a34(v: Views) -> DataFrame:
    a = F.col("role") == "assistant"
    return v.steps.groupBy("conv_id").agg(F.round(F.sum(F.when(a, F.length("text") / 1000)), 6).alias("usd"), F.count_if(a).alias("priced"), F.count_if(~a).alias("unpriced")).filter("priced > 0")


@query("a35_duration_by_type", "SELECT conv_id, role, CAST(sum(length(text)) AS BIGINT) AS ms, count(*) AS steps, round(sum(length(text)) / sum(sum(length(text))) OVER (PARTITION BY conv_id), 6) AS share FROM steps GROUP BY 1, 2")
def a35(v: Views) -> DataFrame:
    g = v.steps.groupBy("conv_id", "role").agg(F.sum(F.length("text")).cast("long").alias("ms"), F.count(F.lit(1)).alias("steps"))
    return g.withColumn("share", F.round(F.col("ms") / F.sum("ms").over(W.partitionBy("conv_id")), 6))


@query("a36_tool_calls", "SELECT user_id, count(*) AS calls, count(*) FILTER (WHERE event_type <> 'error') AS ok, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS tools FROM events GROUP BY 1")
def a36(v: Views) -> DataFrame:
    return v.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("event_type") != "error").alias("ok"), F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("tools"))


@query("a37_backend_matrix", "SELECT topic_id, event_type AS backend, count(*) AS searches, count(*) FILTER (WHERE grade = 0) AS zero, count(*) FILTER (WHERE failed) AS failed, count(DISTINCT jkey) AS documents FROM log GROUP BY 1, 2")
def a37(v: Views) -> DataFrame:
    return v.log.groupBy("topic_id", F.col("event_type").alias("backend")).agg(F.count(F.lit(1)).alias("searches"), F.count_if(F.col("grade") == 0).alias("zero"), F.count_if("failed").alias("failed"), F.countDistinct("jkey").alias("documents"))


SEL = "s AS (SELECT topic_id AS kind, event_type AS backend, sum(coalesce(grade, 0)) AS committed, sum(event_id % 9 + 1) AS returned FROM log GROUP BY 1, 2)"


def selection(v: Views) -> DataFrame:
    return v.log.groupBy(F.col("topic_id").alias("kind"), F.col("event_type").alias("backend")).agg(F.sum(F.coalesce("grade", F.lit(0))).alias("committed"), F.sum(F.col("event_id") % 9 + 1).alias("returned"))


@query("a38_selection_ratio", f"WITH {SEL} SELECT kind, backend, round(committed / returned, 6) AS ratio, returned < 300 AS thin FROM s")
def a38(v: Views) -> DataFrame:
    return selection(v).select("kind", "backend", F.round(F.col("committed") / F.col("returned"), 6).alias("ratio"), (F.col("returned") < 300).alias("thin"))


@query("a39_best_backend", f"WITH {SEL} SELECT kind, arg_max(backend, (round(committed / returned, 9), backend)) AS best FROM s GROUP BY 1")
def a39(v: Views) -> DataFrame:
    return selection(v).groupBy("kind").agg(F.max_by("backend", F.struct(F.round(F.col("committed") / F.col("returned"), 9), "backend")).alias("best"))


@query("a40_run_stats", r"SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS searches, count(*) FILTER (WHERE length(text) < 60) AS zero, round(avg(length(text)) FILTER (WHERE role = 'assistant'), 6) AS mean_chars, CAST(max(len(regexp_extract_all(text, '\S+'))) AS BIGINT) AS longest FROM steps GROUP BY 1")
def a40(v: Views) -> DataFrame:
    return v.steps.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("searches"), F.count_if(F.length("text") < 60).alias("zero"), F.round(F.avg(F.when(F.col("role") == "assistant", F.length("text"))), 6).alias("mean_chars"), F.max(T.n_words(F.col("text"))).cast("long").alias("longest"))


@query("a41_structural_stats", r"""WITH a AS (SELECT conv_id % 5 AS run, turn, len(regexp_extract_all(text, '\S+')) AS words, turn % 4 AS cites, len(regexp_extract_all(text, '\d+')) AS digits FROM steps WHERE role = 'assistant')
SELECT run, round(avg(words), 6) AS words, round(avg(cites), 6) AS cites, round(avg((cites = 0)::INT), 6) AS uncited, round(1000.0 * sum(digits) / sum(words), 6) AS digits_1k FROM a GROUP BY 1""")
def a41(v: Views) -> DataFrame:
    a = v.steps.filter("role = 'assistant'").select((F.col("conv_id") % 5).alias("run"), T.n_words(F.col("text")).alias("words"), (F.col("turn") % 4).alias("cites"), F.regexp_count("text", F.lit(r"\d+")).alias("digits"))
    return a.groupBy("run").agg(F.round(F.avg("words"), 6).alias("words"), F.round(F.avg("cites"), 6).alias("cites"), F.round(F.avg((F.col("cites") == 0).cast("int")), 6).alias("uncited"), F.round(1000.0 * F.sum("digits") / F.sum("words"), 6).alias("digits_1k"))


@query("a42_arena_outcome", """WITH v AS (SELECT qid, axis, cid % 2 AS ord, bool_and(grade_a >= grade_b) AS won FROM rubric GROUP BY 1, 2, 3)
SELECT qid, axis, CAST(CASE WHEN bool_and(won) THEN 1.0 WHEN NOT bool_or(won) THEN 0.0 ELSE 0.5 END AS DOUBLE) AS outcome FROM v GROUP BY 1, 2 HAVING count(DISTINCT ord) = 2""")
def a42(v: Views) -> DataFrame:
    votes = v.rubric.groupBy("qid", "axis", (F.col("cid") % 2).alias("order")).agg(F.bool_and(F.col("grade_a") >= F.col("grade_b")).alias("won"))
    return A.arena_outcome(votes, ["qid", "axis"])


@query("a43_arena_groups", "SELECT qid, axis, CASE WHEN count(DISTINCT sign(grade_a - grade_b)) = 1 THEN CAST(any_value(sign(grade_a - grade_b)) AS VARCHAR) ELSE 'ambiguous' END AS verdict FROM rubric GROUP BY 1, 2")
def a43(v: Views) -> DataFrame:
    s = F.signum(F.col("grade_a") - F.col("grade_b")).cast("int")
    return v.rubric.groupBy("qid", "axis").agg(F.collect_set(s).alias("x")).select("qid", "axis", F.when(F.size("x") == 1, F.get("x", F.lit(0)).cast("string")).otherwise("ambiguous").alias("verdict"))


SUPPORT = "p AS (SELECT conv_id % 5 AS run, conv_id, turn AS sentence, CASE (conv_id + turn) % 4 WHEN 0 THEN 'FS' WHEN 1 THEN 'PS' WHEN 2 THEN 'NS' END AS label FROM steps WHERE role = 'assistant')"


def support(v: Views) -> DataFrame:
    k = (F.col("conv_id") + F.col("turn")) % 4
    return v.steps.filter("role = 'assistant'").select((F.col("conv_id") % 5).alias("run"), "conv_id", F.col("turn").alias("sentence"), F.when(k == 0, "FS").when(k == 1, "PS").when(k == 2, "NS").alias("label"))


@query("a44_support_counts", f"WITH {SUPPORT} SELECT run, {', '.join(f'''count(*) FILTER (WHERE label = '{x}') AS {x.lower()}''' for x in ('FS', 'PS', 'NS'))}, count(*) FILTER (WHERE label IS NULL) AS error FROM p GROUP BY 1")
def a44(v: Views) -> DataFrame:
    return support(v).groupBy("run").agg(*(F.count_if(F.col("label") == x).alias(x.lower()) for x in ("FS", "PS", "NS")), F.count_if(F.col("label").isNull()).alias("error"))


@query("a45_support_precision_recall", f"""WITH {SUPPORT}, s AS (SELECT run, conv_id, CASE label WHEN 'FS' THEN 1.0 WHEN 'PS' THEN 0.5 WHEN 'NS' THEN 0.0 END AS v FROM p)
SELECT run, conv_id, round(sum(v) / nullif(count(v), 0), 6) AS precision, round(sum(coalesce(v, 0)) / count(*), 6) AS recall FROM s GROUP BY 1, 2""")
def a45(v: Views) -> DataFrame:
    return A.support_rates(support(v), ["run", "conv_id"]).select("run", "conv_id", *r6("precision", "recall"))


@query("a46_support_assembly", f"WITH {SUPPORT} SELECT conv_id, string_agg(sentence || ':' || coalesce(CASE label WHEN 'FS' THEN 2 WHEN 'PS' THEN 1 WHEN 'NS' THEN 0 END, -1), ' ' ORDER BY sentence) AS body FROM p GROUP BY 1")
def a46(v: Views) -> DataFrame:
    n = F.when(F.col("label") == "FS", 2).when(F.col("label") == "PS", 1).when(F.col("label") == "NS", 0).otherwise(-1)
    x = F.array_sort(F.collect_list(F.struct("sentence", n.alias("n"))))
    return support(v).groupBy("conv_id").agg(F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["sentence"].cast("string"), s["n"].cast("string"))), " ").alias("body"))


@query("a47_rating_tally", "SELECT event_type AS target, count(*) FILTER (WHERE event_id % 3 = 0) AS up, count(*) FILTER (WHERE event_id % 3 = 1) AS down, round(100.0 * count(*) FILTER (WHERE event_id % 3 = 0) / nullif(count(*) FILTER (WHERE event_id % 3 < 2), 0), 6) AS pct_up FROM events GROUP BY 1")
def a47(v: Views) -> DataFrame:
    m = F.col("event_id") % 3
    return v.events.groupBy(F.col("event_type").alias("target")).agg(F.count_if(m == 0).alias("up"), F.count_if(m == 1).alias("down"), F.round(100.0 * F.try_divide(F.count_if(m == 0), F.count_if(m < 2)), 6).alias("pct_up"))


@query("a48_nugget_merge", """WITH f AS (SELECT topic_id, chunk_id, min((CASE config WHEN 'len' THEN 0 ELSE 1 END) * 1000000 + rnk) AS pos FROM runs WHERE rnk <= 3 GROUP BY 1, 2)
SELECT topic_id, md5(string_agg(chunk_id, ' ' ORDER BY pos, chunk_id)) AS candidates, count(*) AS n FROM f GROUP BY 1""")
def a48(v: Views) -> DataFrame:
    pos = F.when(F.col("config") == "len", 0).otherwise(1) * 1_000_000 + F.col("rnk")
    f = v.runs.filter("rnk <= 3").groupBy("topic_id", "chunk_id").agg(F.min(pos).alias("pos"))
    x = F.array_sort(F.collect_list(F.struct("pos", "chunk_id")))
    return f.groupBy("topic_id").agg(F.md5(F.array_join(F.transform(x, lambda s: s["chunk_id"]), " ")).alias("candidates"), F.count(F.lit(1)).alias("n"))


@query("a49_relevance_requests", "SELECT qkey, string_agg(chunk_id, ' ' ORDER BY rnk) AS refs, count(*) AS n FROM runs WHERE config = 'len' AND rnk <= 4 GROUP BY 1")
def a49(v: Views) -> DataFrame:
    x = F.array_sort(F.collect_list(F.struct("rnk", "chunk_id")))
    return v.runs.filter("config = 'len' AND rnk <= 4").groupBy("qkey").agg(F.array_join(F.array_distinct(F.transform(x, lambda s: s["chunk_id"])), " ").alias("refs"), F.count(F.lit(1)).alias("n"))


@query("a50_fine_tune_rows", "SELECT r.config, r.qkey, count(*) FILTER (WHERE q.grade >= 2) AS positive, count(*) FILTER (WHERE q.grade < 2) AS negative, count(*) FILTER (WHERE q.grade IS NULL) AS unjudged FROM runs r LEFT JOIN qrels q ON r.topic_id = q.topic_id AND r.chunk_id = q.chunk_id GROUP BY 1, 2")
def a50(v: Views) -> DataFrame:
    g = M.graded(v.runs, v.qrels)
    j = F.col("judged")
    return g.groupBy("config", "qkey").agg(F.count_if(j & (F.col("grade") >= 2)).alias("positive"), F.count_if(j & (F.col("grade") < 2)).alias("negative"), F.count_if(~j).alias("unjudged"))


@query("a51_pool_provenance", "SELECT topic_id, chunk_id, string_agg(config || ':' || qkey || ':' || rnk, ' ' ORDER BY config, qkey, rnk) AS provenance FROM runs WHERE rnk <= 2 GROUP BY 1, 2")
def a51(v: Views) -> DataFrame:
    x = F.array_sort(F.collect_list(F.struct("config", "qkey", "rnk")))
    return v.runs.filter("rnk <= 2").groupBy("topic_id", "chunk_id").agg(F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["config"], s["qkey"], s["rnk"].cast("string"))), " ").alias("provenance"))


@query("a52_evidence_merge", "SELECT chunk_id, config, qkey FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY config DESC, rnk, qkey) AS r FROM runs) WHERE r = 1")
def a52(v: Views) -> DataFrame:
    w = W.partitionBy("chunk_id").orderBy(F.desc("config"), "rnk", "qkey")
    return v.runs.withColumn("r", F.row_number().over(w)).filter("r = 1").select("chunk_id", "config", "qkey")


@query("a53_input_summary", "SELECT count(*) AS hits, count(DISTINCT topic_id) AS topics, count(DISTINCT qkey) AS queries, count(DISTINCT chunk_id) AS units, count(*) FILTER (WHERE score < 0) AS negative_scores, max(rnk) AS deepest FROM runs")
def a53(v: Views) -> DataFrame:
    return v.runs.agg(F.count(F.lit(1)).alias("hits"), *(F.countDistinct(c).alias(n) for c, n in (("topic_id", "topics"), ("qkey", "queries"), ("chunk_id", "units"))), F.count_if(F.col("score") < 0).alias("negative_scores"), F.max("rnk").cast("long").alias("deepest"))


@query("a54_max_pool_to_documents", "WITH d AS (SELECT doc_id % 7 AS q, docid, max(length(contents)) AS score FROM chunks GROUP BY 1, 2) SELECT q, docid, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, docid) AS r FROM d) WHERE r <= 20")
def a54(v: Views) -> DataFrame:
    d = v.chunks.groupBy((F.col("doc_id") % 7).alias("q"), "docid").agg(F.max(F.length("contents")).cast("long").alias("score"))
    return d.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "docid"))).filter("r <= 20").drop("r")


@query("a55_judged_at_k", "SELECT config, round(avg(j), 6) AS judged, round(avg(rel), 6) AS relevant FROM (SELECT r.config, r.topic_id, avg((q.grade IS NOT NULL)::INT) AS j, avg((coalesce(q.grade, 0) >= 2)::INT) AS rel FROM runs r LEFT JOIN qrels q ON r.topic_id = q.topic_id AND r.chunk_id = q.chunk_id WHERE rnk <= 10 GROUP BY 1, 2) GROUP BY 1")
def a55(v: Views) -> DataFrame:
    g = M.graded(v.runs.filter("rnk <= 10"), v.qrels).groupBy("config", "topic_id").agg(F.avg(F.col("judged").cast("int")).alias("j"), F.avg((F.col("grade") >= 2).cast("int")).alias("rel"))
    return g.groupBy("config").agg(F.round(F.avg("j"), 6).alias("judged"), F.round(F.avg("rel"), 6).alias("relevant"))


@query("a56_results_upsert", """WITH b AS (SELECT p_brand AS stage, p_size AS variant, p_partkey AS place, p_retailprice AS mean, p_partkey % 2 AS v FROM part)
SELECT stage, variant, arg_min(place, (v, place)) AS place, arg_max(mean, (v, place)) AS mean FROM b GROUP BY 1, 2""")
def a56(v: Views) -> DataFrame:
    p = v.part.select(F.col("p_brand").alias("stage"), F.col("p_size").alias("variant"), F.col("p_partkey").alias("place"), F.col("p_retailprice").alias("mean"))
    return A.upsert(p.filter("place % 2 = 0"), p.filter("place % 2 = 1"), ["stage", "variant"], "place")


@query("a57_best_full_run", f"WITH {PER_QUERY}, s AS (SELECT config, avg(ndcg10_lin) AS p, count(DISTINCT topic_id) AS t FROM m GROUP BY 1) SELECT arg_max(config, (round(p, 9), config)) AS best FROM s WHERE t = (SELECT count(DISTINCT topic_id) FROM runs)")
def a57(v: Views) -> DataFrame:
    s = per_query(v).groupBy("config").agg(F.avg("ndcg10_lin").alias("p"), F.countDistinct("topic_id").alias("t"))
    full = s.withColumn("full", F.max("t").over(W.partitionBy())).filter("t = full")
    return full.agg(F.max_by("config", F.struct(F.round("p", 9), "config")).alias("best"))


@query("a58_pairwise_preference", """WITH o AS (SELECT axis, cid % 2 AS ord, CASE WHEN grade_a > grade_b THEN 1.0 WHEN grade_a = grade_b THEN 0.5 ELSE 0.0 END AS s FROM rubric) SELECT axis, run, round(sum(s) / count(*), 6) AS rate FROM (SELECT axis, 'a' AS run, s FROM o UNION ALL SELECT axis, 'b', 1 - s FROM o) GROUP BY 1, 2""")
def a58(v: Views) -> DataFrame:
    s = F.when(F.col("grade_a") > F.col("grade_b"), 1.0).when(F.col("grade_a") == F.col("grade_b"), 0.5).otherwise(0.0)
    o = v.rubric.select("axis", F.explode(F.create_map(F.lit("a"), s, F.lit("b"), 1 - s)).alias("run", "s"))
    return o.groupBy("axis", "run").agg(F.round(F.sum("s") / F.count(F.lit(1)), 6).alias("rate"))


@query("a59_best_explanation", """WITH c AS (SELECT axis, weight, grade_a, grade_b, greatest(grade_a, grade_b) AS best FROM rubric WHERE weight > 0), e AS (SELECT axis, weight, 'a' AS engine, grade_a AS g, best, (grade_a = best)::INT + (grade_b = best)::INT AS winners FROM c UNION ALL SELECT axis, weight, 'b', grade_b, best, (grade_a = best)::INT + (grade_b = best)::INT FROM c)
SELECT axis, engine, count(*) FILTER (WHERE g = best AND winners = 1 AND best > 0) AS sole, round(sum(CASE WHEN g = best AND best > 0 THEN 1.0 / winners ELSE 0 END), 6) AS shared, CAST(sum(CASE WHEN g = best AND winners = 1 AND best > 0 THEN weight ELSE 0 END) AS BIGINT) AS sole_weight, round(avg((g = 0)::INT), 6) AS low, round(avg((g = 2)::INT), 6) AS high FROM e GROUP BY 1, 2""")
def a59(v: Views) -> DataFrame:
    best = F.greatest("grade_a", "grade_b")
    winners = (F.col("grade_a") == best).cast("int") + (F.col("grade_b") == best).cast("int")
    e = v.rubric.filter("weight > 0").select("axis", "weight", best.alias("best"), winners.alias("winners"), F.explode(F.create_map(F.lit("a"), "grade_a", F.lit("b"), "grade_b")).alias("engine", "g"))
    won = (F.col("g") == F.col("best")) & (F.col("best") > 0)
    sole = won & (F.col("winners") == 1)
    return e.groupBy("axis", "engine").agg(F.count_if(sole).alias("sole"), F.round(F.sum(F.when(won, 1.0 / F.col("winners")).otherwise(0.0)), 6).alias("shared"), F.sum(F.when(sole, F.col("weight")).otherwise(0)).alias("sole_weight"), F.round(F.avg((F.col("g") == 0).cast("int")), 6).alias("low"), F.round(F.avg((F.col("g") == 2).cast("int")), 6).alias("high"))


@query("a60_two_arms", """WITH s AS (SELECT topic_id, list(DISTINCT chunk_id) FILTER (WHERE config = 'len') AS a, list(DISTINCT chunk_id) FILTER (WHERE config = 'id') AS b FROM runs WHERE rnk <= 5 GROUP BY 1)
SELECT round(avg(len(a)), 6) AS a_docs, round(avg(len(b)), 6) AS b_docs, round(avg(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))), 6) AS jaccard, round(avg(len(a) - len(list_intersect(a, b))), 6) AS a_only FROM s""")
def a60(v: Views) -> DataFrame:
    side = lambda c: F.collect_set(F.when(F.col("config") == c, F.col("chunk_id")))
    s = v.runs.filter("rnk <= 5").groupBy("topic_id").agg(side("len").alias("a"), side("id").alias("b"))
    return s.agg(F.round(F.avg(F.size("a")), 6).alias("a_docs"), F.round(F.avg(F.size("b")), 6).alias("b_docs"), F.round(F.avg(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))), 6).alias("jaccard"), F.round(F.avg(F.size(F.array_except("a", "b"))), 6).alias("a_only"))


@query("a61_spend_reconciliation", "SELECT topic_id, round(sum(value), 4) AS log_usd, round(sum(value) FILTER (WHERE event_id % 50 <> 0), 4) AS ledger_usd, count(*) FILTER (WHERE event_id % 50 = 0) > 0 AS differs FROM log GROUP BY 1")
def a61(v: Views) -> DataFrame:
    kept = F.col("event_id") % 50 != 0
    g = v.log.groupBy("topic_id").agg(F.sum("value").alias("a"), F.sum(F.when(kept, F.col("value"))).alias("b"))
    return g.select("topic_id", F.round("a", 4).alias("log_usd"), F.round("b", 4).alias("ledger_usd"), (F.abs(F.col("a") - F.col("b")) > 1e-6).alias("differs"))


@query("a62_obligation_merge", r"""WITH a AS (SELECT item_id, item_id % 2 AS audit, item_id % 5 AS grp, lower(text) AS t, list_sort(list_transform(regexp_extract_all(text, '\d+')[1:2], lambda x: lower(x))) AS mentions FROM benchmark),
w AS (SELECT *, array_to_string(list_filter(regexp_extract_all(t, '\S+'), lambda x: length(x) > 3)[1:6], ' ') AS words FROM a),
f AS (SELECT *, row_number() OVER (PARTITION BY grp, words, mentions ORDER BY audit, item_id) AS r FROM w WHERE trim(t) <> ''), k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY audit, item_id) AS place FROM f WHERE r = 1)
SELECT grp, audit, item_id, words, array_to_string(mentions, ',') AS mentions, place FROM k WHERE place <= 14""")
def a62(v: Views) -> DataFrame:
    mentions = F.slice(F.regexp_extract_all("text", F.lit(r"\d+"), F.lit(0)), 1, 2)
    items = v.benchmark.select((F.col("item_id") % 5).alias("grp"), (F.col("item_id") % 2).alias("audit"), "item_id", F.col("text").alias("requirement"), mentions.alias("mentions"))
    m = A.obligations(items, ["grp"], "audit", "item_id")
    return m.select("grp", "audit", "item_id", "words", F.array_join("mentions", ",").alias("mentions"), "place")


@query("a63_candidate_index", "SELECT conv_id % 5 AS run, conv_id AS topic, count(*) FILTER (WHERE role = 'assistant') AS answers, count(*) FILTER (WHERE role = 'assistant') > 1 AS ambiguous FROM steps GROUP BY 1, 2")
def a63(v: Views) -> DataFrame:
    return v.steps.groupBy((F.col("conv_id") % 5).alias("run"), F.col("conv_id").alias("topic")).agg(F.count_if(F.col("role") == "assistant").alias("answers")).withColumn("ambiguous", F.col("answers") > 1)


@query("a64_answer_rendering", "SELECT conv_id, md5(string_agg(text || ' [shard_' || turn || '] [shard_' || (turn + 1) || ']', ' ' ORDER BY turn)) AS body FROM steps WHERE role = 'assistant' GROUP BY 1")
def a64(v: Views) -> DataFrame:
    t = F.col("turn").cast("string")
    line = F.concat("text", F.lit(" [shard_"), t, F.lit("] [shard_"), (F.col("turn") + 1).cast("string"), F.lit("]"))
    x = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return v.steps.filter("role = 'assistant'").groupBy("conv_id").agg(F.md5(F.array_join(F.transform(x, lambda s: s["line"]), " ")).alias("body"))


@query("a65_viewer_summaries", "SELECT kind, name, n FROM (SELECT 'type' AS kind, event_type AS name, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'user', CAST(user_id AS VARCHAR), count(*) FROM events GROUP BY 2)")
def a65(v: Views) -> DataFrame:
    e = v.events.select(F.explode(F.create_map(F.lit("type"), "event_type", F.lit("user"), F.col("user_id").cast("string"))).alias("kind", "name"))
    return e.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))


@query("a66_candidate_documents", "SELECT conv_id, string_agg(doc, ',' ORDER BY k) AS docs FROM (SELECT conv_id, CAST(length(text) % 5 AS VARCHAR) AS doc, min((CASE WHEN role = 'assistant' THEN 0 ELSE 1 END) * 1000 + turn) AS k FROM steps GROUP BY 1, 2) GROUP BY 1")
def a66(v: Views) -> DataFrame:
    d = v.steps.groupBy("conv_id", (F.length("text") % 5).cast("string").alias("doc")).agg(F.min(F.struct((F.col("role") != "assistant").alias("searched"), "turn")).alias("k"))
    x = F.array_sort(F.collect_list(F.struct("k", "doc")))
    return d.groupBy("conv_id").agg(F.array_join(F.transform(x, lambda s: s["doc"]), ",").alias("docs"))
