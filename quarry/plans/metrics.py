"""Queries of evaluation metrics (M1-M14), top-k and set operators (K, U)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.fixtures import Views
from quarry.functions import ids
from quarry.operators import metrics as M
from quarry.operators.order import global_rank
from quarry.registry import query


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def gain_sql(g: str, kind: str) -> str:
    return {"exp": f"(power(2.0, {g}) - 1)", "lin": f"CAST({g} AS DOUBLE)"}.get(kind) or f"CASE WHEN {g} >= {kind[3:]} THEN 1.0 ELSE 0.0 END"


def dcg_sql(k: int, kind: str, g: str = "grade", r: str = "rnk") -> str:
    return f"sum(CASE WHEN {r} <= {k} THEN {gain_sql(g, kind)} / log2({r} + 1.0) ELSE 0.0 END)"


GRADED = "g AS (SELECT r.*, coalesce(q.grade, 0) AS grade, q.grade IS NOT NULL AS judged FROM runs r LEFT JOIN qrels q ON r.topic_id = q.topic_id AND r.chunk_id = q.chunk_id)"
IDEAL = f"""i AS (SELECT topic_id, {', '.join(f"{dcg_sql(10, k)} AS idcg_{k}" for k in ('exp', 'lin', 'bin2'))}, count(*) FILTER (WHERE grade >= 1) AS rel1, count(*) FILTER (WHERE grade >= 2) AS rel2
  FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY grade DESC, chunk_id) AS rnk FROM qrels) GROUP BY 1)"""
PER_QUERY = f"""{GRADED}, {IDEAL},
h AS (SELECT *, sum((grade >= 1)::INT) OVER w AS hit1, sum((grade >= 2)::INT) OVER w AS hit2 FROM g WHERE rnk <= 30 WINDOW w AS (PARTITION BY config, qkey ORDER BY rnk)),
a AS (SELECT config, topic_id, qkey, {', '.join(f"{dcg_sql(10, k)} AS dcg_{k}" for k in ('exp', 'lin', 'bin2'))},
  count(*) FILTER (WHERE rnk <= 10 AND grade >= 2) / 10.0 AS p10_bin2, coalesce(sum(grade) FILTER (WHERE rnk <= 10), 0) / 30.0 AS gp10, count(*) FILTER (WHERE rnk <= 10 AND grade >= 2) AS hits10,
  sum(CASE WHEN grade >= 1 THEN hit1 / rnk ELSE 0 END) AS ap1, sum(CASE WHEN grade >= 2 THEN hit2 / rnk ELSE 0 END) AS ap2,
  count(*) FILTER (WHERE rnk <= 10 AND judged) AS judged10, least(count(*), 10) AS shown10 FROM h GROUP BY 1, 2, 3),
m AS (SELECT config, topic_id, qkey, {', '.join(f"dcg_{k} / nullif(idcg_{k}, 0) AS ndcg10_{k}" for k in ('exp', 'lin', 'bin2'))}, gp10, p10_bin2, hits10 / nullif(rel2, 0) AS recall10_bin2,
  ap1 / nullif(rel1, 0) AS map30_bin1, ap2 / nullif(rel2, 0) AS map30_bin2, judged10, judged10 / shown10 AS coverage10 FROM a LEFT JOIN i USING (topic_id))"""


def per_query(v: Views) -> DataFrame:
    return M.query_metrics(v.runs, v.qrels)


@query("m01_gains_discount", f"""SELECT config, qkey, chunk_id, {gain_sql('grade', 'exp')} AS g_exp, {gain_sql('grade', 'lin')} AS g_lin, CAST({gain_sql('grade', 'bin2')} AS DOUBLE) AS g_bin, round(1.0 / log2(rnk + 1.0), 6) AS discount
FROM (SELECT r.config, r.qkey, r.chunk_id, r.rnk, coalesce(q.grade, 0) AS grade FROM runs r LEFT JOIN qrels q ON q.topic_id = r.topic_id AND q.chunk_id = r.chunk_id)""")
def m01(v: Views) -> DataFrame:
    """Gains and discount of every hit of the runs."""
    d = v.runs.join(v.qrels.select("topic_id", "chunk_id", "grade"), ["topic_id", "chunk_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    return d.select("config", "qkey", "chunk_id", *(M.gain(F.col("grade"), k).alias(n) for k, n in (("exp", "g_exp"), ("lin", "g_lin"), ("bin2", "g_bin"))), F.round(M.discount(F.col("rnk")), 6).alias("discount"))


@query("m02_dcg", f"WITH {GRADED} SELECT config, qkey, round({dcg_sql(10, 'exp')}, 6) AS dcg FROM g GROUP BY 1, 2")
def m02(v: Views) -> DataFrame:
    return M.graded(v.runs, v.qrels).groupBy("config", "qkey").agg(F.round(M.dcg(10), 6).alias("dcg"))


@query("m03_ndcg_topic_ideal", f"WITH {PER_QUERY} SELECT config, qkey, round(ndcg10_exp, 6) AS ndcg10_exp, round(ndcg10_lin, 6) AS ndcg10_lin, round(ndcg10_bin2, 6) AS ndcg10_bin2 FROM m")
def m03(v: Views) -> DataFrame:
    return per_query(v).select("config", "qkey", *r6("ndcg10_exp", "ndcg10_lin", "ndcg10_bin2"))


@query("m04_ndcg_self_ideal", f"""WITH {GRADED}, b AS (SELECT *, row_number() OVER (PARTITION BY config, qkey ORDER BY grade DESC, rnk) AS best FROM g),
s AS (SELECT config, qkey, {dcg_sql(10, 'lin')} AS d, {dcg_sql(10, 'lin', r='best')} AS i FROM b GROUP BY 1, 2) SELECT config, qkey, round(CASE WHEN i > 0 THEN d / i ELSE 0 END, 6) AS ndcg FROM s""")
def m04(v: Views) -> DataFrame:
    return M.self_ideal_ndcg(M.graded(v.runs, v.qrels)).select("config", "qkey", *r6("ndcg"))


for _name, _cols in {"m05_precision": ("p10_bin2",), "m06_graded_precision": ("gp10",), "m07_recall": ("recall10_bin2",), "m08_average_precision": ("map30_bin1", "map30_bin2"), "m09_query_metrics": (*M.METRICS, "coverage10")}.items():
    query(_name, f"WITH {PER_QUERY} SELECT config, qkey, {', '.join(f'round({c}, 6) AS {c}' for c in _cols)} FROM m")(lambda v, cols=_cols: per_query(v).select("config", "qkey", *r6(*cols)))


@query("m10_config_scores", f"""WITH {PER_QUERY}, t AS (SELECT config, topic_id, {', '.join(f'avg({c}) AS {c}' for c in M.METRICS)} FROM m GROUP BY 1, 2), x AS (SELECT config, {', '.join(f'avg({c}) AS {c}, count({c}) AS {c}_n' for c in M.METRICS)} FROM m GROUP BY 1)
SELECT x.config, {', '.join(f'round(x.{c}, 6) AS {c}, round(y.{c}, 6) AS {c}_topics, CAST({c}_n AS BIGINT) AS {c}_n' for c in M.METRICS)} FROM x JOIN (SELECT config, {', '.join(f'avg({c}) AS {c}' for c in M.METRICS)} FROM t GROUP BY 1) y ON x.config = y.config""")
def m10(v: Views) -> DataFrame:
    s = M.config_scores(per_query(v))
    return s.select("config", *r6(*M.METRICS, *(f"{m}_topics" for m in M.METRICS)), *(f"{m}_n" for m in M.METRICS))


@query("m11_trec_suite", f"""WITH {GRADED}, q AS (SELECT topic_id, grade, row_number() OVER (PARTITION BY topic_id ORDER BY grade DESC, chunk_id) AS rnk FROM qrels),
i AS (SELECT topic_id, {', '.join(f"{dcg_sql(k, 'lin')} AS i{k}" for k in (10, 20, 100))}, count(*) FILTER (WHERE grade >= 1) AS rel FROM q GROUP BY 1),
h AS (SELECT *, sum((grade >= 1)::INT) OVER (PARTITION BY config, qkey ORDER BY rnk) AS hit FROM g),
s AS (SELECT config, qkey, topic_id, {', '.join(f"{dcg_sql(k, 'lin')} AS d{k}" for k in (10, 20, 100))}, sum(CASE WHEN grade >= 1 THEN hit / rnk ELSE 0 END) AS ap,
 count(*) FILTER (WHERE grade >= 1 AND rnk <= 100) AS h100, count(*) FILTER (WHERE grade >= 1 AND rnk <= 1000) AS h1000, count(*) FILTER (WHERE grade >= 1 AND rnk <= 10) AS h10 FROM h GROUP BY 1, 2, 3)
SELECT config, {', '.join(f'round(avg(d{k} / nullif(i{k}, 0)), 6) AS ndcg_{k}' for k in (10, 20, 100))}, round(avg(ap / nullif(rel, 0)), 6) AS map, round(avg(h100 / nullif(rel, 0)), 6) AS recall_100, round(avg(h1000 / nullif(rel, 0)), 6) AS recall_1000, round(avg(h10 / 10.0), 6) AS p_10 FROM s JOIN i USING (topic_id) GROUP BY 1""")
def m11(v: Views) -> DataFrame:
    w = W.partitionBy("config", "qkey").orderBy("rnk").rowsBetween(W.unboundedPreceding, 0)
    rel = F.col("grade") >= 1
    g = M.graded(v.runs, v.qrels).withColumn("hit", F.sum(rel.cast("int")).over(w))
    s = g.groupBy("config", "qkey", "topic_id").agg(*(M.dcg(k, "lin").alias(f"d{k}") for k in (10, 20, 100)), F.sum(F.when(rel, F.col("hit") / F.col("rnk")).otherwise(0.0)).alias("ap"), *(F.count_if(rel & (F.col("rnk") <= k)).alias(f"h{k}") for k in (10, 100, 1000)))
    s = s.join(M.ideals(v.qrels, (10, 20, 100), ("lin",)), "topic_id")
    part = lambda a, b: F.round(F.avg(F.col(a) / F.nullif(F.col(b).cast("double"), F.lit(0.0))), 6)
    return s.groupBy("config").agg(*(part(f"d{k}", f"idcg{k}_lin").alias(f"ndcg_{k}") for k in (10, 20, 100)), part("ap", "rel1").alias("map"), part("h100", "rel1").alias("recall_100"), part("h1000", "rel1").alias("recall_1000"), F.round(F.avg(F.col("h10") / 10), 6).alias("p_10"))


AUC_SQL = """r AS (SELECT *, rank() OVER (PARTITION BY topic_id ORDER BY grade) + (count(*) OVER (PARTITION BY topic_id, grade) - 1) / 2.0 AS ar FROM j),
x AS (SELECT topic_id, sum(CASE WHEN pos THEN ar ELSE 0 END) AS s, count(*) FILTER (WHERE pos) AS p, count(*) FILTER (WHERE NOT pos) AS n FROM r GROUP BY 1)"""


def judged_classes(v: Views) -> DataFrame:
    """Topics' grades with the stratum of the unit: here, whether its document is long."""
    return v.qrels.join(v.corpus.select(F.col("docid").alias("chunk_id"), (F.length("contents") > 1200).alias("pos")), "chunk_id")


CLASSES = "j AS (SELECT q.topic_id, q.grade, length(c.contents) > 1200 AS pos FROM qrels q JOIN corpus c ON c.docid = q.chunk_id)"


@query("m12_auc", f"WITH {CLASSES}, {AUC_SQL} SELECT topic_id, round((s - p * (p + 1) / 2.0) / nullif(p * n, 0), 6) AS auc FROM x")
def m12(v: Views) -> DataFrame:
    return M.auc(judged_classes(v), "grade", F.col("pos"), ["topic_id"]).select("topic_id", *r6("auc"))


@query("m13_class_agreement", f"WITH {CLASSES} SELECT topic_id, pos, round(avg(grade), 6) AS mean, round(avg((grade >= 2)::INT), 6) AS share2, count(*) AS n FROM j GROUP BY 1, 2")
def m13(v: Views) -> DataFrame:
    return judged_classes(v).groupBy("topic_id", "pos").agg(F.round(F.avg("grade"), 6).alias("mean"), F.round(F.avg((F.col("grade") >= 2).cast("int")), 6).alias("share2"), F.count(F.lit(1)).alias("n"))


@query("m14_consensus", """SELECT cid, CASE WHEN abs(a - b) < 2 THEN (a + b) // 2 WHEN t IS NULL THEN NULL ELSE list_sort([a, b, t])[2] END AS grade, abs(a - b) >= 2 AND t IS NULL AS pending
FROM (SELECT cid, (cid * 7) % 4 AS a, (cid * 5 + 1) % 4 AS b, CASE WHEN cid % 3 = 0 THEN NULL ELSE (cid * 3) % 4 END AS t FROM rubric)""")
def m14(v: Views) -> DataFrame:
    from quarry.operators.judging import consensus

    c = F.col("cid")
    d = v.rubric.select("cid", ((c * 7) % 4).alias("a"), ((c * 5 + 1) % 4).alias("b"), F.when(c % 3 == 0, F.lit(None)).otherwise((c * 3) % 4).alias("t"))
    return d.select("cid", *consensus(F.col("a"), F.col("b"), F.col("t")))


# ------------------------------------------------------------------ top-k
@query("k01_sort_by_length", "SELECT docid, row_number() OVER (ORDER BY length(contents) DESC, doc_id) AS place FROM corpus")
def k01(v: Views) -> DataFrame:
    from quarry.operators.order import global_rank

    return global_rank(v.corpus.select("docid", "doc_id", F.length("contents").alias("n")), [F.desc("n"), F.asc("doc_id")]).select("docid", F.col("place"))


@query("k02_length_batches", "SELECT docid, (row_number() OVER (ORDER BY length(contents) DESC, doc_id) - 1) // 64 AS batch FROM corpus")
def k02(v: Views) -> DataFrame:
    from quarry.operators.order import global_rank

    return global_rank(v.corpus.select("docid", "doc_id", F.length("contents").alias("n")), [F.desc("n"), F.asc("doc_id")]).select("docid", F.floor((F.col("place") - 1) / 64).alias("batch"))


@query("k03_top_k", "SELECT config, qkey, chunk_id, score FROM runs WHERE rnk <= 10")
def k03(v: Views) -> DataFrame:
    w = W.partitionBy("config", "qkey").orderBy(F.desc("score"), "chunk_id")
    return v.runs.drop("rnk").withColumn("r", F.row_number().over(w)).filter("r <= 10").select("config", "qkey", "chunk_id", "score")


@query("k04_ideal_grades", "SELECT topic_id, array_to_string(list(grade ORDER BY grade DESC)[1:10], ',') AS grades FROM qrels GROUP BY 1")
def k04(v: Views) -> DataFrame:
    return v.qrels.groupBy("topic_id").agg(F.array_join(F.slice(F.sort_array(F.collect_list("grade"), False), 1, 10), ",").alias("grades"))


@query("k05_leaderboard", f"WITH {PER_QUERY}, s AS (SELECT config, avg(ndcg10_exp) AS p FROM m GROUP BY 1) SELECT config, row_number() OVER (ORDER BY coalesce(p, -1) DESC, config) AS place FROM s")
def k05(v: Views) -> DataFrame:
    s = per_query(v).groupBy("config").agg(F.avg("ndcg10_exp").alias("p"))
    return s.select("config", F.row_number().over(W.orderBy(F.desc(F.coalesce("p", F.lit(-1.0))), "config")).cast("long").alias("place"))


@query("k06_gate_decision", """WITH s AS (SELECT topic_id, round(max(n) / sum(n), 6) AS modal FROM (SELECT topic_id, grade, count(*) AS n FROM qrels GROUP BY 1, 2) GROUP BY 1)
SELECT topic_id, modal, row_number() OVER (ORDER BY CASE WHEN modal BETWEEN 0.3 AND 0.75 THEN 0 ELSE 1 END, CASE WHEN modal BETWEEN 0.3 AND 0.75 THEN modal ELSE greatest(0.3 - modal, modal - 0.75) END, topic_id) AS place FROM s""")
def k06(v: Views) -> DataFrame:
    n = v.qrels.groupBy("topic_id", "grade").agg(F.count(F.lit(1)).alias("n"))
    s = n.groupBy("topic_id").agg(F.round(F.max("n") / F.sum("n"), 6).alias("modal"))
    ok = F.col("modal").between(0.3, 0.75)
    off = F.greatest(F.lit(0.3) - F.col("modal"), F.col("modal") - F.lit(0.75))
    w = W.orderBy(F.when(ok, 0).otherwise(1), F.when(ok, F.col("modal")).otherwise(off), "topic_id")
    return s.select("topic_id", "modal", F.row_number().over(w).cast("long").alias("place"))


@query("k07_stratified_subsample", "SELECT topic_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY sha256('13' || chunk_id), chunk_id) AS r FROM qrels) WHERE r <= 20")
def k07(v: Views) -> DataFrame:
    from quarry.operators.order import seeded_sample

    return seeded_sample(v.qrels, ["topic_id"], "chunk_id", 20, seed=13).select("topic_id", "chunk_id")


ROBIN = """SELECT topic_id, cls, chunk_id FROM (SELECT *, row_number() OVER (ORDER BY round, freq, cls, topic_id, chunk_id) AS n FROM (SELECT q.topic_id, q.grade AS cls, chunk_id,
 row_number() OVER (PARTITION BY q.topic_id, q.grade ORDER BY sha256('13' || chunk_id), chunk_id) AS round, f.freq FROM qrels q JOIN (SELECT grade, count(*) AS freq FROM qrels GROUP BY 1) f ON q.grade = f.grade)) WHERE n <= 280"""


@query("k08_calibration_sample", ROBIN)
def k08(v: Views) -> DataFrame:
    from quarry.operators.order import round_robin

    return round_robin(v.qrels.withColumnRenamed("grade", "cls"), "topic_id", "cls", "chunk_id", 280, seed=13).select("topic_id", "cls", "chunk_id")


@query("k09_pilot_sample", """SELECT topic_id, chunk_id FROM (SELECT *, row_number() OVER (ORDER BY round, topic_id, chunk_id) AS n FROM (SELECT topic_id, chunk_id, row_number() OVER (PARTITION BY topic_id ORDER BY sha256('13' || chunk_id), chunk_id) AS round FROM qrels)) WHERE n <= 100""")
def k09(v: Views) -> DataFrame:
    from quarry.operators.order import round_robin

    return round_robin(v.qrels.withColumn("cls", F.lit(0)), "topic_id", "cls", "chunk_id", 100, seed=13).select("topic_id", "chunk_id")


@query("k10_representative_queries", """WITH r AS (SELECT config, topic_id, qkey, row_number() OVER (PARTITION BY config, topic_id ORDER BY qkey) AS k FROM (SELECT DISTINCT config, topic_id, qkey FROM runs))
SELECT config, qkey FROM (SELECT *, row_number() OVER (PARTITION BY config ORDER BY CASE WHEN k <= 2 THEN 0 ELSE 1 END, topic_id, qkey) AS n FROM r) WHERE n <= 14""")
def k10(v: Views) -> DataFrame:
    q = v.runs.select("config", "topic_id", "qkey").distinct()
    q = q.withColumn("k", F.row_number().over(W.partitionBy("config", "topic_id").orderBy("qkey")))
    w = W.partitionBy("config").orderBy(F.when(F.col("k") <= 2, 0).otherwise(1), "topic_id", "qkey")
    return q.withColumn("n", F.row_number().over(w)).filter("n <= 14").select("config", "qkey")


@query("k11_latest_artifact", "SELECT jkey, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM log WHERE NOT failed GROUP BY 1")
def k11(v: Views) -> DataFrame:
    return v.log.filter("NOT failed").groupBy("jkey").agg(F.max("ts").alias("ts"), F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


# ------------------------------------------------------------------ sets
@query("u01_judging_pool", "SELECT DISTINCT topic_id, chunk_id FROM runs WHERE rnk <= 5")
def u01(v: Views) -> DataFrame:
    return v.runs.filter("rnk <= 5").select("topic_id", "chunk_id").distinct()


@query("u02_jaccard_overlap", """WITH s AS (SELECT qkey, list(DISTINCT chunk_id) FILTER (WHERE config = 'len') AS a, list(DISTINCT chunk_id) FILTER (WHERE config = 'id') AS b FROM runs WHERE rnk <= 5 GROUP BY 1)
SELECT qkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM s""")
def u02(v: Views) -> DataFrame:
    side = lambda c: F.collect_set(F.when(F.col("config") == c, F.col("chunk_id")))
    s = v.runs.filter("rnk <= 5").groupBy("qkey").agg(side("len").alias("a"), side("id").alias("b")).filter("size(a) + size(b) > 0")
    return s.select("qkey", F.round(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")), 6).alias("jaccard"))


@query("u03_union_of_grade_keys", "SELECT topic_id, chunk_id FROM qrels UNION SELECT topic_id, chunk_id FROM runs WHERE rnk <= 3")
def u03(v: Views) -> DataFrame:
    return v.qrels.select("topic_id", "chunk_id").union(v.runs.filter("rnk <= 3").select("topic_id", "chunk_id")).distinct()


@query("u04_ordered_distinct", "SELECT conv_id, array_to_string(list_transform(list_sort(list({'t': t, 'role': role})), lambda x: x.role), ',') AS roles FROM (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY 1, 2) GROUP BY 1")
def u04(v: Views) -> DataFrame:
    g = v.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    return g.select("conv_id", F.array_join(F.array_distinct(F.transform("x", lambda s: s["role"])), ",").alias("roles"))


@query("u05_held_out_keys", "SELECT DISTINCT qkey FROM runs EXCEPT SELECT qkey FROM runs WHERE right(qkey, 1) = '1'")
def u05(v: Views) -> DataFrame:
    from quarry.operators.judging import held_out

    q = v.runs.select("qkey").distinct()
    return held_out(q, q.filter(F.col("qkey").endswith("1")), "qkey")


@query("u06_ordered_filter", "SELECT item_id, row_number() OVER (ORDER BY item_id) AS place FROM benchmark WHERE item_id IN (SELECT doc_id % 60 FROM documents WHERE lang = 'es')")
def u06(v: Views) -> DataFrame:
    wanted = v.documents.filter("lang = 'es'").select((F.col("doc_id") % 60).alias("item_id"))
    return global_rank(v.benchmark.join(wanted, "item_id", "left_semi").select("item_id"), [F.col("item_id")])


@query("u07_config_list", """WITH t AS (SELECT doc_id, doc_id % 9 + 1 AS n FROM documents)
SELECT doc_id, 0 AS place, n / 10.0::DOUBLE AS k1, 0.4::DOUBLE AS b FROM t UNION ALL SELECT doc_id, 1, 1.2, 0.75 FROM t UNION ALL SELECT doc_id, 2, n + 1.0, n / 20.0::DOUBLE FROM t""")
def u07(v: Views) -> DataFrame:
    """A list of configurations for each document, one of them twice; repeats keep their first place."""
    n = (F.col("doc_id") % 9 + 1).cast("double")
    one = F.concat((n / 10).cast("string"), F.lit(":0.4"))
    given = F.concat_ws(",", one, F.lit("1.2:0.75"), one, F.concat((n + 1).cast("string"), F.lit(":"), (n / 20).cast("string")))
    t = v.documents.select("doc_id", F.posexplode(F.array_distinct(F.split(given, ","))).alias("place", "t"))
    return t.select("doc_id", "place", F.split_part("t", F.lit(":"), F.lit(1)).cast("double").alias("k1"), F.split_part("t", F.lit(":"), F.lit(2)).cast("double").alias("b"))
