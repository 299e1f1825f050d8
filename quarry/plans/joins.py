"""Queries of joins and look-ups (section J), and plain relational ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.fixtures import Views
from quarry.functions import ids
from quarry.operators import evidence as E
from quarry.operators import judging as JU
from quarry.operators import metrics as M
from quarry.plans.aggregates import LATEST
from quarry.plans.metrics import GRADED, PER_QUERY, per_query
from quarry.registry import query



@query("j01_grade_or_zero", f"WITH {GRADED} SELECT config, qkey, chunk_id, grade FROM g")
def j01(v: Views) -> DataFrame:
    return M.graded(v.runs, v.qrels).select("config", "qkey", "chunk_id", "grade")


@query("j02_grade_or_null", "SELECT r.config, r.qkey, r.chunk_id, q.grade FROM runs r LEFT JOIN qrels q ON r.topic_id = q.topic_id AND r.chunk_id = q.chunk_id")
def j02(v: Views) -> DataFrame:
    return v.runs.join(v.qrels, ["topic_id", "chunk_id"], "left").select("config", "qkey", "chunk_id", "grade")


WANT = "want AS (SELECT DISTINCT qkey FROM runs UNION SELECT 'xx::none')"


@query("j03_missing_queries_count", f"WITH {WANT} SELECT w.qkey, count(r.chunk_id) AS hits FROM want w LEFT JOIN (SELECT * FROM runs WHERE config = 'len' AND rnk <= 3) r ON w.qkey = r.qkey GROUP BY 1")
def j03(v: Views) -> DataFrame:
    want = v.runs.select("qkey").distinct().union(v.spark.sql("SELECT 'xx::none'"))
    return want.join(v.runs.filter("config = 'len' AND rnk <= 3").select("qkey", "chunk_id"), "qkey", "left").groupBy("qkey").agg(F.count("chunk_id").alias("hits"))


@query("j04_config_by_query", "SELECT c.config, q.qkey, count(r.chunk_id) AS hits FROM (SELECT DISTINCT config FROM runs) c CROSS JOIN (SELECT DISTINCT qkey FROM runs) q LEFT JOIN runs r ON r.config = c.config AND r.qkey = q.qkey AND r.rnk <= 30 GROUP BY 1, 2")
def j04(v: Views) -> DataFrame:
    """Every query for every configuration: the configurations, a list of the sweep's size, ride along each query."""
    configs = [r[0] for r in v.runs.select("config").distinct().limit(10_001).collect()]
    if len(configs) > 10_000:
        raise ValueError("a sweep has at most 10,000 configurations")
    grid = v.runs.select("qkey").distinct().select("qkey", F.explode(F.array(*map(F.lit, configs))).alias("config"))
    return grid.join(v.runs.filter("rnk <= 30").select("config", "qkey", "chunk_id"), ["config", "qkey"], "left").groupBy("config", "qkey").agg(F.count("chunk_id").alias("hits"))


@query("j05_grid_with_baseline", """WITH k AS (SELECT DISTINCT (length(text) % 12 + 1) / 10.0::DOUBLE AS k1 FROM documents), b AS (SELECT DISTINCT (doc_id % 7) / 10.0::DOUBLE AS b FROM documents)
SELECT k1, b, row_number() OVER (ORDER BY k1, b) AS place FROM (SELECT k1, b FROM k, b UNION SELECT 0.95, 0.45)""")
def j05(v: Views) -> DataFrame:
    """The grid of all values that the table has of either parameter (12 and 7 at most), and a baseline beside it."""
    d = v.documents.select(((F.length("text") % 12 + 1) / F.lit(10.0)).alias("k1"), (F.col("doc_id") % 7 / F.lit(10.0)).alias("b"))
    g = d.agg(F.collect_set("k1").alias("ks"), F.collect_set("b").alias("bs")).select(F.explode("ks").alias("k1"), "bs").select("k1", F.explode("bs").alias("b"))
    g = g.unionByName(v.spark.sql("SELECT 0.95D AS k1, 0.45D AS b")).dropDuplicates()
    return g.select("k1", "b", F.row_number().over(W.orderBy("k1", "b")).cast("long").alias("place"))


@query("j06_topic_of_query", "SELECT qkey, any_value(topic_id) AS topic_id, count(DISTINCT topic_id) > 1 AS conflict FROM runs GROUP BY 1")
def j06(v: Views) -> DataFrame:
    return v.runs.groupBy("qkey").agg(F.min("topic_id").alias("topic_id"), (F.min("topic_id") != F.max("topic_id")).alias("conflict"))


@query("j07_paired_deltas", f"WITH {PER_QUERY} SELECT coalesce(a.qkey, b.qkey) AS qkey, round(a.ndcg10_exp - b.ndcg10_exp, 6) AS delta FROM (SELECT * FROM m WHERE config = 'len') a FULL JOIN (SELECT * FROM m WHERE config = 'id') b ON a.qkey = b.qkey")
def j07(v: Views) -> DataFrame:
    from quarry.operators.stats import paired

    q = per_query(v)
    return paired(q, "len", "id", "ndcg10_exp").select("qkey", F.round("delta", 6).alias("delta"))


@query("j08_consensus_join", """WITH p AS (SELECT topic_id, chunk_id, grade FROM qrels WHERE md5(chunk_id) < 'c'), s AS (SELECT topic_id, chunk_id, 3 - grade AS grade FROM qrels WHERE md5(chunk_id) >= '4'), t AS (SELECT topic_id, chunk_id, 1 AS grade FROM qrels WHERE md5(chunk_id) < '8'),
u AS (SELECT topic_id, chunk_id FROM p UNION SELECT topic_id, chunk_id FROM s) SELECT u.topic_id, u.chunk_id, CASE WHEN p.grade IS NULL OR s.grade IS NULL THEN coalesce(p.grade, s.grade) WHEN abs(p.grade - s.grade) < 2 THEN (p.grade + s.grade) // 2 WHEN t.grade IS NOT NULL THEN list_sort([p.grade, s.grade, t.grade])[2] END AS grade
FROM u LEFT JOIN p USING (topic_id, chunk_id) LEFT JOIN s USING (topic_id, chunk_id) LEFT JOIN t USING (topic_id, chunk_id)""")
def j08(v: Views) -> DataFrame:
    k, h = ["topic_id", "chunk_id"], F.md5("chunk_id")
    p = v.qrels.filter(h < "c").select(*k, F.col("grade").alias("a"))
    s = v.qrels.filter(h >= "4").select(*k, (3 - F.col("grade")).alias("b"))
    t = v.qrels.filter(h < "8").select(*k, F.lit(1).alias("t"))
    j = p.join(s, k, "full_outer").join(t, k, "left")
    return j.select(*k, JU.consensus(F.col("a"), F.col("b"), F.col("t"))[0].cast("int").alias("grade"))


@query("j09_text_hydration", "SELECT r.qkey, r.rnk AS pos, r.chunk_id, length(c.contents) AS chars, c.docid IS NULL AS missing FROM (SELECT qkey, rnk, CASE WHEN rnk = 2 THEN chunk_id || 'x' ELSE chunk_id END AS chunk_id FROM runs WHERE config = 'id' AND rnk <= 3) r LEFT JOIN corpus c ON c.docid = r.chunk_id")
def j09(v: Views) -> DataFrame:
    want = v.runs.filter("config = 'id' AND rnk <= 3").select("qkey", F.col("rnk").cast("long").alias("pos"), F.when(F.col("rnk") == 2, F.concat("chunk_id", F.lit("x"))).otherwise(F.col("chunk_id")).alias("chunk_id"))
    j = want.join(v.corpus.select(F.col("docid").alias("d"), F.length("contents").cast("long").alias("chars")), F.col("d") == F.col("chunk_id"), "left")
    return j.select("qkey", "pos", "chunk_id", "chars", F.col("d").isNull().alias("missing"))


@query("j10_fetch_by_ids", "SELECT conv_id, doc, min(turn) AS pos FROM (SELECT conv_id, turn, length(text) % 40 AS doc FROM steps) s WHERE doc IN (SELECT item_id FROM benchmark) GROUP BY 1, 2")
def j10(v: Views) -> DataFrame:
    want = v.steps.groupBy("conv_id", (F.length("text") % 40).cast("long").alias("doc")).agg(F.min("turn").alias("pos"))
    return want.join(v.benchmark.select(F.col("item_id").alias("doc")), "doc", "left_semi").select("conv_id", "doc", "pos")


@query("j11_adjacent_pages", """WITH s AS (SELECT docid, page FROM chunks WHERE page % 5 = 2), w AS (SELECT docid, unnest([page - 1, page + 1]) AS page FROM s)
SELECT DISTINCT c.id FROM w JOIN chunks c ON c.docid = w.docid AND c.page = w.page WHERE c.page % 5 <> 2""")
def j11(v: Views) -> DataFrame:
    seeds = v.chunks.filter("page % 5 = 2").select("docid", "page")
    near = seeds.select("docid", F.explode(F.array(F.col("page") - 1, F.col("page") + 1)).alias("page")).distinct().join(seeds, ["docid", "page"], "left_anti")
    return v.chunks.join(near, ["docid", "page"], "left_semi").select("id")


@query("j12_augment_append", """WITH a AS (SELECT qkey, chunk_id, rnk FROM runs WHERE config = 'len' AND rnk <= 4), b AS (SELECT qkey, chunk_id, rnk FROM runs WHERE config = 'id' AND rnk <= 4),
n AS (SELECT b.qkey, b.chunk_id, row_number() OVER (PARTITION BY b.qkey ORDER BY b.rnk) + (SELECT count(*) FROM a x WHERE x.qkey = b.qkey) AS rank FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.qkey = b.qkey AND a.chunk_id = b.chunk_id))
SELECT qkey, chunk_id, rnk AS rank FROM a UNION ALL SELECT qkey, chunk_id, rank FROM n""")
def j12(v: Views) -> DataFrame:
    a, b = (v.runs.filter(f"config = '{c}' AND rnk <= 4").select("qkey", "chunk_id", "rnk") for c in ("len", "id"))
    new = b.join(a, ["qkey", "chunk_id"], "left_anti").withColumn("src", F.lit(1))
    w = W.partitionBy("qkey").orderBy("src", "rnk")
    return a.withColumn("src", F.lit(0)).unionByName(new).select("qkey", "chunk_id", F.row_number().over(w).cast("long").alias("rank"))


@query("j13_verdict_rerank", """WITH r AS (SELECT qkey, chunk_id, rnk, CASE WHEN rnk > 20 THEN NULL ELSE CAST(score AS BIGINT) % 3 END AS verdict FROM runs WHERE config = 'len')
SELECT qkey, chunk_id, row_number() OVER (PARTITION BY qkey ORDER BY coalesce(verdict, 1), rnk) AS rank FROM r WHERE verdict IS NULL OR verdict < 2""")
def j13(v: Views) -> DataFrame:
    verdict = F.when(F.col("rnk") <= 20, F.col("score").cast("long") % 3)
    r = v.runs.filter("config = 'len'").withColumn("verdict", verdict).filter("verdict IS NULL OR verdict < 2")
    w = W.partitionBy("qkey").orderBy(F.coalesce("verdict", F.lit(1)), "rnk")
    return r.select("qkey", "chunk_id", F.row_number().over(w).cast("long").alias("rank"))


@query("j14_rate_lookup", "SELECT e.event_type, round(sum(e.value) * any_value(r.rate::DOUBLE), 3) AS usd FROM events e JOIN (SELECT event_type, 0.001 * length(event_type) AS rate FROM (SELECT DISTINCT event_type FROM events)) r ON e.event_type = r.event_type GROUP BY 1")
def j14(v: Views) -> DataFrame:
    rates = v.events.select("event_type").distinct().withColumn("rate", 0.001 * F.length("event_type"))
    once = rates.groupBy("event_type").agg(F.when(F.count(F.lit(1)) > 1, F.raise_error("two rates")).otherwise(F.max("rate")).alias("rate"))
    return v.events.groupBy("event_type").agg(F.sum("value").alias("v")).join(once, "event_type").select("event_type", F.round(F.col("v") * F.col("rate"), 3).alias("usd"))


@query("j15_reference_texts", "SELECT conv_id, arg_min(length(text), turn) AS chars FROM steps WHERE length(text) > 100 GROUP BY 1")
def j15(v: Views) -> DataFrame:
    return v.steps.filter("length(text) > 100").groupBy("conv_id").agg(F.min_by(F.length("text").cast("long"), "turn").alias("chars"))


@query("j16_citation_resolution", """WITH c AS (SELECT conv_id, turn AS sentence, unnest([0, 1]) AS pos, unnest([CAST(turn % 3 AS VARCHAR), 'shard_' || turn]) AS citation FROM steps), f AS (SELECT conv_id, CAST(unnest([0, 1]) AS INT) AS ref, 'shard_' || unnest([1, 2]) AS doc FROM (SELECT DISTINCT conv_id FROM steps)),
j AS (SELECT c.conv_id, sentence, pos, CASE WHEN TRY_CAST(citation AS INT) IS NULL THEN citation ELSE f.doc END AS doc FROM c LEFT JOIN f ON c.conv_id = f.conv_id AND TRY_CAST(citation AS INT) = f.ref) SELECT conv_id, sentence, doc, min(pos) AS pos FROM j WHERE doc IS NOT NULL GROUP BY 1, 2, 3""")
def j16(v: Views) -> DataFrame:
    t = F.col("turn")
    c = v.steps.select("conv_id", t.alias("sentence"), F.posexplode(F.array((t % 3).cast("string"), F.concat(F.lit("shard_"), t.cast("string")))).alias("pos", "citation"))
    f = v.steps.select("conv_id").distinct().select("conv_id", F.posexplode(F.array(F.lit("shard_1"), F.lit("shard_2"))).alias("ref", "doc"))
    return E.resolve(c, f, ["conv_id"])


@query("j17_support_pairs", "SELECT s.conv_id, s.turn, b.item_id AS doc, length(substr(b.text, 1, 100)) AS chars FROM steps s JOIN benchmark b ON b.item_id = length(s.text) % 60 WHERE s.role = 'assistant'")
def j17(v: Views) -> DataFrame:
    s = v.steps.filter("role = 'assistant'").select("conv_id", "turn", (F.length("text") % 60).cast("long").alias("doc"), F.lit(0).alias("pos"))
    p = v.benchmark.select(F.col("item_id").alias("doc"), F.col("text").alias("passage"))
    return E.support_pairs(s, p, True, 100).select("conv_id", "turn", "doc", F.length("passage").cast("long").alias("chars"))


@query("j18_nearest_elsewhere", """WITH a AS (SELECT * FROM embeddings WHERE vec_id % 2 = 0), b AS (SELECT * FROM embeddings WHERE vec_id % 2 = 1)
SELECT a.vec_id, round(max(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 5) AS nearest FROM a JOIN b ON a.label = b.label GROUP BY 1""")
def j18(v: Views) -> DataFrame:
    from quarry.operators.neighbours import nearest

    arm = (F.col("vec_id") % 2).alias("arm")
    n = nearest(v.embeddings.select("label", arm, "vec_id", "embedding"), ["label"], "arm")
    return n.filter("arm = 0").select("vec_id", F.round("nearest", 5).alias("nearest"))


@query("j19_held_out", "SELECT DISTINCT qkey FROM runs WHERE qkey NOT IN (SELECT qkey FROM runs WHERE qkey LIKE 'en::%')")
def j19(v: Views) -> DataFrame:
    q = v.runs.select("qkey").distinct()
    return JU.held_out(q, q.filter("qkey LIKE 'en::%'"), "qkey")


@query("j20_battles", "SELECT a.topic_id, a.config AS first, b.config AS second FROM (SELECT DISTINCT topic_id, config FROM runs) a JOIN (SELECT DISTINCT topic_id, config FROM runs) b ON a.topic_id = b.topic_id AND a.config <> b.config")
def j20(v: Views) -> DataFrame:
    """Both orientations of all pairs of runs of a topic, from the sorted set of a topic's runs."""
    s = v.runs.groupBy("topic_id").agg(F.array_sort(F.collect_set("config")).alias("c"))
    e = s.select("topic_id", "c", F.posexplode("c").alias("i", "first"))
    return e.select("topic_id", "first", F.explode(F.filter("c", lambda x: x != F.col("first"))).alias("second"))


@query("j21_diversity_dataset", "SELECT r.chunk_id AS docid, min(r.qkey) AS qkey, coalesce(any_value(length(c.contents)), 0) AS chars FROM runs r LEFT JOIN corpus c ON c.docid = r.chunk_id WHERE rnk <= 2 GROUP BY 1")
def j21(v: Views) -> DataFrame:
    r = v.runs.filter("rnk <= 2").groupBy(F.col("chunk_id").alias("docid")).agg(F.min("qkey").alias("qkey"))
    return r.join(v.corpus.select("docid", F.length("contents").cast("long").alias("n")), "docid", "left").select("docid", "qkey", F.coalesce("n", F.lit(0)).alias("chars"))


@query("j22_adopted_judgments", f"WITH {LATEST}, t AS (SELECT DISTINCT jkey FROM log WHERE event_id % 2 = 0) SELECT t.jkey, l.grade, l.jkey IS NULL AS pending FROM t LEFT JOIN l ON t.jkey = l.jkey")
def j22(v: Views) -> DataFrame:
    t = v.log.filter("event_id % 2 = 0").select("jkey").distinct()
    return t.join(JU.latest(v.log).select("jkey", "grade", F.lit(True).alias("known")), "jkey", "left").select("jkey", "grade", F.col("known").isNull().alias("pending"))


# Relational extras, not from the reference: equi, semi, anti and range joins at the size of orders and line items.
@query("x01_revenue_by_nation", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def x01(v: Views) -> DataFrame:
    """Line items are summed by order before the joins, so these move one row an order."""
    per = v.lineitem.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    j = per.join(v.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(v.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_nationkey").agg(F.sum("r").alias("r")).join(v.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", F.round("r", 2).alias("revenue"))


@query("x02_orders_without_returns", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1")
def x02(v: Views) -> DataFrame:
    r = v.lineitem.filter("l_returnflag = 'R'").select("l_orderkey")
    return v.orders.join(r, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("x03_event_time_window", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def x03(v: Views) -> DataFrame:
    return v.events.groupBy(F.window("ts", "1 day")["start"].alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("x04_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS begun, count(*) AS n FROM s GROUP BY user_id, k""")
def x04(v: Views) -> DataFrame:
    return v.events.groupBy("user_id", F.session_window("ts", "6 hours").alias("s")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("begun"), "n")
