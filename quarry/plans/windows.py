"""Queries of windows, ranking and trajectories (section W)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.fixtures import Views
from quarry.operators import evidence as E
from quarry.operators import metrics as M
from quarry.operators import traces as T
from quarry.plans.metrics import r6
from quarry.registry import query


@query("w01_rank_from_position", "SELECT config, qkey, chunk_id, row_number() OVER (PARTITION BY config, qkey ORDER BY score DESC, chunk_id) AS rank FROM runs")
def w01(v: Views) -> DataFrame:
    w = W.partitionBy("config", "qkey").orderBy(F.desc("score"), "chunk_id")
    return v.runs.select("config", "qkey", "chunk_id", F.row_number().over(w).cast("long").alias("rank"))


@query("w02_average_ranks", "SELECT topic_id, chunk_id, rank() OVER (PARTITION BY topic_id ORDER BY grade) + (count(*) OVER (PARTITION BY topic_id, grade) - 1) / 2.0 AS avg_rank FROM qrels")
def w02(v: Views) -> DataFrame:
    return M.average_ranks(v.qrels, "grade", ["topic_id"]).select("topic_id", "chunk_id", "avg_rank")


@query("w03_first_surfacer", "SELECT topic_id, jkey, min(event_id) AS event_id FROM log GROUP BY 1, 2")
def w03(v: Views) -> DataFrame:
    return T.first_credit(v.log, ["topic_id"], "jkey", "event_id")


@query("w04_first_seen_config", "SELECT topic_id, chunk_id, arg_min(config, (CASE config WHEN 'len' THEN 0 ELSE 1 END, qkey, rnk)) AS config FROM runs WHERE rnk <= 5 GROUP BY 1, 2")
def w04(v: Views) -> DataFrame:
    grid = F.when(F.col("config") == "len", 0).otherwise(1)
    return v.runs.filter("rnk <= 5").groupBy("topic_id", "chunk_id").agg(F.min_by("config", F.struct(grid.alias("g"), "qkey", "rnk")).alias("config"))


@query("w05_running_tokens", """WITH s AS (SELECT conv_id, step_idx, CASE WHEN role = 'assistant' THEN length(text) END AS n FROM steps)
SELECT conv_id, step_idx, CASE WHEN count(n) OVER w > 0 THEN CAST(sum(n) OVER w AS BIGINT) END AS cumulative FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY step_idx)""")
def w05(v: Views) -> DataFrame:
    s = v.steps.select("conv_id", F.col("step_idx").cast("long").alias("step_idx"), F.when(F.col("role") == "assistant", F.length("text")).alias("n"))
    return T.running_tokens(s, ["conv_id"], "step_idx", "n").select("conv_id", "step_idx", "cumulative")


TIMED = "s AS (SELECT user_id AS run, event_id AS id, CAST(event_id % 7 AS BIGINT) AS turn, epoch_us(ts) // 1000 AS t0, epoch_us(ts) // 1000 + CAST(floor(value * 1000) AS BIGINT) AS t1 FROM events)"


def timed(v: Views) -> DataFrame:
    t = F.unix_millis(F.col("ts").cast("timestamp"))
    return v.events.select(F.col("user_id").alias("run"), F.col("event_id").alias("id"), (F.col("event_id") % 7).alias("turn"), t.alias("t0"), (t + F.floor(F.col("value") * 1000)).alias("t1"))


@query("w06_step_duration", "SELECT event_id, CASE WHEN n >= 0 THEN n END AS ms FROM (SELECT event_id, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY event_id)) // 1000 - epoch_us(ts) // 1000 AS n FROM events)")
def w06(v: Views) -> DataFrame:
    end = F.lead("ts").over(W.partitionBy("user_id").orderBy("event_id"))
    return v.events.withColumn("e", end).select("event_id", T.duration_ms(F.col("ts"), F.col("e")).alias("ms"))


@query("w07_turn_spans", f"WITH {TIMED}, g AS (SELECT run, turn, min(t0) AS a, max(t1) AS b FROM s GROUP BY 1, 2) SELECT run, turn, a - min(a) OVER w AS start, b - min(a) OVER w AS \"end\", greatest(1, max(b) OVER w - min(a) OVER w) AS total FROM g WINDOW w AS (PARTITION BY run)")
def w07(v: Views) -> DataFrame:
    return T.spans_of(timed(v), ["run", "turn"])


@query("w08_lane_packing", f"""WITH RECURSIVE {TIMED}, o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY t0, t1, id) AS i FROM s),
f AS (SELECT run, 0 AS i, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS k, CAST([] AS BIGINT[]) AS ends FROM o WHERE i = 1
  UNION ALL SELECT run, i, id, k, list_concat(list_append(ends[1 : k - 1], t1), ends[k + 1 :]) AS ends FROM (SELECT o.run, o.i, o.id, o.t1, f.ends,
    coalesce(nullif(list_position(list_transform(f.ends, lambda e: e <= o.t0 + 1), true), 0), len(f.ends) + 1) AS k FROM f JOIN o ON o.run = f.run AND o.i = f.i + 1))
SELECT run, id, CAST(k - 1 AS INT) AS lane FROM f WHERE i > 0""")
def w08(v: Views) -> DataFrame:
    return T.lanes(timed(v), ["run"])


@query("w09_nice_ticks", "SELECT user_id, list_min(list_filter([1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000], lambda s: ceil(total / s) <= 8)) AS step FROM (SELECT user_id, sum(value) AS total FROM events GROUP BY 1)")
def w09(v: Views) -> DataFrame:
    ticks = F.array(*map(F.lit, (1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000)))
    return v.events.groupBy("user_id").agg(F.sum("value").alias("total")).select("user_id", F.array_min(F.filter(ticks, lambda s: F.ceil(F.col("total") / s) <= 8)).alias("step"))


@query("w10_sandwich_order", "WITH r AS (SELECT config, qkey, chunk_id, rnk - 1 AS i, count(*) OVER (PARTITION BY config, qkey) AS n FROM runs WHERE rnk <= 9) SELECT config, qkey, chunk_id, CASE WHEN i % 2 = 0 THEN i // 2 ELSE n - 1 - (i - 1) // 2 END AS place FROM r")
def w10(v: Views) -> DataFrame:
    return T.sandwich(v.runs.filter("rnk <= 9"), ["config", "qkey"], "rnk").select("config", "qkey", "chunk_id", "place")


@query("w11_heading_groups", "WITH l AS (SELECT conv_id, turn, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM steps) SELECT conv_id, CAST(g AS BIGINT) AS section, min(turn) AS first_turn, count(*) AS lines FROM l GROUP BY 1, 2")
def w11(v: Views) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    return v.steps.withColumn("section", F.sum((F.col("role") == "user").cast("int")).over(w)).groupBy("conv_id", "section").agg(F.min("turn").alias("first_turn"), F.count(F.lit(1)).alias("lines"))


@query("w12_residue_split", "SELECT docid, (row_number() OVER (PARTITION BY lang ORDER BY length(contents), docid) - 1) % 6 AS fold FROM corpus")
def w12(v: Views) -> DataFrame:
    w = W.partitionBy("lang").orderBy(F.length("contents"), "docid")
    return v.corpus.select("docid", ((F.row_number().over(w) - 1) % 6).cast("long").alias("fold"))


@query("w13_stable_hash_order", "SELECT qkey, config, chunk_id, row_number() OVER (PARTITION BY qkey ORDER BY sha256(qkey || '|' || config || chunk_id), chunk_id) AS place FROM runs WHERE rnk <= 3")
def w13(v: Views) -> DataFrame:
    w = W.partitionBy("qkey").orderBy(F.sha2(F.concat("qkey", F.lit("|"), "config", "chunk_id"), 256), "chunk_id")
    return v.runs.filter("rnk <= 3").select("qkey", "config", "chunk_id", F.row_number().over(w).cast("long").alias("place"))


@query("w14_curation_top_n", "SELECT qkey, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY config, qkey ORDER BY CAST(score AS BIGINT) % 2, rnk) AS r FROM runs WHERE config = 'len') WHERE r <= 8")
def w14(v: Views) -> DataFrame:
    w = W.partitionBy("config", "qkey").orderBy(F.col("score").cast("long") % 2, "rnk")
    return v.runs.filter("config = 'len'").withColumn("r", F.row_number().over(w)).filter("r <= 8").select("qkey", "chunk_id")


CITES = "c AS (SELECT conv_id, turn AS sentence, CAST(unnest([length(text) % 5, length(text) % 3, turn, length(text) % 7]) AS BIGINT) AS doc, unnest([0, 1, 2, 3]) AS pos FROM steps WHERE role = 'assistant')"


def cites(v: Views) -> DataFrame:
    n = F.length("text")
    return v.steps.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("sentence"), F.posexplode(F.array((n % 5).cast("long"), (n % 3).cast("long"), F.col("turn"), (n % 7).cast("long"))).alias("pos", "doc"))


@query("w15_cited_first_index", f"""WITH {CITES}, k AS (SELECT conv_id, doc, min(sentence * 10 + pos) AS k FROM c WHERE pos < 3 GROUP BY 1, 2) SELECT conv_id, doc, row_number() OVER (PARTITION BY conv_id ORDER BY k) - 1 AS ref FROM k""")
def w15(v: Views) -> DataFrame:
    return E.reference_index(cites(v), ["conv_id"], cap=3)


@query("w16_document_collapse", f"""WITH {CITES}, d AS (SELECT conv_id, sentence, doc // 2 AS doc, min(pos) AS pos FROM c GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, sentence ORDER BY pos) AS n FROM d)
SELECT conv_id, sentence, string_agg(doc, ',' ORDER BY n) AS docs FROM r WHERE n <= 3 GROUP BY 1, 2""")
def w16(v: Views) -> DataFrame:
    x = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.floor(F.col("doc") / 2).alias("doc")))), lambda s: s["doc"])
    return cites(v).groupBy("conv_id", "sentence").agg(F.array_join(F.slice(F.array_distinct(x), 1, 3), ",").alias("docs"))


@query("w17_queue_assignment", "SELECT source, (row_number() OVER (ORDER BY source) - 1) % 4 AS worker FROM (SELECT DISTINCT source FROM corpus)")
def w17(v: Views) -> DataFrame:
    return v.corpus.select("source").distinct().select("source", ((F.row_number().over(W.orderBy("source")) - 1) % 4).cast("long").alias("worker"))


@query("w18_tool_log_replay", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, event_type = 'error' AS failed, CAST(json_extract_string(props, '$.k') AS BIGINT) AS returned FROM events")
def w18(v: Views) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return v.events.select("user_id", "event_id", (F.row_number().over(w) - 1).cast("long").alias("step"), (F.col("event_type") == "error").alias("failed"), F.get_json_object("props", "$.k").cast("long").alias("returned"))
