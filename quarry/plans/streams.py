"""Queries of stateful and streaming operators (section ST)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.fixtures import Views
from quarry.operators import patches as P
from quarry.operators import traces as T
from quarry.operators.judging import latest
from quarry.plans.aggregates import LATEST
from quarry.registry import query
from quarry.streaming import ledger as L
from quarry.streaming import pipes
from quarry.streaming import shards as SH
from quarry.streaming.store import scratch



def ledger_events(v: Views) -> DataFrame:
    """User turns stage four units, assistant turns commit three of the last; every fourth turn releases one, the last expires."""
    t, n = F.col("turn"), F.length("text")
    u = lambda x: F.concat(F.lit("u"), x.cast("string"))
    staged = F.array(u(t), u(t % 3), u(n % 5), u(n % 5))
    prev = F.lag("staged").over(W.partitionBy("conv_id").orderBy("turn"))
    s = v.conversations.select("conv_id", "turn", "role", staged.alias("staged")).withColumn("prev", prev)
    kind = F.when(F.col("role") == "user", "stage").when(F.col("turn") % 4 == 3, "release").when(F.col("role") == "assistant", "commit").otherwise("expire")
    units = F.when(F.col("role") == "user", F.col("staged")).when(F.col("turn") % 4 == 3, F.array(u(F.lit(0)))).otherwise(F.coalesce(F.slice("prev", 1, 3), F.array().cast("array<string>")))
    return s.select(F.col("conv_id").alias("run"), F.col("turn").alias("seq"), kind.alias("kind"), units.alias("units"))


def _row(u: str, o: str, r: str) -> str:
    return f"{{'seq': seq, 'unit': {u}, 'outcome': {o}, 'reason': {r}}}"


def _error(reason: str) -> str:
    return _row("u", "'error'", f"'{reason}'")


def _later(more: str) -> str:
    """What a staged unit that isn't taken gets: a duplicate if it was committed before, else rejected for a reason."""
    return _row("u", "CASE WHEN list_contains(hu, u) THEN 'duplicate' ELSE 'rejected' END", f"CASE WHEN list_contains(hu, u) THEN '{L.LATER}' {more} END")


_BEYOND = f"WHEN list_contains(beyond, u) THEN '{L.OVERFLOW.replace(chr(39), chr(39) * 2)}' ELSE '{L.UNSELECTED}'"
#: The ledger's fold, one event of every run at a time: views ending in d (run, seq, unit, outcome, reason).
LEDGER = f"""WITH RECURSIVE c AS (SELECT conv_id AS run, turn AS seq, role, ['u' || turn, 'u' || (turn % 3), 'u' || (length(text) % 5), 'u' || (length(text) % 5)] AS staged FROM conversations),
p AS (SELECT *, lag(staged) OVER (PARTITION BY run ORDER BY seq) AS prev, row_number() OVER (PARTITION BY run ORDER BY seq) AS i FROM c),
e AS (SELECT run, seq, i, CASE WHEN role = 'user' THEN 'stage' WHEN seq % 4 = 3 THEN 'release' WHEN role = 'assistant' THEN 'commit' ELSE 'expire' END AS kind,
      CASE WHEN role = 'user' THEN staged WHEN seq % 4 = 3 THEN ['u0'] ELSE coalesce(prev[1:3], []) END AS units FROM p),
q AS (SELECT run, seq, i, kind, units, list_filter(units, lambda x, n: list_position(units, x) = n) AS chosen FROM e),
z AS (SELECT run, 0 AS i, CAST([] AS VARCHAR[]) AS pending, CAST([] AS STRUCT(u VARCHAR, s BIGINT)[]) AS home, CAST([] AS STRUCT(seq BIGINT, unit VARCHAR, outcome VARCHAR, reason VARCHAR)[]) AS out FROM q WHERE i = 1
  UNION ALL SELECT run, i,
    CASE WHEN kind = 'stage' THEN pending || units WHEN kind = 'release' OR (kind = 'commit' AND len(strange) > 0) THEN pending ELSE [] END AS pending,
    CASE WHEN kind = 'commit' AND len(strange) = 0 THEN home || list_transform(taken, lambda u: {{'u': u, 's': seq}}) WHEN kind = 'release' AND len(gone) = 0 THEN list_filter(home, lambda h: NOT list_contains(chosen, h.u)) ELSE home END AS home,
    CASE WHEN kind = 'commit' AND len(strange) > 0 THEN list_transform(strange, lambda u: {_error('not staged')})
         WHEN kind = 'commit' THEN flatten(list_transform(once, lambda u: CASE WHEN list_contains(taken, u) THEN [{_row('u', "'committed'", "''")}] || list_transform(list_filter(pending, lambda x, n: x = u AND list_position(pending, x) <> n), lambda x: {_row('x', "'duplicate'", f"'{L.PARALLEL}'")})
                                             ELSE [{_later(_BEYOND)}] END))
         WHEN kind = 'release' AND len(gone) > 0 THEN list_transform(gone, lambda u: {_error('not committed')})
         WHEN kind = 'release' THEN list_transform(chosen, lambda u: {_row('u', "'released'", "'kept since ' || home[list_position(hu, u)].s")})
         WHEN kind = 'expire' THEN list_transform(once, lambda u: {_later("ELSE 'expired'")}) ELSE [] END AS out
    FROM (SELECT *, list_filter(chosen, lambda x: NOT list_contains(pending, x)) AS strange, list_filter(chosen, lambda x: NOT list_contains(hu, x)) AS gone,
            list_filter(chosen, lambda x: NOT list_contains(hu, x))[1:3] AS taken, list_filter(chosen, lambda x: NOT list_contains(hu, x))[4:] AS beyond, list_filter(pending, lambda x, n: list_position(pending, x) = n) AS once
          FROM (SELECT q.*, z.pending, z.home, list_transform(z.home, lambda h: h.u) AS hu FROM z JOIN q ON q.run = z.run AND q.i = z.i + 1))),
d AS (SELECT run, x.seq AS seq, x.unit AS unit, x.outcome AS outcome, x.reason AS reason FROM (SELECT run, unnest(out) AS x FROM z))"""


def streamed(v: Views, events: DataFrame, parts: list[str], keep_ms: int | None = None) -> DataFrame:
    """The ledgers' decisions by a stream that is stopped and begun again: each part of the events comes after the ones before are done."""
    src, out, cp = (scratch(v.spark, f"ledger-{x}") for x in ("in", "out", "cp"))
    for part in parts:
        events.filter(part).write.mode("append").parquet(src)
        stream = v.spark.readStream.schema(events.schema).parquet(src)
        pipes.drain(L.replay_stream(stream if keep_ms is None else stream.withWatermark("at", "0 seconds"), keep_ms=keep_ms), out, cp)
    return v.spark.read.parquet(out)


_HALVES = ["seq < 3", "seq >= 3"]


@query("st01_ledger_commit", f"{LEDGER} SELECT * FROM d WHERE outcome IN ('committed', 'duplicate', 'rejected')")
def st01(v: Views) -> DataFrame:
    return streamed(v, ledger_events(v), _HALVES).filter("outcome IN ('committed', 'duplicate', 'rejected')")


@query("st02_ledger_release", f"{LEDGER} SELECT * FROM d WHERE outcome IN ('released', 'error')")
def st02(v: Views) -> DataFrame:
    return streamed(v, ledger_events(v), _HALVES).filter("outcome IN ('released', 'error')")


@query("st03_result_compaction", "SELECT config, qkey, string_agg(CASE WHEN rnk % 3 = 1 THEN chunk_id ELSE '[' || chunk_id || ' dropped]' END, ' ' ORDER BY rnk) AS body FROM runs WHERE rnk <= 6 GROUP BY 1, 2")
def st03(v: Views) -> DataFrame:
    x = F.array_sort(F.collect_list(F.struct("rnk", "chunk_id")))
    g = v.runs.filter("rnk <= 6").groupBy("config", "qkey").agg(x.alias("x"))
    body = F.transform("x", lambda r: F.when(r["rnk"] % 3 == 1, r["chunk_id"]).otherwise(F.concat(F.lit("["), r["chunk_id"], F.lit(" dropped]"))))
    return g.select("config", "qkey", F.array_join(body, " ").alias("body"))


@query("st04_staged_expiry", """WITH s AS (SELECT conv_id, turn, unnest([turn, turn % 3, length(text) % 5]) AS u, max(turn) OVER (PARTITION BY conv_id) + 1 AS seq FROM conversations WHERE role = 'user')
SELECT DISTINCT conv_id AS run, seq, 'u' || u AS unit, 'rejected' AS outcome, 'expired' AS reason FROM s""")
def st04(v: Views) -> DataFrame:
    """Staged batches that nothing commits, until their timers run out: a last event of another run brings the watermark there."""
    e = ledger_events(v).filter("kind = 'stage'").withColumn("at", F.timestamp_seconds(F.col("seq") + 1_000))
    end = e.agg(F.timestamp_seconds(F.max("seq") + 2_001_000).alias("at")).select(F.lit(None).cast("long").alias("run"), F.lit(0).cast("long").alias("seq"), F.lit("commit").alias("kind"), F.array().cast("array<string>").alias("units"), "at")
    events = e.select("run", F.col("seq").cast("long").alias("seq"), "kind", "units", "at").unionByName(end)
    return streamed(v, events, ["run IS NOT NULL", "run IS NULL"], keep_ms=1_000_000_000)


@query("st05_ready_ingestion", "SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1")
def st05(v: Views) -> DataFrame:
    """Shards come in two lots, with a restart between; one is never marked as ready."""
    src, out, cp = (scratch(v.spark, f"ingest-{x}") for x in ("in", "out", "cp"))
    docs = v.documents.select("doc_id", "lang", "text")
    step = lambda d: d.select("lang", F.length("text").alias("n"))
    for lot in (0, 1):
        docs.filter(F.pmod("doc_id", F.lit(2)) == lot).repartition(3).write.mode("append").json(src)
        for name in SH.names(src):
            if name.endswith(".json") and f"{name}{SH.READY}" not in SH.names(src):
                SH.mark(src, f"{name}{SH.READY}")
        if lot == 0:
            pipes.drain(step(SH.ready(v.spark, src, docs.schema)), out, cp)
    docs.limit(5).write.mode("append").json(src)
    SH.mark(src, SH.DONE)
    return SH.watch(v.spark, src, docs.schema, step, out, cp).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n").cast("long").alias("chars"))


@query("st06_streamed_compaction", f"WITH {LATEST} SELECT jkey, grade, event_id FROM l")
def st06(v: Views) -> DataFrame:
    src, out, cp = (scratch(v.spark, f"compact-{x}") for x in ("in", "out", "cp"))
    v.log.repartition(6, "event_id").write.parquet(src)
    return pipes.compact_log(v.spark, src, v.log.schema, out, cp).select("jkey", "grade", "event_id")


@query("st07_budget_guard", """WITH s AS (SELECT topic_id, event_id, sum(value) OVER w + 4 * max(value) OVER w AS x FROM log WINDOW w AS (PARTITION BY topic_id ORDER BY event_id)) SELECT topic_id, min(event_id) AS event_id FROM s WHERE x >= 5000 GROUP BY 1""")
def st07(v: Views) -> DataFrame:
    return T.budget_breach(v.log, ["topic_id"], ["event_id"], "value", 5000.0, 4)


@query("st08_circuit_breaker", """WITH s AS (SELECT topic_id, count(*) OVER w AS n, sum(failed::INT) OVER w AS f FROM log WINDOW w AS (PARTITION BY topic_id ORDER BY event_id)) SELECT topic_id, min(n) AS calls FROM s WHERE n >= 50 AND f > 0.01 * n GROUP BY 1""")
def st08(v: Views) -> DataFrame:
    return T.breaker(v.log, ["topic_id"], ["event_id"], F.col("failed"))


@query("st09_fetch_pacing", "SELECT user_id, count(*) FILTER (WHERE gap < 60000000) AS too_soon, min(gap) AS shortest FROM (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) GROUP BY 1")
def st09(v: Views) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = us - F.lag(us).over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return v.events.withColumn("gap", gap).groupBy("user_id").agg(F.count_if(F.col("gap") < 60_000_000).alias("too_soon"), F.min("gap").alias("shortest"))


@query("st10_facet_loop", """WITH r AS (SELECT conv_id, turn, length(text) AS e, length(text) > 1200 AS c FROM steps), s AS (SELECT conv_id, min(turn) FILTER (WHERE c) AS f, max(turn) AS l FROM r GROUP BY 1), t AS (SELECT conv_id, least(coalesce(f, l), 5) AS stopped, coalesce(f <= 5, false) AS covered FROM s)
SELECT t.conv_id, stopped, covered, CAST(sum(e) AS BIGINT) AS evidence FROM r JOIN t ON r.conv_id = t.conv_id AND r.turn <= t.stopped GROUP BY 1, 2, 3""")
def st10(v: Views) -> DataFrame:
    n = F.length("text")
    return P.facet_loop(v.steps.select("conv_id", "turn", n.alias("evidence"), (n > 1200).alias("c")), ["conv_id"], "turn", "c", 5).select("conv_id", "stopped", "covered", F.col("evidence").cast("long").alias("evidence"))


@query("st11_evidence_ledger", "SELECT topic_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS searches, count(DISTINCT jkey) AS anchors FROM log GROUP BY 1")
def st11(v: Views) -> DataFrame:
    return v.log.groupBy("topic_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("searches"), F.countDistinct("jkey").alias("anchors"))


UNION_SQL = r"""WITH a AS (SELECT conv_id, count(*) AS items, sum(len(regexp_extract_all(text, '\S+'))) AS words FROM steps WHERE role = 'assistant' GROUP BY 1),
u AS (SELECT conv_id, count(*) AS items, sum(len(regexp_extract_all(text, '\S+'))) AS words FROM steps WHERE role = 'assistant' AND turn % 4 <> 3 GROUP BY 1)
SELECT a.conv_id, coalesce(u.items, 0) < 0.6 * a.items AS few_items, coalesce(u.words, 0) < 0.65 * a.words AS few_words FROM a LEFT JOIN u ON a.conv_id = u.conv_id"""


def unions(v: Views) -> DataFrame:
    from quarry.functions.text import n_words

    kept = F.col("turn") % 4 != 3
    n = n_words(F.col("text"))
    return v.steps.filter("role = 'assistant'").groupBy("conv_id").agg(F.count(F.lit(1)).alias("a_items"), F.sum(n).alias("a_words"), F.count_if(kept).alias("items"), F.sum(F.when(kept, n).otherwise(0)).alias("words"))


@query("st12_union_checks", UNION_SQL)
def st12(v: Views) -> DataFrame:
    bad = P.union_violations(F.col("items"), F.col("words"), F.col("a_items"), F.col("a_words"))
    return unions(v).withColumn("bad", bad).select("conv_id", F.array_contains("bad", "items").alias("few_items"), F.array_contains("bad", "words").alias("few_words"))


@query("st13_anchor_fallback", UNION_SQL.replace("SELECT a.conv_id, coalesce(u.items, 0) <", "SELECT a.conv_id, CASE WHEN coalesce(u.items, 0) <").replace("* a.items AS few_items, coalesce", "* a.items OR coalesce").replace("* a.words AS few_words", "* a.words THEN 'anchor' ELSE 'union' END AS answer"))
def st13(v: Views) -> DataFrame:
    bad = P.union_violations(F.col("items"), F.col("words"), F.col("a_items"), F.col("a_words"))
    return unions(v).select("conv_id", F.when(F.size(bad) > 0, "anchor").otherwise("union").alias("answer"))


@query("st14_line_patches")
def st14(v: Views) -> DataFrame:
    x = F.array_sort(F.collect_list(F.struct("turn", "text")))
    drafts = v.conversations.groupBy(F.col("conv_id").alias("key")).agg(F.transform(x, lambda s: s["text"]).alias("lines"))
    t = F.col("turn")
    op = F.when(t % 3 == 0, "replace").when(t % 3 == 1, "insert").otherwise("delete")
    text = F.when(t % 2 == 0, F.concat("text", F.lit(" More."))).otherwise(F.lit("Short."))
    props = v.conversations.select(F.col("conv_id").alias("key"), t.alias("n"), op.alias("op"), t.cast("int").alias("at"), text.alias("text"), (t % 5 != 4).alias("ok"))
    return P.apply_patches(drafts, props)


@query("st15_driver_accounting", "SELECT topic_id, count(*) AS attempts, count(DISTINCT jkey) AS keys, count(*) FILTER (WHERE failed) AS failures, max(event_id) AS checkpoint FROM log GROUP BY 1")
def st15(v: Views) -> DataFrame:
    return v.log.groupBy("topic_id").agg(F.count(F.lit(1)).alias("attempts"), F.countDistinct("jkey").alias("keys"), F.count_if("failed").alias("failures"), F.max("event_id").alias("checkpoint"))
