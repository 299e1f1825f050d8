"""Preference formatting of chosen and rejected conversations.

Two conversations with a common beginning: their longest common prefix of turns (same role and text) is rendered
once, as the prompt; what each goes on with is rendered as its completion, with the spans that are trained on: the
text and end mark of assistant turns. Everything else is masked.

Nulls and odd rows: a null role or text counts as empty. Turns are ordered by number, nulls first, ties by role
and text; rows repeated within a conversation count once. A pair with one side missing has status "single" and an empty
completion on that side; conversations that agree to the end have status "same". Rows of a null pair or side go
to no pair, and are left out; so are rows of a null conversation. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import scratch
from quarry.operators.order import global_rank

TURN_END = "<|end|>\n"


def _head(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t["role"]), t["text"], F.lit(TURN_END))), "")


def _spans(turns: Column) -> Column:
    """'start-end' of each trained stretch of a rendered completion, in code points, joined by commas."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("found"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(_head(t["role"]))
        end = begin + F.length(t["text"]) + len(TURN_END)
        span = F.array(F.concat_ws("-", begin.cast("string"), end.cast("string")))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", F.concat(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    return F.array_join(F.aggregate(turns, start, step, lambda acc: acc["found"]), ",")


def format_pairs(turns: DataFrame) -> DataFrame:
    """One row per pair from turns (pair_id, side chosen or rejected, turn, role, text). One shuffle, by pair."""
    t = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    side = lambda name: F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("side") == name, t))), _order)
    both = turns.filter("pair_id IS NOT NULL AND side IN ('chosen', 'rejected')").groupBy("pair_id").agg(side("chosen").alias("c"), side("rejected").alias("r"))
    same = lambda i: (F.get("c", i)["role"] == F.get("r", i)["role"]) & (F.get("c", i)["text"] == F.get("r", i)["text"])
    shorter = F.least(F.size("c"), F.size("r"))
    first_off = F.array_min(F.filter(F.sequence(F.lit(0), shorter), lambda i: (i == shorter) | ~same(i)))
    d = both.withColumn("n", first_off)
    rest = {s: F.slice(F.col(s), F.col("n") + 1, F.size(s)) for s in "cr"}
    single = (F.size("c") == 0) | (F.size("r") == 0)
    ended = (F.size("c") == F.col("n")) & (F.size("r") == F.col("n"))
    return d.select(
        "pair_id",
        F.when(single, "single").when(ended, "same").otherwise("pair").alias("status"),
        F.col("n").cast("long").alias("prompt_turns"),
        _render(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"),
        _render(rest["c"]).alias("chosen"),
        _spans(rest["c"]).alias("chosen_spans"),
        _render(rest["r"]).alias("rejected"),
        _spans(rest["r"]).alias("rejected_spans"),
    )


def _order(a: Column, b: Column) -> Column:
    """Turn numbers ascending with nulls first, then role, then text."""
    cmp = lambda x, y: F.when(x < y, -1).when(x > y, 1)
    nulls = F.when(a["turn"].isNull() & b["turn"].isNotNull(), -1).when(a["turn"].isNotNull() & b["turn"].isNull(), 1)
    return F.coalesce(nulls, cmp(a["turn"], b["turn"]), cmp(a["role"], b["role"]), cmp(a["text"], b["text"]), F.lit(0))


def neighbours(conversations: DataFrame) -> DataFrame:
    """Turns with pair and side, every conversation in one pair (one may be left alone).

    Conversations that begin alike are paired first: within those of one first turn, in the order of their turns' digests, neighbours have
    the longest prefixes in common. Those left over are paired in the order of their ids. Of a pair the one with the lesser id is
    taken as chosen, and names it. Only digests are sorted; the order is global, so many conversations of one first
    turn, or equal ones, stand in many partitions.
    """
    given = conversations.filter("conv_id IS NOT NULL").select("conv_id", "turn", "role", "text")
    digest = F.md5(F.concat(F.coalesce("role", F.lit("")), F.lit("\x1f"), F.coalesce("text", F.lit(""))))
    keys = given.groupBy("conv_id").agg(F.sort_array(F.collect_set(F.struct("turn", digest.alias("d")))).alias("turns"))
    keys = keys.select("conv_id", F.col("turns.d").alias("key"))
    ranked = global_rank(keys, [F.col("key"), F.col("conv_id")]).select("conv_id", F.col("key")[0].alias("first"), "place")
    starts = scratch.table(ranked.groupBy("first").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("n")))
    at = scratch.table(ranked.join(starts, "first").select("conv_id", "first", "n", (F.col("place") - F.col("start")).alias("p")))
    alike = at.filter(F.col("p") < F.col("n") - F.col("n") % 2).select("conv_id", "first", F.floor(F.col("p") / 2).alias("j"))
    alone = at.filter((F.col("n") % 2 == 1) & (F.col("p") == F.col("n") - 1)).select("conv_id")
    alone = global_rank(alone, [F.col("conv_id")]).select("conv_id", F.lit(None).cast("string").alias("first"), F.floor((F.col("place") - 1) / 2).alias("j"))
    pairs = alike.unionByName(alone).groupBy("first", "j").agg(F.min("conv_id").alias("pair_id"), F.max("conv_id").alias("other"))
    side = lambda c, name: F.struct(F.col(c).alias("conv_id"), F.lit(name).alias("side"))
    sides = pairs.select("pair_id", F.explode(F.when(F.col("other") == F.col("pair_id"), F.array(side("pair_id", "chosen"))).otherwise(F.array(side("pair_id", "chosen"), side("other", "rejected")))).alias("x"))
    return given.join(scratch.table(sides.select("pair_id", "x.*")), "conv_id").select("pair_id", "side", "turn", "role", "text")


_SIDE = """list_transform(range(1, len({s}) + 1), lambda i: {{'i': i, 'role': {s}[i].role, 'text': {s}[i].text,
    'len': length({s}[i].role) + 5 + length({s}[i].text) + 8, 'head': length({s}[i].role) + 5}})"""
_RENDER = "coalesce(array_to_string(list_transform({x}, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '')"
_SPANS = """coalesce(array_to_string(list_transform(list_filter({x}, lambda t: t.role = 'assistant'), lambda t:
    CAST(coalesce(list_sum(list_transform(list_filter({x}, lambda u: u.i < t.i), lambda u: u.len)), 0) + t.head AS BIGINT) || '-' ||
    CAST(coalesce(list_sum(list_transform(list_filter({x}, lambda u: u.i < t.i), lambda u: u.len)), 0) + t.len AS BIGINT)), ','), '')"""

ORACLE = f"""
WITH o AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, list(md5(role || chr(31) || text) ORDER BY turn NULLS FIRST, md5(role || chr(31) || text)) AS key FROM o GROUP BY conv_id),
a AS (SELECT conv_id, key[1] AS first, row_number() OVER (PARTITION BY key[1] ORDER BY key, conv_id) - 1 AS p, count(*) OVER (PARTITION BY key[1]) AS c FROM k),
j AS (SELECT conv_id, first, p // 2 AS j FROM a WHERE p < c - c % 2
      UNION ALL SELECT conv_id, NULL, (row_number() OVER (ORDER BY conv_id) - 1) // 2 FROM a WHERE c % 2 = 1 AND p = c - 1),
w AS (SELECT conv_id, min(conv_id) OVER (PARTITION BY first, j) AS pair_id FROM j),
t AS (SELECT pair_id, CAST(o.conv_id <> pair_id AS INT) AS side, turn, role, text FROM o JOIN w ON w.conv_id = o.conv_id),
g AS (SELECT pair_id,
      coalesce(list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE side = 0), []) AS c0,
      coalesce(list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE side = 1), []) AS r0 FROM t GROUP BY pair_id),
n AS (SELECT *, list_min(list_filter(range(0, least(len(c0), len(r0)) + 1),
      lambda i: i = least(len(c0), len(r0)) OR c0[i + 1].role <> r0[i + 1].role OR c0[i + 1].text <> r0[i + 1].text)) AS n FROM g),
s AS (SELECT pair_id, n, len(c0) AS nc, len(r0) AS nr, {_SIDE.format(s='c0')} AS c, {_SIDE.format(s='r0')} AS r FROM n),
p AS (SELECT *, list_filter(c, lambda t: t.i <= n) AS pre, list_filter(c, lambda t: t.i > n) AS cc, list_filter(r, lambda t: t.i > n) AS rr FROM s)
SELECT pair_id, CASE WHEN nc = 0 OR nr = 0 THEN 'single' WHEN nc = n AND nr = n THEN 'same' ELSE 'pair' END AS status,
       CAST(n AS BIGINT) AS prompt_turns, {_RENDER.format(x='pre')} AS prompt,
       {_RENDER.format(x='cc')} AS chosen, {_SPANS.format(x='cc')} AS chosen_spans,
       {_RENDER.format(x='rr')} AS rejected, {_SPANS.format(x='rr')} AS rejected_spans
FROM p"""
