"""Filter interaction audit: what five filters remove, alone and in each of their 120 orders, per source.

A: under 50 words. B: fewer than 65 distinct words in 100. C: more than 5 capitals (A-Z) in 100 code points. D: any of #$%&*|.
E: the text of a smaller doc_id, table-wide.

Duplicates come from a sort: documents are ranged by (fingerprint, doc_id), so that a text with a third of all rows is dealt to many
tasks, and sorted by fingerprint, text and doc_id inside; a row fails E if the row before has its text and a smaller id. A run of
one text that goes over a task's bounds is settled afterwards: tasks hand on the first and the last text they hold with its least id, and the
rows of a first run that aren't above an id of their own task are judged by the least id of all. Copies stand side by side, so the other filters look at a text once.

Each document then is one mask of five bits. Masks are counted per source, at most 32 rows of them, and the report of all orders is a
sum over those counters: a join with a fixed table of 120 orders, 5 steps and 32 masks.

Nulls and odd rows: a null text counts as '', so such rows are copies of each other; a null source is ''. A null doc_id is no smaller than any and none is smaller than it:
it never fails E. Rows with one id and one text don't fail E for each other. Labels of a document are those of any row of `labels` with its id; null labels are none. Very long texts
are looked at whole. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import scratch
from quarry.llm.scratch import small_batches

LETTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 50, 65, 5
COPY = 1 << LETTERS.index("E")
_CAPITAL = bytes(range(0x41, 0x5B))
_SIGN = re.compile(rb"[#$%&*|]")


def mask_of(text: bytes) -> int:
    """Bits of the filters A to D that a text in UTF-8 fails."""
    words = text.split()  # bytes split at exactly \x20 and \x09-\x0D
    n = len(words)
    capitals = len(text) - len(text.translate(None, _CAPITAL))
    code_points = len(text) if text.isascii() else len(text.decode("utf-8", "surrogatepass"))
    fails = (n < MIN_WORDS, 100 * len(set(words)) < MIN_DISTINCT * n, 100 * capitals > MAX_CAPITALS * code_points, _SIGN.search(text) is not None)
    return sum(1 << k for k, x in enumerate(fails) if x)


JUDGED = "task long, doc_id long, part string, mask int, open boolean, edge string, print binary, text string"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (print, text, doc_id): their masks, `open` where E hangs on other tasks, and the task's first and last text as `edge` rows."""
    task, schema = TaskContext.get().partitionId(), pa.schema([("task", pa.int64()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("open", pa.bool_()), ("edge", pa.string()), ("print", pa.binary()), ("text", pa.string())])
    last: tuple[bytes, bytes] | None = None
    least: int | None = None
    mask, first = 0, True
    edge = lambda name: pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((task, least, None, None, None, name, last[0], last[1].decode("utf-8", "surrogatepass")), schema)], schema=schema)
    for b in batches:
        masks, opens, ids = [], [], b.column(0).to_pylist()
        for doc, key, text in zip(ids, b.column(2).to_pylist(), b.column(3).cast(pa.binary()).to_pylist()):
            if last is None or key != last[0] or text != last[1]:
                if last is not None and first:
                    yield edge("first")
                    first = False
                last, least, mask = (key, text), None, mask_of(text)
            if least is None:
                least = doc  # ids that are null come first
            above = doc is not None and doc > least
            masks.append(mask | COPY if above else mask)
            opens.append(first and doc is not None and not above)
        n = len(ids)
        yield pa.RecordBatch.from_arrays([pa.array([task] * n, pa.int64()), b.column(0), b.column(1), pa.array(masks, pa.int32()), pa.array(opens, pa.bool_()), *(pa.nulls(n, f.type) for f in list(schema)[5:])], schema=schema)
    if last is not None:
        if first:
            yield edge("first")
        yield edge("last")


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask and n: how many documents of an id and a source fail which filters."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("print"), text.alias("text"))
    # ranges are sampled from fingerprint and id only, as texts may be very long; equal fingerprints are equal texts but for a broken SHA-256
    ranged = small_batches(rows).repartitionByRange("print", "doc_id").sortWithinPartitions("print", "text", "doc_id")
    judged = scratch.table(ranged.mapInArrow(_judge, JUDGED))
    edges = judged.filter("edge IS NOT NULL").select("task", "edge", "print", "text", F.col("doc_id").alias("least"))
    everywhere = edges.groupBy("print", "text").agg(F.min("least").alias("lowest"))
    late = edges.filter("edge = 'first'").join(everywhere, ["print", "text"]).filter("lowest < least").select("task", F.lit(True).alias("late"))
    found = judged.filter("edge IS NULL").join(late, "task", "left")
    mask = F.when(F.col("open") & F.col("late"), F.col("mask").bitwiseOR(F.lit(COPY))).otherwise(F.col("mask"))
    return found.groupBy("doc_id", "part", mask.alias("mask")).agg(F.count(F.lit(1)).alias("n"))


def counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: additive, so that parts and tables can be merged by sums."""
    said = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.expr("coalesce(quality = 1, false)")).alias("good"), F.max(F.expr("coalesce(toxic = 1, false)")).alias("toxic"))
    rows = masks.filter("doc_id IS NOT NULL").join(said, "doc_id", "left").drop("doc_id").unionByName(masks.filter("doc_id IS NULL").drop("doc_id"), allowMissingColumns=True)
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0)).alias(c) for c in ("good", "toxic")))


def plan(spark: SparkSession) -> DataFrame:
    """What each step of each order does with each mask: 120 x 5 x 32 rows, whatever the data."""
    rows = []
    for order in map("".join, permutations(LETTERS)):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << LETTERS.index(letter)
            for mask in range(1 << len(LETTERS)):
                fails, gone = bool(mask & bit), bool(mask & before)
                # among the orders of the filters that a document fails, each is first equally often
                rows.append((order, step, mask, int(not fails and not gone), int(fails and not gone), int(fails and gone), int(mask == bit), 120 // mask.bit_count() if fails else 0))
            before |= bit
    return spark.createDataFrame(rows, "filter_order string, step int, mask int, keeps int, removes int, again int, alone int, share int")


def report(counters: DataFrame) -> DataFrame:
    """One row per part, order and step, zeros included."""
    both = counters.join(F.broadcast(plan(counters.sparkSession)), "mask")
    total = lambda n, times, name: F.sum(F.col(n) * F.col(times)).alias(name)
    return both.groupBy("part", "filter_order", "step").agg(
        total("n", "keeps", "kept"), total("n", "removes", "removed"), total("n", "again", "redundant"), total("n", "alone", "unique_fails"),
        total("good", "removes", "good_lost"), total("toxic", "removes", "toxic_lost"), total("n", "share", "shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return report(counters(masks(docs), labels))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
f AS (SELECT id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, unnest(['A', 'B', 'C', 'D', 'E']) AS letter,
        unnest([len(ws) < {MIN_WORDS}, 100 * len(list_distinct(ws)) < {MIN_DISTINCT} * len(ws), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MAX_CAPITALS} * length(text),
                regexp_matches(text, '[#$%&*|]'), coalesce(least < w.doc_id, false)]) AS fails FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e WHERE b.c <> a.c AND c.c NOT IN (a.c, b.c) AND d.c NOT IN (a.c, b.c, c.c) AND e.c NOT IN (a.c, b.c, c.c, d.c)),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS letter FROM o, (SELECT unnest(range(1, 6)) AS step)),
m AS (SELECT id, part, good, toxic, string_agg(CASE WHEN fails THEN letter ELSE '' END, '' ORDER BY letter) AS failed FROM f GROUP BY ALL),
n AS (SELECT part, failed, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM m GROUP BY 1, 2),
e AS (SELECT part, filter_order, step, letter, n, good, toxic, failed, contains(failed, letter) AS fails,
        len(list_filter(string_split(substr(filter_order, 1, step - 1), ''), lambda c: c <> '' AND contains(failed, c))) > 0 AS gone FROM n, s),
r AS (SELECT part, filter_order, step, letter, sum(n) FILTER (NOT fails AND NOT gone) AS kept, sum(n) FILTER (fails AND NOT gone) AS removed, sum(n) FILTER (fails AND gone) AS redundant,
        sum(n) FILTER (failed = letter) AS unique_fails, sum(good) FILTER (fails AND NOT gone) AS good_lost, sum(toxic) FILTER (fails AND NOT gone) AS toxic_lost FROM e GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
       CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r
"""
