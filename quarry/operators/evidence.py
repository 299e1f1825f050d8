"""Operators on answers and their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as T


def parse_report(reports: DataFrame, key: list[str], cap: int = 3) -> DataFrame:
    """Sentences of a report: fences and headings go, list marks and emphasis too; a line of citations only joins the line before."""
    body = F.regexp_replace("text", r"(?s)```.*?```", "")
    lines = reports.select(*key, F.posexplode(F.split(body, "\n")).alias("n", "line"))
    line = F.trim(F.regexp_replace(F.regexp_replace("line", r"^\s*(?:[-*]|\d+[.)])\s+", ""), r"\*\*([^*]+)\*\*", "$1"))
    lines = lines.filter(~F.col("line").rlike(r"^\s*#")).select(*key, "n", line.alias("line")).filter("line != ''")
    bare = T.without_markers(F.col("line"))
    own = lines.select(*key, "n", bare.alias("sentence"), T.markers(F.col("line")).alias("cited"))
    w = W.partitionBy(*key).orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    grouped = own.withColumn("g", F.sum((F.col("sentence") != "").cast("int")).over(w))
    s = grouped.groupBy(*key, "g").agg(F.max("sentence").alias("sentence"), F.array_distinct(F.flatten(F.collect_list("cited"))).alias("cited"))
    return s.filter("g > 0").select(*key, F.col("g").alias("sentence_no"), "sentence", F.slice("cited", 1, cap).alias("citations"))


def reference_index(cites: DataFrame, by: list[str], cap: int = 3) -> DataFrame:
    """References in the order they are first cited, over the first `cap` citations of each sentence."""
    k = cites.filter(F.col("pos") < cap).groupBy(*by, "doc").agg(F.min(F.struct("sentence", "pos")).alias("at"))
    return k.select(*by, "doc", (F.row_number().over(W.partitionBy(*by).orderBy("at")) - 1).cast("long").alias("ref"))


def resolve(citations: DataFrame, refs: DataFrame, by: list[str]) -> DataFrame:
    """Citations as document ids: a number is an index into the references, anything else an id. Repeats keep their first place."""
    n = F.col("citation").try_cast("int")
    j = citations.withColumn("_n", n).join(refs.select(*by, F.col("ref").alias("_n"), F.col("doc").alias("_doc")), [*by, "_n"], "left")
    j = j.withColumn("doc", F.when(F.col("_n").isNull(), F.col("citation")).otherwise(F.col("_doc"))).filter("doc IS NOT NULL")
    return j.groupBy(*by, "sentence", "doc").agg(F.min("pos").alias("pos"))


def support_pairs(sentences: DataFrame, passages: DataFrame, first_only: bool, limit: int) -> DataFrame:
    """(sentence, cited passage) with the passage there, cut to `limit` characters."""
    s = sentences.filter("pos = 0") if first_only else sentences
    return s.join(passages, "doc").withColumn("passage", F.substring("passage", 1, limit))


#: Characters of an excerpt, and of all excerpts of a packet.
EXCERPT, PACKET = 620, 44_000


def packets(claims: DataFrame, docs: DataFrame, by: list[str], docs_per: int = 3, spans_per: int = 2, local_spans: int = 5, least: float = 0.05, excerpt: int = EXCERPT, budget: int = PACKET) -> DataFrame:
    """Per finding, the documents of its group that speak to it best, and the best spans of each, as far as a packet's characters go.

    claims: (by, finding, claim, cited): cited are the documents of the lines that a finding is about. docs: (by, doc, parent, text). A document counts by its
    best span, and 1.0 more if it is cited, 0.8 more if its parent is that of a cited one; such documents give up to `local_spans` spans, others `spans_per`.
    Equal documents come in descending order. Excerpts are taken in order until the next would go beyond the budget. Claims meet the spans of their own group only.
    """
    family = docs.select(*by, F.col("doc").alias("_d"), F.col("parent").alias("_p"))
    kin = claims.select(*by, "finding", F.explode("cited").alias("_d")).join(family, [*by, "_d"]).groupBy(*by, "finding").agg(F.collect_set("_p").alias("parents"))
    spans = docs.select(*by, "doc", "parent", F.posexplode(T.spans(F.col("text"))).alias("n", "span"))
    s = claims.join(kin, [*by, "finding"], "left").join(spans, by).withColumn("score", F.round(T.span_score(F.col("claim"), F.col("span")), 6))
    bonus = F.when(F.array_contains("cited", F.col("doc")), 1.0).when(F.array_contains("parents", F.col("parent")), 0.8).otherwise(0.0)
    s = s.withColumn("bonus", F.coalesce(bonus, F.lit(0.0))).select(*by, "finding", "doc", "n", "span", "score", "bonus")
    most = F.when(F.col("bonus") > 0, local_spans).otherwise(spans_per)
    best = s.withColumn("r", F.row_number().over(W.partitionBy(*by, "finding", "doc").orderBy(F.desc("score"), "n"))).filter(F.col("r") <= most)
    total = F.round(F.col("score") + F.col("bonus"), 6)
    first = best.filter("r = 1").filter(total >= least)
    top = first.withColumn("d", F.row_number().over(W.partitionBy(*by, "finding").orderBy(F.desc(total), F.desc("doc")))).filter(F.col("d") <= docs_per)
    out = best.join(top.select(*by, "finding", "doc", "d"), [*by, "finding", "doc"]).withColumn("span", F.substring("span", 1, excerpt))
    used = F.sum(F.length("span")).over(W.partitionBy(*by).orderBy("finding", "d", "r").rowsBetween(W.unboundedPreceding, 0))
    return out.withColumn("_u", used).filter(F.col("_u") <= budget).select(*by, "finding", F.col("d").alias("doc_rank"), "doc", F.col("r").alias("span_rank"), "span", "score", "bonus")
