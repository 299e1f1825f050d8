"""Identifiers of retrieval units, queries, judgments and configurations, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = r"_p\d+$"
PAGE_HEADER = r"^Page \d+ of document: [^\n]*\n\n"


def unit_kind(unit: Column) -> Column:
    return F.when(unit.rlike(CHUNK), "chunk").otherwise("document")


def unit_docid(unit: Column) -> Column:
    return F.regexp_replace(unit, CHUNK, "")


def parent_docid(unit: Column) -> Column:
    """Everything before the last "_p", digits or not."""
    return F.regexp_replace(unit, r"^(?s)(.*)_p.*$", "$1")


def page_of(unit: Column) -> Column:
    """Page number of a chunk, null for a document."""
    return F.regexp_extract(unit, r"_p(\d+)$", 1).try_cast("int")


def shard_of(docid: Column) -> Column:
    return F.nullif(F.regexp_extract(docid, r"^(.+)_(\d+)$", 1), F.lit(""))


def row_of(docid: Column) -> Column:
    return F.regexp_extract(docid, r"^(.+)_(\d+)$", 2).try_cast("long")


def qkey(topic: Column, text: Column) -> Column:
    return F.concat(topic, F.lit("::"), F.substring(F.sha1(text), 1, 12))


def jkey(*parts: Column) -> Column:
    """Parts joined by "::"; an empty part or one that holds the separator is an error."""
    checked = [F.when((p == "") | p.contains("::"), F.raise_error(F.concat(F.lit("bad key part: "), p))).otherwise(p) for p in parts]
    return F.concat_ws("::", *checked)


def jkey_part(key: Column, n: int) -> Column:
    return F.split_part(key, F.lit("::"), F.lit(n))


def topic_of_qkey(key: Column) -> Column:
    return F.when(key.contains("::"), F.split_part(key, F.lit("::"), F.lit(1))).otherwise(F.raise_error(F.concat(F.lit("no topic in "), key)))


def number_key(x: Column) -> Column:
    """A double as %g writes it, for values of few digits."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def config_key(k1: Column, b: Column) -> Column:
    return F.concat(F.lit("k1_"), number_key(k1), F.lit("__b_"), number_key(b))


def config_number(config: Column, which: str) -> Column:
    return F.regexp_extract(config, r"^k1_(-?\d+(?:\.\d+)?)__b_(-?\d+(?:\.\d+)?)$", {"k1": 1, "b": 2}[which]).try_cast("double")


def topic_order(topic: Column) -> list[Column]:
    """Natural order: by trailing number, names without one last."""
    return [F.regexp_extract(topic, r"(\d+)$", 1).try_cast("long").asc_nulls_last(), topic.asc()]


def header_length(text: Column) -> Column:
    return F.length(F.regexp_extract(F.coalesce(text, F.lit("")), PAGE_HEADER, 0))


def strip_header(text: Column) -> Column:
    """Without the page header, unless that is all there is."""
    n = header_length(text)
    return F.when((n > 0) & (n < F.length(text)), F.substring(text, n + 1, F.length(text))).otherwise(text)


def header_anomaly(text: Column, claimed: Column) -> Column:
    """How a claimed header length disagrees with the text, or null."""
    n = header_length(text)
    return (
        F.when((claimed > 0) & (claimed >= F.length(text)), "out_of_range")
        .when((claimed > 0) & (n != claimed), "not_a_header")
        .when(header_length(strip_header(text)) > 0, "residual_header")
    )


def agent_class(label: Column) -> Column:
    return F.when(label.isin("positive", "negative"), label).otherwise("unjudged")
