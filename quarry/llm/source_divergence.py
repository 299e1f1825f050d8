"""Source divergence audit: how far the term distributions of a language's sources are apart, and which terms make a source stand out.

Terms are maximal runs of ASCII letters and non-ASCII characters, A-Z in lower case. A language keeps the terms in at least
`min_docs` of its documents. Three passes: (1) every task counts document frequencies of (language, term) in a count-min
sketch; the merged sketch never underestimates, so a term whose estimate is below `min_docs` can't be kept. (2) Tasks count
occurrences per (language, source, term) and documents per (language, term), leave out what the sketch rules out, and the rest is shuffled and
summed exactly. (3) Sources are compared over the terms that both hold, by a join on the term; terms that only one holds come from a histogram
of its counts, and terms that neither holds from their number, so that no term-by-source table is ever made.

All numbers are whole: p = 1 + floor(10^9 (count + 1) / (N + V)), f = floor((p - q)^2 / q).

Nulls and odd rows: null text, lang and source count as ''. A null or repeated doc_id is a document like others; repeated rows count as often as they are
there. Ties in value are ranked by item in the order of its UTF-8 bytes. A group without terms has count 0 for every kept term; a language
that keeps none gives pairs of value 0 and no terms. A very long text is counted whole; the worker hands on its counts whenever they
reach a bound in bytes. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import scratch, vectors
from quarry.llm.scratch import small_batches

MIN_DOCS = 3
TOP_TERMS = 200
#: Rows of the sketch; the width follows the number of documents up to 2**22, so it has 16 MB at most. A fuller sketch lets more through, never less.
DEPTH, MIN_BITS, MAX_BITS = 4, 16, 22
#: Bytes of counts, roughly, that a worker holds before it hands them on.
HELD = 64 << 20
#: Bytes of a counter's entry beside those of the term.
ENTRY = 120

_SPACE, _A, _SMALL = b" "[0], range(0x41, 0x5B), range(0x61, 0x7B)
FOLD = bytes(b + 32 if b in _A else b if b in _SMALL or b >= 0x80 else _SPACE for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8; no byte of a longer character is a space."""
    return text.translate(FOLD).split()


def cells(lang: str, found: list[bytes], bits: int) -> np.ndarray:
    """Place of each term in each row of the sketch, as (DEPTH, terms) places in the whole."""
    h = pd.util.hash_array(np.array([*found, b""], object)[:-1], hash_key=hashlib.md5(lang.encode()).hexdigest()[:16])
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([((h + np.uint64(k) * step) & np.uint64((1 << bits) - 1)).astype(np.int64) + (k << bits) for k in range(DEPTH)])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, bytes]]:
    for b in batches:
        yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist())


def sketched(docs: DataFrame, bits: int) -> np.ndarray:
    """Count-min sketch of the document frequencies of (lang, term), each count held at 255."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen, size = np.zeros(DEPTH << bits, np.uint8), defaultdict(Counter), 0

        def pour() -> None:
            for lang, df in seen.items():
                n = np.fromiter(df.values(), np.int64, len(df))
                for at in cells(lang, list(df), bits):
                    lo = at[0] >> bits << bits if len(at) else 0
                    part = sketch[lo : lo + (1 << bits)]
                    part[:] = np.minimum(part + np.bincount(at - lo, weights=n, minlength=1 << bits), 255)
            seen.clear()

        for lang, _, text in _rows(batches):
            df = seen[lang]
            had, own = len(df), set(terms(text))
            df.update(own)
            size += (len(df) - had) * ENTRY + len(text)
            if size > HELD:
                pour()
                size = 0
        pour()
        yield from vectors.pieces(sketch)

    return vectors.total(docs.mapInArrow(run, vectors.SCHEMA), vectors.splits(docs), DEPTH << bits, "uint8", 255)


PARTIAL = "lang string, source string, term string, n long, docs long"


def partials(docs: DataFrame, sketch: np.ndarray, bits: int, min_docs: int) -> DataFrame:
    """Occurrences of each (lang, source, term) within a task, for terms that the sketch lets through; with one of a term's sources go the documents of the language."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.frombuffer(shared.value, np.uint8)
        counts: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
        seen: dict[str, Counter] = defaultdict(Counter)
        size = 0

        def pour() -> Iterator[pa.RecordBatch]:
            for lang, df in seen.items():
                found = list(df)
                least = sketch[cells(lang, found, bits)].min(axis=0) if found else np.zeros(0)
                left = {found[i]: df[found[i]] for i in np.flatnonzero(least >= min_docs)}
                for source, n in counts[lang].items():
                    if keep := [t for t in n if t in left]:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(keep)), pa.array([source] * len(keep)), pa.array(keep, pa.binary()).cast(pa.string()), pa.array(list(map(n.__getitem__, keep)), pa.int64()), pa.array(list(map(left.__getitem__, keep)), pa.int64())],
                            names=["lang", "source", "term", "n", "docs"],
                        )
                        left.update(dict.fromkeys(keep, 0))  # the language's documents go along once
            seen.clear()
            counts.clear()

        for lang, source, text in _rows(batches):
            n, df, found = counts[lang][source], seen[lang], terms(text)
            had = len(n)
            n.update(found)
            df.update(set(found))
            size += 2 * (len(n) - had) * ENTRY + len(text)
            if size > HELD:
                yield from pour()
                size = 0
        yield from pour()

    return docs.mapInArrow(run, PARTIAL)


def _share(n: Column, whole: Column) -> Column:
    """1 + floor(10^9 (n + 1) / whole), exactly for any count."""
    unit = F.lit(1_000_000_000).cast("long")
    wide = F.call_function("div", (n + 1).cast("decimal(20,0)") * unit.cast("decimal(10,0)"), whole.cast("decimal(20,0)"))
    return 1 + F.when(n < 9_000_000_000, F.call_function("div", unit * (n + 1), whole)).otherwise(wide)


def _far(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, bits: int | None = None) -> DataFrame:
    """lang, source, part, item, value, rank: all other sources (part `pair`) and the `top_terms` terms (part `term`) of each (lang, source)."""
    docs = small_batches(docs).select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    if bits is None:
        bits = min(MAX_BITS, max(MIN_BITS, (16 * docs.count()).bit_length()))
    partial = partials(docs, sketched(docs, bits), bits, min_docs)
    # one exchange by (lang, term) serves the exact sums, the languages' totals and the documents of a term
    counted = partial.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    postings = counted.withColumns({"total": F.sum("n").over(term), "docs": F.sum("docs").over(term)}).filter(F.col("docs") >= min_docs).drop("docs")
    postings = scratch.table(postings.select("lang", "source", "term", "n", "total"))

    sums = postings.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("held"))
    kept = postings.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_size"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0)
    groups = scratch.table(groups.withColumn("none", F.when(F.col("v") > 0, _share(F.lit(0).cast("long"), F.col("size") + F.col("v")))))

    each = postings.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("size") + F.col("v")))
    return _pairs(each, groups).unionByName(_terms(each, top_terms))


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _terms(each: DataFrame, top_terms: int) -> DataFrame:
    q = _share(F.col("total"), F.col("lang_size") + F.col("v"))
    rows = each.withColumn("q", q).filter("p > q").select("lang", "source", F.col("term").alias("item"), _far(F.col("p"), F.col("q")).alias("value"))
    return _ranked(rows, "term").filter(F.col("rank") <= top_terms)


def _pairs(each: DataFrame, groups: DataFrame) -> DataFrame:
    """Sums over all kept terms, from the terms that both sources hold, the counts of either, and the number of kept terms."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("other_none"), F.col("held").alias("other_held"))
    p, none, far = F.col("p"), F.col("none"), F.col("other_none")

    # as if no term were held by both: terms of neither, then those of one or the other
    both_none = groups.join(other, "lang").filter("source <> item").select("lang", "source", "item", F.coalesce(_far(none, far) * (F.col("v") - F.col("held") - F.col("other_held")), F.lit(0)).alias("value"))
    counts = each.groupBy("lang", "source", "p", "none").agg(F.count(F.lit(1)).alias("k"))
    by_count = counts.join(other, "lang").filter("source <> item").groupBy("lang", "source", "item")
    by_count = by_count.agg(F.sum(F.col("k") * _far(p, far)).alias("ours"), F.sum(F.col("k") * _far(far, p)).alias("theirs"))

    # what that misses for terms that both hold
    a, b = (each.select("lang", "term", *(F.col(c).alias(f"{c}_{x}") for c in ("source", "p", "none"))) for x in "ab")
    pa_, pb, na, nb = (F.col(c) for c in ("p_a", "p_b", "none_a", "none_b"))
    joint = a.join(b, ["lang", "term"]).filter("source_a < source_b").groupBy("lang", "source_a", "source_b")
    joint = joint.agg(F.sum(_far(pa_, pb) - _far(pa_, nb) - _far(na, pb) + _far(na, nb)).alias("ours"), F.sum(_far(pb, pa_) - _far(pb, na) - _far(nb, pa_) + _far(nb, na)).alias("theirs"))
    joint = joint.withColumnsRenamed({"source_a": "source", "source_b": "item"})

    def both_ways(rows: DataFrame) -> DataFrame:
        return rows.select("lang", F.inline(F.array(F.struct("source", "item", F.col("ours").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("theirs").alias("value")))))

    parts = both_none.unionByName(both_ways(by_count)).unionByName(both_ways(joint))
    return _ranked(parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pair")


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(total) AS size FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY 1, 2, 3),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS size FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (s.size + v.v) AS BIGINT) AS p, CAST(1 + (1000000000 * (k.total + 1)) // (v.size + v.v) AS BIGINT) AS lang_p
      FROM s JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
every AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
term AS (SELECT lang, source, term AS item, ((p - lang_p) * (p - lang_p)) // lang_p AS value FROM p WHERE n > 0 AND p > lang_p),
r AS (SELECT lang, source, 'pair' AS part, item, value FROM every UNION ALL SELECT lang, source, 'term', item, value FROM term),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
