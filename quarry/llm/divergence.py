"""Quality rules: distribution divergence against language references.

Each document gives two histograms, of its characters by class and of the common words of four
languages. The reference of a language is the mean of its documents' histograms. A document
fails when the Jensen-Shannon distance to its language's reference is above a limit; texts
too short for a stable histogram are not judged by it (minimum-length guards).

Nulls and odd rows: a null text has no words, so it fails the base rules (n_words < 10); an empty text
likewise. A null lang counts as the empty string. Rare languages use the reference of the whole table. Ties don't arise; repeated rows give one result row each; extra columns
are ignored by `rule_table` and passed through by `apply_rules`. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from quarry.llm import scratch
from quarry.llm.scratch import fresh, small_batches

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

# The common words of each language that the histogram counts.
COMMON = {
    "en": "the of and to a in is that it for was on with as be by are this from or an at",
    "fr": "le la les de des et un une du en que qui est dans pour par sur au pas avec il elle",
    "de": "der die das und in den von zu mit ist im für nicht ein eine dem sich auf es auch",
    "es": "el la los las de que y en un una por con para se no del al es lo como su",
}
WORD_BIN = {w.encode(): i + 1 for i, w in enumerate(sorted({w for s in COMMON.values() for w in s.split()}))}
N_WORD = len(WORD_BIN) + 1

# Character classes: 0 small letter, 1 capital, 2 digit, 3 white space, 4 sentence mark, 5 pause or quote, 6 symbol, 7 other.
N_CHAR = 8
#: JS distances (square root of the divergence in bits) above which a document fails.
MAX_CHAR, MAX_WORD = 0.30, 0.72
#: Lower limits that count when a document is beyond both of them.
BOTH_CHAR, BOTH_WORD = 0.15, 0.25
#: Code points in words, and words, below which a histogram is not compared.
MIN_CHARS, MIN_WORDS = 100, 60
#: Documents, and share of all documents, that a language needs for a reference of its own.
MIN_REFERENCE, MIN_SHARE = 30, 0.001


def _class_of(c: str) -> int:
    if c.islower():
        return 0
    if c.isupper():
        return 1
    if c.isdigit():
        return 2
    if c.isspace():
        return 3
    if c in ".!?…":
        return 4
    if c in ",;:'\"()-–—’“”«»¿¡":
        return 5
    if c.isalpha():
        return 0
    return 6 if ord(c) < 128 or not c.isprintable() else 7


_CLASS = np.full(0x110000, 7, np.uint8)
_CLASS[:0x3000] = [_class_of(chr(i)) for i in range(0x3000)]


def histograms(text: str, n_words: int) -> tuple[list[float], list[float]]:
    """Shares of the character classes, and of the common words (bin 0: any other word)."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = np.bincount(_CLASS[codes], minlength=N_CHAR)
    found = np.zeros(N_WORD)
    if n_words:
        get = WORD_BIN.get
        found = np.bincount(np.array([get(w, 0) for w in text.lower().encode("utf-8", "surrogatepass").split()], np.int64), minlength=N_WORD)
    return (chars / max(1, len(codes))).tolist(), (found / max(1, found.sum())).tolist()


def counts(text: str, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    n, dup = len(words), 0
    if "\n" in text:
        seen: set[str] = set()
        for line in text.split("\n"):
            if line in seen:
                dup += 1
            elif line.strip(SPACES):
                seen.add(line)
    repeat = 0
    if n >= 6:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
        if len(set(windows)) < len(windows):
            first: dict = {}
            hit = np.zeros(n + 1, np.int32)
            for i, w in enumerate(windows):
                j = first.setdefault(w, i)
                if j != i:
                    hit[[i, j]] += 1
                    hit[[i + 5, j + 5]] -= 1
            repeat = int((np.cumsum(hit[:n]) > 0).sum())
    return len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeat


def measure(text: str | None, every: bool = True) -> dict:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at exactly \x20 and \x09-\x0D
    h_char, h_word = histograms(text, len(words))
    out = {"n_words": len(words), "h_char": h_char, "h_word": h_word}
    if every:
        out |= dict(zip(("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), counts(text, words)))
    return out


FEATURES = "n_words long, h_char array<double>, h_word array<double>"
ALL_FEATURES = FEATURES + ", word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def features(docs: DataFrame, into: str, every: bool) -> DataFrame:
    """docs with a struct column `into` of the measures; a narrow map, nothing is shuffled."""
    kind = StructType.fromDDL(ALL_FEATURES if every else FEATURES)
    out = StructType([*docs.schema.fields, StructField(into, kind)])
    where, arrow = docs.columns.index("text"), to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(t, every) for t in b.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, arrow.field(into).type)], names=arrow.names)

    return small_batches(docs).mapInArrow(run, out)


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence in bits of two histogram columns."""
    side = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    parts = F.zip_with(p, q, lambda a, b: (side(a, (a + b) / 2) + side(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)))


def references(docs: DataFrame, min_reference: int = MIN_REFERENCE, min_share: float = MIN_SHARE) -> DataFrame:
    """One row per language with a reference of its own, and one of ref_lang null for all others.

    Languages need `min_reference` documents with words and `min_share` of them all, so there are at most
    1 / min_share + 1 rows. Each task hands on one partial sum per language.
    """
    feats = features(docs.select("lang", "text"), "f", every=False).select(F.coalesce("lang", F.lit("")).alias("lang"), "f.*").filter("n_words > 0")
    bins = [(c, i) for c, n in (("h_char", N_CHAR), ("h_word", N_WORD)) for i in range(n)]
    # whole numbers, so that no order of summation matters; as fine as 64 bits allow for so many documents
    unit = float(1 << max(1, 61 - docs.count().bit_length()))
    sums = feats.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.round(F.col(c)[i] * unit).cast("long")).alias(f"{c}_{i}") for c, i in bins))
    names = ["n", *(f"{c}_{i}" for c, i in bins)]
    sums = scratch.table(sums)
    whole = sums.agg(*(F.sum(x).alias(x) for x in names)).select(F.lit(None).cast("string").alias("lang"), *names)
    total = sums.agg(F.sum("n")).collect()[0][0] or 0
    own = sums.filter((F.col("n") >= min_reference) & (F.col("n") >= min_share * total))
    pack = lambda c, n: F.array(*[F.col(f"{c}_{i}") / unit / F.col("n") for i in range(n)]).alias(f"ref_{c}")
    return own.unionByName(whole).filter("n > 0").select(F.col("lang").alias("ref_lang"), pack("h_char", N_CHAR), pack("h_word", N_WORD))


def judged(docs: DataFrame, into: str, max_char: float = MAX_CHAR, max_word: float = MAX_WORD, both_char: float = BOTH_CHAR, both_word: float = BOTH_WORD, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, **reference: float) -> DataFrame:
    """docs with a struct `into`: the measures, both distances, base_failed and kept.

    Two narrow passes over the texts: one sums the references, one judges. The references have a
    proven bound (see `references`), so they are broadcast and the texts are never shuffled.
    """
    refs = references(docs, **reference).collect()
    known = {r["ref_lang"]: (r["ref_h_char"], r["ref_h_word"]) for r in refs}
    other = known.pop(None, ([1.0 / N_CHAR] * N_CHAR, [1.0 / N_WORD] * N_WORD))
    spark = docs.sparkSession
    table = spark.createDataFrame([("own", k, *v) for k, v in known.items()] + [("rest", None, *other)], "kind string, ref_lang string, ref_h_char array<double>, ref_h_word array<double>")
    f = fresh(docs, "f")
    at, kind = fresh(docs, "ref_at"), fresh(docs, "ref_kind")
    cols = {c: fresh(docs, c) for c in ("ref_h_char", "ref_h_word")}
    own = F.coalesce("lang", F.lit(""))
    at_of = F.when(own.isin(list(known)), own) if known else F.lit(None).cast("string")
    d = features(docs, f, every=True).withColumn(at, at_of)
    refs_df = F.broadcast(table.select(F.col("ref_lang").alias(kind), *(F.col(c).alias(n) for c, n in cols.items())))
    d = d.join(refs_df, d[at].eqNullSafe(refs_df[kind]))
    char, word = js_distance(F.col(f)["h_char"], F.col(cols["ref_h_char"])), js_distance(F.col(f)["h_word"], F.col(cols["ref_h_word"]))
    d = d.withColumn(into, F.struct(F.col(f), char.alias("js_char"), word.alias("js_word")))
    m, r = F.col(into)["%s" % f], F.col(into)
    base = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    chars_ok, words_ok = m["word_chars"] >= min_chars, m["n_words"] >= min_words
    both = chars_ok & words_ok & (r["js_char"] > both_char) & (r["js_word"] > both_word)
    far = (chars_ok & (r["js_char"] > max_char)) | (words_ok & (r["js_word"] > max_word)) | both
    found = F.struct(*(m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), r["js_char"].alias("js_char"), r["js_word"].alias("js_word"), base.alias("base_failed"), (~base & ~far).alias("kept"))
    return d.withColumn(into, found).select(*(F.col(f"`{c}`") for c in docs.columns), into)


def rule_table(docs: DataFrame, **limits: float) -> DataFrame:
    """The report: measures and verdict, one row per document."""
    d = judged(docs.select("doc_id", "lang", "text"), "found", **limits)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return d.select("doc_id", *(F.col("found")[c].alias(c) for c in names), *(F.round(F.col("found")[c], 6).alias(c) for c in ("js_char", "js_word")))


def apply_rules(docs: DataFrame, **limits: float) -> DataFrame:
    """The documents that pass, with all their columns."""
    found = fresh(docs, "found")
    return judged(docs, found, **limits).filter(F.col(found)["kept"]).drop(found)


def oracle() -> str:
    """The same report in DuckDB. Character classes agree for Latin letters, digits and the marks listed."""
    words = ", ".join(f"'{w.decode()}'" for w in sorted(WORD_BIN, key=WORD_BIN.get))
    space = r"\x20\x09-\x0D"
    kind = r"""CASE WHEN regexp_matches(c, '^\p{Ll}$') THEN 0 WHEN regexp_matches(c, '^\p{Lu}$') THEN 1 WHEN regexp_matches(c, '^\d$') THEN 2 WHEN regexp_matches(c, '^\s$') THEN 3
      WHEN c IN ('.', '!', '?', '…') THEN 4 WHEN c IN (',', ';', ':', '''', '"', '(', ')', '-', '–', '—', '’', '“', '”', '«', '»', '¿', '¡') THEN 5
      WHEN regexp_matches(c, '^\p{L}$') THEN 0 WHEN ascii(c) < 128 THEN 6 ELSE 7 END"""

    def histogram(items: str, n: int, name: str) -> str:
        return f"""{name}n AS (SELECT doc_id, bin, count(*) AS k FROM {items} GROUP BY 1, 2), {name} AS (SELECT d.doc_id, d.lang, b.bin, coalesce(x.k / sum(x.k) OVER (PARTITION BY d.doc_id), 0.0) AS p
          FROM (SELECT doc_id, lang FROM m WHERE n_words > 0) d CROSS JOIN (SELECT unnest(range(0, {n})) AS bin) b LEFT JOIN {name}n x ON x.doc_id = d.doc_id AND x.bin = b.bin)"""

    def distance(name: str) -> str:
        half = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / ((p + q) / 2)) ELSE 0 END"
        return f"""{name}r AS (SELECT lang, bin, avg(p) AS q FROM {name} GROUP BY 1, 2), {name}a AS (SELECT bin, avg(p) AS q FROM {name} GROUP BY 1),
          {name}q AS (SELECT h.doc_id, h.p, CASE WHEN o.lang IS NOT NULL THEN r.q ELSE a.q END AS q FROM {name} h LEFT JOIN own o ON o.lang = h.lang
            LEFT JOIN {name}r r ON r.lang = h.lang AND r.bin = h.bin JOIN {name}a a ON a.bin = h.bin),
          {name}d AS (SELECT doc_id, sqrt(greatest(0, sum(({half('p')} + {half('q')}) / 2))) AS d FROM {name}q GROUP BY 1)"""

    return rf"""
    WITH t AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^{space}]+') AS ws FROM t),
    g AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) AS win FROM w WHERE len(ws) >= 5),
    v AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g), (SELECT unnest(range(0, 5)) AS k) WHERE c > 1 GROUP BY 1),
    li AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^{space}]') GROUP BY 1),
    m AS (SELECT w.doc_id, w.lang, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
          coalesce(li.n, 0) AS n_dup_lines, coalesce(v.n, 0) AS n_repeat_words FROM w LEFT JOIN v ON v.doc_id = w.doc_id LEFT JOIN li ON li.doc_id = w.doc_id),
    own AS (SELECT lang FROM m WHERE n_words > 0 GROUP BY 1 HAVING count(*) >= {MIN_REFERENCE} AND count(*) >= {MIN_SHARE} * (SELECT count(*) FROM m WHERE n_words > 0)),
    ci AS (SELECT doc_id, {kind} AS bin FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM t)),
    wi AS (SELECT doc_id, coalesce(list_position([{words}], x), 0) AS bin FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^{space}]+')) AS x FROM t)),
    {histogram('ci', N_CHAR, 'hc')}, {histogram('wi', N_WORD, 'hw')}, {distance('hc')}, {distance('hw')},
    f AS (SELECT m.*, hcd.d AS jc, hwd.d AS jw, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m JOIN hcd ON hcd.doc_id = m.doc_id JOIN hwd ON hwd.doc_id = m.doc_id)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND NOT ((word_chars >= {MIN_CHARS} AND jc > {MAX_CHAR}) OR (n_words >= {MIN_WORDS} AND jw > {MAX_WORD})
             OR (word_chars >= {MIN_CHARS} AND n_words >= {MIN_WORDS} AND jc > {BOTH_CHAR} AND jw > {BOTH_WORD})) AS kept, round(jc, 6) AS js_char, round(jw, 6) AS js_word FROM f"""
