"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Texts become sequences of words in which numbers, names (capitalised words inside a sentence) and units (after a number)
are typed placeholders. Windows of 8 such tokens are hashed by doubling (pairs, fours, eights) and joined with the
windows of the benchmark. Where a document and an item share windows in one alignment, their placeholders' values
must correspond one to one: then the passage is the item, word for word or with other numbers and names put in.

A document's windows first pass a bit table of the benchmark's hashes, of a fixed 512 KB, inside the row; only windows that
it lets through (all true ones, few others) become rows and meet the join. Items are matched with and without names
masked, so that a copy in capitals or small letters is found as well. Items in which a name also begins a sentence, or has two words, or which
have number words, are matched a second time with names masked there too, as one, and number words as numbers, in the item and in the
documents; what only that finds is added.

Items of fewer than 8 tokens, or whose windows all hold fewer than 4 plain words, are matched as wholes: the item's whole sequence of
tokens, nothing masked, is one window of its own length. Here operators are tokens too, and letters of scripts without spaces
are tokens each. A window of any length is two of a power of two that overlap.

Nulls and odd rows: null and empty texts, and items without any token, match nothing. Rows that repeat a (doc_id, text) count as one
document in the report, and all go in `apply_decontamination`. Null ids are ids like others. Extra columns are
ignored by the report and passed through by `apply_decontamination`. An item that matches in several ways is reported once, the first way of: names as
written, names masked everywhere, whole item. Empty tables give empty results; with an empty benchmark all documents stay.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.scratch import fresh, without

WINDOW, PLAIN = 8, 4
#: Share of an item's windows that a document must hold.
COVERAGE = 0.5
#: The bit table: 2**22 bits in 64-bit words, two bits per hash.
TABLE_BITS = 22

# Units, as written after a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg lb oz t ml l s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters gram grams kilogram kilograms liter liters litre litres mile miles foot feet inch inches "
    "pound pounds ounce ounces dollar dollars usd eur euro euros cent cents percent degree degrees w kw v hz kmh mph"
).split()

MARK = "\u0001"
_NAME = r"(?<=[\p{L}\p{N},;:] )\p{Lu}\p{Ll}+"
_TOKEN = MARK + r"?\p{L}+|[0-9]+(?:[.,][0-9]+)*"
#: A capitalised word elsewhere, as at the start of a sentence or after a quote: a name if it is one elsewhere in the text.
FIRST = "\u0002"
_FIRST = r"(?<![\p{L}\p{N}" + MARK + r"])\p{Lu}\p{Ll}+"


def tokens(text: Column, names: bool = True) -> Column:
    """Lower-case words and numbers; a name begins with MARK."""
    marked = F.regexp_replace(text, _NAME, MARK + "$0") if names else text
    return F.regexp_extract_all(F.lower(marked), F.lit(_TOKEN), F.lit(0))


# Number words.
NUMBER_WORDS = (
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half third quarter twice thrice"
).split()
#: Stands between the words of a name, or of a number.
JOIN = "\u0003"
_WIDE = rf"{FIRST}?(?:{MARK}?\p{{L}}+(?:{JOIN}{MARK}?\p{{L}}+)*)|[0-9]+(?:[.,][0-9]+)*"


def wide_tokens(text: Column) -> Column:
    """tokens(), with a name of the text masked wherever it begins a sentence as well, the words of a name or number as one, and number words as numbers.

    A number word begins with 0, as a name begins with MARK.
    """
    numbers = "|".join(NUMBER_WORDS)
    marked = F.regexp_replace(F.regexp_replace(text, _NAME, MARK + "$0"), _FIRST, FIRST + "$0")
    marked = F.regexp_replace(marked, rf"({MARK}\p{{Lu}}\p{{Ll}}+) (?={MARK})", f"$1{JOIN}")
    marked = F.regexp_replace(marked, rf"(?i)(?<!\p{{L}})({numbers})[ -](?=(?:{numbers})(?!\p{{L}}))", f"$1{JOIN}")
    found = F.regexp_extract_all(F.lower(marked), F.lit(_WIDE), F.lit(0))
    names = F.array_distinct(F.filter(found, lambda t: t.startswith(MARK)))

    def one(t: Column) -> Column:
        bare = F.ltrim(t, F.lit(FIRST))
        name = F.concat(F.lit(MARK), bare)
        named = F.when(t.startswith(FIRST) & F.array_contains(names, name), name).otherwise(bare)
        return F.when(F.split_part(bare, F.lit(JOIN), F.lit(1)).isin(NUMBER_WORDS), F.concat(F.lit("0"), bare)).otherwise(named)

    return F.transform(found, one)


#: Scripts that put no spaces between words.
_DENSE = "\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}\\p{IsLao}\\p{IsKhmer}\\p{IsMyanmar}\\p{IsTibetan}"
_EXACT = rf"[\p{{L}}&&[{_DENSE}]]|[\p{{L}}&&[^{_DENSE}]]+|[0-9]+(?:[.,][0-9]+)*|\p{{S}}|[-*/%]"


def exact_tokens(text: Column) -> Column:
    """Lower-case words, numbers and operators."""
    return F.regexp_extract_all(F.lower(text), F.lit(_EXACT), F.lit(0))


def canonical(toks: Column) -> Column:
    """Tokens with '#', '@' or '%' for a number, name or unit."""

    def one(t: Column, i: Column) -> Column:
        after_number = F.coalesce(F.get(toks, i - 1).between("0", "9~"), F.lit(False))
        return F.when(t < ":", F.when(t < "\u0002", "@").otherwise("#")).when(t.isin(UNITS) & after_number, "%").otherwise(t)

    return F.transform(toks, one)


def _doubled(h: Column, step: int) -> Column:
    return F.zip_with(h, F.slice(h, F.lit(step + 1), F.greatest(F.size(h) - step, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def _with_hashes(df: DataFrame, toks: str, into: str) -> DataFrame:
    """Adds `into`, the hash of the window at each position (junk in the last 7)."""
    df = df.withColumn(f"{into}1", F.transform(canonical(F.col(toks)), lambda c: F.xxhash64(c)))
    for a, b in ((1, 2), (2, 4), (4, 8)):
        df = df.withColumn(f"{into}{b}", _doubled(F.col(f"{into}{a}"), a))
    return df.withColumnRenamed(f"{into}8", into).drop(f"{into}1", f"{into}2", f"{into}4")


def benchmark_windows(bench: DataFrame, masked: Callable[[Column], Column] = tokens) -> DataFrame:
    """item_id, pos, h, words and kinds of each window, with and without names masked, and the item's number of windows."""
    b = bench.select("item_id", "text").filter("text IS NOT NULL").dropDuplicates()
    both = b.select("item_id", F.explode(F.array(masked(F.col("text")), tokens(F.col("text"), names=False))).alias("toks"))
    both = _with_hashes(both.filter(F.size("toks") >= WINDOW), "toks", "h").withColumn("canon", canonical(F.col("toks")))
    at = both.select("item_id", "toks", "canon", "h", F.explode(F.sequence(F.lit(0), F.size("toks") - WINDOW)).alias("pos"))
    w = at.select(
        "item_id",
        "pos",
        F.get("h", F.col("pos")).alias("h"),
        F.slice("toks", F.col("pos") + 1, WINDOW).alias("words"),
        F.transform(F.slice("canon", F.col("pos") + 1, WINDOW), lambda c: F.when(c.isin("#", "@", "%"), c).otherwise("")).alias("kinds"),
    )
    w = w.filter(F.size(F.filter("kinds", lambda k: k == "")) >= PLAIN).dropDuplicates(["item_id", "pos", "h", "words"])
    n = w.groupBy("item_id").agg(F.countDistinct("pos").alias("item_windows"))
    return w.join(n, w["item_id"].eqNullSafe(n["item_id"])).drop(n["item_id"])


def _places(h: Column) -> list[Column]:
    """The two bits of a hash in the table."""
    mask = (1 << TABLE_BITS) - 1
    return [h.bitwiseAND(F.lit(mask)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(mask))]


def bit_table(windows: DataFrame) -> DataFrame:
    """All hashes' bits as one row, an array of 2**16 longs: its size doesn't depend on the data."""
    bits = windows.select(F.explode(F.array(*_places(F.col("h")))).alias("p"))
    held = bits.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))).alias("v"))
    every = windows.sparkSession.range(1 << (TABLE_BITS - 6)).select(F.col("id").alias("w"))
    filled = every.join(held, "w", "left").select("w", F.coalesce("v", F.lit(0).cast("long")).alias("v"))
    return filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "v"))), lambda x: x["v"]).alias("bits"))


def matches(docs: DataFrame, bench: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, key (of id and text), item_id and how they match, one row per contaminated document and item."""
    found = [window_matches(docs, bench, coverage)]
    wide = bench.filter(wide_tokens(F.col("text")) != tokens(F.col("text"))).select("item_id").distinct()
    if wide.head(1):
        items = bench.select("item_id", "text").join(wide.select(F.col("item_id").alias("_item")), F.col("item_id").eqNullSafe(F.col("_item")), "left_semi")
        found.append(window_matches(docs, items, coverage, wide_tokens))
    if (short := whole_items(bench)).head(1):
        found.append(whole_matches(docs, short))
    return _first_of(found)


def whole_items(bench: DataFrame) -> DataFrame:
    """item_id and toks of the items' texts that have no window to match by."""
    plain = lambda toks: F.transform(canonical(toks), lambda c: ~c.isin("#", "@", "%"))
    b = bench.select("item_id", "text").filter("text IS NOT NULL").dropDuplicates()
    # names masked leave no more plain words than names that stand
    b = b.select("item_id", exact_tokens(F.col("text")).alias("toks"), plain(tokens(F.col("text"), names=False)).alias("plain"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("plain") - WINDOW, F.lit(0)))
    windowed = (F.size("plain") >= WINDOW) & F.exists(starts, lambda i: F.size(F.filter(F.slice("plain", i + 1, WINDOW), lambda p: p)) >= PLAIN)
    return b.filter((F.size("toks") > 0) & ~windowed).select("item_id", "toks")


def _power(n: int) -> int:
    """The largest power of two within n."""
    return 1 << (n.bit_length() - 1)


def _with_powers(df: DataFrame, most: int) -> DataFrame:
    """Adds s1, s2, s4 ... up to `most`: the hashes of the windows of so many of toks at each position."""
    df = df.withColumn("s1", F.transform("toks", lambda t: F.xxhash64(t)))
    k = 1
    while 2 * k <= most:
        df = df.withColumn(f"s{2 * k}", _doubled(F.col(f"s{k}"), k))
        k *= 2
    return df


def _whole_hashes(lengths: list[int]) -> list[Column]:
    """Per power of two, the hashes of the windows of these lengths; one expression however many lengths there are."""
    out = []
    for s in sorted({_power(n) for n in lengths}):
        here = F.filter(F.lit([n for n in lengths if _power(n) == s]), lambda n: n <= F.size("toks"))
        window = lambda i, n, s=s: F.xxhash64(n.cast("int"), F.get(f"s{s}", i), F.get(f"s{s}", (i + n - s).cast("int")))
        out.append(F.flatten(F.transform(here, lambda n: F.transform(F.sequence(F.lit(0), (F.size("toks") - n).cast("int")), lambda i: window(i, n)))))
    return out


def whole_matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The matches of whole items (item_id, toks), word for word."""
    lengths = sorted(r["n"] for r in items.select(F.size("toks").alias("n")).distinct().collect())
    b = _with_powers(items, lengths[-1])
    n = F.size("toks")
    own = F.coalesce(*(F.when(n.between(s, 2 * s - 1), F.xxhash64(n, F.get(f"s{s}", F.lit(0)), F.get(f"s{s}", n - s))) for s in sorted({_power(k) for k in lengths})))
    b = b.select("item_id", own.alias("h")).distinct()
    d = _with_powers(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), exact_tokens(F.col("text")).alias("toks")), lengths[-1])
    d = d.withColumn("bits", bit_table(b).scalar())
    d = d.withColumn("at", F.array_distinct(F.filter(F.flatten(F.array(*_whole_hashes(lengths))), _held)))
    found = d.select("doc_id", "key", F.explode_outer("at").alias("h")).filter("h IS NOT NULL")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    return found.join(b, "h").select("doc_id", "key", "item_id", one.alias("windows"), one.alias("item_windows"), none.alias("slots"), none.alias("changed_slots")).distinct()


def _held(h: Column) -> Column:
    """Whether the table `bits` has both bits of a hash."""
    a, b = (F.getbit(F.get("bits", F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1 for p in _places(h))
    return a & b


def _first_of(found: list[DataFrame]) -> DataFrame:
    """The union, and of the rows of a document and item the one of the earliest table."""
    if len(found) == 1:
        return found[0]
    every = reduce(DataFrame.unionByName, (f.withColumn("_n", F.lit(n)) for n, f in enumerate(found)))
    how = F.min_by(F.struct("windows", "item_windows", "slots", "changed_slots"), "_n").alias("how")
    return every.groupBy("doc_id", "key", "item_id").agg(how).select("doc_id", "key", "item_id", "how.*")


def window_matches(docs: DataFrame, bench: DataFrame, coverage: float, masked: Callable[[Column], Column] = tokens) -> DataFrame:
    """The matches by windows."""
    windows = benchmark_windows(bench, masked)
    d = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), masked(F.col("text")).alias("toks"))
    d = _with_hashes(d, "toks", "h")
    table = bit_table(windows).scalar()
    starts = F.when(F.size("toks") >= WINDOW, F.sequence(F.lit(0), F.size("toks") - WINDOW)).otherwise(F.array().cast("array<int>"))

    d = d.withColumn("bits", table).withColumn("at", F.filter(starts, lambda i: _held(F.get("h", i))))
    # No filter on "at" and no inner explode: Catalyst would push either below the projections, and evaluate all of them in one expression.
    found = d.select("doc_id", "key", F.explode_outer(F.transform("at", lambda i: F.struct(i.alias("pos"), F.get("h", i).alias("h"), F.slice("toks", i + 1, WINDOW).alias("words")))).alias("f"))
    found = found.filter("f IS NOT NULL").select("doc_id", "key", F.col("f.pos").alias("d_pos"), F.col("f.h").alias("h"), F.col("f.words").alias("d_words"))
    plain = lambda t: F.ltrim(t, F.lit(MARK))
    slots = F.filter(
        F.transform(F.arrays_zip("kinds", "words", "d_words"), lambda z: F.struct(z["kinds"].alias("k"), plain(z["words"]).alias("b"), plain(z["d_words"]).alias("d"))),
        lambda s: s["k"] != "",
    )
    hits = found.join(windows, "h").select("doc_id", "key", "item_id", "item_windows", (F.col("d_pos") - F.col("pos")).alias("shift"), "pos", slots.alias("slots"))
    one = hits.groupBy("doc_id", "key", "item_id", "item_windows", "shift").agg(F.collect_set("pos").alias("places"), F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots"))
    distinct = lambda *names: F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(*(s[n].alias(n) for n in names)))))
    sound = one.filter((distinct("k", "b") == F.size("slots")) & (distinct("k", "d") == F.size("slots")))
    whole = sound.groupBy("doc_id", "key", "item_id", "item_windows").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("windows"), F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots"))
    changed = F.size(F.filter("slots", lambda s: s["b"] != s["d"])).cast("long")
    return whole.filter(F.col("windows") >= F.greatest(F.lit(1.0), coverage * F.col("item_windows"))).select("doc_id", "key", "item_id", "windows", "item_windows", F.size("slots").cast("long").alias("slots"), changed.alias("changed_slots"))


def leaks(docs: DataFrame, bench: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The report: contaminated documents with the items they hold."""
    kind = F.when(F.col("changed_slots") > 0, "reparameterised").otherwise("verbatim")
    return matches(docs, bench, coverage).select("doc_id", "item_id", "windows", "item_windows", "slots", "changed_slots", kind.alias("kind")).distinct()


def apply_decontamination(docs: DataFrame, bench: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    key = fresh(docs, "_key")
    bad = matches(docs, bench, coverage).select(F.col("key").alias(key)).distinct()
    return without(docs.withColumn(key, F.xxhash64("doc_id", "text")), bad, key).drop(key)


def oracle(coverage: float = COVERAGE) -> str:
    """The same report in DuckDB, by a join on the windows' words instead of hashes."""
    units = ", ".join(f"'{u}'" for u in UNITS)

    def toks(t: str) -> str:
        return f"regexp_extract_all(lower({t}), chr(1) || '?\\p{{L}}+|[0-9]+(?:[.,][0-9]+)*')"

    once = r"regexp_replace({}, '([\p{{L}}\p{{N}},;:] )(\p{{Lu}}\p{{Ll}}+)', '\1' || chr(1) || '\2', 'g')"
    named = once.format(once.format("text"))
    canon = f"list_transform(range(1, len(toks) + 1), lambda i: CASE WHEN toks[i] < ':' THEN CASE WHEN toks[i] < chr(2) THEN '@' ELSE '#' END WHEN toks[i] IN ({units}) AND i > 1 AND toks[i - 1] BETWEEN '0' AND '9~' THEN '%' ELSE toks[i] END)"
    cut = f"list_transform(range(0, len(toks) - {WINDOW - 1}), lambda i: {{'pos': i, 'words': toks[i + 1 : i + {WINDOW}], 'tpl': canon[i + 1 : i + {WINDOW}]}})"
    return f"""
    WITH b AS (SELECT DISTINCT item_id, unnest([{toks(named)}, {toks('text')}]) AS toks FROM benchmark WHERE text IS NOT NULL),
    bc AS (SELECT item_id, toks, {canon} AS canon FROM b WHERE len(toks) >= {WINDOW}),
    bw AS (SELECT item_id, unnest({cut}) AS c FROM bc),
    w AS (SELECT DISTINCT item_id, c.pos AS pos, c.words AS words, c.tpl AS tpl FROM bw WHERE len(list_filter(c.tpl, lambda c: c NOT IN ('#', '@', '%'))) >= {PLAIN}),
    n AS (SELECT item_id, count(DISTINCT pos) AS item_windows FROM w GROUP BY item_id),
    d AS (SELECT doc_id, text, {toks(named)} AS toks FROM documents WHERE text IS NOT NULL),
    dc AS (SELECT doc_id, text, toks, {canon} AS canon FROM d WHERE len(toks) >= {WINDOW}),
    dw AS (SELECT doc_id, hash(text) AS text, unnest({cut}) AS c FROM dc),
    v AS (SELECT doc_id, text, c.pos AS pos, c.words AS words, c.tpl AS tpl FROM dw),
    m AS (SELECT doc_id, text, w.item_id, item_windows, v.pos - w.pos AS shift, w.pos,
          list_transform(list_filter(range(1, {WINDOW + 1}), lambda i: w.tpl[i] IN ('#', '@', '%')),
                         lambda i: {{'k': w.tpl[i], 'b': ltrim(w.words[i], chr(1)), 'd': ltrim(v.words[i], chr(1))}}) AS slots
          FROM v JOIN w ON v.tpl = w.tpl JOIN n ON w.item_id = n.item_id),
    g AS (SELECT doc_id, text, item_id, item_windows, shift, list(DISTINCT pos) AS places, list_distinct(flatten(list(slots))) AS slots FROM m GROUP BY ALL),
    s AS (SELECT * FROM g WHERE len(list_distinct(list_transform(slots, lambda s: {{'k': s.k, 'b': s.b}}))) = len(slots)
          AND len(list_distinct(list_transform(slots, lambda s: {{'k': s.k, 'd': s.d}}))) = len(slots)),
    t AS (SELECT doc_id, text, item_id, item_windows, CAST(len(list_distinct(flatten(list(places)))) AS BIGINT) AS windows, list_distinct(flatten(list(slots))) AS slots
          FROM s GROUP BY doc_id, text, item_id, item_windows)
    SELECT DISTINCT doc_id, item_id, windows, item_windows, CAST(len(slots) AS BIGINT) AS slots,
           CAST(len(list_filter(slots, lambda s: s.b <> s.d)) AS BIGINT) AS changed_slots,
           CASE WHEN len(list_filter(slots, lambda s: s.b <> s.d)) > 0 THEN 'reparameterised' ELSE 'verbatim' END AS kind
    FROM t WHERE windows >= greatest(1.0, {coverage} * item_windows)"""
