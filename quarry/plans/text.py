"""Queries of text, chunking and string operators (section T)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.fixtures import Views
from quarry.functions import chunking
from quarry.functions import text as T
from quarry.registry import query

STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
FLAT = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def tokens_sql(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[A-Za-z0-9]+(?:[.,:/-][A-Za-z0-9]+)*'), lambda t: length(t) > 1 AND t NOT IN ({STOP})))"


def numbers_sql(x: str) -> str:
    return rf"list_distinct(regexp_extract_all({x}, '\b\d[\d.,:/%-]*'))"


@query("t01_token_estimate", r"SELECT doc_id, CAST(len(regexp_extract_all(contents, '\S+')) AS BIGINT) AS words, CAST(round_even(len(regexp_extract_all(contents, '\S+')) * 1.3::DOUBLE, 0) AS BIGINT) AS tokens FROM corpus")
def t01(v: Views) -> DataFrame:
    return v.corpus.select("doc_id", T.n_words(F.col("contents")).cast("long").alias("words"), T.est_tokens(F.col("contents")).alias("tokens"))


@query("t02_word_budget", "SELECT o_orderkey, greatest(1, CAST(floor(CAST(o_orderkey % 3000 AS DOUBLE) / 1.3::DOUBLE) AS BIGINT)) AS words FROM orders")
def t02(v: Views) -> DataFrame:
    return v.orders.select("o_orderkey", T.to_words((F.col("o_orderkey") % 3000).cast("double")).alias("words"))


@query("t03_oversized_split")
def t03(v: Views) -> DataFrame:
    @F.pandas_udf("array<string>")
    def run(t):
        return t.map(lambda x: list(chunking.cut_long(x or "", 150)))

    return v.corpus.select("doc_id", F.posexplode(run("contents")).alias("k", "piece"))


@query("t04_paragraph_pieces", r"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(contents, chr(10), chr(10) || chr(10)), '\n\s*\n'), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '') AS ps FROM corpus)
SELECT doc_id, CAST(len(ps) AS BIGINT) AS paragraphs, CAST(list_max(list_transform(ps, lambda x: len(regexp_extract_all(x, '\S+')))) AS BIGINT) AS longest FROM p""")
def t04(v: Views) -> DataFrame:
    ps = F.filter(F.transform(F.split(F.regexp_replace("contents", "\n", "\n\n"), r"\n\s*\n"), lambda x: F.trim(x)), lambda x: x != "")
    return v.corpus.select("doc_id", ps.alias("ps")).select("doc_id", F.size("ps").cast("long").alias("paragraphs"), F.array_max(F.transform("ps", T.n_words)).cast("long").alias("longest"))


@query("t05_chunk_band")
def t05(v: Views) -> DataFrame:
    return chunking.chunk_corpus(v.corpus.withColumn("contents", F.regexp_replace("contents", "\n", "\n\n")), "band")


@query("t06_chunk_para_pack")
def t06(v: Views) -> DataFrame:
    return chunking.chunk_corpus(v.corpus.withColumn("contents", F.regexp_replace("contents", "\n", "\n\n")), "para_pack")


@query("t07_chunk_fixed", "SELECT id, contents FROM chunks")
def t07(v: Views) -> DataFrame:
    return v.chunks.select("id", "contents")


@query("t08_chunk_titles", "SELECT id, length(contents) AS body FROM chunks")
def t08(v: Views) -> DataFrame:
    c = chunking.chunk_corpus(v.corpus, "fixed", titles=True, size=256, overlap=32)
    return c.select("id", F.length(F.regexp_replace("contents", r"^Page \d+ of document: [^\n]*\n\n", "")).cast("long").alias("body"))


@query("t09_corpus_chunking", "SELECT docid, count(*) AS pages, max(page) AS last_page, CAST(sum(length(contents)) AS BIGINT) AS chars FROM chunks GROUP BY docid")
def t09(v: Views) -> DataFrame:
    return v.chunks.groupBy("docid").agg(F.count(F.lit(1)).alias("pages"), F.max("page").alias("last_page"), F.sum(F.length("contents")).cast("long").alias("chars"))


@query("t10_derived_title", r"""WITH l AS (SELECT doc_id, trim(regexp_extract(contents, '([^\s][^\n]*)', 1)) AS line FROM corpus), s AS (SELECT *, regexp_extract(line, '^(.*?[.!?])(?:\s|$)', 1) AS sentence FROM l)
SELECT doc_id, CASE WHEN length(line) <= 120 THEN line WHEN sentence <> '' AND length(sentence) <= 160 THEN sentence ELSE rtrim(substr(line, 1, 120)) || '…' END AS title FROM s""")
def t10(v: Views) -> DataFrame:
    return v.corpus.select("doc_id", T.derive_title(F.col("contents")).alias("title"))


@query("t11_cover_location", "SELECT d.doc_id, b.item_id, CAST(instr(d.contents, b.text) - 1 AS BIGINT) AS place FROM corpus d JOIN benchmark b ON contains(d.contents, b.text)")
def t11(v: Views) -> DataFrame:
    return _passages(v).select("doc_id", "item_id", (F.instr("contents", F.col("text")) - 1).cast("long").alias("place"))


def _passages(v: Views) -> DataFrame:
    """Documents that hold a benchmark item, found by the item's first three words."""
    head = lambda c: F.regexp_extract(c, r"^(\S+\s+\S+\s+\S+)", 1)
    b = v.benchmark.select("item_id", "text", head("text").alias("g"))
    words = F.regexp_extract_all("contents", F.lit(r"\S+\s*"), F.lit(0))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - 2)), lambda i: F.rtrim(F.regexp_replace(F.array_join(F.slice("w", i, 3), ""), r"\s+$", ""))))
    d = v.corpus.select("doc_id", "contents", words.alias("w")).select("doc_id", F.explode(grams).alias("g"))
    return d.join(b, "g").join(v.corpus.select("doc_id", "contents"), "doc_id").filter(F.contains("contents", F.col("text"))).select("doc_id", "item_id", "contents", "text")


@query("t12_evidence_window", r"""WITH m AS (SELECT d.doc_id, d.contents, instr(d.contents, b.text) - 1 AS pos FROM corpus d JOIN benchmark b ON contains(d.contents, b.text)),
w AS (SELECT *, regexp_extract_all(contents, '\S+\s*') AS ws, len(regexp_extract_all(substr(contents, 1, pos), '\S+')) - CAST(pos > 0 AND regexp_matches(substr(contents, pos, 2), '^\S\S$') AS INT) AS mid FROM m),
h AS (SELECT *, greatest(0, mid - 98) AS a, least(len(ws), mid + 98) AS b FROM w)
SELECT doc_id, CAST(pos AS BIGINT) AS "at", regexp_replace(array_to_string(ws[a + 1 : b], ''), '\s+$', '') AS "window", CAST(round_even(a * 1.3::DOUBLE, 0) AS BIGINT) AS before, CAST(round_even((len(ws) - b) * 1.3::DOUBLE, 0) AS BIGINT) AS after FROM h""")
def t12(v: Views) -> DataFrame:
    return chunking.windows(_passages(v).withColumnRenamed("text", "cover"))


@query("t13_budget_truncation", r"""WITH p AS (SELECT doc_id, contents, substr(contents, 1, 1000) AS head FROM corpus), q AS (SELECT *, length(head) - length(list_last(string_split(head, chr(10)))) - 1 AS cut FROM p)
SELECT doc_id, md5(CASE WHEN length(contents) <= 1000 THEN contents WHEN cut > 0 THEN substr(head, 1, cut) ELSE head END) AS body, length(contents) > 1000 AS truncated FROM q""")
def t13(v: Views) -> DataFrame:
    return v.corpus.select("doc_id", F.md5(T.budget_cut(F.col("contents"), 200)).alias("body"), (F.length(F.col("contents")) > 1000).alias("truncated"))


@query("t14_snippet", rf"""WITH f AS (SELECT doc_id, {FLAT.format('contents')} AS flat FROM corpus), h AS (SELECT *, substr(flat, 1, 160) AS head FROM f), q AS (SELECT *, length(head) - length(list_last(string_split(head, ' '))) - 1 AS cut FROM h)
SELECT doc_id, CASE WHEN length(flat) <= 160 THEN flat ELSE rtrim(CASE WHEN cut > 0 THEN substr(head, 1, cut) ELSE head END) || '...' END AS snippet FROM q""")
def t14(v: Views) -> DataFrame:
    return v.corpus.select("doc_id", T.snippet(F.col("contents"), 160).alias("snippet"))


@query("t15_compaction", f"SELECT doc_id, md5({FLAT.format('contents')}) AS flat FROM corpus")
def t15(v: Views) -> DataFrame:
    return v.corpus.select("doc_id", F.md5(T.compact(F.col("contents"))).alias("flat"))


@query("t16_content_tokens", f"SELECT doc_id, CAST(len({tokens_sql('contents')}) AS BIGINT) AS n, array_to_string(list_sort({tokens_sql('contents')})[1:10], ' ') AS first_ten FROM corpus")
def t16(v: Views) -> DataFrame:
    return v.corpus.select("doc_id", T.content_tokens(F.col("contents")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.array_join(F.slice(F.array_sort("t"), 1, 10), " ").alias("first_ten"))


SPANS_SQL = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace(replace({x}, chr(10), chr(1)), '\s+', ' ', 'g'), '([.!?]) +([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) >= 24)"


@query("t17_source_spans", f"WITH s AS (SELECT doc_id, contents, {SPANS_SQL.format(x='contents')} AS sp FROM corpus) SELECT doc_id, CAST(CASE WHEN len(sp) > 0 THEN len(sp) WHEN trim(regexp_replace(contents, '\\s+', ' ', 'g')) = '' THEN 0 ELSE 1 END AS BIGINT) AS n, md5(CASE WHEN len(sp) > 0 THEN array_to_string(sp, '|') ELSE trim(regexp_replace(contents, '\\s+', ' ', 'g')) END) AS body FROM s")
def t17(v: Views) -> DataFrame:
    return v.corpus.select("doc_id", T.spans(F.col("contents")).alias("s")).select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("body"))


PAIR_SQL = "SELECT a.conv_id, a.turn, a.text AS claim, b.text AS span FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"


def _pairs(v: Views) -> DataFrame:
    a, b = v.conversations.alias("a"), v.conversations.alias("b")
    return a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1)).select("a.conv_id", "a.turn", F.col("a.text").alias("claim"), F.col("b.text").alias("span"))


@query("t18_span_score", f"""WITH p AS ({PAIR_SQL}), t AS (SELECT conv_id, turn, {tokens_sql('claim')} AS a, {tokens_sql('span')} AS b, {numbers_sql('claim')} AS na, {numbers_sql('span')} AS nb FROM p)
SELECT conv_id, turn, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / sqrt(len(a) * len(b)) + CASE WHEN len(list_intersect(na, nb)) > 0 THEN 0.35 ELSE 0 END END, 6) AS score FROM t""")
def t18(v: Views) -> DataFrame:
    return _pairs(v).select("conv_id", "turn", F.round(T.span_score(F.col("claim"), F.col("span")), 6).alias("score"))


@query("t19_fact_relevance", f"""WITH p AS ({PAIR_SQL}), t AS (SELECT conv_id, turn, {tokens_sql('claim')} AS a, {tokens_sql('span')} AS b FROM p)
SELECT conv_id, turn, round(len(list_intersect(a, b)) / greatest(1, len(a)), 6) AS relevance, len(list_intersect(a, b)) / greatest(1, len(a)) >= 0.65 AS reused FROM t""")
def t19(v: Views) -> DataFrame:
    a, b = T.content_tokens(F.col("claim")), T.content_tokens(F.col("span"))
    r = F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(a))
    return _pairs(v).select("conv_id", "turn", F.round(r, 6).alias("relevance"), (r >= 0.65).alias("reused"))


CITED_SQL = "SELECT conv_id, turn, 'Fact ' || turn || ' holds [shard_0000' || turn || '_1, shard_00002_' || conv_id || '] , and more [note] [shard_0000' || turn || '_1].' AS line FROM conversations"


def _cited(v: Views) -> DataFrame:
    t, c = F.col("turn").cast("string"), F.col("conv_id").cast("string")
    return v.conversations.select("conv_id", "turn", F.concat(F.lit("Fact "), t, F.lit(" holds [shard_0000"), t, F.lit("_1, shard_00002_"), c, F.lit("] , and more [note] [shard_0000"), t, F.lit("_1].")).alias("line"))


@query("t20_citation_markers", f"WITH l AS ({CITED_SQL}) SELECT conv_id, turn, CASE WHEN turn = 2 AND conv_id = 1 THEN 'shard_00002_1' ELSE 'shard_0000' || turn || '_1 shard_00002_' || conv_id END AS cited, 'Fact ' || turn || ' holds, and more [note].' AS bare FROM l")
def t20(v: Views) -> DataFrame:
    return _cited(v).select("conv_id", "turn", F.array_join(T.markers(F.col("line")), " ").alias("cited"), T.without_markers(F.col("line")).alias("bare"))


@query("t21_report_parsing", r"""WITH r AS (SELECT conv_id, unnest(string_split(text, chr(10))) AS line FROM conversations WHERE role = 'assistant'), k AS (SELECT conv_id, trim(line) AS line FROM r)
SELECT conv_id, count(*) AS sentences, CAST(sum(length(line)) AS BIGINT) AS chars FROM k WHERE line <> '' GROUP BY 1""")
def t21(v: Views) -> DataFrame:
    from quarry.operators.evidence import parse_report

    a = v.conversations.filter("role = 'assistant'")
    text = F.concat(F.lit("## Answer\n- "), F.regexp_replace("text", "\n", "\n- "), F.lit("\n[shard_00001_1]"))
    s = parse_report(a.select("conv_id", "turn", text.alias("text")), ["conv_id", "turn"])
    return s.groupBy("conv_id").agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.length("sentence")).cast("long").alias("chars"))


@query("t22_answer_words", r"SELECT conv_id, CAST(sum(len(regexp_extract_all(text, '\S+'))) AS BIGINT) AS words FROM conversations WHERE role = 'assistant' GROUP BY 1")
def t22(v: Views) -> DataFrame:
    return v.conversations.filter("role = 'assistant'").groupBy("conv_id").agg(F.sum(T.n_words(F.col("text"))).cast("long").alias("words"))


@query("t23_item_fingerprint", rf"SELECT item_id, trim(regexp_replace(lower({FLAT.format('text')}), '[.!?]+$', '')) AS fingerprint FROM benchmark")
def t23(v: Views) -> DataFrame:
    return v.benchmark.select("item_id", T.fingerprint(F.col("text")).alias("fingerprint"))


@query("t24_many_sentences", r"""WITH a AS (SELECT conv_id, turn, regexp_replace(text, '(?i)(^|[^\p{L}\p{N}_])(?:D\.Phil|M\.D|Ph\.D)\.', '\1X', 'g') AS t FROM conversations), b AS (SELECT conv_id, turn, regexp_replace(t, '(^|[^\p{L}\p{N}_])(?:[A-Za-z]\.){2,}', '\1X', 'g') AS t FROM a),
c AS (SELECT conv_id, turn, regexp_replace(t, '(?i)(^|[^\p{L}\p{N}_])(?:al|Art|cf|Ch|Dr|e\.g|Eq|etc|Fig|i\.e|Jr|Mr|Mrs|Ms|No|p|pp|Prof|Sec|Sr|St|Vol|vs)\.', '\1X', 'g') AS t FROM b) SELECT conv_id, turn, regexp_matches(t, '[.!?]["'')\]]*\s+\S') AS many FROM c""")
def t24(v: Views) -> DataFrame:
    return v.conversations.select("conv_id", "turn", T.many_sentences(F.col("text")).alias("many"))


@query("t25_quantities", r"""WITH n AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(contents, '(?i)(?:^|[^A-Za-z0-9])((?:[$€£]\s*)?[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?\b(?:\([A-Za-z]\))?(?:\s*(?:%|percent(?:age)?(?:\s+points?)?\b))?)', 1), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')))) AS q FROM corpus)
SELECT doc_id, CAST(len(q) AS BIGINT) AS n, array_to_string(list_sort(q), ' ') AS values FROM n""")
def t25(v: Views) -> DataFrame:
    return v.corpus.select("doc_id", T.quantities(F.col("contents")).alias("q")).select("doc_id", F.size("q").cast("long").alias("n"), F.array_join(F.array_sort("q"), " ").alias("values"))


@query("t26_document_quality")
def t26(v: Views) -> DataFrame:
    d = rated(v)
    r = {k: F.col(k) for k in T.QUALITY}
    return d.select("doc_id", T.quality_score(r).alias("score"), F.array_join(T.quality_reasons(r), "; ").alias("reasons"), "words", *(F.round(k, 3).alias(k) for k in T.QUALITY))


def rated(v: Views) -> DataFrame:
    """Words and rates, each pattern counted once however often its rate is used."""
    c = F.col("contents")
    counted = v.corpus.select("doc_id", T.n_words(c).cast("long").alias("words"), *(F.regexp_count(c, F.lit(p)).alias(k) for k, p in T.QUALITY.items()))
    n = F.greatest(F.col("words"), F.lit(1))
    return counted.select("doc_id", "words", *((1000.0 * F.col(k) / n).alias(k) for k in T.QUALITY))


@query("t27_quality_bands")
def t27(v: Views) -> DataFrame:
    r = {k: F.col(k) for k in T.QUALITY}
    s = rated(v).filter("words >= 80").select(T.quality_band(T.quality_score(r)).alias("band")).groupBy("band").count()
    return s.select("band", F.col("count").alias("docs"), F.round(F.col("count") / F.sum("count").over(W.partitionBy()), 6).alias("share"))  # four rows at most


@query("t28_query_slug", r"SELECT item_id, regexp_replace(lower(array_to_string(regexp_extract_all(text, '\S+')[1:5], '-')), '[^a-z0-9-]+', '', 'g') AS slug FROM benchmark")
def t28(v: Views) -> DataFrame:
    return v.benchmark.select("item_id", T.slug(F.col("text")).alias("slug"))


@query("t29_answer_within_limit", r"""WITH s AS (SELECT conv_id, turn, len(regexp_extract_all(text, '\S+')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations WHERE role = 'assistant'),
r AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS total FROM s) SELECT conv_id, turn, CAST(total AS BIGINT) AS total, i % 3 AS citation FROM r WHERE total <= 300""")
def t29(v: Views) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn")
    s = v.conversations.filter("role = 'assistant'").select("conv_id", "turn", F.sum(T.n_words(F.col("text"))).over(w).cast("long").alias("total"), ((F.row_number().over(w) - 1) % 3).cast("long").alias("citation"))
    return s.filter("total <= 300")


@query("t30_grade_parse", "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(event_id % 4 AS INT) END AS grade FROM events")
def t30(v: Views) -> DataFrame:
    g = (F.col("event_id") % 4).cast("string")
    text = F.when(F.col("event_type") == "error", F.lit("no verdict ## score 9")).otherwise(F.concat(F.lit("##final score: 1\nthen ## Final Score : "), g, F.lit(" end")))
    return v.events.select("event_id", T.parse_grade(text).alias("grade"))


ERRORS = [("ClientError", "ThrottlingException", 400), ("ReadTimeoutError", "", 0), ("ClientError", "ExpiredToken", 403), ("ClientError", "Other", 400), ("ClientError", "", 503), ("SlowDown", "", 0), ("ClientError", "", 429)]


@query("t31_error_class", """WITH e AS (SELECT event_id, CAST(event_id % 7 AS INT) AS n FROM events)
SELECT event_id, CASE n WHEN 0 THEN 'throttle' WHEN 1 THEN 'timeout' WHEN 2 THEN 'expired_token' WHEN 4 THEN 'server_error' WHEN 5 THEN 'throttle' WHEN 6 THEN 'throttle' ELSE 'other' END AS class, least(30.0, power(2, greatest(n - 1, 0)))::DOUBLE AS delay FROM e""")
def t31(v: Views) -> DataFrame:
    from quarry.operators.traces import backoff, error_class

    n = (F.col("event_id") % 7).cast("int")
    e = F.get(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in ERRORS)), n)
    return v.events.select("event_id", error_class(e["a"], e["b"], e["c"]).alias("class"), backoff(n).alias("delay"))


@query("t32_tool_output", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events""")
def t32(v: Views) -> DataFrame:
    from quarry.operators.traces import parse_tool_output

    raw = F.concat(F.when(F.col("event_id") % 5 == 0, F.lit("oops ")).otherwise(F.lit("")), F.col("props"), F.lit("\n--- footer: 3 of 9 shown ---"))
    return v.events.select("event_id", F.try_variant_get(parse_tool_output(raw), "$.k", "long").alias("k"))


@query("t33_search_preview", rf"""WITH f AS (SELECT doc_id, {FLAT.format('contents')} AS flat, CASE WHEN doc_id % 4 = 0 THEN 'Preview of ' || doc_id END AS made FROM corpus), h AS (SELECT *, substr(flat, 1, 80) AS head FROM f),
q AS (SELECT *, length(head) - length(list_last(string_split(head, ' '))) - 1 AS cut FROM h)
SELECT doc_id, coalesce(made, CASE WHEN length(flat) <= 80 THEN flat ELSE rtrim(CASE WHEN cut > 0 THEN substr(head, 1, cut) ELSE head END) || '...' END) AS preview, made IS NOT NULL AS generated, made IS NULL AND length(flat) > 80 AS truncated FROM q""")
def t33(v: Views) -> DataFrame:
    made = v.corpus.filter("doc_id % 4 = 0").select("doc_id", F.concat(F.lit("Preview of "), F.col("doc_id").cast("string")).alias("made"))
    j = v.corpus.join(made, "doc_id", "left")
    return j.select("doc_id", F.coalesce(F.substring("made", 1, 80), T.snippet(F.col("contents"), 80)).alias("preview"), F.col("made").isNotNull().alias("generated"), (F.col("made").isNull() & (F.length(T.compact(F.col("contents"))) > 80)).alias("truncated"))


@query("t34_markdown_cleaning", r"SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS clean FROM conversations")
def t34(v: Views) -> DataFrame:
    text = F.concat(F.lit("# "), F.regexp_replace("text", r"^(\S+)", "**$1**"), F.lit("\n```\ncode\n```\n"))
    return v.conversations.select("conv_id", "turn", T.strip_markdown(text).alias("clean"))


@query("t35_model_output", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'tie' END AS verdict FROM events")
def t35(v: Views) -> DataFrame:
    from quarry.operators.traces import parse_verdict

    said = F.array(*map(F.lit, ("I think <verdict>A</verdict>", 'Well: {"winner": "b"} done', "<verdict>tie", "no idea")))
    return v.events.select("event_id", parse_verdict(F.get(said, (F.col("event_id") % 4).cast("int"))).alias("verdict"))
