"""Queries of identity, predicate and validation operators (section P)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.fixtures import Views
from quarry.functions import ids, text
from quarry.operators import validate
from quarry.registry import query

TITLED_SQL = "SELECT id, page, CASE WHEN page >= 2 THEN 'Page ' || page || ' of document: T' || doc_id || chr(10) || chr(10) || contents ELSE contents END AS contents FROM chunks"


def titled(v: Views) -> DataFrame:
    head = F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(" of document: T"), F.col("doc_id").cast("string"), F.lit("\n\n"), F.col("contents"))
    return v.chunks.select("id", "page", F.when(F.col("page") >= 2, head).otherwise(F.col("contents")).alias("contents"))


@query("p01_unit_id_class", r"""SELECT id, CASE WHEN regexp_matches(id, '_p\d+$') THEN 'chunk' ELSE 'document' END AS kind, regexp_replace(id, '_p\d+$', '') AS parent
FROM (SELECT id FROM chunks UNION ALL SELECT docid FROM corpus)""")
def p01(v: Views) -> DataFrame:
    u = v.chunks.select("id").union(v.corpus.select("docid"))
    return u.select("id", ids.unit_kind(F.col("id")).alias("kind"), ids.unit_docid(F.col("id")).alias("parent"))


@query("p02_parent_docid", "SELECT id, regexp_replace(id, '^(.*)_p.*$', '\\1') AS parent FROM (SELECT id FROM chunks UNION ALL SELECT docid || '_px' FROM corpus)")
def p02(v: Views) -> DataFrame:
    u = v.chunks.select("id").union(v.corpus.select(F.concat("docid", F.lit("_px"))))
    return u.select("id", ids.parent_docid(F.col("id")).alias("parent"))


@query("p03_unit_page", r"SELECT id, CASE WHEN regexp_matches(id, '_p\d+$') THEN regexp_replace(id, '_p\d+$', '') ELSE id END AS parent, TRY_CAST(nullif(regexp_extract(id, '_p(\d+)$', 1), '') AS INT) AS page FROM (SELECT id FROM chunks UNION ALL SELECT docid FROM corpus)")
def p03(v: Views) -> DataFrame:
    u = v.chunks.select("id").union(v.corpus.select("docid"))
    return u.select("id", ids.unit_docid(F.col("id")).alias("parent"), ids.page_of(F.col("id")).alias("page"))


@query("p04_shard_and_row", r"SELECT docid, regexp_extract(docid, '^(.+)_(\d+)$', 1) AS shard, CAST(regexp_extract(docid, '^(.+)_(\d+)$', 2) AS BIGINT) AS row_number FROM corpus")
def p04(v: Views) -> DataFrame:
    return v.corpus.select("docid", ids.shard_of(F.col("docid")).alias("shard"), ids.row_of(F.col("docid")).alias("row_number"))


@query("p05_make_hit", r"""SELECT chunk_id AS id, regexp_replace(chunk_id, '_p\d+$', '') AS docid, CASE WHEN regexp_matches(chunk_id, '_p\d+$') THEN 'chunk' ELSE 'document' END AS kind,
score, CAST(rnk AS BIGINT) AS rank FROM runs WHERE config = 'len' AND rnk <= 3""")
def p05(v: Views) -> DataFrame:
    r = v.runs.filter("config = 'len' AND rnk <= 3")
    u = F.col("chunk_id")
    return r.select(u.alias("id"), ids.unit_docid(u).alias("docid"), ids.unit_kind(u).alias("kind"), "score", F.col("rnk").cast("long").alias("rank"))


@query("p06_query_key", "SELECT item_id, concat(CAST(item_id AS VARCHAR), '::', substr(sha1(text), 1, 12)) AS qkey, sha256(text) AS text_sha256 FROM benchmark")
def p06(v: Views) -> DataFrame:
    return v.benchmark.select("item_id", ids.qkey(F.col("item_id").cast("string"), F.col("text")).alias("qkey"), F.sha2("text", 256).alias("text_sha256"))


@query("p07_judgment_key", """SELECT DISTINCT jkey, split_part(jkey, '::', 1) AS version, split_part(jkey, '::', 2) AS topic, split_part(jkey, '::', 3) AS chunk, concat_ws('::', split_part(jkey, '::', 1), split_part(jkey, '::', 2), split_part(jkey, '::', 3)) AS rebuilt FROM log""")
def p07(v: Views) -> DataFrame:
    parts = [ids.jkey_part(F.col("jkey"), n) for n in (1, 2, 3)]
    return v.log.select("jkey", parts[0].alias("version"), parts[1].alias("topic"), parts[2].alias("chunk"), ids.jkey(*parts).alias("rebuilt")).distinct()


@query("p08_topic_of_query_key", "SELECT DISTINCT qkey, split_part(qkey, '::', 1) AS topic FROM runs")
def p08(v: Views) -> DataFrame:
    return v.runs.select("qkey", ids.topic_of_qkey(F.col("qkey")).alias("topic")).distinct()




@query("p09_config_key", """SELECT doc_id, 'k1_' || regexp_replace(CAST(k1 AS VARCHAR), '\\.0$', '') || '__b_' || regexp_replace(CAST(b AS VARCHAR), '\\.0$', '') AS config
FROM (SELECT doc_id, (doc_id % 30 + 1) / 10.0::DOUBLE AS k1, (doc_id // 30 % 21) / 20.0::DOUBLE AS b FROM documents)""")
def p09(v: Views) -> DataFrame:
    """A configuration a document, over a grid of 30 by 21."""
    d = F.col("doc_id")
    g = v.documents.select("doc_id", ((d % 30 + 1) / F.lit(10.0)).alias("k1"), (F.floor(d / 30) % 21 / F.lit(20.0)).alias("b"))
    return g.select("doc_id", ids.config_key(F.col("k1"), F.col("b")).alias("config"))


@query("p10_natural_topic_order", r"""SELECT topic, row_number() OVER (ORDER BY TRY_CAST(nullif(regexp_extract(topic, '(\d+)$', 1), '') AS BIGINT) NULLS LAST, topic) AS place
FROM (SELECT DISTINCT source AS topic FROM corpus UNION SELECT DISTINCT lang FROM corpus)""")
def p10(v: Views) -> DataFrame:
    from pyspark.sql import Window as W

    t = v.corpus.select(F.col("source").alias("topic")).union(v.corpus.select("lang")).distinct()
    return t.select("topic", F.row_number().over(W.orderBy(*ids.topic_order(F.col("topic")))).cast("long").alias("place"))


@query("p11_successful_judgments", "SELECT event_id, jkey, grade FROM log WHERE NOT failed AND grade IS NOT NULL AND grade BETWEEN 0 AND 3")
def p11(v: Views) -> DataFrame:
    return v.log.filter("NOT failed AND grade IS NOT NULL AND grade BETWEEN 0 AND 3").select("event_id", "jkey", "grade")


@query("p12_pending_pairs", """WITH done AS (SELECT DISTINCT jkey FROM log WHERE NOT failed AND event_id % 3 = 0), want AS (SELECT DISTINCT jkey FROM log)
SELECT w.jkey, d.jkey IS NOT NULL AS cached FROM want w LEFT JOIN done d ON w.jkey = d.jkey""")
def p12(v: Views) -> DataFrame:
    done = v.log.filter("NOT failed AND event_id % 3 = 0").select("jkey").distinct()
    want = v.log.select("jkey").distinct()
    return want.join(done, "jkey", "left_anti").withColumn("cached", F.lit(False)).union(want.join(done, "jkey", "left_semi").withColumn("cached", F.lit(True)))


@query("p13_agent_class", "SELECT d.doc_id, CASE l.quality WHEN 1 THEN 'positive' WHEN 0 THEN 'negative' ELSE 'unjudged' END AS stratum FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def p13(v: Views) -> DataFrame:
    label = F.when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "negative").otherwise("none")
    return v.documents.select("doc_id").join(v.labels, "doc_id", "left").select("doc_id", ids.agent_class(label).alias("stratum"))


@query("p14_training_label", """WITH r AS (SELECT conv_id AS unit, bool_or(role = 'assistant' AND length(text) > 1500) AS committed,
  list(DISTINCT CASE WHEN turn % 3 = 0 THEN 'duplicate' WHEN turn % 3 = 1 THEN 'off_topic' ELSE 'void' END) AS reasons FROM conversations WHERE role <> 'system' GROUP BY 1)
SELECT unit, CASE WHEN committed THEN 'positive' WHEN list_contains(reasons, 'duplicate') THEN 'unjudged' WHEN len(reasons) = 0 THEN 'unjudged'
  WHEN len(list_filter(reasons, lambda x: x <> 'void')) = 0 THEN 'unjudged' ELSE 'negative' END AS label,
 CASE WHEN committed THEN 'committed' WHEN list_contains(reasons, 'duplicate') THEN 'duplicate' WHEN len(reasons) = 0 THEN 'never_judged'
  WHEN len(list_filter(reasons, lambda x: x <> 'void')) = 0 THEN 'voided' ELSE 'rejected' END AS reason FROM r""")
def p14(v: Views) -> DataFrame:
    why = F.when(F.col("turn") % 3 == 0, "duplicate").when(F.col("turn") % 3 == 1, "off_topic").otherwise("void")
    r = v.conversations.filter("role != 'system'").groupBy(F.col("conv_id").alias("unit")).agg(
        F.bool_or((F.col("role") == "assistant") & (F.length("text") > 1500)).alias("committed"), F.collect_set(why).alias("reasons"))
    return r.select("unit", *validate.training_label(F.col("committed"), F.col("reasons")))


@query("p15_header_strip", f"""WITH t AS ({TITLED_SQL}) SELECT id, length(regexp_extract(contents, '^Page \\d+ of document: [^\\n]*\\n\\n')) AS header,
 md5(regexp_replace(contents, '^Page \\d+ of document: [^\\n]*\\n\\n', '')) AS rest FROM t""")
def p15(v: Views) -> DataFrame:
    t = F.col("contents")
    return titled(v).select("id", ids.header_length(t).cast("long").alias("header"), F.md5(ids.strip_header(t)).alias("rest"))


@query("p16_header_anomaly", f"""WITH t AS ({TITLED_SQL}), c AS (SELECT id, contents, CASE WHEN page % 4 = 0 THEN 100000 WHEN page % 4 = 1 THEN 0 WHEN page % 4 = 2 THEN 5 ELSE length(regexp_extract(contents, '^Page \\d+ of document: [^\\n]*\\n\\n')) END AS claimed FROM t)
SELECT id, CASE WHEN claimed > 0 AND claimed >= length(contents) THEN 'out_of_range' WHEN claimed > 0 AND claimed <> length(regexp_extract(contents, '^Page \\d+ of document: [^\\n]*\\n\\n')) THEN 'not_a_header' END AS anomaly FROM c""")
def p16(v: Views) -> DataFrame:
    t = F.col("contents")
    m = F.col("page") % 4
    claimed = F.when(m == 0, 100000).when(m == 1, 0).when(m == 2, 5).otherwise(ids.header_length(t))
    return titled(v).select("id", ids.header_anomaly(t, claimed).alias("anomaly"))


@query("p17_header_length", f"WITH t AS ({TITLED_SQL}) SELECT page, length(regexp_extract(contents, '^Page \\d+ of document: [^\\n]*\\n\\n')) AS n, count(*) AS units FROM t GROUP BY 1, 2")
def p17(v: Views) -> DataFrame:
    return titled(v).groupBy("page", ids.header_length(F.col("contents")).cast("long").alias("n")).agg(F.count(F.lit(1)).alias("units"))


@query("p18_condensed_run", "SELECT config, qkey, chunk_id, score FROM runs r WHERE EXISTS (SELECT 1 FROM qrels q WHERE q.topic_id = r.topic_id AND q.chunk_id = r.chunk_id)")
def p18(v: Views) -> DataFrame:
    return v.runs.join(v.qrels, ["topic_id", "chunk_id"], "left_semi").select("config", "qkey", "chunk_id", "score")


@query("p19_restrict_to_pool", "SELECT topic_id, chunk_id, grade FROM qrels q WHERE EXISTS (SELECT 1 FROM runs r WHERE r.rnk <= 5 AND q.topic_id = r.topic_id AND q.chunk_id = r.chunk_id)")
def p19(v: Views) -> DataFrame:
    return v.qrels.join(v.runs.filter("rnk <= 5"), ["topic_id", "chunk_id"], "left_semi").select("topic_id", "chunk_id", "grade")


@query("p20_answer_violations", r"""WITH a AS (SELECT conv_id, list(text ORDER BY turn) FILTER (WHERE role = 'assistant') AS sentences,
  CAST(sum(len(regexp_extract_all(text, '\S+'))) FILTER (WHERE role = 'assistant') AS BIGINT) AS words, count(*) FILTER (WHERE role = 'user') AS refs FROM conversations GROUP BY 1),
s AS (SELECT conv_id, unnest(range(0, coalesce(len(sentences), 0))) AS i, refs FROM a),
c AS (SELECT conv_id, i, CAST(unnest(range(0, i + 1)) AS BIGINT) AS citation, refs FROM s)
SELECT conv_id, 'words' AS rule, CAST(count(*) AS BIGINT) AS n FROM a WHERE words > 1024 GROUP BY 1
UNION ALL SELECT conv_id, 'citations', count(*) FROM s WHERE i + 1 > 3 GROUP BY 1
UNION ALL SELECT conv_id, 'range', count(*) FROM c WHERE citation >= refs - 1 GROUP BY 1
UNION ALL SELECT conv_id, 'empty', 1 FROM a WHERE sentences IS NULL OR len(sentences) = 0""")
def p20(v: Views) -> DataFrame:
    return validate.answer_violations(validate.answers_of(v.conversations))


@query("p21_conformance_counts", r"""WITH a AS (SELECT conv_id, conv_id % 5 AS run, list(text ORDER BY turn) FILTER (WHERE role = 'assistant') AS sentences,
  CAST(sum(len(regexp_extract_all(text, '\S+'))) FILTER (WHERE role = 'assistant') AS BIGINT) AS words, count(*) FILTER (WHERE role = 'user') AS refs FROM conversations GROUP BY 1),
s AS (SELECT conv_id, run, unnest(range(0, coalesce(len(sentences), 0))) AS i, refs FROM a), c AS (SELECT run, conv_id, CAST(unnest(range(0, i + 1)) AS BIGINT) AS citation, refs FROM s),
x AS (SELECT run, conv_id, 'words' AS rule FROM a WHERE words > 1024 UNION ALL SELECT run, conv_id, 'citations' FROM s WHERE i + 1 > 3 UNION ALL SELECT run, conv_id, 'range' FROM c WHERE citation >= refs - 1
 UNION ALL SELECT run, conv_id, 'empty' FROM a WHERE sentences IS NULL OR len(sentences) = 0)
SELECT run, rule, rule IN ('range', 'empty') AS hard, count(*) AS violations, count(DISTINCT conv_id) AS answers FROM x GROUP BY 1, 2, 3""")
def p21(v: Views) -> DataFrame:
    found = validate.answer_violations(validate.answers_of(v.conversations))
    return validate.conformance(found.withColumn("run", F.col("conv_id") % 5))


@query("p22_reference_rows", """WITH r AS (SELECT conv_id, list(CAST(length(text) % 7 AS BIGINT) ORDER BY turn) AS refs, max(turn) AS top FROM conversations GROUP BY 1)
SELECT conv_id, len(refs) = len(list_distinct(refs)) AS unique_refs, len(list_filter(refs, lambda x: x > top)) = 0 AS in_range FROM r""")
def p22(v: Views) -> DataFrame:
    r = v.conversations.groupBy("conv_id").agg(F.collect_list((F.length("text") % 7).cast("long")).alias("refs"), F.max("turn").alias("top"))
    return r.select("conv_id", (F.size("refs") == F.size(F.array_distinct("refs"))).alias("unique_refs"), F.forall("refs", lambda x: x <= F.col("top")).alias("in_range"))


@query("p23_run_file_checks", r"""WITH f AS (SELECT config, qkey, chunk_id, score, row_number() OVER (PARTITION BY config ORDER BY qkey, score DESC, chunk_id) AS line, rnk FROM runs),
p AS (SELECT *, lag(qkey) OVER w AS q0, lag(score) OVER w AS s0, lag(rnk) OVER w AS r0 FROM f WINDOW w AS (PARTITION BY config ORDER BY line)),
x AS (SELECT config, 'contiguous' AS rule, qkey FROM (SELECT config, qkey, count(*) AS starts FROM p WHERE q0 IS DISTINCT FROM qkey GROUP BY 1, 2) WHERE starts > 1
UNION ALL SELECT config, 'ranks', qkey FROM p WHERE rnk <> CASE WHEN q0 IS DISTINCT FROM qkey THEN 1 ELSE r0 + 1 END
UNION ALL SELECT config, 'scores', qkey FROM p WHERE q0 = qkey AND score > s0
UNION ALL SELECT config, 'docid', qkey FROM p WHERE NOT regexp_matches(chunk_id, '^shard_\d{5}_\d+[02468]$'))
SELECT config, rule, count(*) AS n FROM x GROUP BY 1, 2""")
def p23(v: Views) -> DataFrame:
    from pyspark.sql import Window as W

    line = F.row_number().over(W.partitionBy("config").orderBy("qkey", F.desc("score"), "chunk_id"))
    return validate.run_file_checks(v.runs.withColumn("line", line), docid=r"^shard_\d{5}_\d+[02468]$")


@query("p24_rubric_waivers", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'visual' WHEN 1 THEN 'citation' WHEN 2 THEN 'markdown' WHEN 3 THEN 'words' END AS waiver FROM documents")
def p24(v: Views) -> DataFrame:
    """A criterion of six kinds for each document, with numbers of its own."""
    n = F.col("doc_id").cast("string")
    texts = [F.concat(F.lit("Includes a diagram of part "), n), F.concat(F.lit("Uses APA citation style, item "), n), F.concat(F.lit("Presents the table in Markdown, row "), n),
             F.concat(F.lit("Has at least "), (F.col("doc_id") + 1_500).cast("string"), F.lit(" words")), F.lit("Between 500 and 2000 words"), F.concat(F.lit("Names three causes of case "), n)]
    return v.documents.select("doc_id", validate.waiver(F.get(F.array(*texts), (F.col("doc_id") % 6).cast("int"))).alias("waiver"))


@query("p25_rubric_conversion", """SELECT qid, qid || '::c' || printf('%02d', row_number() OVER (PARTITION BY qid ORDER BY cid) - 1) AS cid, least(5, abs(weight)) AS weight,
 weight AS signed_weight, CASE WHEN weight < 0 THEN 'penalty' ELSE 'reward' END AS kind, CASE WHEN abs(weight) >= 4 THEN 'mandatory' ELSE 'optional' END AS tier
 FROM rubric""")
def p25(v: Views) -> DataFrame:
    return validate.convert_rubric(v.rubric)


@query("p26_information_criteria", "SELECT qid, cid, row_number() OVER (PARTITION BY qid ORDER BY cid) - 1 AS n, weight FROM rubric WHERE axis IN ('STANDARD', 'PROMO', 'SMALL') AND weight > 0")
def p26(v: Views) -> DataFrame:
    from pyspark.sql import Window as W

    r = v.rubric.filter(F.col("axis").isin("STANDARD", "PROMO", "SMALL") & (F.col("weight") > 0))
    return r.select("qid", "cid", (F.row_number().over(W.partitionBy("qid").orderBy("cid")) - 1).cast("long").alias("n"), "weight")


@query("p27_answer_form", """SELECT doc_id, doc_id % 5 = 0 AS python_code, CASE WHEN doc_id % 5 IN (1, 2, 3) THEN 'Blog post' ELSE '' END AS label,
CAST(CASE doc_id % 5 WHEN 1 THEN 5 WHEN 2 THEN doc_id % 7 + 3 WHEN 3 THEN 3 ELSE 0 END AS BIGINT) AS least_labels FROM documents""")
def p27(v: Views) -> DataFrame:
    """A request of five forms for each document, with a number of its own."""
    n = (F.col("doc_id") % 7 + 3).cast("string")
    forms = [F.lit("Write python code to sort"), F.lit("A series of five blog posts"), F.concat(F.lit("Make "), n, F.lit(" posts about tea")), F.lit("A series of blog posts on rain"), F.concat(F.lit("Explain rain, part "), n)]
    return v.documents.select("doc_id", F.get(F.array(*forms), (F.col("doc_id") % 5).cast("int")).alias("q")).select("doc_id", *validate.answer_form(F.col("q")))


SHAPES = ["(^ solar panel cost)", '(+ wind turbine) (^ NRC rules)', '"heat pump" (^ a b c d)', "(^ one two) (^ red green blue)", "alone", "(^ rain snow)", "wind << sea", "(# 3 tea milk)"]
#: A query of one of these shapes for each document, with a word of its own, in SQL and in Spark.
_SHAPED = f"t AS (SELECT doc_id, [{', '.join(repr(q) for q in SHAPES)}][doc_id % {len(SHAPES)} + 1] || ' x' || doc_id AS q FROM documents)"
_ARITY = r"coalesce(list_max(list_transform(regexp_extract_all(q, '\(\^([^()]*)\)', 1), lambda g: len(regexp_extract_all(g, '\S+')))), 0)"


def shaped(v: Views) -> DataFrame:
    q = F.get(F.array(*map(F.lit, SHAPES)), (F.col("doc_id") % len(SHAPES)).cast("int"))
    return v.documents.select("doc_id", F.concat(q, F.lit(" x"), F.col("doc_id").cast("string")).alias("q"))


@query("p28_query_shape", f"""WITH {_SHAPED} SELECT doc_id, CAST({_ARITY} AS BIGINT) AS arity,
regexp_matches(q, '"[^"]+"') AS phrase, contains(q, '(+ ') AS has_or, contains(q, '<<') OR contains(q, '>>') OR contains(q, '(# ') AS proximity, regexp_matches(q, '[A-Z]') AS entity,
CAST(len(regexp_extract_all(q, '[A-Za-z0-9]+')) AS BIGINT) AS atoms FROM t""")
def p28(v: Views) -> DataFrame:
    q = F.col("q")
    return shaped(v).select("doc_id", text.and_arity(q).cast("long").alias("arity"), text.has_phrase(q).alias("phrase"), text.has_or(q).alias("has_or"), text.has_proximity(q).alias("proximity"), text.has_entity(q).alias("entity"), text.n_atoms(q).cast("long").alias("atoms"))


@query("p29_query_bucket", f"""WITH {_SHAPED}, u AS (SELECT *, {_ARITY} AS a FROM t)
SELECT doc_id, CASE WHEN contains(q, '(+ ') THEN 'anchor+OR' WHEN regexp_matches(q, '"[^"]+"') THEN 'phrase-bearing' WHEN a >= 3 THEN 'multi-AND' WHEN a <= 1 THEN 'single-facet' ELSE 'other' END AS bucket FROM u""")
def p29(v: Views) -> DataFrame:
    return shaped(v).select("doc_id", text.shape(F.col("q")).alias("bucket"))


def term_sql(term: str) -> str:
    """Views b (item_id, text, term) and hits (doc_id, item_id): documents that hold the term whole."""
    return rf"""b AS (SELECT item_id, text, {term} AS term FROM benchmark), c AS (SELECT doc_id, trim(regexp_replace(lower(contents), '\s+', ' ', 'g')) AS t FROM corpus),
n AS (SELECT doc_id, item_id, t, term FROM c JOIN b ON contains(t, lower(term)))
, hits AS (SELECT doc_id, item_id FROM n WHERE regexp_matches(t, '(^|[^\p{{L}}\p{{N}}])' || regexp_replace(lower(term), '([\\.\[\]{{}}()*+?^$|])', '\\\1', 'g') || '($|[^\p{{L}}\p{{N}}])') AND term <> '')"""


WHOLE_TERM = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
HEAD = r"^(\S+ \S+ \S+ \S+)"


@query("p30_exact_term_containment", f"WITH {term_sql(WHOLE_TERM)} SELECT doc_id, item_id FROM hits")
def p30(v: Views) -> DataFrame:
    b = v.benchmark.select("item_id", text.compact(F.col("text")).alias("term")).filter("term != ''")
    return validate.term_matches(v.corpus.select("doc_id", "contents"), b)


@query("p31_evidence_grounding", f"""WITH {term_sql(f"regexp_extract(text, '{HEAD}', 1)")} SELECT h.doc_id, h.item_id, CASE WHEN NOT contains(d.text, b.text) THEN 'quote not in document' END AS error
FROM hits h JOIN b ON b.item_id = h.item_id JOIN documents d ON d.doc_id = h.doc_id""")
def p31(v: Views) -> DataFrame:
    """Every document that a quote's first four words lead to, checked for the whole quote."""
    heads = v.benchmark.select("item_id", F.regexp_extract("text", HEAD, 1).alias("term")).filter("term != ''")
    led = validate.term_matches(v.corpus.select("doc_id", "contents"), heads)
    d = led.join(v.benchmark.withColumnRenamed("text", "quote"), "item_id").join(v.documents.select("doc_id", "text"), "doc_id")
    return d.select("doc_id", "item_id", F.array_join(validate.grounding_errors(F.col("text"), F.col("quote"), F.col("quote")), "; ").alias("e")).select("doc_id", "item_id", F.nullif("e", F.lit("")).alias("error"))


@query("p32_fetched_only_citations", "SELECT config, qkey, chunk_id FROM runs r WHERE rnk <= 5 AND EXISTS (SELECT 1 FROM chunks c WHERE c.page = 2 AND c.docid = r.chunk_id)")
def p32(v: Views) -> DataFrame:
    fetched = v.chunks.filter("page = 2").select(F.col("docid").alias("chunk_id"))
    return v.runs.filter("rnk <= 5").join(fetched, "chunk_id", "left_semi").select("config", "qkey", "chunk_id")


@query("p33_completed_topics", "SELECT DISTINCT conv_id AS topic FROM (SELECT conv_id, max_by(role, turn) AS last_role, count(*) AS n FROM conversations GROUP BY 1) WHERE last_role = 'assistant' AND n >= 2")
def p33(v: Views) -> DataFrame:
    g = v.conversations.groupBy("conv_id").agg(F.max_by("role", "turn").alias("last_role"), F.count(F.lit(1)).alias("n"))
    return g.filter("last_role = 'assistant' AND n >= 2").select(F.col("conv_id").alias("topic")).distinct()


@query("p34_robustness_injection", "SELECT conv_id, md5(array_to_string(list(text || ' INJECTED' ORDER BY turn), '|')) AS body, 'run-' || conv_id || '-inj' AS run FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def p34(v: Views) -> DataFrame:
    a = v.conversations.filter("role = 'assistant'").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("s"))
    return a.select("conv_id", F.md5(F.array_join(F.transform("s", lambda s: F.concat(s, F.lit(" INJECTED"))), "|")).alias("body"), F.concat(F.lit("run-"), F.col("conv_id").cast("string"), F.lit("-inj")).alias("run"))


@query("p35_docid_prefix_search", r"SELECT docid FROM corpus WHERE starts_with(docid, 'shard_00003_1') OR docid = regexp_replace('shard_00004_4_p2', '_p\d+$', '')")
def p35(v: Views) -> DataFrame:
    exact = ids.unit_docid(F.lit("shard_00004_4_p2"))
    return v.corpus.filter(F.col("docid").startswith("shard_00003_1") | (F.col("docid") == exact)).select("docid")


@query("p36_document_page", "SELECT docid, substr(contents, 1, 80) AS preview FROM corpus ORDER BY docid LIMIT 25 OFFSET 50")
def p36(v: Views) -> DataFrame:
    return v.corpus.orderBy("docid").offset(50).limit(25).select("docid", F.substring("contents", 1, 80).alias("preview"))


@query("p37_stage_verification", r"""WITH s AS (SELECT docid, CASE WHEN doc_id % 5 = 0 THEN contents || ' ' WHEN doc_id % 5 = 1 THEN contents || 'x' ELSE contents END AS t FROM corpus WHERE doc_id % 10 <> 9)
SELECT c.docid, s.docid IS NOT NULL AS found, coalesce(s.t = c.contents, false) AS exact_text, coalesce(trim(regexp_replace(s.t, '\s+', ' ', 'g')) = trim(regexp_replace(c.contents, '\s+', ' ', 'g')), false) AS compact_text FROM corpus c LEFT JOIN s ON c.docid = s.docid""")
def p37(v: Views) -> DataFrame:
    m = F.col("doc_id") % 5
    s = v.corpus.filter("doc_id % 10 != 9").select("docid", F.when(m == 0, F.concat("contents", F.lit(" "))).when(m == 1, F.concat("contents", F.lit("x"))).otherwise(F.col("contents")).alias("t"))
    return validate.stage_checks(v.corpus.select("docid", "contents"), s)


@query("p38_fail_closed_payload", "SELECT doc_id, doc_id % 5 = 0 AS accepted, CASE doc_id % 5 WHEN 1 THEN 'grade' WHEN 2 THEN 'keys' WHEN 3 THEN 'json' WHEN 4 THEN 'keys' END AS problem FROM documents")
def p38(v: Views) -> DataFrame:
    """An answer of five kinds for each document."""
    n = F.col("doc_id").cast("string")
    grade = (F.col("doc_id") % 3).cast("string")
    payloads = [F.concat(F.lit('{"cid": '), n, F.lit(', "grade": '), grade, F.lit("}")), F.concat(F.lit('{"cid": '), n, F.lit(', "grade": 9}')), F.concat(F.lit('{"cid": '), n, F.lit("}")), F.concat(F.lit("not json "), n),
                F.concat(F.lit('{"cid": '), n, F.lit(', "grade": '), grade, F.lit(', "more": 1}'))]
    problem = validate.payload_problem(F.get(F.array(*payloads), (F.col("doc_id") % 5).cast("int")))
    return v.documents.select("doc_id", problem.alias("problem")).select("doc_id", F.col("problem").isNull().alias("accepted"), "problem")


MATRIX = """c AS (SELECT qid, cid FROM rubric WHERE weight > 0), s AS (SELECT qid, CASE WHEN cid % 97 = 0 THEN -cid ELSE cid END AS cid, CASE WHEN cid % 89 = 0 THEN 7 ELSE grade_a END AS score FROM rubric WHERE weight > 0 AND cid % 101 <> 0
 UNION ALL SELECT qid, cid, grade_b FROM rubric WHERE weight > 0 AND cid % 103 = 0),
g AS (SELECT qid, cid, count(*) AS n, count(*) FILTER (WHERE score NOT BETWEEN 0 AND 2) AS off FROM s GROUP BY 1, 2), j AS (SELECT coalesce(c.qid, g.qid) AS qid, c.cid AS want, g.n, g.off FROM c FULL JOIN g ON c.qid = g.qid AND c.cid = g.cid),
p AS (SELECT qid, 'missing' AS problem FROM j WHERE n IS NULL UNION ALL SELECT qid, 'unknown' FROM j WHERE want IS NULL UNION ALL SELECT qid, 'repeated' FROM j WHERE n > 1 UNION ALL SELECT qid, 'bounds' FROM j WHERE off > 0)"""


def matrix(v: Views) -> DataFrame:
    r = v.rubric.filter("weight > 0")
    c = F.col("cid")
    s = r.filter("cid % 101 != 0").select("qid", F.when(c % 97 == 0, -c).otherwise(c).alias("cid"), F.when(c % 89 == 0, 7).otherwise(F.col("grade_a")).alias("score"))
    s = s.unionByName(r.filter("cid % 103 = 0").select("qid", "cid", F.col("grade_b").alias("score")))
    return validate.matrix_problems(s, r.select("qid", "cid"), "qid", 0, 2)


@query("p38b_score_matrix", f"WITH {MATRIX} SELECT qid, problem, count(*) AS n FROM p GROUP BY 1, 2")
def p38b(v: Views) -> DataFrame:
    return matrix(v)


@query("p38c_accepted_matrices", f"WITH {MATRIX} SELECT DISTINCT qid FROM c WHERE qid NOT IN (SELECT qid FROM p)")
def p38c(v: Views) -> DataFrame:
    return validate.accepted(v.rubric.filter("weight > 0").select("qid").distinct(), matrix(v), "qid")


@query("p39_dropped_mentions", r"""WITH w AS (SELECT item_id, regexp_extract_all(text, '\S+') AS ws FROM benchmark), p AS (SELECT item_id, ws, array_to_string(list_filter(ws, lambda x, i: i % 3 <> 0), ' ') AS plan FROM w)
SELECT item_id, coalesce(array_to_string(list_filter(ws, lambda t: NOT contains(plan, t)), ' '), '') AS missing FROM p""")
def p39(v: Views) -> DataFrame:
    """Words of an item that a plan without every third of them lacks."""
    w = v.benchmark.select("item_id", F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)).alias("ws"))
    w = w.select("item_id", "ws", F.array_join(F.filter("ws", lambda x, i: (i + 1) % 3 != 0), " ").alias("plan"))
    return w.select("item_id", F.array_join(validate.dropped(F.col("ws"), F.col("plan")), " ").alias("missing"))


@query("p40_revision_guard", """WITH a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
b AS (SELECT conv_id, turn, CASE WHEN turn = 3 THEN text || '!' ELSE text END AS text FROM a WHERE NOT (conv_id % 9 = 0 AND turn = 1))
SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.turn, b.turn) AS turn, CASE WHEN b.turn IS NULL THEN 'removed' WHEN a.turn IS NULL THEN 'added' ELSE 'changed' END AS error
FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn WHERE a.text IS DISTINCT FROM b.text AND NOT (coalesce(a.conv_id, b.conv_id) % 2 = 0 AND b.turn IS NOT NULL AND a.turn IS NOT NULL)""")
def p40(v: Views) -> DataFrame:
    a = v.conversations.filter("role = 'assistant'").select("conv_id", "turn", "text")
    b = a.filter("NOT (conv_id % 9 = 0 AND turn = 1)").withColumn("text", F.when(F.col("turn") == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return validate.revision_errors(a, b, ["conv_id", "turn"], repairable=F.col("conv_id") % 2 == 0)


@query("p41_submission_contract", """WITH s AS (SELECT conv_id, count(*) FILTER (WHERE role = 'assistant') AS items, count(*) FILTER (WHERE role = 'user') AS needs FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN items = 0 THEN 'no item' WHEN items < needs THEN 'requirement without item' END AS error FROM s WHERE items = 0 OR items < needs""")
def p41(v: Views) -> DataFrame:
    needs = v.conversations.filter("role = 'user'").select("conv_id", F.col("turn").alias("need"))
    items = v.conversations.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("need"))
    return validate.submission_errors(needs, items)


_WORDS = "regexp_extract_all(term, '[A-Za-z0-9]+')"
_DULL = ", ".join(f"'{w}'" for w in validate.UNINFORMATIVE)
_NEG = ", ".join(f"'{w}'" for w in validate.NEGATIVES)


@query("p42_material_anchor", rf"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^\s.,]+(?: [^\s.,]+)?')) AS term FROM benchmark),
c AS (SELECT term, {_WORDS} AS ws, list_filter({_WORDS}, lambda x: lower(x) NOT IN ({_DULL})) AS content FROM w)
SELECT term, len(ws) > 0 AND lower(term) NOT IN ({_DULL}) AND (len(list_filter(ws, lambda x: regexp_matches(x, '[0-9]'))) > 0 OR (len(ws) >= 2 AND len(list_filter(ws, lambda x: lower(x) IN ({_NEG}))) > 0)
  OR len(content) >= 2 OR (len(content) = 1 AND (length(content[1]) >= 4 OR (length(content[1]) >= 2 AND regexp_matches(content[1], '[A-Z]'))))) AS material FROM c""")
def p42(v: Views) -> DataFrame:
    w = v.benchmark.select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\s.,]+(?: [^\s.,]+)?"), F.lit(0))).alias("term")).distinct()
    return w.select("term", validate.material(F.col("term")).alias("material"))
