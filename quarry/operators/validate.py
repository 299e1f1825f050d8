"""Validation and labelling operators: every rule gives rows of violations, never a silent drop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as T

WORD_CAP, CITATION_CAP = 1024, 3


def training_label(committed: Column, reasons: Column) -> list[Column]:
    """(label, reason): committed, then duplicate, never judged, voided, and only else negative."""
    voided = F.forall(reasons, lambda r: r == "void")
    reason = F.when(committed, "committed").when(F.array_contains(reasons, "duplicate"), "duplicate").when(F.size(reasons) == 0, "never_judged").when(voided, "voided").otherwise("rejected")
    label = F.when(committed, "positive").when(F.array_contains(reasons, "duplicate") | (F.size(reasons) == 0) | voided, "unjudged").otherwise("negative")
    return [label.alias("label"), reason.alias("reason")]


def answers_of(conversations: DataFrame) -> DataFrame:
    """Answers in the shape of the checks: each assistant turn a sentence, the i-th citing references 0 to i."""
    said = F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text")))
    g = conversations.groupBy("conv_id").agg(F.transform(F.array_sort(said), lambda x: x["text"]).alias("texts"), F.count_if(F.col("role") == "user").alias("n_refs"))
    cited = F.transform("texts", lambda t, i: F.struct(t.alias("text"), F.sequence(F.lit(0), i).alias("citations")))
    return g.select("conv_id", cited.alias("answer"), "n_refs")


def answer_violations(answers: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, rule, n) from answers (key, answer[text, citations], n_refs)."""
    words = F.aggregate("answer", F.lit(0), lambda s, x: s + T.n_words(x["text"]))
    many = F.size(F.filter("answer", lambda x: F.size(x["citations"]) > CITATION_CAP))
    last = F.col("n_refs") - 1
    wide = F.aggregate("answer", F.lit(0), lambda s, x: s + F.size(F.filter(x["citations"], lambda c: (c >= last) | (c < 0))))
    rules = F.array(
        F.struct(F.lit("words").alias("rule"), F.when(words > WORD_CAP, 1).otherwise(0).alias("n")),
        F.struct(F.lit("citations").alias("rule"), many.alias("n")),
        F.struct(F.lit("range").alias("rule"), wide.alias("n")),
        F.struct(F.lit("empty").alias("rule"), F.when(F.size("answer") == 0, 1).otherwise(0).alias("n")),
    )
    return answers.select(key, F.explode(rules).alias("r")).select(key, "r.rule", F.col("r.n").cast("long").alias("n")).filter("n > 0")


def conformance(violations: DataFrame, key: str = "conv_id") -> DataFrame:
    """Per run and rule, hard or advisory: violations and answers touched."""
    hard = F.col("rule").isin("range", "empty")
    return violations.groupBy("run", "rule", hard.alias("hard")).agg(F.sum("n").alias("violations"), F.countDistinct(key).alias("answers"))


def run_file_checks(run: DataFrame, docid: str) -> DataFrame:
    """Violations per rule of runs in file order (config, line, qkey, rnk, score, chunk_id)."""
    w = W.partitionBy("config").orderBy("line")
    p = run.select("config", "qkey", "chunk_id", "score", "rnk", F.lag("qkey").over(w).alias("q0"), F.lag("score").over(w).alias("s0"), F.lag("rnk").over(w).alias("r0"))
    starts = ~F.col("q0").eqNullSafe(F.col("qkey"))
    rules = F.array_compact(
        F.array(
            F.when(F.col("rnk") != F.when(starts, 1).otherwise(F.col("r0") + 1), "ranks"),
            F.when((F.col("q0") == F.col("qkey")) & (F.col("score") > F.col("s0")), "scores"),
            F.when(~F.col("chunk_id").rlike(docid), "docid"),
        )
    )
    rows = p.select("config", F.explode(rules).alias("rule")).groupBy("config", "rule").agg(F.count(F.lit(1)).alias("n"))
    split = p.filter(starts).groupBy("config", "qkey").count().filter("count > 1").groupBy("config").agg(F.count(F.lit(1)).alias("n")).select("config", F.lit("contiguous").alias("rule"), "n")
    return rows.unionByName(split)


# Patterns of criteria that plain prose of at most WORD_CAP words can't meet.
VISUAL = r"(?i)\b(diagram|figures?|images?|illustrations?|pictures?|drawings?|screenshots?|flowcharts?|infographics?|visual aids?)\b"
CITATION_APPARATUS = r"(?i)\b(?:official format|MLA|APA\b|Chicago(?: style)?|IEEE\b|BibTeX|footnotes?|bibliograph|reference list|works cited|displays? the citations|citations? (?:are )?(?:displayed|listed))\b"
MARKDOWN = r"(?i)\b(markdown|bullet(?:ed)? (?:point|list)|numbered list|table format|in a table|as a table|tables?\b[^.]{0,40}\b(?:format|column|row)|section headers?|headings?|code block|latex|rendered)\b"
RANGE_BOUND = r"(?i)\bbetween\s+([\d,]{3,6})\s*(?:and|-|–|to)\s*([\d,]{3,6})\s*words?\b"
LOWER_BOUND = r"(?i)\b(?:at least|no fewer than|minimum of|more than|exceed(?:s|ing)?|longer than)\s+(?:approximately\s+)?([\d,]{3,6})\s*words?\b"


def waiver(text: Column) -> Column:
    """Why a criterion can't be met; the first rule that fits, or null."""
    number = lambda p, g: F.regexp_replace(F.regexp_extract(text, p, g), ",", "").try_cast("int")
    return (
        F.when(text.rlike(VISUAL), "visual")
        .when(text.rlike(CITATION_APPARATUS), "citation")
        .when(text.rlike(MARKDOWN), "markdown")
        .when(number(RANGE_BOUND, 1) > WORD_CAP, "words")
        .when(number(RANGE_BOUND, 2) > WORD_CAP, F.lit(None))
        .when(number(LOWER_BOUND, 1) > WORD_CAP, "words")
    )


def convert_rubric(rubric: DataFrame) -> DataFrame:
    n = F.row_number().over(W.partitionBy("qid").orderBy("cid")) - 1
    cid = F.concat(F.col("qid"), F.lit("::c"), F.format_string("%02d", n))
    size = F.abs("weight")
    return rubric.select("qid", cid.alias("cid"), F.least(F.lit(5).cast("long"), F.bround(size)).alias("weight"), F.col("weight").alias("signed_weight"), F.when(F.col("weight") < 0, "penalty").otherwise("reward").alias("kind"), F.when(size >= 4, "mandatory").otherwise("optional").alias("tier"))


# How a request asks for Python code, and number words.
PYTHON_CODE = r"(?i)(?:\b(?:include|provide|show|write)\b[^.\n]{0,80}\bpython\s+code\b)|(?:\bpython\s+(?:code|implementation|script)\b)|(?:\bimplement\b[^.\n]{0,80}\bin\s+python\b)"
NUMBER_WORDS = {"two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}


def answer_form(request: Column) -> list[Column]:
    """Forms that a request asks for in so many words: Python code, or repeated labelled posts (three at least)."""
    count = F.lower(F.regexp_extract(request, r"(?i)\b(\d+|two|three|four|five|six|seven|eight|nine|ten)\s+(?:blog\s+)?posts\b", 1))
    series = request.rlike(r"(?i)\bseries\s+of\s+(?:blog\s+)?posts\b") | (count != "")
    words = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv])
    n = F.coalesce(count.try_cast("int"), F.try_element_at(words, count), F.lit(3))
    return [request.rlike(PYTHON_CODE).alias("python_code"), F.when(series, "Blog post").otherwise("").alias("label"), F.when(series, F.greatest(F.lit(3), n)).otherwise(0).cast("long").alias("least_labels")]


def term_matches(docs: DataFrame, terms: DataFrame, head: int = 4) -> DataFrame:
    """(doc_id, item_id) where the document has the term whole. Joined on a hash of the term's first words, then checked.

    Only documents that hold these `head` words one after the other (all of a shorter term) meet the term, so nothing is compared with everything.
    """
    words = lambda c: F.regexp_extract_all(T.compact(F.lower(c)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    gram = lambda ws, at, n: F.xxhash64(F.array_join(F.slice(ws, at, n), " "))
    t = terms.select("item_id", "term", F.slice(words("term"), 1, head).alias("ws")).filter(F.size("ws") > 0)
    t = t.select("item_id", "term", F.size("ws").alias("n"), gram(F.col("ws"), 1, head).alias("h"))
    lengths = [r["n"] for r in t.select("n").distinct().collect()]  # `head` rows at most
    d = docs.select("doc_id", words("contents").alias("ws"))
    none = F.array().cast("array<long>")

    def grams_of(n: int) -> Column:
        return F.when(F.size("ws") >= n, F.transform(F.sequence(F.lit(1), F.size("ws") - n + 1), lambda i: gram(F.col("ws"), i, n))).otherwise(none)

    grams = [none, *map(grams_of, lengths)]
    found = d.select("doc_id", F.explode(F.array_distinct(F.concat(*grams))).alias("h"))
    heads = t.select("item_id", "h")
    near = found.join(F.broadcast(heads) if heads.limit(100_001).count() <= 100_000 else heads, "h").select("doc_id", "item_id").distinct()
    return near.join(terms.select("item_id", "term"), "item_id").join(docs, "doc_id").filter(T.contains_term(F.col("contents"), F.col("term"))).select("doc_id", "item_id")


def grounding_errors(text: Column, quote: Column, claim: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(~F.contains(text, quote), "quote not in document"),
            F.when(F.size(F.array_except(T.quantities(claim), T.quantities(quote))) > 0, "value not in quote"),
        )
    )


def stage_checks(corpus: DataFrame, stage: DataFrame) -> DataFrame:
    j = corpus.join(stage.select(F.col("docid").alias("s"), "t"), F.col("docid") == F.col("s"), "left")
    no = F.lit(False)
    return j.select("docid", F.col("s").isNotNull().alias("found"), F.coalesce(F.col("t") == F.col("contents"), no).alias("exact_text"), F.coalesce(T.compact(F.col("t")) == T.compact(F.col("contents")), no).alias("compact_text"))


def payload_problem(payload: Column) -> Column:
    """Why a judged payload is refused as a whole, or null: not JSON, other keys than cid and grade, grade out of range."""
    v = F.try_parse_json(payload)
    keys = F.json_object_keys(payload)
    grade = F.try_variant_get(v, "$.grade", "int")
    return F.when(v.isNull(), "json").when(~F.array_sort(keys).eqNullSafe(F.array(F.lit("cid"), F.lit("grade"))), "keys").when(grade.isNull() | ~grade.between(0, 3), "grade")


def dropped(terms: Column, plan: Column) -> Column:
    return F.filter(terms, lambda t: ~F.contains(plan, t))


def revision_errors(before: DataFrame, after: DataFrame, key: list[str], repairable: Column) -> DataFrame:
    """Items removed or added, and items changed that weren't repairable."""
    a = before.withColumnRenamed("text", "a").withColumn("in_a", F.lit(True))
    b = after.withColumnRenamed("text", "b").withColumn("in_b", F.lit(True))
    j = a.join(b, key, "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    return j.filter(~(both & repairable)).select(*key, F.when(F.col("in_b").isNull(), "removed").when(F.col("in_a").isNull(), "added").otherwise("changed").alias("error"))


def submission_errors(needs: DataFrame, items: DataFrame) -> DataFrame:
    """Answers without an item, or with fewer items than requirements."""
    n = needs.groupBy("conv_id").agg(F.count(F.lit(1)).alias("needs")).join(items.groupBy("conv_id").agg(F.count(F.lit(1)).alias("items")), "conv_id", "full_outer")
    n = n.fillna(0, ["needs", "items"])
    return n.select("conv_id", F.when(F.col("items") == 0, "no item").when(F.col("items") < F.col("needs"), "requirement without item").alias("error")).filter("error IS NOT NULL")


# Words that say nothing by themselves, and negatives.
UNINFORMATIVE = (
    "a amount amounts an and article authors change changes claim data date dates document effect effects evidence finding findings for from in information "
    "measure measured number numbers of paper population populations reported research result results said scope source states study that the this to value values with"
).split()
NEGATIVES = "failed failure lack lacked lacks neither never no none not without zero".split()


def material(term: Column) -> Column:
    """Whether a literal finishes a claim: digits do, negatives with a noun, two words of content, or one that is a name or of four letters."""
    words = F.regexp_extract_all(term, F.lit("[A-Za-z0-9]+"), F.lit(0))
    content = F.filter(words, lambda w: ~F.lower(w).isin(UNINFORMATIVE))
    negative = (F.size(words) >= 2) & F.exists(words, lambda w: F.lower(w).isin(NEGATIVES))
    only = F.get(content, F.lit(0))
    one = (F.size(content) == 1) & ((F.length(only) >= 4) | ((F.length(only) >= 2) & only.rlike("[A-Z]")))
    some = (F.size(words) > 0) & ~F.lower(term).isin(UNINFORMATIVE)
    return some & (F.exists(words, lambda w: w.rlike("[0-9]")) | negative | (F.size(content) >= 2) | F.coalesce(one, F.lit(False)))


def matrix_problems(scores: DataFrame, criteria: DataFrame, by: str, low: int, high: int) -> DataFrame:
    """(by, problem, n) of score matrices (by, cid, score) that must hold each criterion (by, cid) once, within bounds. A matrix with any problem is refused whole."""
    seen = scores.groupBy(by, "cid").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score").isNull() | ~F.col("score").between(low, high)).alias("off"))
    j = criteria.select(by, "cid", F.lit(True).alias("wanted")).join(seen, [by, "cid"], "full_outer")
    found = F.array_compact(
        F.array(
            F.when(F.col("n").isNull(), "missing"),
            F.when(F.col("wanted").isNull(), "unknown"),
            F.when(F.col("n") > 1, "repeated"),
            F.when(F.col("off") > 0, "bounds"),
        )
    )
    return j.select(by, F.explode(found).alias("problem")).groupBy(by, "problem").agg(F.count(F.lit(1)).alias("n"))


def accepted(keys: DataFrame, problems: DataFrame, by: str) -> DataFrame:
    """Keys without any problem."""
    return keys.join(problems, by, "left_anti")
