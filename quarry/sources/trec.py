"""Runs and judgments in TREC and JSON-lines form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _bad(what: str, line: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"{what}: "), line))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, line): a file's lines in order. Files are read whole by a task each, as order needs."""
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    return raw.select("file", F.posexplode(F.split("value", "\n")).alias("line", "value")).filter(F.trim("value") != "")


def parse_run(rows: DataFrame, strict: bool = True) -> DataFrame:
    """(config, qkey, chunk_id, rnk, score) of lines "qid Q0 docid rank score tag".

    strict: six columns, of a repeated (qid, docid) the line that comes first, order by rank. Else five at least, order by rank, docid, score.
    """
    c = F.split(F.trim("value"), r"\s+")
    least = 6 if strict else 5
    ok = F.size(c) == 6 if strict else F.size(c) >= least
    part = lambda i: F.get("c", F.lit(i))
    d = rows.select("file", "line", F.when(ok, c).otherwise(_bad("not a run line", F.col("value"))).alias("c"))
    d = d.select(F.regexp_replace("file", r"\.[^.]*$", "").alias("config"), "line", part(0).alias("qkey"), part(2).alias("chunk_id"), part(3).cast("int").alias("rank"), part(4).cast("double").alias("score"))
    w = W.partitionBy("config", "qkey")
    if strict:
        d = d.groupBy("config", "qkey", "chunk_id").agg(F.min_by(F.struct("rank", "score", "line"), "line").alias("x")).select("config", "qkey", "chunk_id", "x.*")
        order = w.orderBy("rank", "line")
    else:
        order = w.orderBy("rank", "chunk_id", "score")
    return d.select("config", "qkey", "chunk_id", F.row_number().over(order).alias("rnk"), "score")


def run_line(tag: str) -> Column:
    return F.format_string(f"%s Q0 %s %d %.6f {tag}", "qkey", "chunk_id", "rank", "score")


def format_run(run: DataFrame, tag: str, depth: int) -> DataFrame:
    """Lines of a run, ranks made anew from the order, `depth` a query."""
    r = F.row_number().over(W.partitionBy("config", "qkey").orderBy("rnk"))
    return run.withColumn("rank", r).filter(F.col("rank") <= depth).select("config", "qkey", "rank", run_line(tag).alias("value"))


def write_run(run: DataFrame, path: str, tag: str, depth: int = 1000) -> None:
    """One folder per configuration, sorted by query and rank."""
    rows = format_run(run, tag, depth)
    rows.repartitionByRange("config", "qkey").sortWithinPartitions("config", "qkey", "rank").select("config", "value").write.mode("overwrite").partitionBy("config").text(path)


def parse_qrels(rows: DataFrame) -> DataFrame:
    """(topic_id, chunk_id, grade) of lines "topic 0 chunk grade"; other widths and grades outside 0 to 3 are errors."""
    c = F.split(F.trim("value"), r"\s+")
    d = rows.select("value", F.when(F.size(c) == 4, c).otherwise(_bad("not a qrels line", F.col("value"))).alias("c"))
    grade = F.get("c", F.lit(3)).try_cast("int")
    return d.select(F.get("c", F.lit(0)).alias("topic_id"), F.get("c", F.lit(2)).alias("chunk_id"), F.when(grade.between(0, 3), grade).otherwise(_bad("grade", F.col("value")).cast("int")).alias("grade"))


def qrels_line() -> Column:
    return F.concat_ws(" ", "topic_id", F.lit("0"), "chunk_id", F.col("grade").cast("string"))


SNAPSHOT = "kind STRING, jkey STRING, prompt_version STRING, topic_id STRING, chunk_id STRING, grade INT, ts STRING"


def parse_snapshot(rows: DataFrame, version: str) -> DataFrame:
    """Qrels of a JSON-lines snapshot: explicit fields or the parts of jkey; null grades are left out, another version is an error."""
    j = rows.select(F.from_json("value", SNAPSHOT, {"mode": "FAILFAST"}).alias("r")).select("r.*").filter("kind IS NULL OR kind != 'cache_meta'")
    part = lambda n: F.split_part("jkey", F.lit("::"), F.lit(n))
    own = F.coalesce("prompt_version", part(1))
    checked = F.when(own == version, F.coalesce("topic_id", part(2))).otherwise(_bad("another prompt version", own))
    return j.filter("grade IS NOT NULL").select(checked.alias("topic_id"), F.coalesce("chunk_id", part(3)).alias("chunk_id"), "grade")


def load_run_folder(spark: SparkSession, path: str) -> DataFrame:
    """All *.txt runs of a folder, configuration from the file name."""
    return parse_run(lines(spark, f"{path}/*.txt"))


def queries_from(spark: SparkSession, path: str) -> DataFrame:
    """(topic_id, query) of a query file, its form told by its first line: JSON lines, a table with a header, or plain lines."""
    head = (spark.read.text(path).limit(1).collect() or [[""]])[0][0]
    if head.lstrip().startswith("{"):
        return spark.read.schema("topic_id STRING, query STRING").json(path, mode="FAILFAST").dropDuplicates()
    sep = "\t" if "\t" in head else ","
    names = [n.strip().lower().replace("-", "_").replace(" ", "_") for n in head.split(sep)]
    alias = {"qid": "topic_id", "topic": "topic_id", "id": "topic_id", "text": "query", "search_query": "query"}
    names = [alias.get(n, n) for n in names]
    if "query" in names:
        t = spark.read.option("header", "true").option("sep", sep).csv(path).toDF(*names)
        return t.select(F.col("topic_id") if "topic_id" in names else F.lit("q").alias("topic_id"), "query").dropDuplicates()
    if sep == "\t":
        v = F.split("value", "\t", 2)
        return spark.read.text(path).select(F.get(v, F.lit(0)).alias("topic_id"), F.get(v, F.lit(1)).alias("query")).dropDuplicates()
    return spark.read.text(path).filter("trim(value) != ''").select(F.lit("q").alias("topic_id"), F.trim("value").alias("query")).dropDuplicates()


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of append-only JSON-lines segments with segment and line; only a segment's last line may be torn."""
    rows = lines(spark, path).select("file", "line", "value", F.from_json("value", schema).alias("r"))
    last = F.max("line").over(W.partitionBy("file"))
    torn = F.try_parse_json("value").isNull()
    rows = rows.withColumn("last", last).filter(~(torn & (F.col("line") == F.col("last"))))
    return rows.select(F.col("file").alias("segment"), F.when(torn, _bad("damaged record", F.col("value")).cast("int")).otherwise(F.col("line")).alias("line"), "r.*")
