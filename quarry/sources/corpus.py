"""Corpus sources: schema discovery, row identity, record sinks."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Column names tried in this order.
ID_FIELDS = ("id", "docid", "doc_id", "document_id")
TEXT_FIELDS = ("text", "contents", "content", "body")


def id_candidates(columns: list[str], preferred: str | None = None) -> list[str]:
    """Columns that may hold the id: the preferred one, well-known names, then any that has "id" in it."""
    named = [c for c in ID_FIELDS if c in columns]
    rest = [c for c in columns if "id" in c.lower()]
    first = [preferred] if preferred and preferred in columns else []
    return list(dict.fromkeys([*first, *named, *rest]))


def text_field(columns: list[str], preferred: str | None = None) -> str:
    if preferred:
        if preferred not in columns:
            raise ValueError(f"no column {preferred}")
        return preferred
    for c in TEXT_FIELDS:
        if c in columns:
            return c
    raise ValueError(f"no text column among {columns}")


def with_row_numbers(df: DataFrame) -> DataFrame:
    """file_stem and row_number, the row's place in its file, from Spark's own row index of Parquet files."""
    stem = F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.[^.]*)?$", 1)
    return df.select("*", stem.alias("file_stem"), F.col("_metadata.row_index").alias("row_number"))


def with_table_row_numbers(df: DataFrame, path: str) -> DataFrame:
    """The same for a table that may be a folder: its name's stem, and rows numbered on over its files in order of their paths.

    What is known of a file is its number of rows, which its footer tells.
    """
    file = F.col("_metadata.file_path")
    files = sorted(df.select(file.alias("file")).groupBy("file").count().collect())
    starts = list(zip((f for f, _ in files), accumulate((n for _, n in files), initial=0)))
    before = df.sparkSession.createDataFrame(starts, "_file string, _before long")
    rows = df.select("*", file.alias("_file"), F.col("_metadata.row_index").alias("_row")).join(F.broadcast(before), "_file")
    stem = path.rstrip("/").rsplit("/", 1)[-1]
    return rows.withColumn("file_stem", F.lit(stem.rsplit(".", 1)[0] or stem)).withColumn("row_number", F.col("_before") + F.col("_row")).drop("_file", "_before", "_row")


def scan_parquet(spark: SparkSession, path: str | list[str], preferred_id: str | None = None, preferred_text: str | None = None, table: bool = False) -> DataFrame:
    """(docid, contents, source_file, row_number, mode): the first non-empty string id, else <stem>_<row>.

    Only the id candidates and the text column are read. `table`: the path is one table, be it a file or a folder of files.
    """
    df = spark.read.option("recursiveFileLookup", "true").parquet(*([path] if isinstance(path, str) else path))
    strings = dict(df.dtypes)
    text = text_field(df.columns, preferred_text)
    ids = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in id_candidates(df.columns, preferred_id) if strings[c] in ("string", "binary")]
    rows = with_table_row_numbers(df, path) if table and isinstance(path, str) else with_row_numbers(df)
    own = F.coalesce(*ids, F.lit(None).cast("string"))
    made = F.concat("file_stem", F.lit("_"), F.col("row_number").cast("string"))
    return rows.select(F.coalesce(own, made).alias("docid"), F.coalesce(F.col(text), F.lit("")).alias("contents"), F.col("file_stem").alias("source_file"), "row_number", F.when(own.isNull(), "row").otherwise("field").alias("mode"))


def expand(inputs: list[str], spark: SparkSession) -> list[str]:
    """Files of globs and folders (searched through), sorted, without repeats; through Hadoop's file systems."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    found: set[str] = set()
    for item in inputs:
        p = jvm.org.apache.hadoop.fs.Path(item)
        fs = p.getFileSystem(conf)
        for status in fs.globStatus(p) or []:
            if status.isDirectory():
                it = fs.listFiles(status.getPath(), True)
                while it.hasNext():
                    f = it.next().getPath()
                    if not f.getName().startswith(("_", ".")):
                        found.add(f.toString())
            else:
                found.add(status.getPath().toString())
    return sorted(found)


def record_line(fmt: str) -> F.Column:
    """A record (docid, contents) as one line of a format: jsonl, corpus-jsonl, tsv or text."""
    flat = F.regexp_replace("contents", r"[\t\r\n]+", " ")
    if fmt == "jsonl":
        return F.to_json(F.struct("docid", "contents"))
    if fmt == "corpus-jsonl":
        return F.to_json(F.struct(F.col("docid").alias("id"), "contents"))
    if fmt == "tsv":
        return F.concat("docid", F.lit("\t"), flat)
    if fmt == "text":
        return flat
    raise ValueError(fmt)


def write_records(df: DataFrame, fmt: str, path: str) -> None:
    """Text files through Spark's committer: a failed task leaves nothing, a rerun replaces the folder."""
    df.select(record_line(fmt).alias("value")).write.mode("overwrite").text(path)


def spread(df: DataFrame) -> DataFrame:
    """A small table in a few files dealt to all cores before work on its texts; one of many splits stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if splits < 2 * cores else df
