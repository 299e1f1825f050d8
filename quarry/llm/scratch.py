"""Intermediate tables in the folder that every executor can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.corpus import spread


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only where that is unset in a local session (tests), a folder of our own."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = getattr(spark, "_quarry_scratch", None) or f"file://{tempfile.mkdtemp(prefix='quarry-')}"
        spark._quarry_scratch = known
    return known.rstrip("/")


def folder(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{shared_dir(spark)}/quarry/{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, once its results are written."""
    _delete(spark, folder(spark))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def unique() -> str:
    return uuid.uuid4().hex


#: Short rows (ids, hashes, counts) that go in one file at least, where a table has them.
ROWS_PER_FILE = 250_000


def files_for(spark: SparkSession, rows: int) -> int:
    """How many files a table of so many short rows, at most, should have: one a core, more as it grows."""
    return max(spark.sparkContext.defaultParallelism, rows // ROWS_PER_FILE)


def table(df: DataFrame, sort: str | None = None, files: int | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder, in at most `files` files, and read it back.

    The lineage ends there: a lost executor costs a re-read, never a recomputation of the plan above.
    """
    if files:
        df = df.coalesce(files)
    spark = df.sparkSession
    path = f"{folder(spark)}/{unique()}"
    (df.sortWithinPartitions(sort) if sort else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


#: Keys up to this number (some 20 MB in memory) go to every task; more are joined by shuffle, texts and all.
FEW_KEYS = 200_000


def without(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """docs less the rows whose key is in `gone`, which is written first and counted."""
    gone = table(gone, files=files_for(docs.sparkSession, 0))
    return docs.join(F.broadcast(gone) if gone.count() <= FEW_KEYS else gone, key, "left_anti")


def discard(df: DataFrame) -> None:
    """Delete a table that table() wrote and that no later plan reads."""
    if path := getattr(df, "_quarry_path", None):
        _delete(df.sparkSession, path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(table) if name in ("documents", "pages") else table


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def hash_limit(share: float) -> int:
    """The largest 64-bit signed hash within the least `share` of them all; no share above 0 is too small to hold any."""
    return min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))


def small_batches(df: DataFrame) -> DataFrame:
    """Bound what a Python worker holds at once: Arrow batches of at most 500 rows and 4 MB, before any Python map."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4194304")
    return df
