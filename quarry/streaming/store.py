"""Folders for what queries and streams write: in the cluster's shared checkpoint folder where it names one."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def base(spark: SparkSession) -> str:
    """This application's part of the folder that spark.checkpoint.dir names. Only a local session may do without one: there it is a folder of our own."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = getattr(spark, "_quarry_store", None) or f"file://{tempfile.mkdtemp(prefix='quarry-')}"
        spark._quarry_store = known
    return f"{known.rstrip('/')}/store/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    return f"{base(spark)}/{name}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def written(spark: SparkSession, path: str) -> bool:
    """Whether a writer has committed this folder."""
    p, fs = _path(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def folders(spark: SparkSession, path: str) -> list[int]:
    """Folders of a folder whose names are numbers."""
    p, fs = _path(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n) for n in names if n.isdigit())


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def clean_up(spark: SparkSession) -> None:
    """Delete all that this application's queries have written here, once their results are taken."""
    p, fs = _path(spark, base(spark))
    fs.delete(p, True)
