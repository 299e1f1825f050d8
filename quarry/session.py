"""Session construction shared by tests, the benchmark and interactive use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def build_session(app: str = "quarry", cpus: str | int = "*", shuffle: int = 8, **extra: str) -> SparkSession:
    """A local session with the settings that the engine relies on: UTC, AQE, Arrow."""
    conf = {
        "spark.master": f"local[{cpus}]",
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g",
        "spark.driver.host": "127.0.0.1",
    } | extra
    spark = SparkSession.builder.appName(app).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    share_code(spark)
    return spark


def share_code(spark: SparkSession) -> None:
    """Python workers find this repository even when the driver started elsewhere."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if REPO not in have:
        env["PYTHONPATH"] = os.pathsep.join([REPO, *filter(None, have)])
