"""Sums of long count vectors over tasks: each task hands on its vector in pieces, groups of tasks are added in a tree.

No task holds more than `FAN` copies of one piece, however many tasks there are, and nothing passes the driver but the
sum itself, whose size is fixed by its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a piece, and tasks that are added at once.
PIECE = 1 << 16
FAN = 256
SCHEMA = "piece long, task long, data binary"


def pieces(vector: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The pieces of a task's vector that aren't all zero."""
    step, task = PIECE // vector.itemsize, TaskContext.get().partitionId()
    rows = [(k, task, part.tobytes()) for k, part in enumerate(vector[i : i + step] for i in range(0, len(vector), step)) if part.any()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], names=["piece", "task", "data"])


def total(rows: DataFrame, tasks: int, length: int, kind: str, most: int) -> np.ndarray:
    """The sum of the vectors that `tasks` tasks have handed on, each number held at `most`."""

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        s = np.zeros(len(group["data"].iloc[0]) // np.dtype(kind).itemsize, np.int64)
        for x in group["data"]:
            s = np.minimum(s + np.frombuffer(x, kind), most)
        return pd.DataFrame({"piece": [key[0]], "task": [key[1]], "data": [s.astype(kind).tobytes()]})

    while tasks > 1:
        tasks = -(-tasks // FAN)
        rows = rows.groupBy("piece", F.floor(F.col("task") / FAN).alias("task")).applyInPandas(add, SCHEMA)
    out, step = np.zeros(length, kind), PIECE // np.dtype(kind).itemsize
    for r in rows.select("piece", "data").collect():
        out[r["piece"] * step : r["piece"] * step + len(r["data"]) // out.itemsize] = np.frombuffer(r["data"], kind)
    return out


def splits(df: DataFrame) -> int:
    """Tasks that a narrow map of df has."""
    return df._jdf.queryExecution().toRdd().getNumPartitions()
