"""Vector and token shards: round trips, ranges, headers that don't fit, failed jobs."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.sources import binary as B


def vectors(spark, n, dim=5, parts=3):
    rows = [(f"d{i:04}", [float(i) + k / 8 for k in range(dim)]) for i in range(n)]
    return spark.createDataFrame(rows, "docid string, vec array<float>").repartitionByRange(parts, "docid").sortWithinPartitions("docid"), rows


@pytest.mark.parametrize("size", [B.RANGE, 100])
def test_vectors_come_back_in_order(spark, tmp_path, size):
    path = str(tmp_path / "v")
    d, rows = vectors(spark, 101)
    B.write(d, "fbin", path)
    assert sorted(f for f in os.listdir(path) if f.endswith(".fbin")) == [f"shard_{k:05}.fbin" for k in range(3)]
    assert not [f for f in os.listdir(path) if f.startswith("_")]
    got = B.read(spark, "fbin", path, size)
    assert [(r["row"], r["docid"], r["vec"]) for r in got.orderBy("row").collect()] == [(i, a, b) for i, (a, b) in enumerate(rows)]
    if size == 100:
        assert got.rdd.getNumPartitions() > 20
    B.write(spark.createDataFrame([("more", [0.0] * 5)], "docid string, vec array<float>"), "fbin", path)
    assert B.read(spark, "fbin", path).filter("row = 101").collect()[0]["docid"] == "more"


def test_a_shard_is_what_its_header_says(spark, tmp_path):
    path = tmp_path / "v"
    path.mkdir()
    (path / "a.fbin").write_bytes(struct.pack("<II", 2, 3) + np.arange(6, dtype="<f4").tobytes())
    (path / "a.docids.txt").write_text("x\ny")
    assert [r["vec"] for r in B.read(spark, "fbin", str(path)).orderBy("row").collect()] == [[0, 1, 2], [3, 4, 5]]
    for body, ids, error in ((struct.pack("<II", 3, 3) + bytes(24), "x\ny\nz\n", "it has 32"), (struct.pack("<II", 2, 4) + bytes(32), "x\ny\n", "dimension 4"), (struct.pack("<II", 2, 3) + bytes(24), "x\n", "2 rows and 1 ids")):
        (path / "b.fbin").write_bytes(body)
        (path / "b.docids.txt").write_text(ids)
        with pytest.raises(Exception, match=error):
            B.read(spark, "fbin", str(path)).collect()


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "v")
    d, _ = vectors(spark, 20)
    with pytest.raises(Exception, match="dimension"):
        B.write(d.withColumn("vec", F.when(F.col("docid") == "d0013", F.array(F.lit(1.0).cast("float"))).otherwise(F.col("vec"))), "fbin", path)
    with pytest.raises(Exception, match="dimension"):
        B.write(spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "docid string, vec array<float>").repartitionByRange(2, "docid"), "fbin", path)
    assert os.listdir(path) == []


@pytest.mark.parametrize("size", [B.RANGE, 64])
def test_tokens_come_back_with_their_offsets(spark, tmp_path, size):
    path = str(tmp_path / "t")
    rows = [(f"d{i:03}", [i * 7 + k for k in range(i % 9)]) for i in range(80)] + [("z", [4_294_967_295])]
    B.write(spark.createDataFrame(rows, "docid string, ids array<long>").repartitionByRange(2, "docid").sortWithinPartitions("docid"), "tokens", path)
    got = B.read(spark, "tokens", path, size).orderBy("row").collect()
    assert [(r["docid"], r["ids"]) for r in got] == rows
    lens, start = {}, 0
    for r in got:  # starts begin anew with each shard
        start = 0 if r["start"] == 0 and r["row"] else start
        assert r["start"] == start
        start += len(r["ids"])


def test_lengths_that_dont_fit_are_errors(spark, tmp_path):
    path = tmp_path / "t"
    path.mkdir()
    (path / "a.ids.u32").write_bytes(np.arange(5, dtype="<u4").tobytes())
    (path / "a.docids.txt").write_text("x\ny\n")
    (path / "a.len.i16").write_bytes(np.array([2, 3], "<i2").tobytes())
    assert [r["ids"] for r in B.read(spark, "tokens", str(path)).orderBy("row").collect()] == [[0, 1], [2, 3, 4]]
    (path / "a.len.i16").write_bytes(np.array([2, 2], "<i2").tobytes())
    with pytest.raises(Exception, match="sum to 4 tokens, the store has 5"):
        B.read(spark, "tokens", str(path)).collect()
    (path / "a.len.i16").write_bytes(np.array([5], "<i2").tobytes())
    with pytest.raises(Exception, match="1 lengths and 2 ids"):
        B.read(spark, "tokens", str(path)).collect()
    with pytest.raises(Exception, match="32,767"):
        B.write(spark.createDataFrame([("a", list(range(40_000)))], "docid string, ids array<long>"), "tokens", str(tmp_path / "u"))
