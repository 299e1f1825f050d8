"""Folders of what queries write."""

import pytest

from quarry.operators import retrieval as R
from quarry.streaming import store


def test_written_folders_can_be_deleted(spark):
    path = store.scratch(spark, "some")
    assert not store.written(spark, path)
    spark.range(5).write.parquet(path)
    assert store.written(spark, path)
    store.clean_up(spark)
    assert not store.written(spark, path)


def test_an_index_is_kept_while_its_files_are_there(spark):
    docs = spark.createDataFrame([("1", "red green red"), ("2", "blue"), ("3", None)], "docid string, contents string")
    first = R.kept_index(docs, "here")
    assert R.kept_index(docs, "here") is first and (first.n, first.avgdl) == (3, 4 / 3)
    assert sorted((r["term"], r["docid"], r["tf"], r["positions"]) for r in first.read(["red", "blue"]).collect()) == [("blue", "2", 1, [0]), ("red", "1", 2, [0, 2])]
    assert [r["term"] for r in first.read([], ["gr"]).collect()] == ["green"]
    store.clean_up(spark)
    assert R.kept_index(docs, "here") is not first


def test_clusters_need_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://somewhere:7077", "applicationId": "a"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.base(Cluster())
