"""The registered queries against their SQL, and the pipeline against its stages one by one."""

import hashlib

import pytest

import corpus_pipeline
from quarry.llm import byte_bpe, decontaminate, divergence, jaccard_join, queries, scratch, weak_label
from tests.compare import connect, rows_of_spark, rows_of_sql
from tests.llm.test_operators import brute_links


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf, name):
    cols, rows = rows_of_spark(queries.QUERIES[name](spark, sf))
    want_cols, want = rows_of_sql(connect(sf), queries.ORACLES[name])
    assert cols == want_cols and rows == want and rows


def test_pipeline_keeps_what_each_stage_keeps(spark, sf):
    docs = scratch.read(spark, sf, "documents")
    kept = {r["doc_id"] for r in divergence.rule_table(docs).collect() if r["kept"]}
    part = docs.filter(docs["doc_id"].isin(list(kept)))
    kept = {r["doc_id"] for r in weak_label.score_table(part).collect() if r["kept"]}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in kept}
    _, root = brute_links(texts)
    texts = {i: t for i, t in texts.items() if root[i] == i}
    items = {r["item_id"]: r["text"].lower() for r in scratch.read(spark, sf, "benchmark").collect()}
    leaked = {i for i, t in texts.items() if any(x in t.lower() for x in items.values())}
    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items() if i not in leaked}
    got = {r["doc_id"]: r["decoded_sha256"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want
    assert leaked and len(want) > 100


def test_pipeline_on_odd_and_empty_tables(spark, sf, tmp_path):
    """Null ids, ids that repeat, repeated rows, null and empty texts, and more columns."""
    from pyspark.sql import functions as F

    docs = scratch.read(spark, sf, "documents")
    odd = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") % 3 == 1, 7).otherwise(F.col("doc_id")))
    odd = odd.unionByName(odd.limit(9)).unionByName(spark.createDataFrame([(5, None, None, None, None), (None, "", "en", "a", 0)], docs.schema))
    extra = odd
    for c in ("key", "_key", "found", "f", "score", "kept", "toks"):
        extra = extra.withColumn(c, F.lit("mine"))
    extra.write.parquet(f"{tmp_path}/odd/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    for part in ("odd", "none"):
        scratch.read(spark, sf, "benchmark").write.parquet(f"{tmp_path}/{part}/benchmark.parquet")
    whole = sorted(r["decoded_sha256"] for r in corpus_pipeline.run(spark, sf).collect())
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert {r["doc_id"] for r in got if r["doc_id"] is not None} >= {7}
    # the same texts stay, but for those of which the copies' ids now name another one as the first
    assert len(got) == len(whole) and len({r["decoded_sha256"] for r in got} & set(whole)) >= 0.9 * len(whole)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_stages_are_named():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_duplicates", "decontamination", "encoding"]


def test_intermediate_tables_can_be_deleted(spark, sf, tmp_path):
    import os

    docs = scratch.read(spark, sf, "documents")
    jaccard_join.links(docs).count()
    path = scratch.folder(spark).removeprefix("file://")
    assert os.listdir(path)
    scratch.clean_up(spark)
    assert not os.path.exists(path)
