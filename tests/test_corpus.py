"""Scans of tables in one file and in several."""

import duckdb

from quarry import registry
from tests.compare import rows_of_spark, rows_of_sql

NAME = "s01_corpus_scan"


def test_a_table_of_several_files_is_numbered_as_one(spark, sf, tmp_path):
    path = tmp_path / "documents.parquet"
    path.mkdir()
    con = duckdb.connect()
    for i in range(3):
        con.execute(f"COPY (SELECT * FROM '{sf}/documents.parquet' WHERE doc_id // 40 = {i}) TO '{path}/part-000{i}.parquet'")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    cols, rows = rows_of_spark(registry.queries()[NAME](spark, str(tmp_path)))
    want_cols, want = rows_of_sql(con, registry.oracle_sql()[NAME])
    assert cols == want_cols and len(rows) > 100
    assert rows == want
