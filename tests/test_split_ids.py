"""Split ids of a split with more than 99,999 rows, against the SQL: numbers grow longer than five digits."""

import os

import duckdb

from veilspark.plans import ORACLE, QUERIES


def test_large_splits_keep_their_whole_numbers(spark, tmp_path):
    spark.range(150_000).withColumnRenamed("id", "doc_id").coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in QUERIES["a8_write_splits"](spark, f"file://{tmp_path}").select("doc_id", "split", "split_id").collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{os.path.join(tmp_path, 'documents.parquet')}/*.parquet'")
    want = sorted(db.execute(ORACLE["a8_write_splits"]).fetchall())
    assert got == want and "train-100000" in {r[2] for r in want}
