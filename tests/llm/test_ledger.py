from __future__ import annotations

from pyspark.sql import functions as F

from lorespark.llm import ledger as L

SCHEMA = "case_id BIGINT, use_case STRING, test_case STRING, bucket STRING, copies STRING"
ROWS = [
    (5, "Über export", "The job pins", "x", "y"),
    (2, "the JOB　pins…", "über-EXPORT", "x", "y"),
    (9, "Über export ", "the job.pins", "x", "y"),
    (1, "Uber export", "The job pins", "x", "y"),
    (3, None, "a", "x", "y"),
    (4, "…", "a", "x", "y"),
    (6, "", "a", None, None),
    (7, "a", "b", None, None),
    (7, "a", "b", None, None),
]


def groups(rows, ledger):
    return {tuple(r) for r in L.copies_of(rows, ledger).collect()}


def fed(spark, tmp_path, df, delivery=None, buckets=8):
    rows = L.keyed(df, "case_id", ["use_case", "test_case"], delivery)
    return rows, L.feed_all(L.Ledger(spark, f"file://{tmp_path}/ledger{buckets}", buckets), rows)


def test_formatting_and_exchange(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for batches in (1, 3):
        rows, ledger = fed(spark, tmp_path, df, F.pmod("case_id", F.lit(batches)), 7 + batches)
        assert groups(rows, ledger) == {(2, 5), (2, 9)}
        assert {(r.keep_id, r.copies) for r in ledger.collect()} == {(2, 3), (1, 1), (7, 2)}


def test_a_small_batch_touches_its_buckets_only(spark, tmp_path):
    df = spark.range(400).select(F.col("id").alias("case_id"), F.col("id").cast("string").alias("use_case"), F.lit("t").alias("test_case"))
    fed(spark, tmp_path, df, buckets=16)
    stamps = lambda: {f: f.stat().st_mtime_ns for f in tmp_path.glob("ledger16/bucket=*/*.parquet")}
    before = stamps()
    again = L.Ledger(spark, f"file://{tmp_path}/ledger16", 16)  # as a later job would
    again.feed(L.keyed(spark.createDataFrame([(900, " 7", "T!")], "case_id BIGINT, use_case STRING, test_case STRING"), "case_id", ["use_case", "test_case"]))
    after = stamps()
    assert len({f.parent for f in set(before) - set(after)}) == 1 and len(before) >= 16
    assert again.read().count() == 400 and [tuple(r) for r in again.read().where("copies > 1").select("copies", "keep_id").collect()] == [(2, 7)]


def test_empty(spark, tmp_path):
    rows, ledger = fed(spark, tmp_path, spark.createDataFrame([], SCHEMA))
    assert groups(rows, ledger) == set()


def test_hot_group(spark, tmp_path):
    df = spark.range(6000).select(F.col("id").alias("case_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("use_case"), F.lit("t").alias("test_case"))
    found = L.copies_of(*fed(spark, tmp_path, df, F.pmod("case_id", F.lit(2))))
    assert found.count() == 1999 and found.select("keep_id").distinct().count() == 1
