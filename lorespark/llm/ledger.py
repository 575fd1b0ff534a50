"""Duplicates hidden by formatting: an incremental ledger of canonical keys.

Each record is reduced to a canonical key: the letters and digits of each field, case-folded, the fields sorted, so that
spelling habits and exchanged fields give the same key. The ledger holds one row per key with the number of copies and the
earliest representative, in a folder of hash buckets that outlives the job. A batch is aggregated first (map-side, so a key that owns a third of
all rows is one row per task before any shuffle), then full-outer-joined with the buckets that it touches; only these are read and
written again. Choose as many buckets as make one of them a file of convenient size; a small batch then touches few.

Defined results: a record whose every copy has a null, blank or letterless field is left out; ties of the earliest
representative do not arise, since the smallest id wins; repeated ids count each time they are given; an empty batch leaves the
ledger as it is; columns other than the named ones are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions.text import letters_digits
from lorespark.operators.skew import attach_by_key
from lorespark.plans.durable import durable, release

LEDGER = "dup_key BINARY, copies BIGINT, keep_id BIGINT, bucket INT"


def canonical_key(*fields: Column) -> Column:
    """A 16-byte digest of the canonical fields in sorted order; null if a field has no letter or digit."""
    parts = F.array(*[letters_digits(f) for f in fields])
    usable = ~F.exists(parts, lambda p: p.isNull() | (p == ""))
    return F.when(usable, F.unhex(F.md5(F.array_join(F.sort_array(parts), "\u0001").cast("binary"))))


def keyed(df: DataFrame, id_col: str, fields: list[str], delivery: Column | None = None) -> DataFrame:
    """(dup_key, row_id, delivery) of every record that has a key."""
    out = df.select(canonical_key(*[F.col(f) for f in fields]).alias("dup_key"), F.col(id_col).cast("bigint").alias("row_id"), (F.lit(0) if delivery is None else F.coalesce(delivery, F.lit(0))).cast("int").alias("delivery"))
    return out.where("dup_key IS NOT NULL AND row_id IS NOT NULL")


class Ledger:
    """The counts so far, one folder a bucket below ``folder``; a folder written before is taken up again."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def read(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return (self.spark.read.schema(LEDGER).parquet(self.folder) if there else self.spark.createDataFrame([], LEDGER)).select(*[c.split()[0] for c in LEDGER.split(", ")])

    def feed(self, batch: DataFrame) -> None:
        """Add the records of a batch (from :func:`keyed`): counts added, the smaller representative kept."""
        bucket = F.pmod(F.xxhash64("dup_key"), F.lit(self.buckets)).cast("int").alias("bucket")
        new = durable(batch.groupBy(bucket, "dup_key").agg(F.count("*").alias("n"), F.min("row_id").alias("first_id")))
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most as many as there are buckets
        matching = self.read().where(F.col("bucket").isin(touched))  # other folders aren't opened
        merged = matching.join(new, ["bucket", "dup_key"], "full_outer").select(
            "dup_key", (F.coalesce("copies", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("copies"), F.least("keep_id", "first_id").alias("keep_id"), "bucket"
        )
        # staged in the folder of the ledger and put in the place of the touched buckets when all of it is written
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.folder)
        release(new)


def feed_all(ledger: Ledger, rows: DataFrame) -> DataFrame:
    """The ledger after all deliveries of ``rows`` (from :func:`keyed`), in order; the deliveries' numbers are the caller's own, so they are few."""
    for number in sorted(r[0] for r in rows.select("delivery").distinct().collect()):
        ledger.feed(rows.where(F.col("delivery") == number))
    return ledger.read()


def copies_of(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """(keep_id, copy_id): every record that is not its group's representative. Hot groups are not sent to one task."""
    groups = ledger.where("copies > 1").select("dup_key", "copies", "keep_id")
    total = ledger.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    linked = attach_by_key(rows.select("dup_key", "row_id"), groups, "dup_key", "copies", total)
    return linked.where("row_id <> keep_id").select("keep_id", F.col("row_id").alias("copy_id"))
