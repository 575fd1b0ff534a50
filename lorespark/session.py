"""One place for the settings the library expects of a Spark session."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "lorespark", **extra: str) -> SparkSession:
    """A local session for tests and benches, with a checkpoint folder of its own. On a cluster the submitter's own settings are used instead."""
    if master.startswith("local"):
        extra.setdefault("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='spark-')}")
    builder = SparkSession.builder.master(master).appName(app).config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**SETTINGS, "spark.ui.enabled": "false", **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
