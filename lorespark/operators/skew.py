"""Joins that hold when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it owns more than this share of the rows, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.001


def attach_by_key(rows: DataFrame, facts: DataFrame, key: str, weight: str, total: Column | int) -> DataFrame:
    """``rows`` inner-joined with ``facts`` (one row per ``key``) without sending a hot key to one task.

    ``weight`` of ``facts`` says how many of the ``total`` rows have the key. The hot keys are at most
    1 / HOT_SHARE = 1000 by arithmetic, whatever the data, so that side is safe to broadcast; their rows stay where they are.
    All other rows meet their fact in a shuffle in which no key exceeds HOT_SHARE of the rows.
    Rows with a null key match nothing. ``weight`` and ``key`` stay in the result.
    """
    hot = facts.where(F.col(weight) > F.lit(HOT_SHARE) * total)
    cold = facts.where(F.col(weight) <= F.lit(HOT_SHARE) * total)
    hot_keys = F.broadcast(hot.select(key))
    found_hot = rows.join(F.broadcast(hot), key, "inner")
    found_cold = rows.join(hot_keys, key, "left_anti").join(cold, key, "inner")
    return found_hot.unionByName(found_cold.select(found_hot.columns))


def first_rows(rows: DataFrame, key: str, order: list[str], last: bool = False) -> DataFrame:
    """The first row of each non-null key by ``order`` (nulls first), or the last; rows that are equal in all of these all stay.

    Only keys and order are aggregated, map-side first; the join back is on all of them, so the rows of a key that is met very often are
    spread over the tasks.
    """
    pick = F.max if last else F.min
    known = rows.where(F.col(key).isNotNull())
    chosen = known.groupBy(F.col(key).alias("_key")).agg(pick(F.struct(*order)).alias("_order")).select("_key", *[F.col(f"_order.{c}").alias(f"_{c}") for c in order])
    same = F.col(key) == F.col("_key")
    for c in order:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return known.join(chosen, same, "left_semi")


#: Rows of a few hundred bytes that may be sent to every task.
SMALL = 200_000


def small_side(df: DataFrame, limit: int = SMALL) -> DataFrame:
    """``df`` broadcast if it has at most ``limit`` rows by count, else as it is, to be joined in a shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores if its files have fewer splits than there are cores; large tables are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
