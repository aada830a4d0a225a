"""Ordered operators over keys that may be very hot.

A plain window over a key sorts all rows of that key in one task.  These operators cut every
key into time buckets, work inside the buckets in parallel, and carry only one summary row
per (key, bucket) across them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DEFAULT_BUCKET_SECONDS = 3600


def time_bucket(time: Column, seconds: int) -> Column:
    """Index of the bucket of ``seconds`` length; rows without a time share bucket null."""
    return F.floor(F.unix_micros(time) / F.lit(seconds * 1_000_000)).cast("bigint")


def with_next(
    df: DataFrame,
    keys: list[str],
    time: str,
    tie: str,
    columns: list[str],
    out: str = "next",
    bucket_seconds: int = DEFAULT_BUCKET_SECONDS,
) -> DataFrame:
    """Add ``out``: a struct of ``columns`` of the key's next row by (time, tie), or null."""
    item = F.struct(F.col(time).alias("_t"), F.col(tie).alias("_i"), *columns)
    rows = df.withColumn("_bucket", time_bucket(F.col(time), bucket_seconds))
    inside = W.partitionBy(*keys, "_bucket").orderBy(time, tie)
    rows = rows.withColumn("_inside", F.lead(item).over(inside))

    heads = rows.groupBy(*keys, "_bucket").agg(F.min(item).alias("_head"))
    across = W.partitionBy(*keys).orderBy(F.col("_bucket").asc_nulls_first())
    following = heads.select(
        *keys, F.col("_bucket"), F.lead("_head").over(across).alias("_across")
    ).withColumnRenamed("_bucket", "_b")
    condition = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    condition.append(F.col("l._bucket").eqNullSafe(F.col("r._b")))
    joined = rows.alias("l").join(following.alias("r"), condition, "left")
    following_row = F.coalesce(F.col("l._inside"), F.col("r._across"))
    return joined.select(
        *[F.col(f"l.{name}") for name in df.columns],
        F.when(
            following_row.isNotNull(), F.struct(*[following_row[name].alias(name) for name in columns])
        ).alias(out),
    )


def with_running(
    df: DataFrame,
    keys: list[str],
    time: str,
    tie: list[str],
    sums: dict[str, Column],
    firsts: dict[str, Column] | None = None,
    bucket_seconds: int = DEFAULT_BUCKET_SECONDS,
) -> DataFrame:
    """Add running totals and running minima/maxima up to and including each row.

    ``sums`` become running sums.  ``firsts`` become the latest non-null value seen so far,
    taken as the running maximum, so their columns must grow with the order (times, ordinals,
    or structs that start with one).
    """
    firsts = firsts or {}
    rows = df.withColumn("_bucket", time_bucket(F.col(time), bucket_seconds))
    inside = W.partitionBy(*keys, "_bucket").orderBy(time, *tie).rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    rows = rows.select(
        "*",
        *[F.sum(e).over(inside).alias(f"_in_{n}") for n, e in sums.items()],
        *[F.max(e).over(inside).alias(f"_in_{n}") for n, e in firsts.items()],
    )
    totals = df.withColumn("_b", time_bucket(F.col(time), bucket_seconds)).groupBy(*keys, "_b").agg(
        *[F.sum(e).alias(n) for n, e in sums.items()],
        *[F.max(e).alias(n) for n, e in firsts.items()],
    )
    before = W.partitionBy(*keys).orderBy(F.col("_b").asc_nulls_first()).rowsBetween(
        W.unboundedPreceding, -1
    )
    carried = totals.select(
        *keys,
        "_b",
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_pre_{n}") for n in sums],
        *[F.max(n).over(before).alias(f"_pre_{n}") for n in firsts],
    )
    condition = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    condition.append(F.col("l._bucket").eqNullSafe(F.col("r._b")))
    joined = rows.alias("l").join(carried.alias("r"), condition, "left")
    return joined.select(
        *[F.col(f"l.{name}") for name in df.columns],
        *[(F.coalesce(F.col(f"l._in_{n}"), F.lit(0)) + F.col(f"r._pre_{n}")).alias(n) for n in sums],
        *[F.greatest(F.col(f"l._in_{n}"), F.col(f"r._pre_{n}")).alias(n) for n in firsts],
    )
