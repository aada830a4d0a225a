"""Nearest-in-time join within a tolerance, without comparing pairs.

Both sides are reduced to distinct (key, time) points first; each point then looks at the last
candidate before it and the first one after it, inside time buckets of the tolerance's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

c = F.col


def nearest_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    time: str,
    value: str,
    order: str,
    tolerance_seconds: float,
    out: str = "nearest",
) -> DataFrame:
    """``left`` plus ``out``: the struct (value, time, gap_us) of the nearest right row, or null.

    The smallest gap wins; among equal gaps the right row with the smallest ``order`` does.
    """
    width = int(tolerance_seconds * 1_000_000)

    def bucket(t: Column) -> Column:
        return F.floor(F.unix_micros(t) / F.lit(width)).cast("bigint")

    candidate = F.min(F.struct(c(order).alias("o"), c(value).alias("v")))
    points = (
        right.where(c(time).isNotNull())
        .groupBy(*keys, c(time).alias("t"))
        .agg(candidate.alias("best"))
    )
    spread = points.select(
        *keys,
        "t",
        F.struct("t", "best").alias("item"),
        F.explode(F.array(bucket(c("t")) - 1, bucket(c("t")), bucket(c("t")) + 1)).alias("_b"),
        F.lit(0).alias("role"),
    )
    asks = left.where(c(time).isNotNull()).select(*keys, c(time).alias("t")).distinct()
    empty = F.lit(None).cast(spread.schema["item"].dataType).alias("item")
    asked = asks.select(*keys, "t", empty, bucket(c("t")).alias("_b"), F.lit(1).alias("role"))
    rows = spread.unionByName(asked)

    inside = [*keys, "_b"]
    before = W.partitionBy(*inside).orderBy("t", "role").rowsBetween(W.unboundedPreceding, 0)
    after = (
        W.partitionBy(*inside)
        .orderBy(c("t").desc(), c("role").asc())
        .rowsBetween(W.unboundedPreceding, 0)
    )
    seen = rows.select(
        *keys,
        "t",
        "role",
        F.max("item").over(before).alias("p"),
        F.min("item").over(after).alias("n"),
    ).where("role = 1")

    def scored(item: Column) -> Column:
        gap = F.abs(F.unix_micros(item["t"]) - F.unix_micros("t"))
        full = F.struct(
            gap.alias("gap_us"),
            item["best"]["o"].alias("o"),
            item["best"]["v"].alias("value"),
            item["t"].alias("time"),
        )
        return F.when(item.isNotNull() & (gap <= width), full)

    best = F.least(scored(c("p")), scored(c("n")))
    answers = seen.select(
        *keys, c("t").alias(time), F.struct(best["value"].alias("value"), best["time"].alias("time"), best["gap_us"].alias("gap_us")).alias(out), best.isNotNull().alias("_hit")
    ).where("_hit").drop("_hit")
    return left.join(answers, [*keys, time], "left").select(*left.columns, out)
