"""Selection of raw log events: look-back, allow-lists, merging, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegraph import fixed_values as fv

c = F.col


def select_events(
    df: DataFrame,
    time: str,
    as_of: Column,
    hours: int = fv.DEFAULT_LOOKBACK_HOURS,
    ids: tuple[int, ...] | None = None,
    levels: tuple[int, ...] | None = None,
) -> DataFrame:
    """Events of the last ``hours``, optionally of certain ids or levels; both reach the scan."""
    out = df.where(c(time) >= as_of - F.expr(f"INTERVAL {int(hours)} HOURS"))
    if ids:
        out = out.where(c("event_id").isin(*ids))
    if levels:
        out = out.where(c("level").isin(*levels))
    return out


def merge_new(base: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` plus the rows of ``extra`` whose keys it does not hold yet."""
    fresh = extra.join(base.select(*keys).distinct(), keys, "left_anti")
    return base.unionByName(fresh, allowMissingColumns=True)


def log_coverage(df: DataFrame, time: str, keys: list[str]) -> DataFrame:
    """Oldest event per log."""
    return df.groupBy(*keys).agg(F.min(time).alias("oldest"))
