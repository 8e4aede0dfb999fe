"""Usage and change history of assets: activity window, update frequency, volatility, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.functions.fixed import CACHE_TTL
from assayer.operators.ranking import top_ranked


def usage(log: DataFrame, asset: str, ts: str, user: str, duration: str, days: int = 30) -> DataFrame:
    """Query count, active users and average time per asset over the last ``days`` before the newest entry."""
    newest = log.agg(F.max(ts)).scalar()
    recent = log.filter(F.col(ts) >= newest - F.expr(f"INTERVAL {days} DAYS"))
    return recent.groupBy(asset).agg(
        F.count(F.lit(1)).alias("query_count"),
        F.count_distinct(user).alias("active_users"),
        F.avg(duration).alias("avg_query_time"),
    )


def recent_queries(log: DataFrame, asset: str, ts: str, key: str, k: int = 10) -> DataFrame:
    """The ``k`` newest log entries of every asset; each task keeps ``k`` per asset before the shuffle."""
    newest = Window.partitionBy(asset).orderBy(F.desc(ts), key)
    return top_ranked(log, newest, k)


def active_users(log: DataFrame, asset: str, user: str, k: int = 10) -> DataFrame:
    """The ``k`` busiest users of every asset."""
    counted = log.groupBy(asset, user).agg(F.count(F.lit(1)).alias("query_count"))
    busiest = Window.partitionBy(asset).orderBy(F.desc("query_count"), user)
    return top_ranked(counted, busiest, k)


def update_frequency(history: DataFrame, asset: str, ts: str) -> DataFrame:
    """Average hours between changes. The gaps add up to last minus first, so no ordering of the history is needed."""
    span = F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))
    return history.groupBy(asset).agg(
        F.count(F.lit(1)).alias("changes"),
        F.try_divide(span / 3_600_000_000.0, F.count(F.lit(1)) - 1).alias("update_frequency_hours"),
    )


def volatility(asset_type: Column, partitioned: Column, update_hours: Column) -> Column:
    """Views change rarely, partitioned tables sometimes; other tables by their update frequency."""
    return (
        F.when(asset_type.isin("VIEW", "MATERIALIZED_VIEW"), "low")
        .when(F.coalesce(partitioned, F.lit(False)), "medium")
        .when(update_hours < 1, "high")
        .when(update_hours < 24, "medium")
        .otherwise("low")
    )


def cache_ttl(volatility_class: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, ttl in CACHE_TTL.items():
        out = F.when(volatility_class == name, ttl).otherwise(out)
    return out


def stale(assets: DataFrame, last_touch: str, reference: Column, days: int) -> DataFrame:
    """Assets not touched in the ``days`` before ``reference``."""
    return assets.filter(F.col(last_touch) < reference - F.expr(f"INTERVAL {days} DAYS"))
