"""Cost estimate of a stored table, from its size."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from assayer.functions.display import GB, TB
from assayer.functions.fixed import FULL_SCANS_PER_MONTH, QUERY_USD_PER_TB, STORAGE_USD_PER_GB


def _storage(size_bytes: Column) -> Column:
    return F.nullif(size_bytes, F.lit(0)) / GB * STORAGE_USD_PER_GB


def _query(size_bytes: Column) -> Column:
    return F.nullif(size_bytes, F.lit(0)) / TB * QUERY_USD_PER_TB * FULL_SCANS_PER_MONTH


def storage_cost(size_bytes: Column) -> Column:
    """Dollars per month of storage; null when there are no bytes."""
    return F.round(_storage(size_bytes), 2)


def query_cost(size_bytes: Column) -> Column:
    """Dollars per month for four whole scans; null when there are no bytes."""
    return F.round(_query(size_bytes), 2)


def total_cost(size_bytes: Column) -> Column:
    """The rounded sum, not the sum of the rounded parts."""
    return F.round(_storage(size_bytes) + _query(size_bytes), 2)


def cost_per_gb(monthly_cost: Column, size_bytes: Column) -> Column:
    return F.try_divide(monthly_cost, size_bytes / GB)
