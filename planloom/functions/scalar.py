"""Scalar functions that plan analysis uses, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_dir(planid: Column) -> Column:
    """Three digits: an unsigned 64-bit id, kept as text, modulo 1000."""
    return F.lpad(F.pmod(planid.cast("decimal(20,0)"), F.lit(1000)).cast("int").cast("string"), 3, "0")


def query_hash(query: Column) -> Column:
    """A stable number (as text) for a query without id: the first 60 bits of its MD5."""
    return F.conv(F.substring(F.md5(query.cast("binary")), 1, 15), 16, 10)


def is_explain(query: Column) -> Column:
    return F.ltrim(F.lower(query)).startswith("explain")


def has_range(condition: Column) -> Column:
    return condition.rlike("[<>]")


def percent_floor(share: Column) -> Column:
    """Percent, cut (not rounded) after two decimals."""
    return F.floor(share * 10_000) / 100


def sort_work(rows: Column) -> Column:
    """n ln n over the whole part of n; 0 below one row."""
    return F.when(rows >= 1, rows * F.log(F.floor(rows))).otherwise(F.lit(0.0))


def estimate_error(plan: Column, actual: Column) -> Column:
    """The q-error: the factor by which an estimate is off either way, at least 1."""
    p, a = F.greatest(plan, F.lit(1.0)), F.greatest(actual, F.lit(1.0))
    return F.greatest(p / a, a / p)


def flat_relations(nested: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(nested)))
