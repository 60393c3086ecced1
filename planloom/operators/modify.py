"""Table modification as copy-on-write: what a table holds after inserts, updates, deletes and merges.

The result is a DataFrame to be written over the table (or over the partitions it touches); files are never changed
in place.  Conditions that are null match nothing, as in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows.select(*table.columns))


def update(table: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    return table.select(*(F.when(_true(condition), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns))


def delete(table: DataFrame, condition: Column) -> DataFrame:
    return table.where(~_true(condition))


def insert_on_conflict(table: DataFrame, rows: DataFrame, keys: list[str], update_rows: bool = True) -> DataFrame:
    """Insert; rows whose key is there already replace the old ones, or are left out."""
    if update_rows:
        return table.join(rows.select(*keys), keys, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))
    return insert(table, rows.join(table.select(*keys), keys, "left_anti"))


def merge(table: DataFrame, source: DataFrame, keys: list[str], matched: dict[str, Column] | None = None, delete_when: Column | None = None, insert_new: bool = True) -> DataFrame:
    """MERGE: matched rows are deleted if ``delete_when`` holds, else updated; unmatched source rows are inserted.

    One outer join on the keys.  In ``matched`` and ``delete_when`` the table's columns go by their names and the
    source's by ``s.<name>``.  Source keys must be unique; keys are never null.
    """
    old = table.select(F.struct(*table.columns).alias("t"), *keys)
    new = source.select(F.struct(*source.columns).alias("s"), *keys)
    both = old.join(new, keys, "full" if insert_new else "left").drop(*keys)
    there, found = F.col("t").isNotNull(), F.col("s").isNotNull()
    rows = both.select(*(F.col(f"t.{c}").alias(c) for c in table.columns), "s", there.alias("__there"), found.alias("__found"))
    if delete_when is not None:
        rows = rows.where(~(F.col("__there") & F.col("__found") & _true(delete_when)))
    out = []
    for c in table.columns:
        kept = F.when(F.col("__found"), (matched or {})[c]).otherwise(F.col(c)) if c in (matched or {}) else F.col(c)
        fresh = F.col(f"s.{c}") if c in source.columns else F.lit(None)
        out.append(F.when(F.col("__there"), kept).otherwise(fresh).alias(c))
    return rows.select(*out)
