"""Relational operators that Spark has no syntax for, as compositions of those it has."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes (by the optimizer's reckoning) that may be sent to every task.
BROADCAST_BYTES = 64 << 20


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order (a window group limit: ranks are cut before the shuffle)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def top_with_ties(df: DataFrame, n: int, by: list[str], ascending: bool = True, keys: list[str] | None = None) -> DataFrame:
    """The first n rows by the columns ``by`` (nulls last) and all that tie with the n-th, for each key or overall.

    Overall, a bounded top-n finds the n-th row's values first, so that no window ever holds the whole table.
    """
    order = [F.col(c).asc_nulls_last() if ascending else F.col(c).desc_nulls_last() for c in by]
    if keys:
        rank = F.rank().over(Window.partitionBy(*keys).orderBy(*order))
        return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")
    first = df.select(*(F.col(c).alias(f"__{c}") for c in by)).orderBy(*(F.col(f"__{c}").asc_nulls_last() if ascending else F.col(f"__{c}").desc_nulls_last() for c in by)).limit(n)
    # every row that sorts with the first n has the values of one of them: n values at most
    same = [df[c].eqNullSafe(F.col(f"__{c}")) for c in by]
    return df.join(F.broadcast(first.distinct()), same, "left_semi")


def groups_frame(df: DataFrame, keys: list[str], order: str, before: int, after: int, aggregates: dict[str, Callable[[], Column]]) -> DataFrame:
    """Aggregates over a GROUPS frame: rows whose peer group is up to ``before`` groups back and ``after`` ahead."""
    by = Window.partitionBy(*keys)
    ranked = df.withColumn("__group", F.dense_rank().over(by.orderBy(order)))
    frame = by.orderBy("__group").rangeBetween(-before, after)
    return ranked.withColumns({name: f().over(frame) for name, f in aggregates.items()}).drop("__group")


def recursive_union(seed: DataFrame, step: Callable[[DataFrame], DataFrame], checkpoint: Callable[[DataFrame], DataFrame] = lambda df: df.checkpoint(), limit: int = 1000) -> DataFrame:
    """``WITH RECURSIVE ... UNION`` (distinct): repeat ``step`` on the rows that are new until there are none.

    Each round's rows are checkpointed, so lineage stays short; only new rows are fed back.  A recursion that has not
    ended within ``limit`` rounds is an error, not a shorter result.
    """
    found = fresh = checkpoint(seed.distinct())
    for _ in range(limit):
        fresh = checkpoint(step(fresh).distinct().subtract(found))
        if fresh.isEmpty():
            return found
        found = checkpoint(found.unionByName(fresh))
    raise RuntimeError(f"the recursion did not end within {limit} rounds")


def merge_append(parts: list[DataFrame], order: list[Column]) -> DataFrame:
    """Union of the parts in one order."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(*order)


def incremental_sort(df: DataFrame, sorted_by: list[str], then: list[Column]) -> DataFrame:
    """Rows in order of ``sorted_by`` and then of ``then``, for rows that come in order of the former: they are cut into
    ranges of the former, and each range is sorted apart."""
    return df.repartitionByRange(*sorted_by).sortWithinPartitions(*sorted_by, *then)


def unique_inner_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A semi join by way of the distinct keys of the right side and an inner join."""
    return left.join(right.select(*keys).distinct(), keys, "inner")


def broadcast_within(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if the optimizer reckons it no larger than that; else as it is, for a shuffle join."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= most else df


def exclude_frame(df: DataFrame, keys: list[str], order: str, value: str, exclude: str) -> tuple[Column, Column]:
    """count and sum of ``value`` over the whole partition but for the current row, its peers in ``order``, or the peers
    other than itself (EXCLUDE CURRENT ROW, GROUP, TIES); ``df`` needs ``__group`` (``with_groups``).

    What stands before and after is summed apart, so nothing is subtracted and no digits are lost.
    """
    by = Window.partitionBy(*keys)
    if exclude == "current row":
        held = by.orderBy(order, value)
        sides = [held.rowsBetween(Window.unboundedPreceding, -1), held.rowsBetween(1, Window.unboundedFollowing)]
    else:
        held = by.orderBy("__group")
        sides = [held.rangeBetween(Window.unboundedPreceding, -1), held.rangeBetween(1, Window.unboundedFollowing)]
    count = F.count(value).over(sides[0]) + F.count(value).over(sides[1])
    total = F.coalesce(F.sum(value).over(sides[0]), F.lit(0.0)) + F.coalesce(F.sum(value).over(sides[1]), F.lit(0.0))
    if exclude == "ties":
        count, total = count + F.col(value).isNotNull().cast("int"), total + F.coalesce(F.col(value), F.lit(0.0))
    return count, F.when(count > 0, total)


def with_groups(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``df`` with the number of each row's peer group, ``__group``."""
    return df.withColumn("__group", F.dense_rank().over(Window.partitionBy(*keys).orderBy(order)))


def with_tid(df: DataFrame) -> DataFrame:
    """A file table with each row's place: ``tid``, a struct of the file's name and the row's number in it."""
    return df.withColumn("tid", F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")))


def full_theta_join(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """FULL JOIN on any condition: a left join, and the right rows without a partner."""
    lone = right.join(left, on, "left_anti")
    return left.join(right, on, "left").unionByName(lone.select(*(F.lit(None).cast(t).alias(c) for c, t in left.dtypes), *right.columns))


def bucketed(df: DataFrame, keys: list[str], buckets: int, name: str, path: str) -> DataFrame:
    """``df`` stored under ``path`` as a table in buckets of the keys, each sorted: joins and groups on them need no
    exchange.  The table is named anew each time."""
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float], store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """keys, share, quantile (interpolated) of the non-null values of each key.

    Values are dealt by range over all tasks and stored; a key's places follow from the row counts of the ranges, so
    that a key with most rows is never one task's and no state holds its values.
    """
    rows = df.where(F.col(value).isNotNull()).select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col(value).cast("double").alias("__v"))
    names = [f"__k{i}" for i in range(len(keys))]
    held = store(rows.repartitionByRange(*names, "__v").withColumn("__part", F.spark_partition_id()))
    per = held.groupBy(*names, "__part").agg(F.count("*").alias("__n"))
    by = Window.partitionBy(*names)
    per = per.withColumn("__before", F.sum("__n").over(by.orderBy("__part")) - F.col("__n")).withColumn("__all", F.sum("__n").over(by))
    wanted = per.withColumn("__share", F.explode(F.array(*map(F.lit, shares)))).withColumn("__at", F.col("__share") * (F.col("__all") - 1))
    wanted = wanted.withColumn("__place", F.explode(F.array_distinct(F.array(F.floor("__at"), F.ceil("__at")))))
    wanted = wanted.where((F.col("__place") >= F.col("__before")) & (F.col("__place") < F.col("__before") + F.col("__n")))
    wanted = wanted.select(*(F.col(c).alias(f"__w{c}") for c in (*names, "__part")), "__share", "__at", "__place", (F.col("__place") - F.col("__before")).alias("__wanted"))
    # every row's place among those of its key and range; a few of them are wanted
    placed = held.withColumn("__row", F.row_number().over(Window.partitionBy(*names, "__part").orderBy("__v")) - 1)
    same = [F.col(c).eqNullSafe(F.col(f"__w{c}")) for c in (*names, "__part")] + [F.col("__row") == F.col("__wanted")]
    found = placed.join(wanted, same).select(*names, "__share", "__at", "__place", "__v")
    low, high = F.min_by("__v", "__place"), F.max_by("__v", "__place")
    out = found.groupBy(*names, "__share").agg((low + (high - low) * (F.first("__at") - F.min("__place"))).alias("quantile"))
    return out.select(*(F.col(n).alias(k) for n, k in zip(names, keys)), F.col("__share").alias("share"), "quantile")
