"""Rows that parallel workers contribute to the nodes of a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_finished(nodes: DataFrame) -> DataFrame:
    """Finished plans: nodes that list workers get their rows and loops added and the estimate scaled to all workers.

    Nothing changes in plans that launched none, nor (but for the scaled estimate, a factor of one) outside a region.
    """
    inside = F.col("merge_flag") & (F.coalesce(F.size("workers"), F.lit(0)) > 0)
    extra: Column = F.aggregate("workers", F.lit(0.0), lambda s, w: s + w["rows"])
    loops: Column = F.aggregate("workers", F.lit(0.0), lambda s, w: s + w["loops"])
    return nodes.withColumns(
        {
            "plan_rows": F.when(inside, F.col("plan_rows") * F.col("norm_plan")).otherwise(F.col("plan_rows")),
            "actual_rows": F.when(inside, F.col("actual_rows") + extra).otherwise(F.col("actual_rows")),
            "actual_loops": F.when(inside, F.col("actual_loops") + loops).otherwise(F.col("actual_loops")),
        }
    )


def merge_live(leader: DataFrame, workers: DataFrame, keys: list[str]) -> DataFrame:
    """Running plans: worker trees are the last nodes of the leader's tree, so nodes meet at the same distance from
    the end.  ``workers`` has one row for each node and worker (column worker)."""
    size = leader.groupBy(*keys).agg(F.max("node_no").alias("__n"))
    sizes = workers.groupBy(*keys, "worker").agg(F.max("node_no").alias("__n"))
    tail = workers.join(sizes, [*keys, "worker"]).groupBy(*keys, (F.col("__n") - F.col("node_no")).alias("__from_end")).agg(F.sum("actual_rows").alias("__extra"))
    out = leader.join(size, keys).withColumn("__from_end", F.col("__n") - F.col("node_no")).join(tail, [*keys, "__from_end"], "left")
    inside = F.col("merge_flag") & F.col("__extra").isNotNull()
    out = out.withColumn("plan_rows", F.when(inside, F.col("plan_rows") * F.col("norm_plan")).otherwise(F.col("plan_rows")))
    out = out.withColumn("actual_rows", F.when(inside, F.col("actual_rows") + F.col("__extra")).otherwise(F.col("actual_rows")))
    return out.drop("__n", "__from_end", "__extra")


def extrapolate(nodes: DataFrame, running: Column | int) -> DataFrame:
    """Workers that have left no longer report: scale by (launched + 1) / running where fewer run than were started."""
    running = F.lit(running) if isinstance(running, int) else running
    short = F.col("merge_flag") & (running < F.col("norm")) & (running > 0)
    return nodes.withColumn("actual_rows", F.when(short, F.col("actual_rows") * F.col("norm") / running).otherwise(F.col("actual_rows")))
