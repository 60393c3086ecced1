"""What the collected plans say about statistics that should be made, and training data for join models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import schema
from ..sources.shared import written

RATIO, SPREAD, CLOSE, FLAT, EXECUTIONS = 10.0, 0.025, 1.75, 0.001, 3
#: Names of nodes that are sent to every task, at most.
COUNTS_SENT = 200_000


def misestimated(plan: Column, actual: Column, ratio: float = RATIO) -> Column:
    return (plan > 0) & (actual > 0) & ((actual / plan > ratio) | (plan / actual > ratio))


def last_conditions(conds: Column) -> Column:
    """Of a node's conditions those of the last kind it has (in the fixed order of kinds) that hold no < or >, as
    "kind: expression"; null without any."""
    kinds = F.array(*map(F.lit, schema.CONDITIONS))
    latest = F.array_max(F.transform(conds, lambda c: F.array_position(kinds, c["kind"])))
    kept = F.filter(conds, lambda c: (F.array_position(kinds, c["kind"]) == latest) & ~c["expr"].rlike("[<>]"))
    said = F.transform(kept, lambda c: F.concat(c["kind"], F.lit(": "), c["expr"]))
    return F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, said)


def misestimates(nodes: DataFrame, ratio: float = RATIO) -> DataFrame:
    """queryid, planid, node_no, conditions: nodes other than joins whose estimate was off by more than ``ratio`` in
    any execution, with the distinct conditions without < or > of the last kind they have, over all executions; a node
    without any has those of its first child, where ``nodes`` say which that is (parent_no, child_ix).

    One aggregate over the executions, pre-aggregated map-side; what it holds of a node are its distinct conditions.
    """
    plans = ["queryid", "planid"]
    tree = {"parent_no", "child_ix"} <= set(nodes.columns)
    off = ~F.col("node_type").isin(schema.JOINS) & misestimated(F.col("plan_rows"), F.col("actual_rows"), ratio)
    places = [F.max("parent_no").alias("parent_no"), F.max("child_ix").alias("child_ix")] if tree else []
    each = nodes.groupBy(*plans, "node_no").agg(F.max(F.coalesce(off, F.lit(False))).alias("off"), F.collect_set(last_conditions(F.col("conds"))).alias("sets"), *places)
    each = each.withColumn("conditions", F.array_sort(F.array_distinct(F.flatten("sets"))))
    bad = each.where("off").select(*plans, "node_no", "conditions")
    if tree:
        below = each.where("child_ix = 0 and parent_no is not null").select(*plans, F.col("parent_no").alias("node_no"), F.col("conditions").alias("below"))
        bad = bad.join(below, [*plans, "node_no"], "left").withColumn("conditions", F.when(F.size("conditions") > 0, F.col("conditions")).otherwise(F.coalesce("below", "conditions"))).drop("below")
    return bad


def skew_groups(points: Column) -> Column:
    """Greedy clusters of an array of (p, n, low, high) structs in order: a point joins the first cluster whose first p
    is within ``SPREAD`` of its own, else begins one.  An array of struct(first, n, p_low, p_high, a_low, a_high)."""
    kind = "array<struct<first:double,n:bigint,p_low:double,p_high:double,a_low:double,a_high:double>>"

    def add(groups, point):
        fits = lambda g: (F.floor((1 - SPREAD) * g["first"]) <= point["p"]) & (point["p"] <= F.floor((1 + SPREAD) * g["first"]))
        # places of the clusters that fit, first one first; 0 if none
        at = F.coalesce(F.array_position(F.transform(groups, fits), True), F.lit(0))
        fresh = F.struct(point["p"].alias("first"), point["n"].alias("n"), point["p"].alias("p_low"), point["p"].alias("p_high"), point["low"].alias("a_low"), point["high"].alias("a_high"))
        grown = F.transform(
            groups,
            lambda g, i: F.when(
                i + 1 == at,
                F.struct(g["first"].alias("first"), (g["n"] + point["n"]).alias("n"), F.least(g["p_low"], point["p"]).alias("p_low"), F.greatest(g["p_high"], point["p"]).alias("p_high"), F.least(g["a_low"], point["low"]).alias("a_low"), F.greatest(g["a_high"], point["high"]).alias("a_high")),
            ).otherwise(g),
        )
        return F.when(at > 0, grown).otherwise(F.concat(groups, F.array(fresh)))

    return F.aggregate(points, F.array().cast(kind), add)


def skewed(group: Column) -> Column:
    """A cluster of near-equal estimates whose row counts differ widely: the estimate doesn't see what moves the rows."""
    spread = group["a_high"] - group["a_low"]
    return (group["n"] > 1) & (group["a_high"] > group["a_low"] * CLOSE) & (spread != 0) & ((group["p_high"] - group["p_low"]) / spread < FLAT)


def histogram_skew(nodes: DataFrame, keys: list[str] | None = None, order: str = "seqid") -> DataFrame:
    """keys, groups, skewed for each node: whether any cluster of its executions is skewed.

    Equal estimates always fall into one cluster, the one that their first execution found; so executions are put
    together by estimate first (number, extremes and first place, map-side), and what meets in one array, in order of
    first places, are a node's distinct estimates.
    """
    keys = keys or ["queryid", "planid", "node_no"]
    p, a = F.col("plan_rows").cast("double"), F.col("actual_rows").cast("double")
    per = nodes.where(p.isNotNull()).groupBy(*keys, p.alias("p")).agg(F.min(order).alias("o"), F.count("*").alias("n"), F.min(a).alias("low"), F.max(a).alias("high"))
    points = per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("o", "p", "n", "low", "high"))).alias("points"))
    found = points.withColumn("groups", skew_groups(F.col("points")))
    return found.select(*keys, F.size("groups").alias("groups"), F.exists("groups", skewed).alias("skewed"))


def join_training(nodes: DataFrame, least: int = EXECUTIONS) -> DataFrame:
    """Executions (outer, inner, actual rows) of joins that ran at least ``least`` times; ``nodes`` have their inputs.

    Nodes are counted in an aggregate of their own (map-side, so a node with very many executions is no task's window)
    and the counts written; up to ``COUNTS_SENT`` go to every task, more are joined by shuffle.
    """
    keys = ["queryid", "planid", "node_no"]
    joins = nodes.where(F.col("node_type").isin(schema.JOINS))
    often = written(joins.groupBy(*keys).count().where(F.col("count") >= least).select(*(F.col(k).alias(f"__{k}") for k in keys)), "often")
    often = F.broadcast(often) if often.count() <= COUNTS_SENT else often
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return joins.join(often, same, "left_semi").select(*keys, "depth", "node_type", F.col("actual_outer").alias("x_outer"), F.col("actual_inner").alias("x_inner"), F.col("actual_rows").alias("y"))


def query_texts(log: DataFrame) -> DataFrame:
    """The first stored text of each query, its database and its latest plan."""
    return log.groupBy("queryid").agg(F.min_by("query", "seqid").alias("query"), F.min_by("database", "seqid").alias("database"), F.max_by("planid", "seqid").alias("planid"))
