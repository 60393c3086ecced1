"""Estimates replaced by what the learnt parameters make of them, bottom-up.

The nodes of a plan (tens at most) meet in one array, last node first, so that children come before their parents; one
fold over it makes all new estimates, whatever the depth of the tree.  Where the documents themselves are at hand
(``replace_log``), the same is done within each.
"""

from __future__ import annotations

import functools
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import flatten, schema
from ..sources.shared import written

#: Plans whose parameters are sent to every task, at most.
PLANS_SENT = 50_000


def estimate(node_type: Column, plan: Column, outer: Column, inner: Column, p: Column, norm: Column, norm_plan: Column) -> Column:
    """New estimate of a node from its own one and its children's new ones; ``p`` is a struct of parameters."""
    outer, inner = F.coalesce(outer, F.lit(0.0)), F.coalesce(inner, F.lit(0.0))
    product = F.bround(p["coef_outer"] * outer * inner)
    linear = F.bround(p["coef_outer"] * outer + p["coef_inner"] * inner + p["intercept"])
    curved = F.bround(p["coef2"] * outer * inner + p["intercept"])
    joined = F.when((p["coef_outer"] == 0) & (p["coef_inner"] == 0), curved).otherwise(linear)
    scaled = F.bround((p["coef_outer"] * plan + p["intercept"]) * norm_plan / norm)
    return F.when(p.isNull(), plan).when(node_type.isin(schema.MEMBER_NODES), outer).when(node_type.isin(schema.PRODUCT_NODES), product).when(node_type.isin(schema.SUM_JOINS), joined).otherwise(scaled)


def replace_rows(nodes: DataFrame, parameters: DataFrame, keys: list[str]) -> DataFrame:
    """``nodes`` with plan_rows replaced; ``keys`` name a plan's execution.  ``parameters``: queryid, planid, node_no,
    coef_outer, coef_inner, coef2, intercept."""
    named = parameters.select("queryid", "planid", "node_no", F.struct("coef_outer", "coef_inner", "coef2", "intercept").alias("__p"))
    work = nodes.join(named, ["queryid", "planid", "node_no"], "left")
    real = ~F.coalesce(F.col("relationship"), F.lit("Outer")).isin("InitPlan", "SubPlan")
    entry = F.struct((-F.col("node_no")).alias("o"), "node_no", F.when(real, F.col("parent_no")).alias("parent"), (F.coalesce(F.col("relationship"), F.lit("Outer")) == "Outer").alias("outer"), "node_type", "plan_rows", "norm", "norm_plan", F.col("__p").alias("p"))

    def add(done, x):
        kids = F.filter(done, lambda d: d["parent"] == x["node_no"])
        side = lambda outer: F.array_max(F.transform(F.filter(kids, lambda d: d["outer"] == outer), lambda d: d["new"]))
        # without any member there is no sum
        members = F.when(F.size(kids) > 0, F.aggregate(kids, F.lit(0.0), lambda s, d: s + d["new"]))
        outer = F.when(x["node_type"].isin(schema.MEMBER_NODES), members).otherwise(side(True))
        new = estimate(x["node_type"], x["plan_rows"], outer, side(False), x["p"], x["norm"], x["norm_plan"])
        return F.concat(done, F.array(F.struct(x["node_no"].alias("node_no"), x["parent"].alias("parent"), x["outer"].alias("outer"), new.alias("new"))))

    start = F.array().cast("array<struct<node_no:int,parent:int,outer:boolean,new:double>>")
    folded = work.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("__all")).select(*keys, F.explode(F.aggregate("__all", start, add)).alias("__d"))
    found = folded.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__d.node_no").alias("__node_no"), F.col("__d.new").alias("__new"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in (*keys, "node_no")]
    return work.join(found, same, "left").withColumn("plan_rows", F.col("__new")).select(*nodes.columns)


# --- document by document ----------------------------------------------------------------------------------------------


def parameter_texts(parameters: DataFrame) -> DataFrame:
    """queryid, planid, __parameters: all of a plan's parameters as one JSON text; written, and sent to every task if
    there are up to ``PLANS_SENT`` plans."""
    numbers = F.array(*(F.col(c).cast("double") for c in ("node_no", "coef_outer", "coef_inner", "coef2", "intercept")))
    texts = written(parameters.groupBy("queryid", "planid").agg(F.to_json(F.collect_list(numbers)).alias("__parameters")), "parameters")
    return F.broadcast(texts) if texts.count() <= PLANS_SENT else texts


@functools.lru_cache(maxsize=4096)
def _parsed(text: str) -> dict[int, list[float | None]]:
    return {int(p[0]): [None if v is None else float(v) for v in p[1:]] for p in json.loads(text)}


def _half_even(value: float) -> float:
    return float(round(value)) if math.isfinite(value) else value


def _estimate(row: dict, kids: list[tuple[bool, float | None]], p: list[float | None]) -> float | None:
    """``estimate`` on one row; ``kids`` are (outer, new estimate) of its children."""
    kind = row["node_type"]
    if kind in schema.MEMBER_NODES:
        return 0.0 if any(v is None for _, v in kids) else sum((v for _, v in kids), 0.0)
    first, second, both, more = p
    outer, inner = (max((v for side, v in kids if side == at and v is not None), default=0.0) for at in (True, False))
    if kind in schema.PRODUCT_NODES:
        return None if first is None else _half_even(first * outer * inner)
    if kind in schema.SUM_JOINS:
        if first == 0 and second == 0:
            return None if both is None or more is None else _half_even(both * outer * inner + more)
        return None if first is None or second is None or more is None else _half_even(first * outer + second * inner + more)
    plan = row["plan_rows"]
    return None if plan is None or first is None or more is None else _half_even((first * plan + more) * row["norm_plan"] / row["norm"])


def replaced(found: list[dict], text: str | None) -> None:
    """``replace_rows`` on the rows of one document, in place; ``text`` holds its plan's parameters, None if there are none."""
    if text is None:
        return
    parameters, below = _parsed(text), {}
    for row in reversed(found):
        p = parameters.get(row["node_no"])
        if p is not None:
            row["plan_rows"] = _estimate(row, below.get(row["node_no"], []), p)
        side = row["relationship"] or "Outer"
        if row["parent_no"] and side not in ("InitPlan", "SubPlan"):
            below.setdefault(row["parent_no"], []).append((side == "Outer", row["plan_rows"]))


def replace_log(log: DataFrame, parameters: DataFrame, finished: bool = False, columns: list[str] | None = None) -> DataFrame:
    """The nodes of a plan log (``flatten.plan_nodes``) with plan_rows replaced as by ``replace_rows``, each document by
    itself: no node crosses the network."""
    known = log.join(parameter_texts(parameters), ["queryid", "planid"], "left")
    return flatten.plan_nodes(known, finished=finished, columns=columns, change=("__parameters", replaced))
