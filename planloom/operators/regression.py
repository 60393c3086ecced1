"""Row-count corrections for each node of each plan, learnt from its executions.

All models need sums alone: ratios for scans, a product through the origin for nested loops, and for hash and merge
joins the best of three linear models, whose normal equations are made of ten sums.  ``learnt`` gathers the sums, and
what else is kept of a node, per (queryid, planid, node), pre-aggregated map-side; sums of sums are sums, so new log rows
only add to what is stored, and the coefficients are column arithmetic on one row for each node.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import schema
from ..plans.flatten import children

KEYS = ["queryid", "planid", "node_no"]
SUMS = ["n", "sum_plan", "sum_actual", "sum_product_actual", "sum_product_square", "sum_outer", "sum_inner", "sum_outer_outer", "sum_inner_inner", "sum_outer_inner", "sum_outer_actual", "sum_inner_actual", "sum_actual_actual"]
#: Kept besides the sums: the largest value of each (of the sides' relations only where nodes have them).
LARGEST = ["relations", "outer_rels", "inner_rels", "last_no", "relationship", "parent_no", "disk_sort_kb"]


# --- column formulas ---------------------------------------------------------------------------------------------


def scan_coefficient(n: Column, plan: Column, actual: Column, floor: float | None = 250.0) -> Column:
    """struct(coef, intercept): the ratio of the sums; a mean alone where estimates dwarf rows or are all zero."""
    flat = plan == 0
    if floor is not None:
        flat = flat | (actual * floor < plan)
    return F.when(flat, F.struct(F.lit(0.0).alias("coef"), F.bround(actual / n, 5).alias("intercept"))).otherwise(F.struct((actual / plan).alias("coef"), F.lit(0.0).alias("intercept")))


def gather_coefficient(n: Column, plan: Column, actual: Column) -> Column:
    """The same without the floor."""
    return scan_coefficient(n, plan, actual, None)


def product_coefficient(cross: Column, square: Column) -> Column:
    """Least squares through the origin on the product of the inputs; 1 without any."""
    return F.when(square == 0, F.lit(1.0)).otherwise(cross / square)


# --- grouping ------------------------------------------------------------------------------------------------------


def with_inputs(nodes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Nodes with the rows of their children (members count as a sum on the outer side)."""
    keys = keys or ["server_id", "seqid", "queryid", "planid"]
    joined = nodes.join(children(nodes, keys), [*keys, "node_no"], "left")
    member = F.col("node_type").isin(schema.MEMBER_NODES)
    return joined.withColumns(
        {
            "plan_outer": F.when(member, F.col("plan_members")).otherwise(F.col("plan_outer")),
            "actual_outer": F.when(member, F.col("actual_members")).otherwise(F.col("actual_outer")),
            "plan_inner": F.when(member, F.lit(1.0)).otherwise(F.col("plan_inner")),
            "actual_inner": F.when(member, F.lit(1.0)).otherwise(F.col("actual_inner")),
        }
    )


def node_sums(nodes: DataFrame) -> DataFrame:
    """The sums that the models need, for each node of each plan; aggregated map-side."""
    return nodes.groupBy(*KEYS).agg(F.first("node_type").alias("node_type"), *_sums())


def _sums() -> list[Column]:
    o, v = (F.coalesce(c, F.lit(0.0)) for c in ("actual_outer", "actual_inner"))
    a = F.coalesce("actual_rows", F.lit(0.0))
    values = {"plan": F.col("plan_rows"), "actual": F.col("actual_rows"), "product_actual": o * v * F.col("actual_rows"), "product_square": o * v * o * v}
    values |= {"outer": o, "inner": v, "outer_outer": o * o, "inner_inner": v * v, "outer_inner": o * v, "outer_actual": o * a, "inner_actual": v * a, "actual_actual": a * a}
    return [F.count("*").alias("n"), *(F.sum(c).alias(f"sum_{name}") for name, c in values.items())]


def learnt(nodes: DataFrame) -> DataFrame:
    """All that is kept of a log's executions, one row for each node of each plan (``nodes`` with their inputs)."""
    held = set(nodes.columns)
    disk = F.when((F.col("sort_space_type") == "Disk") & (F.col("sort_space_kb") > 0), F.col("sort_space_kb")) if "sort_space_kb" in held else F.lit(None).cast("bigint")
    nodes = nodes.withColumn("disk_sort_kb", disk)
    missing = {c: F.lit(None).cast(t) for c, t in (("relations", "array<string>"), ("last_no", "int"), ("relationship", "string"), ("parent_no", "int"), ("merge_flag", "boolean")) if c not in held}
    # a text that is no key would make this an aggregate by sorting; columns that nodes lack are added to its few rows
    flag = [F.max_by("merge_flag", "seqid").alias("merge_flag")] if "merge_flag" in held else []
    found = nodes.groupBy(*KEYS, "node_type").agg(*_sums(), *(F.max(c).alias(c) for c in LARGEST if c in nodes.columns), *flag, F.max("seqid").alias("last_seqid"))
    return merge_sums(found.withColumns(missing) if missing else found)


def merge_sums(*parts: DataFrame) -> DataFrame:
    """Stored sums (or all that is kept) and those of new executions in one."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    held = set(both.columns)
    last = [F.max_by("merge_flag", "last_seqid").alias("merge_flag"), F.max("last_seqid").alias("last_seqid")] if "last_seqid" in held else []
    return both.groupBy(*KEYS).agg(F.first("node_type").alias("node_type"), *(F.sum(c).alias(c) for c in SUMS), *(F.max(c).alias(c) for c in LARGEST if c in held), *last)


def grouped_plan(nodes: DataFrame) -> DataFrame:
    """The grouped plan: of each node how often it ran, its first and last execution in log order, and its extremes.

    The executions themselves stay rows; no array holds them.
    """
    entry = F.struct("seqid", "plan_rows", "actual_rows", "actual_loops", "removed_rows", "sort_space_kb", "sort_space_type", "conds")
    return nodes.groupBy(*KEYS).agg(
        F.first("node_type").alias("node_type"), F.count("*").alias("n"), F.min_by(entry, "seqid").alias("first"), F.max_by(entry, "seqid").alias("last"),
        F.min("actual_rows").alias("low"), F.max("actual_rows").alias("high"),
    )


def disk_sort_space(nodes: DataFrame) -> DataFrame:
    """The largest sort of each plan that went to disk, kB; null if none did."""
    used = F.max(F.when(F.col("sort_space_type") == "Disk", F.col("sort_space_kb")))
    return nodes.groupBy("queryid", "planid").agg(F.when(used > 0, used).alias("sort_space_used"))


# --- joins with two inputs ---------------------------------------------------------------------------------------------


def _least_squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes of minimum norm and intercept, on centred data."""
    slopes = np.linalg.lstsq(x - x.mean(axis=0), y - y.mean(), rcond=None)[0]
    return slopes, float(y.mean() - x.mean(axis=0) @ slopes)


def fit_join(outer, inner, actual) -> tuple[float, float, float, float]:
    """(coef_outer, coef_inner, intercept, rmse): the best of three linear models of a join's rows, from the executions.

    Each is fitted with the origin as a further point, and without it should a slope be negative.  The smallest error
    over the points fitted wins, ties in the order both inputs, outer alone, inner alone.
    """
    sides, y = [np.asarray(outer, float), np.asarray(inner, float)], np.asarray(actual, float)
    best = None
    for used in ((0, 1), (0,), (1,)):
        x = np.stack([sides[i] for i in used], axis=1)
        points, target = np.vstack([x, np.zeros(len(used))]), np.append(y, 0.0)
        slopes, intercept = _least_squares(points, target)
        if (slopes < 0).any():
            points, target = x, y
            slopes, intercept = _least_squares(points, target)
        error = float(np.sqrt(np.mean((points @ slopes + intercept - target) ** 2)))
        if best is None or error < best[3]:
            both = [0.0, 0.0]
            for i, s in zip(used, slopes):
                both[i] = round(float(s), 5)
            best = (both[0], both[1], round(intercept, 5), error)
    return best


#: Shares of a sum of squares below which a determinant, or what a model leaves unexplained, is rounding.
NO_RANK, NO_ERROR = 1e-12, 1e-13
#: Errors that differ by less than this share are a tie.
TIE = 1e-9


def join_models(sums: DataFrame) -> DataFrame:
    """``sums`` with coef_outer, coef_inner, intercept, rmse: what ``fit_join`` says, from sums alone.

    Sums of squares lose what is below some 1e-13 of them: a model that leaves no more than that unexplained is exact.
    """
    zero = F.lit(0.0)
    out = sums
    for case, n in (("origin", F.col("n") + 1), ("plain", F.col("n"))):
        pairs = {"oo": ("outer_outer", "outer", "outer"), "vv": ("inner_inner", "inner", "inner"), "ov": ("outer_inner", "outer", "inner"), "oa": ("outer_actual", "outer", "actual"), "va": ("inner_actual", "inner", "actual"), "aa": ("actual_actual", "actual", "actual")}
        out = out.withColumns({f"__{case}_{k}": F.col(f"sum_{both}") - F.col(f"sum_{x}") * F.col(f"sum_{y}") / n for k, (both, x, y) in pairs.items()})
        # what is left of a sum that doesn't vary is rounding
        out = out.withColumns({f"__{case}_{k}": F.when(F.col(f"__{case}_{k}") > NO_RANK * F.col(f"sum_{pairs[k][0]}"), F.col(f"__{case}_{k}")).otherwise(zero) for k in ("oo", "vv", "aa")})
        oo, vv, ov, oa, va = (F.col(f"__{case}_{k}") for k in ("oo", "vv", "ov", "oa", "va"))
        det, trace = oo * vv - ov * ov, oo + vv
        full = det > NO_RANK * oo * vv
        # of a matrix without full rank the inverse of least norm is the matrix by its squared trace
        least = lambda x, y: F.when(trace > 0, (x + y) / (trace * trace)).otherwise(zero)
        alone = lambda xx, xa: F.when(xx > 0, xa / xx).otherwise(zero)
        out = out.withColumns({
            f"__{case}_both_o": F.when(full, (oa * vv - va * ov) / det).otherwise(least(oo * oa, F.when((oo > 0) & (vv > 0), ov * va).otherwise(zero))),
            f"__{case}_both_v": F.when(full, (va * oo - oa * ov) / det).otherwise(least(F.when((oo > 0) & (vv > 0), ov * oa).otherwise(zero), vv * va)),
            f"__{case}_outer_o": alone(oo, oa), f"__{case}_outer_v": zero, f"__{case}_inner_o": zero, f"__{case}_inner_v": alone(vv, va),
        })
    best = None
    for model in ("both", "outer", "inner"):
        origin = (F.col(f"__origin_{model}_o") >= 0) & (F.col(f"__origin_{model}_v") >= 0)
        pick = lambda name: F.when(origin, F.col(f"__origin_{name}")).otherwise(F.col(f"__plain_{name}"))  # noqa: B023, E731
        n = F.col("n") + F.when(origin, 1).otherwise(0)
        out = out.withColumns({"__o": pick(f"{model}_o"), "__v": pick(f"{model}_v"), "__n": n, "__aa": pick("aa"), "__oa": pick("oa"), "__va": pick("va")})
        left = F.col("__aa") - F.col("__o") * F.col("__oa") - F.col("__v") * F.col("__va")
        error = F.when(left > NO_ERROR * F.col("sum_actual_actual"), F.sqrt(left / F.col("__n"))).otherwise(zero)
        intercept = (F.col("sum_actual") - F.col("__o") * F.col("sum_outer") - F.col("__v") * F.col("sum_inner")) / F.col("__n")
        out = out.withColumn(f"__{model}", F.struct(error.alias("rmse"), F.col("__o").alias("o"), F.col("__v").alias("v"), intercept.alias("b")))
        here = F.col(f"__{model}")
        best = here if best is None else F.when(here["rmse"] < (1 - TIE) * best["rmse"], here).otherwise(best)
    out = out.withColumn("__best", best)
    fit = {"coef_outer": F.bround("__best.o", 5), "coef_inner": F.bround("__best.v", 5), "intercept": F.bround("__best.b", 5), "rmse": F.col("__best.rmse")}
    return out.select(*sums.columns, *(c.alias(name) for name, c in fit.items()))


# --- all together -------------------------------------------------------------------------------------------------------


def parameters_of(kept: DataFrame) -> DataFrame:
    """The ``reg_param`` table of what is kept of a log (``learnt``, ``merge_sums``).

    ``coef2``, the coefficient of a product of a hash or merge join's inputs, is always 0: that model is not fitted.
    """
    scan = scan_coefficient(F.col("n"), F.col("sum_plan"), F.col("sum_actual"))
    product, join = F.col("node_type").isin(schema.PRODUCT_NODES), F.col("node_type").isin(schema.SUM_JOINS)
    coef = F.when(product, product_coefficient(F.col("sum_product_actual"), F.col("sum_product_square"))).when(join, F.col("coef_outer")).otherwise(scan["coef"])
    found = join_models(kept).select(
        *KEYS, "node_type", "n", coef.alias("coef_outer"), F.when(join, F.col("coef_inner")).otherwise(F.lit(0.0)).alias("coef_inner"), F.lit(0.0).alias("coef2"),
        F.when(product, F.lit(0.0)).when(join, F.col("intercept")).otherwise(scan["intercept"]).alias("intercept"),
        *(c for c in LARGEST if c in kept.columns), "merge_flag",
    )
    space = found.groupBy("queryid", "planid").agg(F.max("disk_sort_kb").alias("sort_space_used"))
    return found.drop("disk_sort_kb").join(space, ["queryid", "planid"])


def parameters(nodes: DataFrame) -> DataFrame:
    """The ``reg_param`` table of plan nodes with their inputs (``with_inputs``)."""
    return parameters_of(learnt(nodes))
