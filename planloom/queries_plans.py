"""Queries over plans: the analytic operators on plan-shaped views of the test tables, and on captured plans."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import params as prm
from .functions import scalar
from .operators import analyze, live, neural, progress, regression, replace, statistics, workers
from .plans import fingerprint, flatten, schema
from .sources import capture
from .sources.shared import fresh_path
from .tables import table

Query = Callable[[SparkSession, str], DataFrame]


# --- regression ----------------------------------------------------------------------------------------------------


def _order_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Orders as executions of one scan node for each (priority, status): estimate and rows from the keys."""
    return table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("queryid"), F.col("o_orderstatus").alias("planid"), F.lit(1).alias("node_no"), F.lit("Seq Scan").alias("node_type"), F.col("o_orderkey").alias("seqid"),
        (F.col("o_orderkey") % 97).cast("double").alias("plan_rows"), (F.col("o_custkey") % 89).cast("double").alias("actual_rows"), F.lit(None).cast("double").alias("actual_outer"), F.lit(None).cast("double").alias("actual_inner"),
    )


def _item_nodes(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """Line items as executions of one join node for each return flag."""
    return table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("queryid"), F.lit("p").alias("planid"), F.lit(1).alias("node_no"), F.lit(kind).alias("node_type"), F.col("l_orderkey").alias("seqid"), F.lit(2).alias("depth"),
        F.lit(1.0).alias("plan_rows"), (F.col("l_partkey") % 50).cast("double").alias("actual_rows"), F.col("l_quantity").alias("actual_outer"), F.col("l_linenumber").cast("double").alias("actual_inner"),
    )


def reg_scan(spark: SparkSession, d: str) -> DataFrame:
    sums = regression.node_sums(_order_nodes(spark, d))
    p = regression.scan_coefficient(F.col("n"), F.col("sum_plan"), F.col("sum_actual"))
    return sums.select("queryid", "planid", "n", "sum_plan", "sum_actual", F.round(p["coef"], 6).alias("coef"), F.round(p["intercept"], 5).alias("intercept"))


def reg_scan_floor(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers where the estimate dwarfs the rows: a mean instead of a ratio."""
    nodes = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("k")).agg(F.count("*").alias("n"), F.sum(F.col("l_partkey") * (F.col("l_suppkey") % 10)).cast("double").alias("p"), F.sum((F.col("l_quantity") > 25).cast("double")).alias("a"))
    p = regression.scan_coefficient(F.col("n"), F.col("p"), F.col("a"))
    g = regression.gather_coefficient(F.col("n"), F.col("p"), F.col("a"))
    return nodes.select("k", F.round(p["coef"], 8).alias("coef"), F.round(p["intercept"], 4).alias("intercept"), F.round(g["coef"], 8).alias("gather_coef"))


def reg_nested_loop(spark: SparkSession, d: str) -> DataFrame:
    sums = regression.node_sums(_item_nodes(spark, d, "Nested Loop"))
    return sums.select("queryid", "n", F.round(regression.product_coefficient(F.col("sum_product_actual"), F.col("sum_product_square")), 6).alias("coef"))


def reg_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Sums of two halves of the log, merged: the same as over the whole."""
    nodes = _order_nodes(spark, d)
    merged = regression.merge_sums(regression.node_sums(nodes.where("seqid % 2 = 0")), regression.node_sums(nodes.where("seqid % 2 = 1")))
    p = regression.scan_coefficient(F.col("n"), F.col("sum_plan"), F.col("sum_actual"))
    return merged.select("queryid", "planid", "n", "sum_plan", "sum_actual", F.round(p["coef"], 6).alias("coef"), F.round(p["intercept"], 5).alias("intercept"))


def reg_join_single(spark: SparkSession, d: str) -> DataFrame:
    return _item_nodes(spark, d, "Hash Join").groupBy("queryid").agg(F.round(F.regr_slope("actual_rows", "actual_outer"), 6).alias("slope_outer"), F.round(F.regr_intercept("actual_rows", "actual_outer"), 6).alias("intercept_outer"), F.round(F.regr_slope("actual_rows", "actual_inner"), 6).alias("slope_inner"))


def reg_join_fit(spark: SparkSession, d: str) -> DataFrame:
    sums = regression.node_sums(_item_nodes(spark, d, "Hash Join"))
    return regression.join_models(sums).select("queryid", *(F.round(c, 4).alias(c) for c in ("coef_outer", "coef_inner", "intercept", "rmse")))


def fit_sql(table: str, keys: str, outer: str, inner: str, actual: str) -> str:
    """CTEs that end in ``fit`` (keys, co, cv, b, rmse): the best of three linear models with the origin as a point."""
    return f"""
s AS (SELECT {keys}, count(*) AS n, sum({outer}) AS o, sum({inner}) AS v, sum({actual}) AS a, sum({outer} * {outer}) AS oo, sum({inner} * {inner}) AS vv, sum({outer} * {inner}) AS ov, sum({outer} * {actual}) AS oa, sum({inner} * {actual}) AS va, sum({actual} * {actual}) AS aa FROM {table} GROUP BY ALL),
c AS (SELECT *, k AS with_origin, n + k AS m, oo - o * o / (n + k) AS coo, vv - v * v / (n + k) AS cvv, ov - o * v / (n + k) AS cov, oa - o * a / (n + k) AS coa, va - v * a / (n + k) AS cva, aa - a * a / (n + k) AS caa FROM s, (VALUES (1), (0)) t(k)),
m3 AS (SELECT *, 1 AS model, (coa * cvv - cva * cov) / (coo * cvv - cov * cov) AS x, (cva * coo - coa * cov) / (coo * cvv - cov * cov) AS y FROM c UNION ALL SELECT *, 2, coa / coo, 0 FROM c UNION ALL SELECT *, 3, 0, cva / cvv FROM c),
picked AS (SELECT *, sqrt(greatest(caa - x * coa - y * cva, 0) / m) AS rmse FROM m3 QUALIFY row_number() OVER (PARTITION BY {keys}, model ORDER BY CASE WHEN x >= 0 AND y >= 0 THEN with_origin ELSE 0.5 - with_origin END DESC) = 1),
fit AS (SELECT *, x AS co, y AS cv, (a - x * o - y * v) / m AS b FROM picked QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY rmse, model) = 1)"""


def group_plan(spark: SparkSession, d: str) -> DataFrame:
    """The grouped plan: how often each node ran, and its first and last execution."""
    nodes = _order_nodes(spark, d).withColumns({"actual_loops": F.lit(1.0), "removed_rows": F.lit(0.0), "sort_space_kb": F.lit(0), "sort_space_type": F.lit("Memory"), "conds": F.array()})
    got = regression.grouped_plan(nodes)
    return got.select("queryid", "planid", "n", F.col("first.seqid").alias("first"), F.col("last.seqid").alias("last"), F.col("last.plan_rows").alias("last_plan"))


def sort_space_max(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "events").select(F.col("user_id").cast("string").alias("queryid"), F.col("event_type").alias("planid"), (F.col("event_id") % 5000).alias("sort_space_kb"), F.when(F.col("event_id") % 3 == 0, "Disk").otherwise("Memory").alias("sort_space_type"))
    return regression.disk_sort_space(nodes)


def latest_plan_per_query(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select(F.lit("db").alias("database"), F.col("user_id").cast("string").alias("queryid"), F.col("event_type").alias("planid"), F.col("event_id").alias("seqid"))
    return prm.latest_plan(log)


def query_texts(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select(F.col("event_type").alias("database"), F.col("user_id").cast("string").alias("queryid"), F.col("props").alias("query"), F.col("event_type").alias("planid"), F.col("event_id").alias("seqid"))
    return analyze.query_texts(log)


# --- workers --------------------------------------------------------------------------------------------------------


def worker_merge(spark: SparkSession, d: str) -> DataFrame:
    worker = lambda share: F.struct(F.lit(0).alias("no"), (F.col("value") * share).alias("rows"), F.lit(1.0).alias("loops"))
    nodes = table(spark, d, "events").select(
        "event_id", (F.col("event_id") % 3 == 0).alias("merge_flag"), (F.col("event_id") % 4 + 1).alias("norm_plan"), (F.col("event_id") % 2 + 1).alias("norm"),
        (F.col("event_id") % 100).cast("double").alias("plan_rows"), F.col("value").alias("actual_rows"), F.lit(1.0).alias("actual_loops"),
        F.when(F.col("event_id") % 5 == 0, F.array().cast("array<struct<no:int,rows:double,loops:double>>")).otherwise(F.array(worker(1.0), worker(0.5))).alias("workers"),
    )
    got = workers.merge_finished(nodes)
    return got.select("event_id", "plan_rows", F.round("actual_rows", 4).alias("actual_rows"), "actual_loops")


def worker_merge_live(spark: SparkSession, d: str) -> DataFrame:
    """Orders as leader trees of five nodes and of worker trees of the last three: nodes meet from the end."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    leader = o.select("o_orderkey", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("node_no")).withColumns({"plan_rows": F.col("node_no") * 10.0, "actual_rows": (F.col("o_orderkey") % 7).cast("double"), "merge_flag": F.col("node_no") != 5, "norm_plan": F.lit(3), "norm": F.lit(3)})
    tails = o.withColumn("worker", F.explode(F.sequence(F.lit(1), F.lit(2)))).withColumn("node_no", F.explode(F.sequence(F.lit(1), F.lit(3))))
    tails = tails.withColumn("actual_rows", (F.col("o_custkey") % 11 + F.col("worker") + F.col("node_no")).cast("double"))
    merged = workers.extrapolate(workers.merge_live(leader, tails, ["o_orderkey"]), 2)
    return merged.select("o_orderkey", "node_no", "plan_rows", F.round("actual_rows", 4).alias("actual_rows"))


# --- a fixed plan -----------------------------------------------------------------------------------------------------

#: number, parent, child index, depth, relationship, type, plan rows, actual rows, loops, removed.
_TREE = [
    (1, None, 0, 0, None, "Aggregate", 10.0, 0.0, 0.0, 0.0),
    (2, 1, 0, 1, "Outer", "Hash Join", 1000.0, 400.0, 1.0, 0.0),
    (3, 2, 0, 2, "Outer", "Nested Loop", 200.0, 300.0, 1.0, 20.0),
    (4, 3, 0, 3, "Outer", "Seq Scan", 20.0, 15.0, 1.0, 5.0),
    (5, 3, 1, 3, "Inner", "Index Scan", 10.0, 20.0, 15.0, 0.0),
    (6, 2, 1, 2, "Inner", "Hash", 50.0, 50.0, 1.0, 0.0),
    (7, 6, 0, 3, "Outer", "Seq Scan", 50.0, 50.0, 1.0, 0.0),
]
#: node, coef_outer, coef_inner, coef2, intercept.
_PARAMETERS = [(1, 0.5, 0.0, 0.0, 0.0), (2, 1.5, 2.0, 0.0, 10.0), (3, 0.5, 0.0, 0.0, 0.0), (4, 1.25, 0.0, 0.0, 0.0), (5, 2.0, 0.0, 0.0, 1.0), (6, 1.0, 0.0, 0.0, 0.0), (7, 0.0, 0.0, 0.0, 33.4)]


def _tree(spark: SparkSession) -> DataFrame:
    rows = [("q", "p", *r, False, 1, 1, []) for r in _TREE]
    return spark.createDataFrame(rows, "queryid string, planid string, node_no int, parent_no int, child_ix int, depth int, relationship string, node_type string, plan_rows double, actual_rows double, actual_loops double, removed_rows double, merge_flag boolean, norm int, norm_plan int, conds array<struct<kind:string,expr:string>>")


def replace_rows(spark: SparkSession, d: str) -> DataFrame:
    parameters = spark.createDataFrame([("q", "p", *r) for r in _PARAMETERS], "queryid string, planid string, node_no int, coef_outer double, coef_inner double, coef2 double, intercept double")
    return replace.replace_rows(_tree(spark), parameters, ["queryid", "planid"]).select("node_no", "node_type", "plan_rows")


_REPLACE_SQL = f"""
WITH n(node_no, node_type, plan_rows) AS (VALUES {", ".join(f"({r[0]}, '{r[5]}', {r[6]}::DOUBLE)" for r in _TREE)}),
p(node_no, c0, c1, c2, b) AS (VALUES {", ".join(f"({a}, {b}::DOUBLE, {c}::DOUBLE, {e}::DOUBLE, {f}::DOUBLE)" for a, b, c, e, f in _PARAMETERS)}),
j AS (SELECT * FROM n JOIN p USING (node_no)),
leaf AS (SELECT node_no, round_even(c0 * plan_rows + b, 0) AS v FROM j WHERE node_no IN (4, 5, 7)),
six AS (SELECT round_even(c0 * plan_rows + b, 0) AS v FROM j WHERE node_no = 6),
three AS (SELECT round_even(c0 * (SELECT v FROM leaf WHERE node_no = 4) * (SELECT v FROM leaf WHERE node_no = 5), 0) AS v FROM j WHERE node_no = 3),
two AS (SELECT round_even(c0 * (SELECT v FROM three) + c1 * (SELECT v FROM six) + b, 0) AS v FROM j WHERE node_no = 2)
SELECT CAST(node_no AS INTEGER) AS node_no, node_type, CASE node_no WHEN 1 THEN round_even(c0 * plan_rows + b, 0) WHEN 2 THEN (SELECT v FROM two) WHEN 3 THEN (SELECT v FROM three) WHEN 6 THEN (SELECT v FROM six) ELSE (SELECT v FROM leaf WHERE leaf.node_no = j.node_no) END AS plan_rows FROM j
"""


def progress_points(spark: SparkSession, d: str) -> DataFrame:
    """Points of each node of the fixed plan, by the rules."""
    root = progress.build([r.asDict(True) for r in _tree(spark).collect()])
    progress.set_states(root)
    progress.apply_rules(root)
    progress.set_points(root)
    rows, stack = [], [root]
    while stack:
        n = stack.pop()
        stack += n.children
        rows.append((n.number, n.state, n.plan_points, n.actual_points))
    return spark.createDataFrame(rows, "node_no int, state string, plan_points double, actual_points double")


# by hand from the definitions: the inner scan and both sides' leaves end by the rules, the hash as it has rows
_POINTS_SQL = """SELECT CAST(n AS INTEGER) AS node_no, s AS state, CAST(p AS DOUBLE) AS plan_points, CAST(a AS DOUBLE) AS actual_points FROM (VALUES
(1, 'WAITING', 1000, 0), (2, 'RUNNING', 430, 400), (3, 'RUNNING', 400, 320), (4, 'RUNNING', 25, 20), (5, 'FINISHED', 20, 20), (6, 'FINISHED', 50, 50), (7, 'FINISHED', 50, 50)) t(n, s, p, a)"""


def progress_ratio(spark: SparkSession, d: str) -> DataFrame:
    return progress.progress(_tree(spark), ["queryid", "planid"])


_RATIO_SQL = "SELECT 'q' AS queryid, 'p' AS planid, round_even((0 + 400 + 320 + 50) / (1000 + 430 + 400 + 50)::DOUBLE, 6) AS progress"


# --- analysis ---------------------------------------------------------------------------------------------------------


def misestimate(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("queryid"), F.col("event_type").alias("planid"), F.lit(1).alias("node_no"), F.when(F.col("event_type") == "click", "Hash Join").otherwise("Seq Scan").alias("node_type"),
        (F.col("event_id") % 50).cast("double").alias("plan_rows"), F.floor("value").cast("double").alias("actual_rows"),
        F.array(F.struct(F.lit("Filter").alias("kind"), F.concat(F.lit("a "), F.when(F.col("event_id") % 2 == 0, "= ").otherwise("< "), (F.col("event_id") % 3).cast("string")).alias("expr"))).alias("conds"),
    )
    return analyze.misestimates(nodes).select("queryid", "planid", F.array_join("conditions", "; ").alias("conditions"))


def misestimate_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Aggregates over scans with up to three kinds of conditions: the last kind counts, and a node without any has its
    child's."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("queryid"), F.col("event_type").alias("planid"), "event_id", F.floor("value").cast("double").alias("actual_rows"))
    cond = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("expr"))
    number = lambda k: (F.col("event_id") % k).cast("string")
    conds = F.when(F.col("event_id") % 4 == 0, F.array(cond("Filter", F.concat(F.lit("f = "), number(3))), cond("Index Cond", F.concat(F.lit("i = "), number(2))))).when(F.col("event_id") % 4 == 1, F.array(cond("Index Cond", F.concat(F.lit("i = "), number(5))))).when(F.col("event_id") % 4 == 2, F.array(cond("Index Cond", F.lit("i = 9")), cond("Filter", F.lit("f < 1")))).otherwise(F.array().cast("array<struct<kind:string,expr:string>>"))
    scan = e.select("queryid", "planid", F.lit(2).alias("node_no"), F.lit(1).alias("parent_no"), F.lit(0).alias("child_ix"), F.lit("Seq Scan").alias("node_type"), F.lit(1.0).alias("plan_rows"), F.lit(5.0).alias("actual_rows"), conds.alias("conds"))
    above = e.select("queryid", "planid", F.lit(1).alias("node_no"), F.lit(None).cast("int").alias("parent_no"), F.lit(0).alias("child_ix"), F.lit("Aggregate").alias("node_type"), (F.col("event_id") % 50).cast("double").alias("plan_rows"), "actual_rows", F.array().cast("array<struct<kind:string,expr:string>>").alias("conds"))
    return analyze.misestimates(scan.unionByName(above)).select("queryid", "planid", "node_no", F.array_join("conditions", "; ").alias("conditions"))


_KINDS_SQL = """
WITH n AS (SELECT *, CAST(event_id % 50 AS DOUBLE) AS p, floor(value) AS a, CASE event_id % 4 WHEN 0 THEN 'Filter: f = ' || (event_id % 3) WHEN 1 THEN 'Index Cond: i = ' || (event_id % 5) END AS c FROM events)
SELECT CAST(user_id AS VARCHAR) AS queryid, event_type AS planid, 1 AS node_no, coalesce(string_agg(DISTINCT c, '; ' ORDER BY c), '') AS conditions FROM n GROUP BY 1, 2 HAVING bool_or(p > 0 AND a > 0 AND (a / p > 10 OR p / a > 10))"""


def neural_joins(spark: SparkSession, d: str) -> DataFrame:
    """A model for each return flag's joins, and how far its predictions are off, by the mean of the rows."""
    training = analyze.join_training(_item_nodes(spark, d, "Hash Join"))
    models = neural.train_joins(training, epochs=20)
    told = neural.predict_joins(training, models)
    return told.groupBy("queryid").agg(F.count("*").alias("n"), (F.avg("predicted") > 0).alias("positive"))


def sampled_rows(spark: SparkSession, d: str) -> DataFrame:
    return statistics.sampled(table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", "o_orderkey"), 500, seed=3)


def join_training(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("queryid"), F.col("l_returnflag").alias("planid"), F.lit(1).alias("node_no"), F.lit(2).alias("depth"), F.lit("Hash Join").alias("node_type"), F.col("l_quantity").alias("actual_outer"), F.col("l_linenumber").cast("double").alias("actual_inner"), (F.col("l_partkey") % 50).cast("double").alias("actual_rows"))
    return analyze.join_training(nodes, 130).groupBy("queryid", "planid").agg(F.count("*").alias("n"), F.sum("x_outer").alias("x_outer"), F.sum("x_inner").alias("x_inner"), F.sum("y").alias("y"))


def hist_skew(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "events").select(F.col("user_id").cast("string").alias("queryid"), F.col("event_type").alias("planid"), F.lit(1).alias("node_no"), F.col("event_id").alias("seqid"), (F.col("event_id") % 7 * 40 + 100).cast("double").alias("plan_rows"), F.floor("value").cast("double").alias("actual_rows"))
    return analyze.histogram_skew(nodes).select("queryid", "planid", F.col("groups").cast("bigint").alias("groups"), "skewed")


# equal estimates fall into one cluster each, and different ones are over 5 % apart, so clusters are the groups here
_SKEW_SQL = """
WITH g AS (SELECT user_id, event_type, event_id % 7 AS k, count(*) AS n, min(floor(value)) AS lo, max(floor(value)) AS hi FROM events GROUP BY ALL)
SELECT CAST(user_id AS VARCHAR) AS queryid, event_type AS planid, CAST(count(*) AS BIGINT) AS groups, bool_or(n > 1 AND hi > lo * 1.75 AND hi <> lo) AS skewed FROM g GROUP BY ALL
"""


# --- statistics ---------------------------------------------------------------------------------------------------------


_FD_CASES = [("nation", ["n_nationkey"], "n_regionkey"), ("lineitem", ["l_partkey", "l_suppkey"], "l_returnflag"), ("part", ["p_brand", "p_size"], "p_type"), ("orders", ["o_custkey"], "o_orderstatus"), ("lineitem", ["l_returnflag"], "l_linestatus")]


def fd_degree(spark: SparkSession, d: str) -> DataFrame:
    """Five dependencies, one scan for each table."""
    out = None
    for name in dict.fromkeys(n for n, _, _ in _FD_CASES):
        found = statistics.dependencies(table(spark, d, name), [], [(g, t) for n, g, t in _FD_CASES if n == name])
        one = found.select(F.array_join("given", ",").alias("given"), F.col("to").alias("to_column"), F.round("degree", 8).alias("degree"))
        out = one if out is None else out.unionByName(one)
    return out


_FD_SQL = " UNION ALL ".join(
    f"SELECT '{','.join(g)}' AS given, '{t}' AS to_column, round(coalesce(sum(CASE WHEN v = 1 THEN n END), 0) / sum(n), 8) AS degree FROM (SELECT count(*) AS n, count(DISTINCT {t}) AS v FROM {name} GROUP BY {', '.join(g)})"
    for name, g, t in [("nation", ["n_nationkey"], "n_regionkey"), ("lineitem", ["l_partkey", "l_suppkey"], "l_returnflag"), ("part", ["p_brand", "p_size"], "p_type"), ("orders", ["o_custkey"], "o_orderstatus"), ("lineitem", ["l_returnflag"], "l_linestatus")]
)


def fd_enumerate(spark: SparkSession, d: str) -> DataFrame:
    found = statistics.dependencies(table(spark, d, "customer"), ["c_nationkey", "c_mktsegment", "c_custkey"])
    return found.select(F.concat_ws(",", "given").alias("given"), F.col("to").alias("to_column"), F.round("degree", 8).alias("degree"))


_FD_ALL = [(["c_mktsegment"], "c_nationkey"), (["c_nationkey"], "c_mktsegment"), (["c_custkey"], "c_nationkey"), (["c_nationkey"], "c_custkey"), (["c_custkey"], "c_mktsegment"), (["c_mktsegment"], "c_custkey"), (["c_custkey", "c_mktsegment"], "c_nationkey"), (["c_custkey", "c_nationkey"], "c_mktsegment"), (["c_mktsegment", "c_nationkey"], "c_custkey")]
_FD_ALL_SQL = " UNION ALL ".join(f"SELECT '{','.join(g)}' AS given, '{t}' AS to_column, round(coalesce(sum(CASE WHEN v = 1 THEN n END), 0) / sum(n), 8) AS degree FROM (SELECT count(*) AS n, count(DISTINCT {t}) AS v FROM customer GROUP BY {', '.join(g)})" for g, t in _FD_ALL)


def fd_strongest(spark: SparkSession, d: str) -> DataFrame:
    found = statistics.dependencies(table(spark, d, "customer"), ["c_nationkey", "c_mktsegment", "c_custkey"])
    best = statistics.strongest_dependency(found, ["c_nationkey", "c_mktsegment", "c_custkey"])
    return best.select(F.concat_ws(",", "given").alias("given"), F.col("to").alias("to_column"), F.round("degree", 8).alias("degree"))


def fd_selectivity(spark: SparkSession, d: str) -> DataFrame:
    """Per brand and size: P(brand and size) from the degree of the dependency between them."""
    part = table(spark, d, "part")
    degree = statistics.dependency_degree(part, ["p_brand"], "p_size")
    n = part.agg(F.count("*").alias("all"))
    a = part.groupBy("p_brand").agg(F.count("*").alias("na"))
    b = part.groupBy("p_size").agg(F.count("*").alias("nb"))
    rows = a.crossJoin(b).crossJoin(F.broadcast(n)).crossJoin(F.broadcast(degree))
    return rows.select("p_brand", "p_size", F.round(statistics.dependent_selectivity(F.col("degree"), F.col("na") / F.col("all"), F.col("nb") / F.col("all")), 8).alias("selectivity"))


_FD_SEL_SQL = """
WITH n AS (SELECT count(*) AS total FROM part), a AS (SELECT p_brand, count(*) AS na FROM part GROUP BY 1), b AS (SELECT p_size, count(*) AS nb FROM part GROUP BY 1),
f AS (SELECT coalesce(sum(CASE WHEN v = 1 THEN c END), 0) / sum(c) AS degree FROM (SELECT count(*) AS c, count(DISTINCT p_size) AS v FROM part GROUP BY p_brand))
SELECT p_brand, p_size, round(degree * least(na / total, nb / total) + (1 - degree) * (na / total) * (nb / total), 8) AS selectivity FROM a, b, n, f
"""


def mcv_list(spark: SparkSession, d: str) -> DataFrame:
    got = statistics.mcv_list(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], 10)
    return got.select("o_orderstatus", "o_orderpriority", "n", F.round("frequency", 8).alias("frequency"), F.round("base_frequency", 8).alias("base_frequency"))


_MCV_CTE = """
n AS (SELECT count(*) AS total FROM orders), a AS (SELECT o_orderstatus, count(*) AS na FROM orders GROUP BY 1), b AS (SELECT o_orderpriority, count(*) AS nb FROM orders GROUP BY 1),
m AS (SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10)
"""


def mcv_mincount(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").cast("double").alias("n"))
    return n.select("o_orderpriority", F.round(statistics.mcv_min_count(F.col("n"), F.lit(1_000_000.0)), 6).alias("least"))


def mcv_combine(spark: SparkSession, d: str) -> DataFrame:
    mcv = statistics.mcv_list(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], 10)
    out = None
    for name, any_of in (("all", False), ("any", True)):
        m = statistics.mcv_match(mcv, [F.col("o_orderstatus") == "F", F.col("o_orderpriority") < "3"], any_of)
        one = m.select(F.lit(name).alias("clauses"), F.round(statistics.mcv_combine(F.lit(0.3), F.col("selectivity"), F.col("base"), F.col("total")), 8).alias("selectivity"))
        out = one if out is None else out.unionByName(one)
    return out


def selectivities(spark: SparkSession, d: str) -> DataFrame:
    """AND, OR and range selectivities from shares of the customers."""
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.avg((F.col("c_acctbal") > 0).cast("double")).alias("a"), F.avg((F.col("c_mktsegment") == "BUILDING").cast("double")).alias("b"), F.avg((F.col("c_acctbal") < 8000).cast("double")).alias("hi"))
    parts = F.array("a", "b")
    return c.select("c_nationkey", F.round(statistics.and_selectivity(parts), 8).alias("both"), F.round(statistics.or_selectivity(parts), 8).alias("either"), F.round(statistics.range_selectivity(F.col("a"), F.col("hi"), F.lit(0.0)), 8).alias("between"))


def best_statistics(spark: SparkSession, d: str) -> DataFrame:
    objects = spark.createDataFrame([("s1", ["a", "b"]), ("s2", ["a", "b", "c"]), ("s3", ["a", "b", "c", "d"]), ("s4", ["x", "y"])], "name string, columns array<string>")
    return statistics.best_statistics(objects, ["a", "b", "c"]).select("name")


def group_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Groups to expect by nation and segment among the customers above each of four balances."""
    c = table(spark, d, "customer")
    whole = c.agg(F.count_distinct("c_nationkey").alias("d1"), F.count_distinct("c_mktsegment").alias("d2"), F.count("*").cast("double").alias("n"))
    levels = c.select(F.explode(F.array(*map(F.lit, (-2000.0, 0.0, 5000.0, 9900.0)))).alias("level"), "c_acctbal")
    rows = levels.groupBy("level").agg(F.sum((F.col("c_acctbal") > F.col("level")).cast("double")).alias("p")).crossJoin(F.broadcast(whole))
    return rows.select("level", statistics.group_count([F.col("d1")], F.col("n"), F.col("p")).alias("by_nation"), statistics.group_count([F.col("d1"), F.col("d2")], F.col("n"), F.col("p")).alias("by_both"))


_GROUPS_SQL = """
WITH w AS (SELECT CAST(count(DISTINCT c_nationkey) AS DOUBLE) AS d1, CAST(count(DISTINCT c_mktsegment) AS DOUBLE) AS d2, CAST(count(*) AS DOUBLE) AS n FROM customer),
r AS (SELECT level, sum(CASE WHEN c_acctbal > level THEN 1.0 ELSE 0.0 END)::DOUBLE AS p FROM customer, (VALUES (-2000.0::DOUBLE), (0.0), (5000.0), (9900.0)) t(level) GROUP BY level),
g AS (SELECT level, p, n, least(d1, n) AS one, greatest(least(d1 * d2, n * 0.1), d1, d2) AS two FROM r, w)
SELECT level, CASE WHEN p <= 0 THEN 1 ELSE greatest(round_even(one * (1 - pow((n - p) / n, n / one)), 0), 1) END AS by_nation, CASE WHEN p <= 0 THEN 1 ELSE greatest(round_even(two * (1 - pow((n - p) / n, n / two)), 0), 1) END AS by_both FROM g"""


def expression_statistics(spark: SparkSession, d: str) -> DataFrame:
    got = statistics.expression_statistics(table(spark, d, "orders"), F.month("o_orderdate") * 10 + F.col("o_custkey") % 7)
    return got.select("n", "null_fraction", "n_distinct", F.round("width", 6).alias("width"), F.col("low").cast("bigint").alias("low"), F.col("high").cast("bigint").alias("high"))


def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select("o_orderkey", scalar.hash_dir(F.col("o_orderkey").cast("string")).alias("dir"), F.round(scalar.sort_work(F.col("o_totalprice")), 2).alias("work"), scalar.percent_floor(F.col("o_totalprice") / 500000).alias("percent"), scalar.query_hash(F.col("o_orderpriority")).alias("hash"), F.round(scalar.estimate_error(F.col("o_custkey").cast("double"), F.col("o_orderkey").cast("double")), 6).alias("error"))


# --- plan documents -------------------------------------------------------------------------------------------------------

_DOCUMENT = {
    "Plan": {
        "Node Type": "Aggregate", "Strategy": "Plain", "Partial Mode": "Finalize", "Plan Rows": 1, "Actual Rows": 1, "Actual Loops": 1,
        "Plans": [
            {"Node Type": "Gather", "Parent Relationship": "Outer", "Plan Rows": 2, "Actual Rows": 3, "Actual Loops": 1, "Workers Planned": 2, "Workers Launched": 2,
             "Plans": [
                 {"Node Type": "Nested Loop", "Parent Relationship": "Outer", "Join Type": "Inner", "Plan Rows": 100, "Actual Rows": 40, "Actual Loops": 1, "Workers": [{"Worker Number": 0, "Actual Rows": 30, "Actual Loops": 1}, {"Worker Number": 1, "Actual Rows": 20, "Actual Loops": 1}],
                  "Plans": [
                      {"Node Type": "Seq Scan", "Parent Relationship": "Outer", "Schema": "public", "Relation Name": "t1", "Alias": "a", "Filter": "(x = 1)", "Rows Removed by Filter": 7, "Plan Rows": 10, "Actual Rows": 4, "Actual Loops": 1, "Workers": [{"Worker Number": 0, "Actual Rows": 3, "Actual Loops": 1}]},
                      {"Node Type": "Index Scan", "Parent Relationship": "Inner", "Schema": "public", "Relation Name": "t2", "Alias": "b", "Index Cond": "(b.id = a.id)", "Plan Rows": 10, "Actual Rows": 10, "Actual Loops": 9},
                  ]},
             ]},
        ],
    }
}


def _document_log(spark: SparkSession, n: int = 3) -> DataFrame:
    rows = [(i, "q", "p", json.dumps(_DOCUMENT)) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "seqid bigint, queryid string, planid string, plan_json string")


def plan_flatten(spark: SparkSession, d: str) -> DataFrame:
    nodes = workers.merge_finished(flatten.plan_nodes(_document_log(spark)))
    return nodes.select("seqid", "node_no", "parent_no", "depth", "last_no", "node_type", "merge_flag", "norm", "plan_rows", "actual_rows", "removed_rows", F.array_join("relations", ",").alias("relations"))


_FLATTEN_SQL = """
SELECT CAST(s AS BIGINT) AS seqid, CAST(a AS INTEGER) AS node_no, CAST(b AS INTEGER) AS parent_no, CAST(c AS INTEGER) AS depth, CAST(e AS INTEGER) AS last_no, f AS node_type, g AS merge_flag, CAST(h AS INTEGER) AS norm, CAST(i AS DOUBLE) AS plan_rows, CAST(j AS DOUBLE) AS actual_rows, CAST(k AS DOUBLE) AS removed_rows, l AS relations
FROM range(1, 4) r(s), (VALUES (1, NULL, 0, 5, 'Aggregate', false, 1, 1, 1, 0, 'public.t1,public.t2'), (2, 1, 1, 5, 'Gather', true, 3, 2, 3, 0, 'public.t1,public.t2'), (3, 2, 2, 5, 'Nested Loop', true, 3, 300, 90, 0, 'public.t1,public.t2'),
(4, 3, 3, 4, 'Seq Scan', true, 3, 30, 7, 7, 'public.t1'), (5, 3, 3, 5, 'Index Scan', false, 1, 10, 10, 0, 'public.t2')) t(a, b, c, e, f, g, h, i, j, k, l)
"""


def plan_regression(spark: SparkSession, d: str) -> DataFrame:
    """Parameters of the document's nodes over its executions."""
    nodes = regression.with_inputs(workers.merge_finished(flatten.plan_nodes(_document_log(spark))))
    return regression.parameters(nodes).select("node_no", "node_type", "n", F.round("coef_outer", 6).alias("coef"), "intercept")


_PLAN_REG_SQL = "SELECT CAST(a AS INTEGER) AS node_no, t AS node_type, CAST(3 AS BIGINT) AS n, round(CAST(c AS DOUBLE), 6) AS coef, CAST(0 AS DOUBLE) AS intercept FROM (VALUES (1, 'Aggregate', 1.0), (2, 'Gather', 1.5), (3, 'Nested Loop', 90.0 / 70), (4, 'Seq Scan', 7.0 / 30), (5, 'Index Scan', 1.0)) v(a, t, c)"


def plan_parameters(spark: SparkSession, d: str) -> DataFrame:
    """The text that is pushed for the document's plan."""
    return prm.encode(regression.parameters(flatten.plan_nodes(_document_log(spark), finished=True)))


def plan_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    other = json.loads(json.dumps(_DOCUMENT).replace("(x = 1)", "(x = 77)").replace('"Actual Rows": 4', '"Actual Rows": 9'))
    third = json.loads(json.dumps(_DOCUMENT).replace("Index Scan", "Seq Scan"))
    log = spark.createDataFrame([(k, json.dumps(t)) for k, t in (("a", _DOCUMENT), ("b", other), ("c", third))], "name string, plan_json string")
    ids = log.select("name", fingerprint.planid_column(F.col("plan_json")).alias("planid"))
    return ids.alias("x").join(ids.alias("y"), F.col("x.planid") == F.col("y.planid")).select(F.col("x.name").alias("one"), F.col("y.name").alias("same"))


_FINGERPRINT_SQL = "SELECT * FROM (VALUES ('a', 'a'), ('a', 'b'), ('b', 'a'), ('b', 'b'), ('c', 'c')) t(one, same)"


# --- plan documents made from a table ---------------------------------------------------------------------------------

#: Estimates and rows of the made documents: join, outer scan, inner scan, worker rows, as both engines compute them.
_MADE = {
    "pj": "o_orderkey % 40 + 1", "aj": "(o_orderkey + o_custkey) % 17", "po": "o_orderkey % 10 + 1", "ao": "o_orderkey % 13 + o_custkey % 3", "pi": "o_custkey % 7 + 1", "ai": "o_custkey % 11 + o_orderkey % 5",
    "wj": "o_custkey % 5", "wo": "o_orderkey % 4", "gone": "o_orderkey % 3",
}
_MADE_SQL = "SELECT o_orderkey, o_orderpriority, o_orderstatus, CAST(ascii(o_orderstatus) AS VARCHAR) AS planid, " + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in _MADE.items()) + " FROM orders"
#: The join's type by the order's status.
_MADE_JOIN = {"F": "Nested Loop", "O": "Hash Join", "P": "Merge Join"}


def _made_log(spark: SparkSession, d: str) -> DataFrame:
    """A log row for each order: a Gather with two planned workers and one launched over a join of two scans, with the
    worker's rows listed at the join and its outer scan.  Query: the priority, plan: the status as a number."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", *(F.expr(e).alias(n) for n, e in _MADE.items()))
    # texts put together: the same documents as by to_json, at a fraction of its time; a null field is left out
    field = lambda name, value: F.coalesce(F.concat(F.lit(f',"{name}":'), value.cast("string")), F.lit(""))
    rows = lambda plan, actual: [field("Plan Rows", plan), field("Actual Rows", actual), F.lit(',"Actual Loops":1.0')]
    worker = lambda actual: [F.lit(',"Workers":[{"Worker Number":0'), field("Actual Rows", actual), F.lit(',"Actual Loops":1.0}]')]
    kind = F.when(F.col("o_orderstatus") == "F", _MADE_JOIN["F"]).when(F.col("o_orderstatus") == "O", _MADE_JOIN["O"]).otherwise(_MADE_JOIN["P"])
    outer = [F.lit('{"Node Type":"Seq Scan","Parent Relationship":"Outer","Schema":"public","Relation Name":"t1","Alias":"a","Filter":"(x = '), F.col("o_orderkey").cast("string"), F.lit(')"'), field("Rows Removed by Filter", F.col("gone")), *rows(F.col("po"), F.col("ao")), *worker(F.col("wo"))]
    inner = [F.lit('},{"Node Type":"Seq Scan","Parent Relationship":"Inner","Schema":"public","Relation Name":"t2","Alias":"b"'), *rows(F.col("pi"), F.col("ai"))]
    join = [F.lit('{"Node Type":"'), kind, F.lit('","Parent Relationship":"Outer","Join Type":"Inner"'), *rows(F.col("pj"), F.col("aj")), *worker(F.col("wj")), F.lit(',"Plans":[')]
    gather = [F.lit('{"Plan":{"Node Type":"Gather","Workers Planned":2,"Workers Launched":1'), *rows(F.col("pj"), F.col("aj") + F.col("wj")), F.lit(',"Plans":[')]
    text = F.concat(*gather, *join, *outer, *inner, F.lit("}]}]}}"))
    return o.select(F.col("o_orderkey").alias("seqid"), F.col("o_orderpriority").alias("queryid"), F.ascii("o_orderstatus").cast("string").alias("planid"), text.alias("plan_json"))


#: The made documents' nodes with workers merged: the inner scan stands outside the parallel region.
_MADE_NODES = f"""
m AS ({_MADE_SQL}),
nodes AS (
SELECT o_orderkey AS seqid, o_orderpriority AS queryid, planid, 1 AS node_no, NULL AS parent_no, 'Gather' AS node_type, 3 AS last_no, pj AS plan_rows, aj + wj AS actual_rows, 0.0::DOUBLE AS removed_rows, 2 AS norm, 3 * pj AS plan_outer, aj + wj AS actual_outer, NULL::DOUBLE AS plan_inner, NULL::DOUBLE AS actual_inner FROM m
UNION ALL SELECT o_orderkey, o_orderpriority, planid, 2, 1, CASE o_orderstatus WHEN 'F' THEN 'Nested Loop' WHEN 'O' THEN 'Hash Join' ELSE 'Merge Join' END, 4, 3 * pj, aj + wj, 0.0, 2, 3 * po, ao + wo, pi, ai FROM m
UNION ALL SELECT o_orderkey, o_orderpriority, planid, 3, 2, 'Seq Scan', 3, 3 * po, ao + wo, gone, 2, NULL, NULL, NULL, NULL FROM m
UNION ALL SELECT o_orderkey, o_orderpriority, planid, 4, 2, 'Seq Scan', 4, pi, ai, 0.0, 1, NULL, NULL, NULL, NULL FROM m)"""


def table_flatten(spark: SparkSession, d: str) -> DataFrame:
    nodes = flatten.plan_nodes(_made_log(spark, d), finished=True)
    return nodes.select("seqid", "queryid", "planid", "node_no", "parent_no", "node_type", "plan_rows", "actual_rows", "removed_rows", "norm", "plan_outer", "actual_outer", "plan_inner", "actual_inner")


_TABLE_FLATTEN_SQL = f"WITH {_MADE_NODES} SELECT seqid, queryid, planid, CAST(node_no AS INTEGER) AS node_no, CAST(parent_no AS INTEGER) AS parent_no, node_type, plan_rows, actual_rows, removed_rows, CAST(norm AS INTEGER) AS norm, plan_outer, actual_outer, plan_inner, actual_inner FROM nodes"

_PARAMETER_COLUMNS = ("coef_outer", "coef_inner", "intercept")


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("queryid", "planid", "node_no", "node_type", "n", *(F.round(c, 4).alias(c) for c in _PARAMETER_COLUMNS))


def table_regression(spark: SparkSession, d: str) -> DataFrame:
    """Parameters of all nodes of the made documents, over all executions."""
    return _rounded(regression.parameters(flatten.plan_nodes(_made_log(spark, d), finished=True)))


_TABLE_REG = f"""
WITH {_MADE_NODES},
joins AS (SELECT * FROM nodes WHERE node_type IN ('Hash Join', 'Merge Join')),
{fit_sql("joins", "queryid, planid, node_no, node_type", "actual_outer", "actual_inner", "actual_rows")},
params AS (
SELECT queryid, planid, node_no, node_type, count(*) AS n, CASE WHEN node_type = 'Nested Loop' THEN coalesce(sum(actual_outer * actual_inner * actual_rows) / nullif(sum(actual_outer * actual_inner * actual_outer * actual_inner), 0), 1) WHEN sum(plan_rows) = 0 OR 250 * sum(actual_rows) < sum(plan_rows) THEN 0 ELSE sum(actual_rows) / sum(plan_rows) END AS co,
0 AS cv, CASE WHEN node_type <> 'Nested Loop' AND (sum(plan_rows) = 0 OR 250 * sum(actual_rows) < sum(plan_rows)) THEN round_even(sum(actual_rows) / count(*), 5) ELSE 0 END AS b FROM nodes WHERE node_type NOT IN ('Hash Join', 'Merge Join') GROUP BY queryid, planid, node_no, node_type
UNION ALL SELECT queryid, planid, node_no, node_type, n, round_even(co, 5), round_even(cv, 5), round_even(b, 5) FROM fit)"""
_TABLE_REG_SQL = _TABLE_REG + " SELECT queryid, planid, CAST(node_no AS INTEGER) AS node_no, node_type, CAST(n AS BIGINT) AS n, round(CAST(co AS DOUBLE), 4) AS coef_outer, round(CAST(cv AS DOUBLE), 4) AS coef_inner, round(CAST(b AS DOUBLE), 4) AS intercept FROM params"


def repository_incremental(spark: SparkSession, d: str) -> DataFrame:
    """The made log taken into a repository in three parts: the parameters are those of the whole."""
    from .repository import Repository

    log = _made_log(spark, d)
    full = log.select("seqid", *(F.lit(None).cast(t).alias(c) for c, t in (x.split(" ") for x in schema.PLAN_LOG.split(", ")[1:6])), "queryid", F.lit(None).cast("string").alias("query"), "planid", F.lit(None).cast("string").alias("plan"), "plan_json")
    repo = Repository.create(spark, fresh_path(spark, "repository"))
    repo.add("s")
    most = log.agg(F.max("seqid")).first()[0] or 0
    # a log begins with 1: the order with key 0 comes with the first part
    shifted = full.withColumn("seqid", F.col("seqid") + 1)
    for upto in (most // 3, 2 * most // 3, most + 1):
        repo.get("s", shifted.where(F.col("seqid") <= upto))
    return _rounded(repo.parameters("s"))


def table_replace(spark: SparkSession, d: str) -> DataFrame:
    """The made documents' estimates replaced by what their own plan's parameters say."""
    log = _made_log(spark, d)
    nodes = flatten.plan_nodes(log, finished=True, columns=["node_no", "node_type", "plan_rows", "actual_rows", "actual_outer", "actual_inner"])
    whole = [F.round(F.col(c) * 4).alias(c) for c in ("coef_outer", "coef_inner", "intercept")]
    # in steps of one, so that rounding is the same in every engine
    steps = regression.parameters(nodes).select("queryid", "planid", "node_no", *whole, "coef2")
    return replace.replace_log(log, steps, finished=True, columns=["node_no", "plan_rows"]).select("seqid", "node_no", "plan_rows")


_TABLE_REPLACE_SQL = _TABLE_REG + """,
w AS (SELECT seqid, n.queryid, n.planid, n.node_no, n.node_type, plan_rows, norm, round(co * 4) AS co, round(cv * 4) AS cv, round(b * 4) AS b FROM nodes n JOIN params p ON n.queryid = p.queryid AND n.planid = p.planid AND n.node_no = p.node_no),
scans AS (SELECT *, round_even((co * plan_rows + b) * CASE WHEN node_no = 3 THEN 3 ELSE 1 END / norm, 0) AS v FROM w WHERE node_no > 2),
joined AS (SELECT w.*, CASE WHEN w.node_type = 'Nested Loop' THEN round_even(w.co * o.v * i.v, 0) WHEN w.co = 0 AND w.cv = 0 THEN round_even(w.b, 0) ELSE round_even(w.co * o.v + w.cv * i.v + w.b, 0) END AS v FROM w JOIN scans o ON o.seqid = w.seqid AND o.node_no = 3 JOIN scans i ON i.seqid = w.seqid AND i.node_no = 4 WHERE w.node_no = 2)
SELECT seqid, CAST(node_no AS INTEGER) AS node_no, v AS plan_rows FROM scans UNION ALL SELECT seqid, CAST(node_no AS INTEGER), v FROM joined
UNION ALL SELECT seqid, CAST(node_no AS INTEGER), round_even((co * plan_rows + b) * 3 / norm, 0) FROM w WHERE node_no = 1"""


def table_progress(spark: SparkSession, d: str) -> DataFrame:
    """Progress of the made documents as if their estimates were learnt ones."""
    return progress.log_progress(_made_log(spark, d), ["seqid"], regression=True, finished=True)


_TABLE_PROGRESS_SQL = f"""
WITH m AS ({_MADE_SQL}),
x AS (SELECT o_orderkey AS seqid, greatest(3 * po, ao + wo) AS o, greatest(pi, ai) AS i, ao + wo AS oa, ai AS ia, o_orderstatus AS s, greatest(pj, aj + wj) AS gp, aj + wj AS ga FROM m),
y AS (SELECT seqid, gp + CASE WHEN s = 'F' THEN o * i ELSE o + i END AS p, ga + CASE WHEN s = 'F' THEN oa * ia ELSE oa + ia END AS a FROM x)
SELECT seqid, CASE WHEN p = 0 THEN 0 ELSE round_even(least(a / p, 1), 6) END AS progress FROM y"""


def progress_driver(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots of leaders and of up to two workers of a parallel scan, one moment for each order, taken through the
    whole driver: workers without a queryid, workers that have left, and all three modes."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.expr("CAST(o_orderkey % 50 + 1 AS DOUBLE)").alias("p"), F.expr("CAST(o_custkey % 23 AS DOUBLE)").alias("a"))
    scan = lambda rows: F.format_string('{"Node Type":"Seq Scan","Parent Relationship":"Outer","Schema":"public","Relation Name":"t","Plan Rows":%s,"Actual Rows":%s,"Actual Loops":1}', F.col("p"), rows)
    leader = F.concat(F.format_string('{"Plan":{"Node Type":"Gather","Workers Planned":2,"Workers Launched":2,"Plan Rows":%s,"Actual Rows":%s,"Actual Loops":1,"Plans":[', F.col("p") * 2, F.col("a")), scan(F.col("a")), F.lit("]}}"))
    text = F.concat(F.lit("select "), F.col("o_orderpriority"))
    shape = lambda rows, pid, kind, queryid, plan: rows.select("o_orderkey", F.lit(pid).alias("pid"), F.lit(None).cast("string").alias("database"), F.lit(kind).alias("worker_type"), F.lit(0).alias("nested_level"), queryid.alias("queryid"), text.alias("query"), F.lit("scan").alias("planid"), plan.alias("plan_json"))
    seen = shape(o, 1, "leader", F.col("o_orderpriority"), leader)
    for pid in (2, 3):
        here = o.where(f"o_orderkey % {pid} = 0")
        seen = seen.unionByName(shape(here, pid, "parallel worker", F.lit("0"), F.concat(F.lit('{"Plan":'), scan(F.col("a") + pid), F.lit("}"))))
    pushed = spark.createDataFrame([("1-URGENT", "x"), ("2-HIGH", "")], "queryid string, params string")
    learnt = spark.createDataFrame([(q, "scan", n, c, 0.0, 0.0, b) for q in ("1-URGENT", "2-HIGH", "3-MEDIUM") for n, c, b in ((1, 3.0, 2.0), (2, 2.0, 1.0))], "queryid string, planid string, node_no int, coef_outer double, coef_inner double, coef2 double, intercept double")
    return live.drive(seen, ["o_orderkey"], pushed, learnt)


_DRIVER_SQL = """
WITH o AS (SELECT o_orderkey, o_orderpriority AS q, CAST(o_orderkey % 50 + 1 AS DOUBLE) AS p, CAST(o_custkey % 23 AS DOUBLE) AS a, CAST(o_orderkey % 2 = 0 AS INTEGER) AS w2, CAST(o_orderkey % 3 = 0 AS INTEGER) AS w3 FROM orders),
x AS (SELECT *, CASE WHEN w2 + w3 < 2 THEN 3.0::DOUBLE / (1 + w2 + w3) ELSE 1 END AS f, CASE WHEN w2 + w3 > 0 THEN 3 * p ELSE p END AS scan_plan, a + w2 * (a + 2) + w3 * (a + 3) AS scan_rows, CASE q WHEN '1-URGENT' THEN 'pushed' WHEN '2-HIGH' THEN 'regression' WHEN '3-MEDIUM' THEN 'regression' ELSE 'rules' END AS mode FROM o),
y AS (SELECT *, a * f AS ga, scan_rows * f AS sa FROM x),
z AS (SELECT *, CASE WHEN mode = 'regression' THEN greatest(round_even((3 * (2 * p) + 2) * 3 / 3, 0), ga) WHEN scan_plan <= sa THEN sa ELSE greatest(scan_plan, sa) END AS gp FROM y)
SELECT o_orderkey, q AS queryid, mode, CASE WHEN gp = 0 THEN 0 ELSE round_even(least(ga / gp, 1), 6) END AS progress FROM z"""


def _flagship(spark: SparkSession, d: str) -> DataFrame:
    items, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    return items.where("l_quantity < 30").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


def plan_capture(spark: SparkSession, d: str) -> DataFrame:
    """Run a query, capture its plan, and return the plan's nodes."""
    _, row = capture.run_and_capture(_flagship(spark, d))
    log = spark.createDataFrame([row], schema.PLAN_LOG)
    return flatten.plan_nodes(log).select("node_no", "parent_no", "depth", "node_type", "relation", "plan_rows", "actual_rows", "removed_rows")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return _flagship(spark, d)


def progress_live(spark: SparkSession, d: str) -> DataFrame:
    """Progress of a query that has just ended, by the estimates that its own execution taught: complete."""
    _, row = capture.run_and_capture(_flagship(spark, d))
    nodes = flatten.plan_nodes(spark.createDataFrame([row], schema.PLAN_LOG), finished=True)
    better = replace.replace_rows(nodes, regression.parameters(nodes), ["queryid", "planid"])
    return progress.progress(better, ["queryid", "planid"], regression=True).select("progress")


def plan_growth(spark: SparkSession, d: str) -> DataFrame:
    """A written log of many plans: flatten, group and regress ten thousand executions."""
    log = spark.range(10_000).select((F.col("id") + 1).alias("seqid"), (F.col("id") % 40).cast("string").alias("queryid"), F.lit("p").alias("planid"), F.lit(json.dumps(_DOCUMENT)).alias("plan_json"))
    return regression.parameters(flatten.plan_nodes(log, finished=True)).groupBy("node_no").agg(F.sum("n").alias("n"), F.round(F.avg("coef_outer"), 6).alias("coef"))


_GROWTH_SQL = "SELECT CAST(a AS INTEGER) AS node_no, CAST(10000 AS BIGINT) AS n, round(CAST(c AS DOUBLE), 6) AS coef FROM (VALUES (1, 1.0), (2, 1.5), (3, 90.0 / 70), (4, 7.0 / 30), (5, 1.0)) v(a, c)"

_REG = "n, CAST(sp AS DOUBLE) AS sum_plan, CAST(sa AS DOUBLE) AS sum_actual, CASE WHEN sp = 0 OR 250 * sa < sp THEN 0.0 ELSE round(sa / sp, 6) END AS coef, CASE WHEN sp = 0 OR 250 * sa < sp THEN round_even(sa / n, 5) ELSE 0.0 END AS intercept"
_REG_SCAN = f"SELECT o_orderpriority AS queryid, o_orderstatus AS planid, {_REG} FROM (SELECT o_orderpriority, o_orderstatus, CAST(count(*) AS BIGINT) AS n, sum(o_orderkey % 97) AS sp, sum(o_custkey % 89) AS sa FROM orders GROUP BY 1, 2)"

ALL: dict[str, tuple[Query, str | None]] = {
    "reg_scan": (reg_scan, _REG_SCAN),
    "reg_incremental": (reg_incremental, _REG_SCAN),
    "reg_scan_floor": (reg_scan_floor, "SELECT k, CASE WHEN p = 0 OR 250 * a < p THEN 0.0 ELSE round(a / p, 8) END AS coef, CASE WHEN p = 0 OR 250 * a < p THEN round(round_even(a / n, 5), 4) ELSE 0.0 END AS intercept, CASE WHEN p = 0 THEN 0.0 ELSE round(a / p, 8) END AS gather_coef FROM (SELECT l_suppkey % 10 AS k, count(*) AS n, CAST(sum(l_partkey * (l_suppkey % 10)) AS DOUBLE) AS p, sum(CAST(l_quantity > 25 AS DOUBLE)) AS a FROM lineitem GROUP BY 1)"),
    "reg_nested_loop": (reg_nested_loop, "SELECT l_returnflag AS queryid, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity * l_linenumber * (l_partkey % 50)) / sum(l_quantity * l_quantity * l_linenumber * l_linenumber), 6) AS coef FROM lineitem GROUP BY 1"),
    "reg_join_single": (reg_join_single, "SELECT l_returnflag AS queryid, round(regr_slope(l_partkey % 50, l_quantity), 6) AS slope_outer, round(regr_intercept(l_partkey % 50, l_quantity), 6) AS intercept_outer, round(regr_slope(l_partkey % 50, l_linenumber), 6) AS slope_inner FROM lineitem GROUP BY 1"),
    "reg_join_fit": (reg_join_fit, f"WITH {fit_sql('lineitem', 'l_returnflag', 'l_quantity', 'l_linenumber', '(l_partkey % 50)')} SELECT l_returnflag AS queryid, round(round_even(co, 5), 4) AS coef_outer, round(round_even(cv, 5), 4) AS coef_inner, round(round_even(b, 5), 4) AS intercept, round(rmse, 4) AS rmse FROM fit"),
    "group_plan": (group_plan, "SELECT o_orderpriority AS queryid, o_orderstatus AS planid, CAST(count(*) AS BIGINT) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last, CAST(max(o_orderkey) % 97 AS DOUBLE) AS last_plan FROM orders GROUP BY 1, 2"),
    "sort_space_max": (sort_space_max, "SELECT CAST(user_id AS VARCHAR) AS queryid, event_type AS planid, nullif(max(event_id % 5000) FILTER (WHERE event_id % 3 = 0), 0) AS sort_space_used FROM events GROUP BY 1, 2"),
    "latest_plan_per_query": (latest_plan_per_query, "SELECT 'db' AS database, CAST(user_id AS VARCHAR) AS queryid, arg_max(event_type, event_id) AS planid FROM events GROUP BY user_id"),
    "query_texts": (query_texts, "SELECT CAST(user_id AS VARCHAR) AS queryid, arg_min(props, event_id) AS query, arg_min(event_type, event_id) AS database, arg_max(event_type, event_id) AS planid FROM events GROUP BY user_id"),
    "worker_merge": (worker_merge, "SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id % 5 <> 0 THEN (event_id % 100) * (event_id % 4 + 1) ELSE event_id % 100 END::DOUBLE AS plan_rows, round(CASE WHEN event_id % 3 = 0 AND event_id % 5 <> 0 THEN value + value + value * 0.5 ELSE value END, 4) AS actual_rows, CASE WHEN event_id % 3 = 0 AND event_id % 5 <> 0 THEN 3.0 ELSE 1.0 END::DOUBLE AS actual_loops FROM events"),
    "worker_merge_live": (worker_merge_live, "SELECT o_orderkey, CAST(k AS INTEGER) AS node_no, CAST(CASE WHEN k IN (3, 4) THEN k * 30 ELSE k * 10 END AS DOUBLE) AS plan_rows, round((o_orderkey % 7 + CASE WHEN k IN (3, 4) THEN 2 * (o_custkey % 11 + k - 2) + 3 ELSE 0 END) * CASE WHEN k <> 5 THEN 1.5 ELSE 1 END, 4)::DOUBLE AS actual_rows FROM orders, range(1, 6) r(k)"),
    "replace_rows": (replace_rows, _REPLACE_SQL),
    "progress_points": (progress_points, _POINTS_SQL),
    "progress_ratio": (progress_ratio, _RATIO_SQL),
    "misestimate": (misestimate, "WITH n AS (SELECT *, CAST(event_id % 50 AS DOUBLE) AS p, floor(value) AS a, CASE WHEN event_id % 2 = 0 THEN 'Filter: a = ' || (event_id % 3) END AS c FROM events WHERE event_type <> 'click') SELECT CAST(user_id AS VARCHAR) AS queryid, event_type AS planid, coalesce(string_agg(DISTINCT c, '; ' ORDER BY c), '') AS conditions FROM n GROUP BY 1, 2 HAVING bool_or(p > 0 AND a > 0 AND (a / p > 10 OR p / a > 10))"),
    "join_training": (join_training, "SELECT CAST(l_suppkey AS VARCHAR) AS queryid, l_returnflag AS planid, CAST(count(*) AS BIGINT) AS n, sum(l_quantity) AS x_outer, CAST(sum(l_linenumber) AS DOUBLE) AS x_inner, CAST(sum(l_partkey % 50) AS DOUBLE) AS y FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 130"),
    "hist_skew": (hist_skew, _SKEW_SQL),
    "fd_degree": (fd_degree, _FD_SQL),
    "fd_enumerate": (fd_enumerate, _FD_ALL_SQL),
    "fd_strongest": (fd_strongest, "SELECT 'c_custkey,c_mktsegment' AS given, 'c_nationkey' AS to_column, 1.0::DOUBLE AS degree"),
    "fd_selectivity": (fd_selectivity, _FD_SEL_SQL),
    "mcv_list": (mcv_list, f"WITH {_MCV_CTE} SELECT o_orderstatus, o_orderpriority, m.n, round(m.n / total, 8) AS frequency, round((na / total) * (nb / total), 8) AS base_frequency FROM m JOIN a USING (o_orderstatus) JOIN b USING (o_orderpriority), n"),
    "mcv_mincount": (mcv_mincount, "SELECT o_orderpriority, round(n * (1e6 - n) / (1e6 - n + 0.04 * n * (1e6 - 1)), 6) AS least FROM (SELECT o_orderpriority, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1)"),
    "mcv_combine": (mcv_combine, f"WITH {_MCV_CTE}, x AS (SELECT m.n / total AS f, (na / total) * (nb / total) AS base, o_orderstatus = 'F' AS c1, o_orderpriority < '3' AS c2 FROM m JOIN a USING (o_orderstatus) JOIN b USING (o_orderpriority), n), s AS (SELECT 'all' AS clauses, sum(CASE WHEN c1 AND c2 THEN f ELSE 0 END) AS v, sum(CASE WHEN c1 AND c2 THEN base ELSE 0 END) AS b, sum(f) AS t FROM x UNION ALL SELECT 'any', sum(CASE WHEN c1 OR c2 THEN f ELSE 0 END), sum(CASE WHEN c1 OR c2 THEN base ELSE 0 END), sum(f) FROM x) SELECT clauses, round(least(greatest(v + least(least(greatest(0.3 - b, 0), 1), 1 - t), 0), 1), 8) AS selectivity FROM s"),
    "selectivities": (selectivities, "WITH c AS (SELECT c_nationkey, avg(CAST(c_acctbal > 0 AS DOUBLE)) AS a, avg(CAST(c_mktsegment = 'BUILDING' AS DOUBLE)) AS b, avg(CAST(c_acctbal < 8000 AS DOUBLE)) AS hi FROM customer GROUP BY 1) SELECT c_nationkey, round(a * b, 8) AS both, round(a + b - a * b, 8) AS either, round(CASE WHEN hi + a - 1 > 0 THEN hi + a - 1 WHEN hi + a - 1 >= -0.01 THEN 1e-10 ELSE 0.005 END, 8) AS between FROM c"),
    "best_statistics": (best_statistics, "SELECT 's2' AS name"),
    "group_estimates": (group_estimates, _GROUPS_SQL),
    "expression_statistics": (expression_statistics, "SELECT CAST(count(*) AS BIGINT) AS n, 0.0::DOUBLE AS null_fraction, CAST(count(DISTINCT v) AS BIGINT) AS n_distinct, round(avg(strlen(CAST(v AS VARCHAR))), 6) AS width, min(v) AS low, max(v) AS high FROM (SELECT month(o_orderdate) * 10 + o_custkey % 7 AS v FROM orders)"),
    "scalar_functions": (scalar_functions, "SELECT o_orderkey, lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS dir, round(CASE WHEN o_totalprice >= 1 THEN o_totalprice * ln(floor(o_totalprice)) ELSE 0 END, 2) AS work, floor(o_totalprice / 500000 * 10000) / 100 AS percent, CAST(CAST('0x' || substr(md5(o_orderpriority), 1, 15) AS BIGINT) AS VARCHAR) AS hash, round(greatest(greatest(o_custkey, 1) / greatest(o_orderkey, 1), greatest(o_orderkey, 1) / greatest(o_custkey, 1)), 6) AS error FROM orders"),
    "plan_flatten": (plan_flatten, _FLATTEN_SQL),
    "plan_regression": (plan_regression, _PLAN_REG_SQL),
    "plan_parameters": (plan_parameters, None),
    "plan_fingerprint": (plan_fingerprint, _FINGERPRINT_SQL),
    "table_flatten": (table_flatten, _TABLE_FLATTEN_SQL),
    "table_regression": (table_regression, _TABLE_REG_SQL),
    "table_replace": (table_replace, _TABLE_REPLACE_SQL),
    "table_progress": (table_progress, _TABLE_PROGRESS_SQL),
    "repository_incremental": (repository_incremental, _TABLE_REG_SQL),
    "progress_driver": (progress_driver, _DRIVER_SQL),
    "misestimate_kinds": (misestimate_kinds, _KINDS_SQL),
    "neural_joins": (neural_joins, None),
    "sampled_rows": (sampled_rows, None),
    "plan_capture": (plan_capture, None),
    "progress_live": (progress_live, "SELECT 1.0::DOUBLE AS progress"),
    "plan_growth": (plan_growth, _GROWTH_SQL),
    "flagship": (flagship, "SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity < 30 GROUP BY 1"),
}


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
