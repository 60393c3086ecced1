"""The relational vocabulary: one query for each kind of plan node, on the star schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import modify
from .operators import relational as rel
from .tables import over, plain, table

#: Read alike by both engines.
SHARED = {
    # scans, projection, filters
    "scan_filter_project": "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount), 4) AS net FROM {lineitem} WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1996-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "scan_or_predicates": "SELECT p_partkey, p_brand, p_size FROM {part} WHERE (p_size < 5 AND p_brand LIKE 'Brand#1%') OR p_size IN (48, 49, 50) OR p_retailprice > 2000",
    "scan_column_prune": "SELECT l_partkey, CAST(count(*) AS BIGINT) AS n FROM {lineitem} WHERE l_partkey IS NOT NULL GROUP BY l_partkey",
    "result_constant": "SELECT 1 AS one, 'x' AS letter",
    "values_scan": "SELECT v.id, v.name, o.n FROM (VALUES (1, '1-URGENT'), (2, '2-HIGH'), (3, '9-NONE')) AS v(id, name) LEFT JOIN (SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM {orders} GROUP BY o_orderpriority) o ON o.o_orderpriority = v.name",
    "subquery_scan": "SELECT n_regionkey, CAST(count(*) AS BIGINT) AS n, round(sum(bal), 4) AS bal FROM (SELECT c_nationkey, sum(c_acctbal) AS bal FROM {customer} GROUP BY c_nationkey) s JOIN {nation} ON n_nationkey = s.c_nationkey GROUP BY n_regionkey",
    # joins
    "join_inner": "SELECT o_orderkey, c_name, o_totalprice FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'",
    "join_left": "SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_orderstatus = 'F'",
    "join_right": "SELECT c_custkey, o_orderkey FROM {customer} RIGHT JOIN {orders} ON c_custkey = o_custkey AND c_acctbal > 5000",
    "join_full": "SELECT c.c_custkey, s.s_suppkey FROM (SELECT * FROM {customer} WHERE c_acctbal > 9000) c FULL JOIN (SELECT * FROM {supplier} WHERE s_acctbal > 5000) s ON c.c_nationkey = s.s_nationkey",
    "join_semi": "SELECT c_custkey, c_name FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "join_anti": "SELECT c_custkey, c_name FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)",
    "join_anti_condition": "SELECT c_custkey, c_name FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 250000)",
    "join_right_anti": "SELECT o_orderkey FROM {orders} WHERE NOT EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey)",
    "join_nested_loop_theta": "SELECT a.n_name AS low, b.n_name AS high FROM {nation} a JOIN {nation} b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey + b.n_nationkey > 20",
    "join_cross": "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}",
    "join_self_alias": "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM {supplier} a JOIN {supplier} b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey",
    "join_multi_way": "SELECT r_name, CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY r_name",
    "join_lateral": "SELECT n_name, t.c_custkey, t.c_acctbal FROM {nation}, LATERAL (SELECT max(c_custkey) AS c_custkey, max(c_acctbal) AS c_acctbal FROM {customer} WHERE c_nationkey = n_nationkey) t",
    # aggregation
    "agg_plain": "SELECT CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 4) AS qty, round(avg(l_extendedprice), 4) AS price, min(l_shipdate) AS first, max(l_shipdate) AS last FROM {lineitem}",
    "agg_group": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 4) AS avg_qty, CAST(count(*) AS BIGINT) AS n FROM {lineitem} GROUP BY l_returnflag, l_linestatus",
    "agg_distinct": "SELECT o_orderpriority, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers, CAST(count(DISTINCT o_orderstatus) AS BIGINT) AS states FROM {orders} GROUP BY o_orderpriority",
    "agg_filter": "SELECT o_orderpriority, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS finished, round(sum(o_totalprice) FILTER (WHERE o_totalprice > 100000), 2) AS large FROM {orders} GROUP BY o_orderpriority",
    "agg_grouping_sets": "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS BIGINT) AS g1, CAST(grouping(l_linestatus) AS BIGINT) AS g2, CAST(count(*) AS BIGINT) AS n FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "agg_cube": "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "agg_rollup": "SELECT r_name, n_name, CAST(count(*) AS BIGINT) AS n FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
    "agg_having": "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 12 AND o_custkey > 10",
    "agg_having_alone": "SELECT 1 AS one FROM {orders} HAVING count(*) > 10",
    "agg_min_max": "SELECT o_orderstatus, min(o_totalprice) AS low, max(o_totalprice) AS high FROM {orders} GROUP BY o_orderstatus",
    "agg_group_only": "SELECT p_brand, p_size FROM {part} GROUP BY p_brand, p_size",
    "distinct_rows": "SELECT DISTINCT c_nationkey, c_mktsegment FROM {customer}",
    # windows
    "win_rank": "SELECT o_orderkey, o_custkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC) AS BIGINT) AS dr, CAST(ntile(4) OVER w AS BIGINT) AS quarter FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "win_distribution": "SELECT c_custkey, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM {customer} WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal)",
    "win_lag_lead": "SELECT event_id, lag(value, 1) OVER w AS before, lead(value, 2, 0.0) OVER w AS after, first_value(event_id) OVER w AS first, nth_value(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "win_rows_frame": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS run3, CAST(count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS BIGINT) AS next3 FROM {orders}",
    "win_range_frame": "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CAST(count(*) OVER (PARTITION BY l_suppkey ORDER BY l_quantity RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS BIGINT) AS near FROM {lineitem}",
    "win_topk_per_group": "SELECT * FROM (SELECT c_nationkey, c_custkey, c_acctbal, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS rn FROM {customer}) t WHERE rn <= 3",
    # order and limits
    "sort_limit_topk": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25",
    "sort_nulls": "SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 300000 ORDER BY o_orderkey ASC NULLS FIRST, c_custkey",
    "limit_offset": "SELECT o_orderkey, o_orderdate FROM {orders} ORDER BY o_orderdate, o_orderkey LIMIT 20 OFFSET 100",
    # set operations
    "union_all": "SELECT c_nationkey AS k, c_acctbal AS bal FROM {customer} UNION ALL SELECT s_nationkey, s_acctbal FROM {supplier}",
    "union_distinct": "SELECT c_nationkey AS k FROM {customer} WHERE c_acctbal > 0 UNION SELECT s_nationkey FROM {supplier}",
    "intersect_distinct": "SELECT c_nationkey AS k FROM {customer} WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM {supplier}",
    "intersect_all": "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}",
    "except_distinct": "SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 5000",
    "except_all": "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}",
    "recursive_cte": "WITH RECURSIVE t(n, total) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, total + (SELECT CAST(count(*) AS BIGINT) FROM {nation} WHERE n_regionkey = 1) * n FROM t WHERE n < 20) SELECT n, total FROM t",
    # subqueries
    "subq_scalar_corr": "SELECT o_orderkey, o_totalprice FROM {orders} o WHERE o_totalprice > (SELECT 1.5 * avg(i.o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)",
    "subq_scalar_init": "SELECT c_custkey FROM {customer} WHERE c_acctbal > (SELECT avg(c_acctbal) + 4000 FROM {customer})",
    "subq_in": "SELECT s_suppkey, s_name FROM {supplier} WHERE s_suppkey IN (SELECT l_suppkey FROM {lineitem} WHERE l_quantity > 49 AND l_discount > 0.09)",
    "subq_not_in": "SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 200000)",
    "subq_not_in_many": "SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 400000)",
    "subq_exists_or": "SELECT c_custkey FROM {customer} WHERE c_acctbal < -900 OR EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    "cte_reuse": "WITH per AS (SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM {orders} GROUP BY o_custkey) SELECT a.o_custkey, a.n FROM per a WHERE a.n > (SELECT 1.5 * avg(n) FROM per)",
    # the published example queries in spirit: a join with a non-equality, a filter on tied columns, a large sort
    "correlated_filter_join": "SELECT a.o_orderkey, b.c_custkey FROM {orders} a JOIN {customer} b ON a.o_custkey = b.c_custkey WHERE b.c_nationkey = 3 AND b.c_mktsegment = 'BUILDING' AND a.o_orderstatus = 'F'",
    "big_sort": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM {lineitem} ORDER BY l_orderkey DESC, l_linenumber, l_partkey, l_suppkey",
}


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders")


def join_hint(method: str) -> Callable[[SparkSession, str], DataFrame]:
    """The same equi-join by each physical method; a broadcast only for a side of a checked size."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        right = table(spark, d, "customer").where("c_acctbal > 0")
        right = rel.broadcast_within(right) if method == "broadcast" else right.hint(method)
        return _orders(spark, d).join(right, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey", "c_nationkey")

    return run


_HINTED = "SELECT o_orderkey, c_custkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0"


def join_unique_semi(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").where("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return rel.unique_inner_join(_orders(spark, d), items, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


def distinct_on(spark: SparkSession, d: str) -> DataFrame:
    return rel.distinct_on(_orders(spark, d), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


def with_ties(spark: SparkSession, d: str) -> DataFrame:
    return rel.top_with_ties(_orders(spark, d), 10, ["o_orderdate"]).select("o_orderkey", "o_orderdate")


def with_ties_per_group(spark: SparkSession, d: str) -> DataFrame:
    return rel.top_with_ties(_orders(spark, d), 3, ["o_orderdate"], False, ["o_orderstatus"]).select("o_orderstatus", "o_orderkey", "o_orderdate")


def win_groups_frame(spark: SparkSession, d: str) -> DataFrame:
    framed = rel.groups_frame(_orders(spark, d), ["o_custkey"], "o_orderdate", 1, 1, {"n": lambda: F.count("*"), "total": lambda: F.sum("o_totalprice")})
    return framed.select("o_orderkey", "n", F.round("total", 4).alias("total"))


def merge_append(spark: SparkSession, d: str) -> DataFrame:
    parts = [_orders(spark, d).where(F.col("o_orderstatus") == s).select("o_orderkey", "o_orderstatus", "o_totalprice") for s in ("F", "O", "P")]
    return rel.merge_append(parts, [F.col("o_totalprice").desc(), F.col("o_orderkey")])


def sort_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Line items, which come by order, within each order by price."""
    items = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_partkey", "l_suppkey", "l_linenumber")
    return rel.incremental_sort(items, ["l_orderkey"], [F.col("l_extendedprice").desc(), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")])


def recursive_union_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Nations that can be reached from nation 0 over steps k -> (2k + 1) mod 25 and k -> (3k) mod 25."""
    nation = table(spark, d, "nation")

    def step(new: DataFrame) -> DataFrame:
        moves = new.select(F.explode(F.array(((F.col("k") * 2 + 1) % 25).cast("int"), ((F.col("k") * 3) % 25).cast("int"))).alias("k"))
        return moves.join(nation.select(F.col("n_nationkey").alias("k")), "k", "left_semi")

    from .sources.shared import checkpointer

    return rel.recursive_union(nation.where("n_nationkey = 0").select(F.col("n_nationkey").alias("k")), step, checkpointer(spark))


def project_set(spark: SparkSession, d: str) -> DataFrame:
    """A set-returning function in the select list: one row for each unit of every part's size."""
    return table(spark, d, "part").where("p_size >= 1").select("p_partkey", F.explode(F.sequence(F.lit(1), F.col("p_size"))).alias("unit"))


def function_scan_explode(spark: SparkSession, d: str) -> DataFrame:
    """A function scan with ordinality over an event's value."""
    steps = F.posexplode(F.when(F.col("value") >= 0, F.sequence(F.lit(0), F.floor(F.col("value") / 100).cast("int"))))
    return table(spark, d, "events").select("event_id", steps.alias("ordinal", "step")).select("event_id", (F.col("ordinal") + 1).cast("bigint").alias("ordinal"), F.col("step").cast("bigint").alias("step"))


def table_function_json(spark: SparkSession, d: str) -> DataFrame:
    """A table function over JSON: rows by event and the number that its properties hold."""
    parsed = F.from_json("props", "k BIGINT")
    return table(spark, d, "events").select("event_type", parsed.getField("k").alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


def tid_range(spark: SparkSession, d: str) -> DataFrame:
    """Rows by their place (file and number in it) between two places."""
    rows = rel.with_tid(table(spark, d, "nation"))
    first = rows.agg(F.min("tid.file").alias("f"))
    place = lambda n: F.struct(F.col("f").alias("file"), F.lit(n).cast("bigint").alias("row"))
    return rows.join(F.broadcast(first), F.col("tid").between(place(5), place(9))).select("n_name")


def tid_scan(spark: SparkSession, d: str) -> DataFrame:
    """The rows at stated places of the first file."""
    rows = rel.with_tid(table(spark, d, "nation"))
    first = rows.agg(F.min("tid.file").alias("f"))
    return rows.where(F.col("tid.row").isin(3, 11)).join(F.broadcast(first), F.col("tid.file") == F.col("f")).select("n_name")


def sample_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").sample(0.1, seed=7).select("l_orderkey", "l_linenumber")


def pivot_counts(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


def ordered_set_aggregate(spark: SparkSession, d: str) -> DataFrame:
    from .sources.shared import checkpointer

    found = rel.exact_quantiles(_orders(spark, d), ["o_orderpriority"], "o_totalprice", [0.5, 0.9], checkpointer(spark))
    at = lambda share: F.round(F.max(F.when(F.col("share") == share, F.col("quantile"))), 4)
    return found.groupBy("o_orderpriority").agg(at(0.5).alias("median"), at(0.9).alias("p90"))


def win_exclude_current(spark: SparkSession, d: str) -> DataFrame:
    """EXCLUDE CURRENT ROW: what stands before the row and what stands after it."""
    count, total = rel.exclude_frame(table(spark, d, "customer"), ["c_nationkey"], "c_custkey", "c_acctbal", "current row")
    return table(spark, d, "customer").select("c_custkey", count.alias("others"), F.round(total, 2).alias("rest"))


def win_exclude(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = rel.with_groups(_orders(spark, d), ["o_custkey"], "o_orderpriority")
        count, total = rel.exclude_frame(rows, ["o_custkey"], "o_orderpriority", "o_totalprice", kind)
        return rows.select("o_orderkey", count.alias("others"), F.round(total, 2).alias("rest"))

    return run


def _exclude_sql(kind: str) -> str:
    return f"SELECT o_orderkey, CAST(count(o_totalprice) OVER w AS BIGINT) AS others, round(sum(o_totalprice) OVER w, 2) AS rest FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE {kind})"


def join_full_theta(spark: SparkSession, d: str) -> DataFrame:
    """FULL JOIN on a comparison: regions and nations whose keys lie far apart."""
    region, nation = table(spark, d, "region").select("r_regionkey", "r_name"), table(spark, d, "nation").select("n_nationkey", "n_name")
    return rel.full_theta_join(region, nation, F.col("r_regionkey") > F.col("n_nationkey") + 1).select("r_name", "n_name")


def join_partition_wise(spark: SparkSession, d: str) -> DataFrame:
    """Orders and line items in buckets of the order's key: joined and grouped within buckets, without an exchange."""
    from .sources.shared import fresh_path

    orders = rel.bucketed(_orders(spark, d).select("o_orderkey", "o_orderpriority"), ["o_orderkey"], 8, "planloom_orders", fresh_path(spark, "orders"))
    items = rel.bucketed(table(spark, d, "lineitem").select("l_orderkey", "l_quantity"), ["l_orderkey"], 8, "planloom_items", fresh_path(spark, "items"))
    return orders.join(items.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("quantity"))


def join_materialize(spark: SparkSession, d: str) -> DataFrame:
    """A nested loop whose inner side is computed once and kept."""
    inner = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name").persist()
    return table(spark, d, "region").join(inner, F.col("r_regionkey") < F.col("n_nationkey") % 7).select(F.col("r_regionkey"), "n_nationkey", inner["r_name"].alias("of"))


def foreign_scan(spark: SparkSession, d: str) -> DataFrame:
    """A table of another system's format (CSV), written to the shared folder and read with its filter pushed down."""
    from .sources.shared import fresh_path

    path, held = fresh_path(spark, "foreign"), table(spark, d, "supplier")
    held.write.option("header", True).csv(path)
    return spark.read.schema(held.schema).option("header", True).csv(path).where("s_nationkey < 10").select("s_suppkey", "s_name", "s_acctbal")


def custom_scan(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of a Python data source joined with the parts of that size."""
    from .sources.series import series

    sizes = table(spark, d, "part").groupBy("p_size").agg(F.count("*").alias("parts"))
    return series(spark, 1, 1000).where("n <= 60").join(sizes, F.col("n") == F.col("p_size"), "left").select("n", "square", F.coalesce("parts", F.lit(0)).alias("parts"))


def named_tuplestore(spark: SparkSession, d: str) -> DataFrame:
    """The rows that a statement changed, under a name, as a trigger's function sees them."""
    old = _orders(spark, d).select("o_orderkey", "o_orderpriority", "o_totalprice")
    changed = modify.update(old, F.col("o_totalprice") > 300000, {"o_totalprice": F.round(F.col("o_totalprice") * 2, 2)})
    old_rows = old.where("o_totalprice > 300000")
    new_rows = changed.join(old_rows.select("o_orderkey"), "o_orderkey", "left_semi")
    sums = "SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM {rows} GROUP BY o_orderpriority"
    return spark.sql(sums, rows=old_rows).withColumn("rows", F.lit("old")).unionByName(spark.sql(sums, rows=new_rows).withColumn("rows", F.lit("new")))


def modify_update_delete(spark: SparkSession, d: str) -> DataFrame:
    """Orders after an update of the urgent ones and a delete of the cheap ones."""
    o = _orders(spark, d).select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    raised = modify.update(o, F.col("o_orderpriority") == "1-URGENT", {"o_totalprice": F.round(F.col("o_totalprice") * 2, 2), "o_orderstatus": F.lit("X")})
    return modify.delete(raised, F.col("o_totalprice") < 20000)


def modify_insert_conflict(spark: SparkSession, d: str) -> DataFrame:
    """Customers with suppliers inserted under the same keys, which replace them."""
    new = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))
    return modify.insert_on_conflict(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), new, ["c_custkey"])


def modify_merge(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers merged with the first customers: sums for matches, deletes for large ones, the rest inserted."""
    old = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"))
    new = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"))
    return modify.merge(old, new, ["k"], {"bal": F.round(F.col("bal") + F.col("s.bal"), 2)}, F.col("s.bal") > 9000)


CUSTOM: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "join_merge_hint": (join_hint("merge"), _HINTED),
    "join_hash_hint": (join_hint("shuffle_hash"), _HINTED),
    "join_broadcast_hint": (join_hint("broadcast"), _HINTED),
    "join_nested_loop_hint": (lambda s, d: table(s, d, "supplier").hint("shuffle_replicate_nl").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name"), "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "join_unique_semi": (join_unique_semi, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)"),
    "distinct_on": (distinct_on, "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey"),
    "with_ties": (with_ties, "SELECT o_orderkey, o_orderdate FROM (SELECT *, rank() OVER (ORDER BY o_orderdate) AS r FROM orders) WHERE r <= 10"),
    "with_ties_per_group": (with_ties_per_group, "SELECT o_orderstatus, o_orderkey, o_orderdate FROM (SELECT *, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC) AS r FROM orders) WHERE r <= 3"),
    "win_groups_frame": (win_groups_frame, "SELECT o_orderkey, CAST(count(*) OVER w AS BIGINT) AS n, round(sum(o_totalprice) OVER w, 4) AS total FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"),
    "win_exclude_current": (win_exclude_current, "SELECT c_custkey, CAST(count(*) OVER w AS BIGINT) - 1 AS others, round(sum(c_acctbal) OVER w - c_acctbal, 2) AS rest FROM customer WINDOW w AS (PARTITION BY c_nationkey)"),
    "win_exclude_group": (win_exclude("group"), _exclude_sql("GROUP")),
    "win_exclude_ties": (win_exclude("ties"), _exclude_sql("TIES")),
    "join_full_theta": (join_full_theta, "SELECT r_name, n_name FROM region LEFT JOIN nation ON r_regionkey > n_nationkey + 1 UNION ALL SELECT NULL, n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM region WHERE r_regionkey > n_nationkey + 1)"),
    "join_partition_wise": (join_partition_wise, "SELECT o_orderkey, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 4) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1"),
    "join_materialize": (join_materialize, "SELECT a.r_regionkey, n_nationkey, b.r_name AS of FROM region a JOIN (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) b ON a.r_regionkey < n_nationkey % 7"),
    "foreign_scan": (foreign_scan, "SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_nationkey < 10"),
    "custom_scan": (custom_scan, "SELECT n, n * n AS square, CAST(coalesce(parts, 0) AS BIGINT) AS parts FROM range(1, 61) r(n) LEFT JOIN (SELECT p_size, count(*) AS parts FROM part GROUP BY 1) ON p_size = n"),
    "named_tuplestore": (named_tuplestore, "SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total, 'old' AS rows FROM orders WHERE o_totalprice > 300000 GROUP BY 1 UNION ALL SELECT o_orderpriority, CAST(count(*) AS BIGINT), round(sum(round(o_totalprice * 2, 2)), 2), 'new' FROM orders WHERE o_totalprice > 300000 GROUP BY 1"),
    "sort_incremental": (sort_incremental, "SELECT l_orderkey, l_extendedprice, l_partkey, l_suppkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber"),
    "merge_append": (merge_append, "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')"),
    "recursive_union_distinct": (recursive_union_distinct, "WITH RECURSIVE t(k) AS (SELECT n_nationkey FROM nation WHERE n_nationkey = 0 UNION SELECT n_nationkey FROM nation, t WHERE n_nationkey = (2 * k + 1) % 25 OR n_nationkey = (3 * k) % 25) SELECT k FROM t"),
    "modify_update_delete": (modify_update_delete, "SELECT * FROM (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderpriority = '1-URGENT' THEN round(o_totalprice * 2, 2) ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM orders) WHERE o_totalprice >= 20000"),
    "modify_insert_conflict": (modify_insert_conflict, "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier"),
    "modify_merge": (modify_merge, "SELECT coalesce(s_suppkey, c_custkey) AS k, CASE WHEN s_suppkey IS NULL THEN c_acctbal WHEN c_custkey IS NULL THEN s_acctbal ELSE round(s_acctbal + c_acctbal, 2) END AS bal FROM supplier FULL JOIN customer ON s_suppkey = c_custkey WHERE NOT (s_suppkey IS NOT NULL AND c_custkey IS NOT NULL AND c_acctbal > 9000)"),
    "project_set": (project_set, "SELECT p_partkey, CAST(unnest(range(1, p_size + 1)) AS INTEGER) AS unit FROM part"),
    "function_scan_explode": (function_scan_explode, "SELECT event_id, s + 1 AS ordinal, s AS step FROM (SELECT event_id, CAST(unnest(range(0, CAST(floor(value / 100) AS BIGINT) + 1)) AS BIGINT) AS s FROM events)"),
    "table_function_json": (table_function_json, "SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL"),
    "tid_range": (tid_range, "SELECT n_name FROM nation WHERE n_nationkey BETWEEN 5 AND 9"),
    "tid_scan": (tid_scan, "SELECT n_name FROM nation WHERE n_nationkey IN (3, 11)"),
    "sample_rows": (sample_rows, None),
    "pivot_counts": (pivot_counts, 'SELECT o_orderpriority, CAST(count(*) FILTER (WHERE o_orderstatus = \'F\') AS BIGINT) AS "F", CAST(count(*) FILTER (WHERE o_orderstatus = \'O\') AS BIGINT) AS "O", CAST(count(*) FILTER (WHERE o_orderstatus = \'P\') AS BIGINT) AS "P" FROM orders GROUP BY o_orderpriority'),
    "ordered_set_aggregate": (ordered_set_aggregate, "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY o_orderpriority"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    shared = {name: (lambda spark, d, text=text: over(spark, d, text)) for name, text in SHARED.items()}
    return shared | {name: f for name, (f, _) in CUSTOM.items()}


def oracle_sql() -> dict[str, str]:
    return {name: plain(text) for name, text in SHARED.items()} | {name: sql for name, (_, sql) in CUSTOM.items() if sql}
