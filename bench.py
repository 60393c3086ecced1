"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from planloom import queries_plans, queries_relational
from planloom.session import local_session
from planloom.sources import capture

HEADLINES = [
    "scan_filter_project", "join_inner", "join_multi_way", "join_anti", "agg_group", "agg_grouping_sets", "win_rank", "win_groups_frame", "win_topk_per_group", "with_ties", "sort_limit_topk", "big_sort",
    "join_partition_wise", "ordered_set_aggregate", "except_all", "recursive_cte", "subq_scalar_corr", "correlated_filter_join", "reg_scan", "reg_nested_loop", "reg_join_fit", "worker_merge", "misestimate", "hist_skew", "fd_degree", "mcv_list", "table_regression", "plan_capture", "plan_growth",
]
#: Rows of each side of the join of tied columns.
JOIN_ROWS = 5_000_000


def timed(run, times: int = 2) -> float:
    best = float("inf")
    for _ in range(times):
        began = time.perf_counter()
        run()
        best = min(best, time.perf_counter() - began)
    return round(best, 4)


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def tied_join(spark, folder: str):
    """Two tables of five million rows whose columns are i div 100 and i div 500: how many pairs there are of a filter on
    both tied columns of one and a join on the second with the other (100 rows by 499)."""
    for k in (1, 2):
        path = f"{folder}/t{k}"
        spark.range(1, JOIN_ROWS + 1).selectExpr(f"CAST(id DIV 100 AS INT) AS a{k}", f"CAST(id DIV 500 AS INT) AS b{k}").write.parquet(path)
        spark.read.parquet(path).createOrReplaceTempView(f"t{k}")

    def run():
        found = spark.sql("SELECT count(*) AS n FROM t1, t2 WHERE t2.a2 = 1 AND t2.b2 = 0 AND t1.b1 = t2.b2").first().n
        assert found == 49_900, found

    return run


def capture_overhead(spark, query, folder: str, times: int = 10) -> dict:
    """Seconds of a query run so many times with the log off and with it on."""
    many = lambda: [consume(query()) for _ in range(times)]
    many()
    off = timed(many)
    with capture.Capture(spark, f"{folder}/log", capture.Settings(log_min_duration=0)):
        on = timed(many)
    return {"off": off, "on": on, "overhead": round(on / off - 1, 4)}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    queries = queries_relational.queries() | queries_plans.queries()
    queries["flagship"](spark, folder).collect()  # warms the engine
    took = {name: timed(lambda name=name: consume(queries[name](spark, folder))) for name in HEADLINES}
    with tempfile.TemporaryDirectory() as held:
        took["tied_join_5m"] = timed(tied_join(spark, f"file://{held}"), 3)
        log = capture_overhead(spark, lambda: queries["agg_group"](spark, folder), f"file://{held}")
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "seconds for all headline queries, best of two", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "capture": log, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
