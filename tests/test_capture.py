"""Capture, ingestion, repository and feedback, end to end on real queries."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from planloom import cli, feedback
from planloom.functions.scalar import estimate_error
from planloom.operators import progress, regression, replace
from planloom.plans import flatten, schema
from planloom.repository import Repository
from planloom.sources import capture, plan_log, snapshot
from planloom.streaming import ingest


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.range(4000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("g"), (F.col("id") % 100).alias("v")).write.parquet(f"file://{path}/facts.parquet")
    spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 3).alias("c")).write.parquet(f"file://{path}/dims.parquet")
    return f"file://{path}"


def joined(spark, tables, limit=50):
    facts = spark.read.parquet(f"{tables}/facts.parquet").where(F.col("v") < limit)
    return facts.join(spark.read.parquet(f"{tables}/dims.parquet"), "k").groupBy("c").agg(F.count("*").alias("n")).orderBy("c")


def test_document(spark, tables):
    rows, row = capture.run_and_capture(joined(spark, tables))
    assert sum(r.n for r in rows) == 250
    nodes = flatten.rows(row[-1])
    kinds = [n["node_type"] for n in nodes]
    assert "Aggregate" in kinds and "Seq Scan" in kinds and any(k in schema.JOINS for k in kinds)
    facts = next(n for n in nodes if n["relation"] == "facts")
    assert (facts["actual_rows"], facts["removed_rows"]) == (2000, 2000) and facts["conds"][0]["kind"] == "Filter"
    join = next(n for n in nodes if n["node_type"] in schema.JOINS)
    assert join["actual_rows"] == 250 and join["relations"] == ["files.dims", "files.facts"]
    sides = {n["relationship"] for n in nodes if n["parent_no"] == join["node_no"]}
    assert sides == {"Outer", "Inner"}


def test_ids_ignore_constants(spark, tables):
    one, two = (capture.run_and_capture(joined(spark, tables, k))[1] for k in (50, 20))
    other = capture.run_and_capture(spark.read.parquet(f"{tables}/facts.parquet").groupBy("g").count())[1]
    assert one[6] == two[6] != other[6] and one[8] == two[8] != other[8]


def test_listener_to_parameters(spark, tables, tmp_path):
    log = f"file://{tmp_path}/log"
    with capture.Capture(spark, log, capture.Settings(log_min_duration=0, flush_seconds=0.2)) as held:
        for k in (10, 50, 90):
            joined(spark, tables, k).collect()
    assert held.dropped == 0 and held.written >= 3
    rows = spark.read.schema(schema.PLAN_LOG).parquet(log)
    assert plan_log.max_seqid(rows) == held.written and plan_log.read_since(rows, held.written - 1).count() == 1
    repo = Repository.create(spark, f"file://{tmp_path}/repo")
    with pytest.raises(FileExistsError):
        Repository.create(spark, f"file://{tmp_path}/repo")
    repo.add("one", host="h")
    with pytest.raises(ValueError):
        repo.add("no good")
    assert repo.get("one", rows.where("seqid <= 2")) == 2 and repo.get("one", rows.where("seqid <= 2")) == 0
    repo.get("one", rows)
    assert repo.log("one").count() == held.written
    learnt = repo.parameters("one")
    pushed = repo.push("one", f"file://{tmp_path}/reg")
    assert pushed.count() >= 1
    again = plan_log.read_parameters(spark, f"file://{tmp_path}/reg", "spark")
    assert {r.queryid for r in again.collect()} == {r.queryid for r in pushed.collect()}
    before = {tuple(r) for r in learnt.select("queryid", "planid", "node_no", "n").collect()}
    repo.recalc("one")
    assert {tuple(r) for r in repo.parameters("one").select("queryid", "planid", "node_no", "n").collect()} == before
    repo.rename("one", "two")
    assert repo.show() == ["two"] and repo.check() == [] and '"host": "h"' in repo.show(True)[0]
    # learnt estimates are no worse than the engine's
    nodes = repo.nodes("two")
    new = replace.replace_rows(nodes, repo.parameters("two"), ["server_id", "seqid", "queryid", "planid"])
    error = lambda df: df.agg(F.avg(F.log(estimate_error(F.col("plan_rows"), F.col("actual_rows"))))).first()[0]
    assert error(new) <= error(nodes) + 1e-9
    finished = progress.progress(nodes, ["seqid"], regression=True)
    assert all(0 <= r.progress <= 1 for r in finished.collect())
    said = []
    assert cli.main([f"file://{tmp_path}/repo", "show"], spark, say=said.append) == 0 and said == ["two"]
    cli.main([f"file://{tmp_path}/repo", "analyze", "two"], spark)
    cli.main([f"file://{tmp_path}/repo", "delete", "two"], spark, ask=lambda _: "no")
    assert repo.show() == ["two"]
    repo.reset("two")
    assert repo.servers()["two"]["seqid"] == 0
    cli.main([f"file://{tmp_path}/repo", "delete", "two", "--yes"], spark)
    assert repo.show() == []


def test_log_conditions(spark, tables, tmp_path):
    for settings in (capture.Settings(log_min_duration=100), capture.Settings(store_plan=False, log_min_duration=0)):
        with capture.Capture(spark, f"file://{tmp_path}/none", settings) as held:
            joined(spark, tables).collect()
        assert held.written == 0


def test_streaming_equals_batch(spark, tables, tmp_path):
    rows = [capture.run_and_capture(joined(spark, tables, k), seqid=i + 1)[1] for i, k in enumerate((5, 25, 50, 75))]
    folder = f"file://{tmp_path}"
    for part in (rows[:2], rows[2:]):
        plan_log.append_log(spark.createDataFrame(part, schema.PLAN_LOG), f"{folder}/log")
        ingest.start(spark, f"{folder}/log", f"{folder}/out", f"{folder}/cursor", once=True).awaitTermination()
    whole = regression.node_sums(ingest.nodes_of(spark.createDataFrame(rows, schema.PLAN_LOG)))
    pick = ["queryid", "planid", "node_no", "n", "sum_plan", "sum_actual"]
    assert sorted(map(tuple, ingest.read_sums(spark, f"{folder}/out").select(pick).collect())) == sorted(map(tuple, whole.select(pick).collect()))
    assert ingest.read_nodes(spark, f"{folder}/out").select("seqid").distinct().count() == 4
    # a batch that runs again replaces itself
    ingest.write_batch(spark.createDataFrame(rows[:2], schema.PLAN_LOG), 0, f"{folder}/out")
    assert ingest.read_sums(spark, f"{folder}/out").agg(F.sum("n")).first()[0] == whole.agg(F.sum("n")).first()[0]


def test_csv_log(spark, tmp_path):
    row = (1, None, None, "db", 5, 0, "18446744073709551615", "q", "18446744073709551614", "", "{}")
    plan_log.write_csv(spark.createDataFrame([row], schema.PLAN_LOG), f"file://{tmp_path}/csv")
    got = plan_log.read_csv(spark, f"file://{tmp_path}/csv").first()
    assert (got.seqid, got.queryid, got.planid) == (1, "18446744073709551615", "18446744073709551614")


def test_live_snapshots(spark):
    done = threading.Event()

    def busy():
        spark.range(0, 60_000_000, 1, 4).select((F.sha1(F.col("id").cast("string")).substr(1, 2)).alias("h")).groupBy("h").count().collect()
        done.set()

    thread = threading.Thread(target=busy)
    with snapshot.Sampler(spark, 0.3, least_age=0.2) as held:
        thread.start()
        thread.join(120)
        time.sleep(0.4)
    seen = [r for _, rows in held.rows for r in rows]
    assert done.is_set() and seen
    nodes = flatten.rows(seen[-1][-1])
    assert any(n["node_type"] == "Function Scan" for n in nodes)
    assert 0.0 <= progress.progress_of(nodes) <= 1.0
    assert snapshot.snapshots(spark).count() == 0


def test_feedback_hints(spark, tables):
    facts, dims = spark.read.parquet(f"{tables}/facts.parquet"), spark.read.parquet(f"{tables}/dims.parquet")
    plans = {}
    for kind in ("Merge Join", "Hash Join", "Nested Loop"):
        text = f'{{"{kind}":("files.dims", "files.facts"):("files.facts"):("files.dims"):[1.0, 0.0]:[0.0]:[0.0]:"False"}}'
        out = feedback.Feedback(text).hinted_join(facts, dims, "k", "inner", {"files.facts"}, {"files.dims"}, inner_rows=10**9)
        plans[kind] = out._jdf.queryExecution().sparkPlan().toString()
        assert out.count() == 500
    assert "SortMergeJoin" in plans["Merge Join"] and "ShuffledHashJoin" in plans["Hash Join"] and "CartesianProduct" in plans["Nested Loop"]
    small = feedback.Feedback(text.replace("Nested Loop", "Hash Join")).hinted_join(facts, dims, "k", "inner", {"files.facts"}, {"files.dims"}, inner_rows=500)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().sparkPlan().toString()
    with feedback.tuned_session(spark, feedback.Feedback([], 200_000)):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "16"
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_windowed_recount_under_a_watermark(spark, tmp_path):
    rows = spark.range(120).select(F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000).alias("ts"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("event_type"))
    rows.coalesce(1).write.parquet(f"file://{tmp_path}/events")
    stream = ingest.recount(spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/events"))
    query = stream.writeStream.format("memory").queryName("recount").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("select sum(n) as n from recount").first().n == 120
