"""Progress of running queries end to end, continued logs, incremental sums, and the switches."""

import json
import math
import random
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_plans import node

from planloom import cli, feedback, queries_relational
from planloom.operators import analyze, live, neural, regression, statistics, workers
from planloom.plans import fingerprint, flatten, lineage, schema
from planloom.repository import Repository
from planloom.sources import capture, plan_log, snapshot
from planloom.streaming import ingest

SMALL = "/root/testdata/sf0.001"


def documents(n=40, seed=3):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        kind = rng.choice(["Nested Loop", "Hash Join", "Append", "Sort"])
        scan = lambda side, t: node("Seq Scan", rng.randint(0, 30), rng.randint(0, 30), side=side, **{"Relation Name": t, "Schema": "s", "Workers": [{"Worker Number": 0, "Actual Rows": rng.randint(0, 9), "Actual Loops": 1}] * rng.randint(0, 2)})
        sides = ("Member", "Member", "Member") if kind == "Append" else ("Outer", "InitPlan", "Inner")[: 1 if kind == "Sort" else 3]
        join = node(kind, rng.randint(0, 99), rng.randint(0, 99), side="Outer", kids=[scan(side, f"t{i}") for i, side in enumerate(sides)])
        out.append({"Plan": node("Gather", 5, 6, kids=[join], **{"Workers Planned": 2, "Workers Launched": 1}) if rng.random() < 0.6 else join})
    return out


def log_rows(spark, trees, first=1):
    rows = [(first + i, None, None, "db", 1, 0, str(i % 3), "q", fingerprint.planid(t), "", json.dumps(t)) for i, t in enumerate(trees)]
    return spark.createDataFrame(rows, schema.PLAN_LOG)


def test_one_walk_equals_the_composition(spark):
    log = log_rows(spark, documents())
    keys = ["server_id", "seqid", "queryid", "planid"]
    plain = regression.with_inputs(workers.merge_finished(flatten.plan_nodes(log)))
    sides = lineage.relation_sets(flatten.plan_nodes(log), keys).select(*keys, "node_no", "outer_rels", "inner_rels")
    want = plain.join(sides, [*keys, "node_no"], "left")
    got = flatten.plan_nodes(log, finished=True)
    assert set(got.columns) == set(want.columns)
    pick = lambda df: sorted(str({c: r[c] for c in sorted(df.columns)}) for r in df.collect())
    assert pick(got) == pick(want)


def test_fits_from_sums_are_those_from_executions(spark):
    rng = random.Random(5)
    rows = []
    for g in range(60):
        n = rng.choice([1, 2, 3, 8, 40])
        a, b, c = rng.uniform(0, 3), rng.uniform(0, 3), rng.choice([0, 5, -20])
        for _ in range(n):
            o = rng.randint(0, 50) if g % 5 else 7
            v = rng.randint(0, 50) if g % 7 else 2 * o
            rows.append((str(g), "p", 1, "Hash Join", float(rng.randint(0, 9)), max(0.0, a * o + b * v + c + (rng.gauss(0, 4) if g % 2 else 0)), float(o), float(v), len(rows)))
    nodes = spark.createDataFrame(rows, "queryid string, planid string, node_no int, node_type string, plan_rows double, actual_rows double, actual_outer double, actual_inner double, seqid bigint")
    for r in regression.join_models(regression.node_sums(nodes)).collect():
        own = np.array([x[5:8] for x in rows if x[0] == r.queryid])
        co, cv, b, rmse = regression.fit_join(own[:, 1], own[:, 2], own[:, 0])
        scale = 1 + np.abs(own[:, 0]).max()
        assert r.rmse == pytest.approx(rmse, abs=1e-4 * scale)
        # models may tie: what counts is what they predict
        assert np.allclose(own[:, 1] * r.coef_outer + own[:, 2] * r.coef_inner + r.intercept, own[:, 1] * co + own[:, 2] * cv + b, atol=2e-3 * scale)
    halves = [regression.learnt(nodes.where(f"seqid % 2 = {k}")) for k in (0, 1)]
    both, whole = (regression.parameters_of(x).select("queryid", "n", *(F.round(c, 3) for c in ("coef_outer", "coef_inner", "intercept"))) for x in (regression.merge_sums(*halves), regression.learnt(nodes)))
    assert sorted(map(str, both.collect())) == sorted(map(str, whole.collect()))


def test_a_spill_does_not_change_the_planid():
    sort = lambda kind, kb: {"Plan": node("Sort", 9, 9, kids=[node("Seq Scan", 9, 9, side="Outer")], **{"Sort Key": ["a"], "Sort Method": kind, "Sort Space Type": "Disk" if kb > 100 else "Memory", "Sort Space Used": kb})}
    assert fingerprint.planid(sort("quicksort", 20)) == fingerprint.planid(sort("external merge", 900))
    assert len(schema.STRUCTURAL) == len(set(schema.STRUCTURAL)) == 28


def test_a_second_log_session_goes_on(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    repo = Repository.create(spark, f"file://{tmp_path}/repo")
    repo.add("s")
    taken = 0
    for k in (1, 2):
        with capture.Capture(spark, path, capture.Settings(log_min_duration=0, flush_seconds=0.2, max_json_bytes=10**6 if k == 1 else 10)):
            spark.range(50 * k).groupBy((F.col("id") % 3).alias("k")).count().collect()
        taken += repo.get("s", spark.read.schema(schema.PLAN_LOG).parquet(path))
    held = spark.read.schema(schema.PLAN_LOG).parquet(path)
    numbers = sorted(r.seqid for r in held.collect())
    assert numbers == list(range(1, len(numbers) + 1)) and len(numbers) == taken >= 2
    # beyond the limit a plan is logged without its document
    assert held.where("plan_json is null and planid is not null").count() >= 1 and held.where("plan_json is not null").count() >= 1


def test_repository_writes_few_files_and_recalculates(spark, tmp_path):
    repo = Repository.create(spark, f"file://{tmp_path}/repo")
    repo.add("s")
    log = log_rows(spark, documents(90)).repartition(8)
    for upto in (30, 60, 90):
        assert repo.get("s", log.where(F.col("seqid") <= upto)) == 30
    assert repo.get("s", log) == 0
    # a file for each hash and intake
    for table in ("nodes", "sums"):
        files = list((tmp_path / "repo" / table).rglob("*.parquet"))
        assert len(files) == len({f.parent for f in files}) > 10
    found = lambda: sorted(map(str, repo.parameters("s").select("queryid", "planid", "node_no", "n", F.round("coef_outer", 6), "relations", "outer_rels", "merge_flag", "last_no").collect()))
    once = found()
    whole = regression.parameters(ingest.nodes_of(log, "s")).select("queryid", "planid", "node_no", "n", F.round("coef_outer", 6), "relations", "outer_rels", "merge_flag", "last_no")
    assert once == sorted(map(str, whole.collect()))
    repo.recalc("s")
    assert found() == once and repo.nodes("s").select("seqid").distinct().count() == 90


def snapshot_row(pid, kind, queryid, query, tree, planid="9"):
    return (pid, "db", kind, 0, queryid, None, query, planid, "", json.dumps(tree))


def test_driver_names_workers_and_picks_modes(spark):
    scan = lambda plan, rows: node("Seq Scan", plan, rows, side="Outer")
    leader = lambda rows: {"Plan": node("Gather", 40, rows, kids=[scan(20, rows)], **{"Workers Planned": 1, "Workers Launched": 1})}
    rows = [snapshot_row(1, "leader", "11", "select 1", leader(10)), snapshot_row(2, "parallel worker", "0", "select 1", {"Plan": scan(20, 10)}), snapshot_row(3, "leader", "12", "select 2", leader(10)), snapshot_row(4, "leader", "13", "select 3", leader(10)), snapshot_row(9, "parallel worker", "0", "nobody's", {"Plan": scan(1, 1)})]
    snap = spark.createDataFrame(rows, schema.SNAPSHOT)
    learnt = spark.createDataFrame([(q, "9", n, 2.0, 0.0, 0.0, 0.0) for q in ("12", "13") for n in (1, 2)], "queryid string, planid string, node_no int, coef_outer double, coef_inner double, coef2 double, intercept double")
    pushed = spark.createDataFrame([("13", "x")], "queryid string, params string")
    got = {r.queryid: (r.mode, r.progress) for r in live.drive(snap, [], pushed, learnt).collect()}
    # 11: 10 of 2 * 20 rows expected; 12: its one process of two scaled, 20 of 2 * 40; 13: estimates as they are
    assert got == {"11": ("rules", 0.25), "12": ("regression", 0.25), "13": ("pushed", 1.0)}


def test_driver_meets_each_document_once(spark):
    scan = lambda rows: {"Plan": node("Seq Scan", 20, rows, side="Outer")}
    leader = lambda rows: {"Plan": node("Gather", 40, rows, kids=[node("Seq Scan", 20, rows, side="Outer")], **{"Workers Planned": 2, "Workers Launched": 2})}
    rows = [snapshot_row(10 * q, "leader", str(q), f"select {q}", leader(5)) for q in range(1, 400)]
    rows += [snapshot_row(10 * q + w, "parallel worker", "0" if w == 1 else str(q), f"select {q}", scan(5)) for q in range(1, 400) for w in (1, 2) if q % 3 >= w]
    rows += [snapshot_row(9000, "leader", None, "unknown", leader(5)), snapshot_row(9001, "parallel worker", "999", "no leader", scan(5)), (9002, "db", "leader", 0, "998", None, "no plan", None, "", None)]
    snap = spark.createDataFrame(rows, schema.SNAPSHOT).repartition(5)
    found = live.drive(snap, [])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "FlatMapGroupsInArrow" not in plan
    # the gather has its own 5 rows, scaled where workers have left, of what the scan is to give
    want = {0: 5 * 3 / 20, 1: 5 * 3 / 2 / 60, 2: round(5 / 60, 6)}
    assert {r.queryid: (r.mode, r.progress) for r in found.collect()} == {str(q): ("rules", want[q % 3]) for q in range(1, 400)}


class _Api(BaseHTTPRequestHandler):
    rounds = 0

    def do_GET(self):  # noqa: N802
        type(self).rounds += 1
        nodes = [{"nodeId": 0, "nodeName": "HashAggregate", "metrics": [{"name": "number of output rows", "value": "1,000"}]}, {"nodeId": 1, "nodeName": "Scan parquet x", "metrics": [{"name": "number of output rows", "value": "4,000"}]}]
        run = {"id": 7, "status": "RUNNING", "description": "select x", "submissionTime": "2026-01-01T00:00:00.000GMT", "nodes": nodes, "edges": [{"fromId": 1, "toId": 0}]}
        body = [{"id": "app"}] if self.path.endswith("applications") else [run, run | {"id": 8, "status": "COMPLETED"}]
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def api():
    server = HTTPServer(("127.0.0.1", 0), _Api)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/api/v1"
    server.shutdown()


def test_progress_and_sampling_of_another_application(spark, tmp_path, api):
    said, asked = [], iter(["", "7", "v", "", "x", "h", "5", "quit"])
    cli.ask_progress(api, lambda _: next(asked), said.append)
    assert [s.split(" ")[0] for s in said[:2]] == ["7", "7"] and "%" in said[0] and said[2].endswith("select x") and said[3] == "not a number: x" and said[5] == "nothing runs"
    folder = f"file://{tmp_path}/samples"
    cli.main([f"file://{tmp_path}/none", "sample", api, folder, "--every", "0.01", "--rounds", "3"], spark, say=said.append)
    assert said[-1] == "3 snapshots"
    got = snapshot.replay(spark, folder).collect()
    assert sorted(r["sample"] for r in got) == [0, 1, 2] and all(r.mode == "rules" and 0 <= r.progress <= 1 for r in got)


def test_reports_are_written(spark, tmp_path):
    repo = Repository.create(spark, f"file://{tmp_path}/repo")
    repo.add("s")
    repo.get("s", log_rows(spark, documents(60)))
    said = []
    cli.main([f"file://{tmp_path}/repo", "analyze", "s", f"file://{tmp_path}/out"], spark, say=said.append)
    assert len(said) == 4
    for line in said:
        name, n = line.split(": ")
        assert sum(len(p.read_text().splitlines()) for p in (tmp_path / "out" / name).glob("*.json")) == int(n)
    assert spark.read.json(f"file://{tmp_path}/out/queries").count() == 3


def test_last_kind_of_conditions_and_first_child(spark):
    kinds = [("Index Cond", "(a = 1)"), ("Filter", "(b = 2)")]
    rows = [("q", "p", 2, 1, 0, "Seq Scan", 1.0, 1.0, kinds), ("q", "p", 1, None, 0, "Sort", 1.0, 99.0, []), ("q", "p", 3, None, 0, "Seq Scan", 1.0, 99.0, [("Index Cond", "(a = 1)"), ("Filter", "(b < 2)")])]
    nodes = spark.createDataFrame(rows, "queryid string, planid string, node_no int, parent_no int, child_ix int, node_type string, plan_rows double, actual_rows double, conds array<struct<kind:string,expr:string>>")
    got = {r.node_no: list(r.conditions) for r in analyze.misestimates(nodes).collect()}
    assert got == {1: ["Filter: (b = 2)"], 3: []}


def test_skew_by_distinct_estimates_is_that_by_executions(spark):
    rng = random.Random(2)
    rows = [(str(q), "p", 1, i, float(rng.choice([100, 101, 104, 107, 300, 301])), float(rng.randint(1, 400))) for q in range(6) for i in range(60)]

    def plain(points):
        groups = []
        for p, a in points:
            for g in groups:
                if int(0.975 * g[0][0]) <= p <= int(1.025 * g[0][0]):
                    g.append((p, a))
                    break
            else:
                groups.append([(p, a)])
        bad = False
        for g in groups:
            ps, xs = zip(*g)
            if len(g) > 1 and max(xs) > 1.75 * min(xs) and max(xs) != min(xs):
                bad |= (max(ps) - min(ps)) / (max(xs) - min(xs)) < 0.001
        return len(groups), bad

    nodes = spark.createDataFrame(rows, "queryid string, planid string, node_no int, seqid int, plan_rows double, actual_rows double").repartition(4)
    got = {r.queryid: (r.groups, r.skewed) for r in analyze.histogram_skew(nodes).collect()}
    assert got == {str(q): plain([r[4:] for r in rows if r[0] == str(q)]) for q in range(6)}


def test_switches_of_row_estimates():
    text = '{"Hash Join":("s.a", "s.b"):("s.a"):("s.b"):[2.0, 1.0]:[0.0]:[3.0]:"False"};{"Seq Scan":("s.a"):():():[2.0]:[]:[1.0]:"False"}'
    on, off = feedback.Feedback(text), feedback.Feedback(text, settings=capture.Settings(enable_adjust_joinrel_rows=False, enable_adjust_rel_rows=False))
    assert on.scan_rows("s.a", 10) == 21 and off.scan_rows("s.a", 10) == 10
    assert on.join({"s.a"}, {"s.b"}, 5, 4).rows == 17 and off.join({"s.a"}, {"s.b"}, 5, 4) == feedback.Advice("Hash Join", None)


def test_neural_model_learns_a_plane(spark):
    rng = random.Random(1)
    rows = [("q", "p", 1, float(o), float(v), 3.0 * o + v) for o, v in ((rng.randint(0, 100), rng.randint(0, 50)) for _ in range(300))]
    training = spark.createDataFrame(rows, "queryid string, planid string, node_no int, x_outer double, x_inner double, y double")
    told = neural.predict_joins(training, neural.train_joins(training)).withColumn("y", 3 * F.col("x_outer") + F.col("x_inner"))
    assert told.count() == 300 and told.agg(F.avg(F.abs(F.col("predicted") - F.col("y")))).first()[0] < 30


def test_models_go_to_tasks_once(spark):
    rows = [(q, "p", n, float(i % 40), float(i % 7), 2.0 * (i % 40) * n) for i in range(200) for q, n in (("a", 1), ("b", 2))]
    nodes = spark.createDataFrame([(*r[:3], 2, "Hash Join", *r[3:]) for r in [*rows, ("rare", "p", 1, 1.0, 1.0, 1.0), (None, "p", 1, 1.0, 1.0, 1.0)]], "queryid string, planid string, node_no int, depth int, node_type string, actual_outer double, actual_inner double, actual_rows double")
    training = analyze.join_training(nodes, 2)
    # nodes are counted without a window over all executions of one
    assert "Window" not in training._jdf.queryExecution().executedPlan().toString()
    assert training.count() == 400 and analyze.join_training(nodes, 1).where("queryid is null").count() == 1
    models = neural.train_joins(training, epochs=50, most=100)
    assert {r.executions for r in models.collect()} == {100}
    models = models.localCheckpoint()
    sent, joined = neural.predict_joins(training, models), neural.predict_joins(training, models, sent=1)
    assert "weights" not in sent._jdf.queryExecution().optimizedPlan().toString()
    some = neural.predict_joins(training, models.where("queryid = 'a'"))
    key = lambda df: sorted(tuple(r[:5]) + (round(r[5], 9),) for r in df.collect())
    assert key(sent) == key(joined) and len(key(sent)) == 400
    assert key(some) == [r for r in key(sent) if r[0] == "a"]


def test_models_are_trained_on_every_execution(spark):
    rng = random.Random(2)
    schema = "queryid string, planid string, node_no int, x_outer double, x_inner double, y double"
    rows = [("q", "p", 1, float(rng.randint(0, 50)), float(rng.randint(1, 7)), float(rng.randint(0, 49))) for _ in range(12_000)]
    rows += [("few", "p", 1, 3.0, 2.0, 6.0), ("few", "p", 1, None, float("nan"), 0.0), (None, "p", 2, 1.0, 1.0, None)]
    training = spark.createDataFrame(rows, schema)
    models = {r.queryid: r for r in neural.train_joins(training, epochs=30).collect()}
    assert {q: r.executions for q, r in models.items()} == {"q": 12_000, "few": 2, None: 1}
    assert models["few"].weights[-3:] == [3.0, 2.0, 6.0] and math.isnan(models[None].weights[-1])
    # the same steps over single executions
    count = Counter(r[3:] for r in rows[:12_000])
    share = {tuple(r[:3]): r[3] for r in spark.createDataFrame(list(count), "o double, v double, y double").selectExpr("*", "xxhash64(o, v, y) / power(2D, 64) + 0.5D").collect()}
    held = {k: math.floor(n * neural.HELD_OUT + share[k]) for k, n in count.items()}
    each = np.array([(*k, float(i < held[k])) for k, n in count.items() for i in range(n)])
    assert 0.19 < each[:, 3].mean() < 0.21
    x, y, out = each[:, :2] / each[:, :2].max(axis=0), each[:, 2] / each[:, 2].max(), each[:, 3]
    model = neural.Descent(np.random.default_rng(0), 30, (1 - out).sum(), out.sum())
    while model.step(neural._sums(model.flat, x, 1 - out, (1 - out) * y, out, out * y, out * y * y)):
        pass
    assert np.allclose(models["q"].weights, [*model.best, 50, 7, 49], atol=1e-6) and abs(models["q"].loss - model.loss) < 1e-9
    # neither partitions nor where a node is trained change a model
    again = {r.queryid: r for r in neural.train_joins(training.repartition(7), epochs=30).collect()}
    passes = {r.queryid: r for r in neural.train_joins(training, epochs=30, points=0).collect()}
    for other in (again, passes):
        assert all(r.executions == other[q].executions and np.allclose(r.weights, other[q].weights, atol=1e-6, equal_nan=True) for q, r in models.items())


def test_slopes_are_those_of_the_error():
    rng = np.random.default_rng(3)
    x, y, one = rng.uniform(size=(40, 2)), rng.uniform(size=40), np.ones(40)
    w = neural.Descent(rng, 1, 1, 1).flat
    told = lambda at: neural._sums(at, x, one, y, one, y, y * y)
    near = [(told(w + d)[-1] - told(w - d)[-1]) / 2e-6 for d in 1e-6 * np.eye(len(w))]
    assert np.allclose(told(w)[:-1], near, atol=1e-4) and np.isclose(told(w)[-1], ((neural._forward(neural._split(w), x) - y) ** 2).sum())


def test_samples_skip_wide_values_and_repeat(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, F.lit("w" * 2000)).when(F.col("id") % 10 == 1, None).otherwise("n").alias("s"))
    got = statistics.sampled(df, 100, seed=4).collect()
    assert len(got) == 100 and not any(r.id % 10 == 0 for r in got) and any(r.s is None for r in got)
    assert got == statistics.sampled(df.repartition(7), 100, seed=4).collect() and statistics.sampled(df, 5000).count() == 900


def test_buckets_are_joined_without_exchange(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    plan = queries_relational.queries()["join_partition_wise"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan and spark.conf.get("spark.sql.adaptive.enabled") == before


def test_log_numbers(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    plan_log.append_log(log_rows(spark, documents(3)), path)
    assert capture.Capture(spark, path)._logged() == 3 and capture.Capture(spark, path + "x")._logged() == 0


def test_incremental_sort_is_a_whole_order(spark):
    rows = queries_relational.queries()["sort_incremental"](spark, SMALL).collect()
    keys = [(r.l_orderkey, -r.l_extendedprice, r.l_partkey, r.l_suppkey, r.l_linenumber) for r in rows]
    assert keys == sorted(keys) and len(keys) == 6000


def test_log_of_a_database(spark):
    url = "jdbc:derby:memory:plans;create=true"
    rows = log_rows(spark, documents(5)).select("seqid", "queryid", "planid", "plan_json")
    rows.write.format("jdbc").option("url", url).option("dbtable", "plan_log").option("driver", "org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    got = plan_log.read_jdbc(spark, url, "plan_log", 2, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert sorted(r[0] for r in got.collect()) == [3, 4, 5]


def test_log_of_a_database_is_cut_by_the_database(spark):
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    for k, name in enumerate(("seqid", "SEQID")):
        url = f"jdbc:derby:memory:cut{k};create=true"
        spark.range(1, 6).toDF(name).write.format("jdbc").option("url", url).option("dbtable", "plan_log").option("driver", driver).save()
        got = plan_log.read_jdbc(spark, url, "plan_log", 2, driver=driver)
        assert sorted(r[0] for r in got.collect()) == [3, 4, 5]
        scan = next(line for line in got._jdf.queryExecution().executedPlan().toString().split("\n") if "JDBCRelation" in line)
        assert f"GreaterThan({name},2)" in scan


def test_aggregates_report_their_memory(spark):
    _, row = capture.run_and_capture(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    kinds = [n for n in flatten.rows(row[-1]) if n["node_type"] == "Aggregate"]
    assert kinds and all(int(n["props"]["Peak Memory Usage"]) > 0 and n["props"]["Disk Usage"] == "0" for n in kinds)
