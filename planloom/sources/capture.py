"""Capture of executed Spark plans in the plan-node vocabulary.

``document`` walks the final physical plan of a query (through adaptive wrappers and query stages) once it has run and
gives the JSON-ready tree; ``Capture`` listens to every query of a session, puts what passes the log conditions into a
bounded queue and appends it to the plan log in batches.
"""

from __future__ import annotations

import json
import queue
import re
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import xxhash
from pyspark.sql import DataFrame, Row, SparkSession

from ..plans import fingerprint, schema
from .plan_log import max_seqid

WRAPPERS = {"AdaptiveSparkPlanExec": "executedPlan", "ShuffleQueryStageExec": "plan", "BroadcastQueryStageExec": "plan", "TableCacheQueryStageExec": "plan", "ResultQueryStageExec": "plan"}
PASS_THROUGH = {"WholeStageCodegenExec", "InputAdapter", "AQEShuffleReadExec", "ColumnarToRowExec", "RowToColumnarExec", "ProjectExec", "ReusedExchangeExec", "CommandResultExec", "DeserializeToObjectExec", "SerializeFromObjectExec", "WriteFilesExec"}
NAMES = {
    "FileSourceScanExec": "Seq Scan", "BatchScanExec": "Seq Scan", "RowDataSourceScanExec": "Foreign Scan", "LocalTableScanExec": "Values Scan", "RangeExec": "Function Scan", "InMemoryTableScanExec": "Materialize", "OneRowRelationExec": "Result", "RDDScanExec": "Result",
    "BroadcastHashJoinExec": "Hash Join", "ShuffledHashJoinExec": "Hash Join", "SortMergeJoinExec": "Merge Join", "BroadcastNestedLoopJoinExec": "Nested Loop", "CartesianProductExec": "Nested Loop",
    "BroadcastExchangeExec": "Hash", "ShuffleExchangeExec": "Gather", "SortExec": "Sort", "TakeOrderedAndProjectExec": "Limit", "GlobalLimitExec": "Limit", "LocalLimitExec": "Limit", "CollectLimitExec": "Limit",
    "HashAggregateExec": "Aggregate", "ObjectHashAggregateExec": "Aggregate", "SortAggregateExec": "Aggregate", "WindowExec": "WindowAgg", "WindowGroupLimitExec": "WindowAgg", "ExpandExec": "ProjectSet", "GenerateExec": "ProjectSet", "UnionExec": "Append", "FilterExec": "Filter", "SampleExec": "Sample Scan", "UnionLoopExec": "Recursive Union",
}


def _option(value):
    return value.get() if value is not None and value.isDefined() else None


def _metric(plan, *names: str) -> float | None:
    metrics = plan.metrics()
    for name in names:
        if metrics.contains(name):
            return float(metrics.apply(name).value())
    return None


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _estimate(plan) -> float | None:
    link = _option(plan.logicalLink())
    rows = _option(link.stats().rowCount()) if link is not None else None
    return float(str(rows)) if rows is not None else None


def _walk(plan) -> dict:
    kind = plan.getClass().getSimpleName()
    if kind in WRAPPERS:
        return _walk(getattr(plan, WRAPPERS[kind])())
    kids = _items(plan.children())
    if kind in PASS_THROUGH and len(kids) <= 1:
        return _walk(kids[0] if kids else plan.child())
    node: dict = {"Node Type": NAMES.get(kind, kind.removesuffix("Exec"))}
    below = [_walk(k) for k in kids]
    rows = _metric(plan, "numOutputRows", "shuffleRecordsWritten", "recordsRead")
    if kind == "FilterExec":
        # a filter belongs to the node below it
        inner = below[0]
        condition = plan.condition().toString()
        inner["Filter"] = f"{inner['Filter']} AND {condition}" if "Filter" in inner else condition
        if rows is not None:
            inner["Rows Removed by Filter"] = inner.get("Rows Removed by Filter", 0.0) + max(0.0, inner["Actual Rows"] - rows)
            inner["Actual Rows"] = rows
        inner["Plan Rows"] = _estimate(plan) if _estimate(plan) is not None else inner["Plan Rows"]
        return inner
    if kind == "FileSourceScanExec":
        table = _option(plan.tableIdentifier())
        roots = _items(plan.relation().location().rootPaths())
        node["Schema"] = "files" if table is None else "spark_catalog"
        node["Relation Name"] = table.table() if table is not None else re.sub(r"\.\w+$", "", roots[0].getName()) if roots else "unknown"
        node["Alias"] = node["Relation Name"]
    elif kind == "BatchScanExec":
        node["Schema"], node["Relation Name"] = "source", plan.table().name()
    if kind in ("BroadcastHashJoinExec", "ShuffledHashJoinExec", "SortMergeJoinExec"):
        pairs = zip(_items(plan.leftKeys()), _items(plan.rightKeys()))
        node["Merge Cond" if kind == "SortMergeJoinExec" else "Hash Cond"] = " AND ".join(f"({a.toString()} = {b.toString()})" for a, b in pairs)
    if "Join" in kind or kind == "CartesianProductExec":
        node["Join Type"] = "Inner" if kind == "CartesianProductExec" else plan.joinType().toString().replace("Outer", "").replace("LeftSemi", "Semi").replace("LeftAnti", "Anti")
        condition = _option(plan.condition())
        if condition is not None:
            node["Join Filter"] = condition.toString()
        build_left = kind != "SortMergeJoinExec" and kind != "CartesianProductExec" and plan.buildSide().toString() == "BuildLeft"
        below = below[::-1] if build_left else below
        for side, child in zip(("Outer", "Inner"), below):
            child["Parent Relationship"] = side
    elif node["Node Type"] == "Append":
        for child in below:
            child["Parent Relationship"] = "Member"
    else:
        for child in below:
            child["Parent Relationship"] = "Outer"
    if node["Node Type"] == "Aggregate":
        grouped = plan.groupingExpressions().size() > 0
        node["Strategy"] = "Plain" if not grouped else "Sorted" if kind == "SortAggregateExec" else "Hashed"
        modes = {e.mode().toString() for e in _items(plan.aggregateExpressions())}
        node["Partial Mode"] = "Partial" if modes and modes <= {"Partial", "PartialMerge"} else "Finalize" if "Final" in modes else "Simple"
    if kind in ("SortExec", "ObjectHashAggregateExec", "HashAggregateExec"):
        spill, peak = _metric(plan, "spillSize") or 0.0, _metric(plan, "peakMemory") or 0.0
        if kind == "SortExec":
            node["Sort Space Used"], node["Sort Space Type"] = int((spill or peak) / 1024), "Disk" if spill > 0 else "Memory"
        else:  # kB, as for sorts
            node["Peak Memory Usage"], node["Disk Usage"] = int(peak / 1024), int(spill / 1024)
    node["Plan Rows"] = _estimate(plan)
    node["Actual Rows"] = rows if rows is not None else sum(c["Actual Rows"] for c in below) if node["Node Type"] == "Append" else below[0]["Actual Rows"] if below else 0.0
    if node["Plan Rows"] is None:  # without table statistics there is no estimate: what was read stands for it
        node["Plan Rows"] = node["Actual Rows"]
    node["Actual Loops"] = 1.0
    if below:
        node["Plans"] = below
    return node


def document(query_execution) -> dict:
    """``{"Plan": ...}`` of a JVM query execution that has run."""
    return {"Plan": _walk(query_execution.executedPlan())}


def query_id(query_execution) -> str:
    """An unsigned 64-bit number (as text) that is the same for queries that differ in constants alone."""
    text = query_execution.analyzed().canonicalized().toString()
    text = re.sub(r"#\d+L?|\[\d+\]", "", text)
    return str(xxhash.xxh64_intdigest(re.sub(r"'[^']*'|\b\d+(\.\d+)?\b", "?", text)))


def text_plan(tree: dict) -> str:
    """The document as an indented text."""
    lines = []

    def add(node: dict, depth: int) -> None:
        relation = f" on {node['Relation Name']}" if "Relation Name" in node else ""
        lines.append(f"{'  ' * depth}{'->  ' if depth else ''}{node['Node Type']}{relation}  (rows={node['Plan Rows']:.0f}) (actual rows={node['Actual Rows']:.0f} loops={node['Actual Loops']:.0f})")
        for key in schema.FINGERPRINT_CONDITIONS:
            if key in node:
                lines.append(f"{'  ' * depth}      {key}: {node[key]}")
        for child in node.get("Plans", []):
            add(child, depth + 1)

    add(tree["Plan"], 0)
    return "\n".join(lines)


def log_row(query_execution, seqid: int, started: datetime, ended: datetime, query: str = "", pid: int = 0) -> tuple:
    """A row of the plan log."""
    tree = document(query_execution)
    return (seqid, started, ended, "spark", pid, 0, query_id(query_execution), query, fingerprint.planid(tree), text_plan(tree), json.dumps(tree))


def run_and_capture(df: DataFrame, seqid: int = 1, query: str = "") -> tuple[Iterator[Row], tuple]:
    """Run ``df`` on the executors and return its rows and its plan-log row.

    Nothing of the result comes to the driver: the rows are an iterator that runs the query again once it is asked.
    """
    started = datetime.now(UTC)
    df._jdf.queryExecution().toRdd().count()
    ended = datetime.now(UTC)

    def rows() -> Iterator[Row]:
        yield from df.toLocalIterator()

    return rows(), log_row(df._jdf.queryExecution(), seqid, started, ended, query)


# --- listening ------------------------------------------------------------------------------------------------------


@dataclass
class Settings:
    """Effective logging needs all four switches; only queries longer than ``log_min_duration`` seconds are logged."""

    global_show_plan: bool = True
    show_plan: bool = True
    global_store_plan: bool = True
    store_plan: bool = True
    log_min_duration: float = 10.0
    enable_adjust_joinrel_rows: bool = True
    enable_adjust_rel_rows: bool = True
    buffer_slots: int = 32
    flush_seconds: float = 5.0
    max_query_chars: int = 16 * 1024
    max_json_bytes: int = 1024 * 1024

    @property
    def stores(self) -> bool:
        return self.global_show_plan and self.show_plan and self.global_store_plan and self.store_plan


class Listener:
    """A QueryExecutionListener in Python; it only puts references into the queue."""

    def __init__(self, take: Callable):
        self.take = take

    def onSuccess(self, function, execution, nanoseconds):  # noqa: N802
        self.take(execution, nanoseconds / 1e9)

    def onFailure(self, function, execution, error):  # noqa: N802
        pass

    class Java:
        implements = ["org.apache.spark.sql.util.QueryExecutionListener"]


class Capture:
    """Logs the plans of a session's finished queries to a Parquet folder.

    Numbers go on from the largest in the folder; two sessions that log at a time need a folder each.  The queue waits for
    a vacant slot, and no plan is dropped but one that can't be read (``dropped``); of a query's text the first
    ``max_query_chars`` are kept, and a document above ``max_json_bytes`` is left out of its row.

    with Capture(spark, path, Settings(log_min_duration=0)): ...
    """

    def __init__(self, spark: SparkSession, path: str, settings: Settings | None = None):
        self.spark, self.path, self.settings = spark, path, settings or Settings()
        self.slots: queue.Queue = queue.Queue(self.settings.buffer_slots)
        self.stopping = threading.Event()
        self.lock, self.written, self.next, self.dropped = threading.Lock(), 0, 1, 0
        self.listener = Listener(self.take)

    def take(self, execution, seconds: float) -> None:
        # the JVM may go on calling a listener that has been unregistered: each call brings a new proxy
        if self.stopping.is_set() or not self.settings.stores or seconds <= self.settings.log_min_duration and self.settings.log_min_duration:
            return
        plan = execution.logical().getClass().getSimpleName()
        if "Command" in plan or plan.startswith(("Insert", "Create", "Append", "Overwrite")):  # only queries are logged, EXPLAIN and writes are not
            return
        try:
            ended = datetime.now(UTC)
            tree = document(execution)
            text = json.dumps(tree)
            if len(text) > self.settings.max_json_bytes:
                text = None  # logged without its document, which the regression then leaves out
            row = [None, datetime.fromtimestamp(ended.timestamp() - seconds, UTC), ended, "spark", 0, 0, query_id(execution), execution.logical().toString()[: self.settings.max_query_chars], fingerprint.planid(tree), text_plan(tree), text]
        except Exception:  # noqa: BLE001  a plan that can't be read must not fail the query
            self.dropped += 1
            return
        while not self.stopping.is_set():
            try:
                return self.slots.put(row, timeout=0.5)  # waits for a vacant slot
            except queue.Full:
                continue

    def _logged(self) -> int:
        """The largest number in the folder, 0 without any."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return 0
        return max_seqid(self.spark.read.schema(schema.PLAN_LOG).parquet(self.path))

    def flush(self) -> int:
        """Append what the queue holds in one batch; the rows written."""
        with self.lock:
            rows = []
            while True:
                try:
                    rows.append(self.slots.get_nowait())
                except queue.Empty:
                    break
            for r in rows:
                r[0] = self.next
                self.next += 1
            if rows:
                self.spark.createDataFrame([tuple(r) for r in rows], schema.PLAN_LOG).coalesce(1).write.mode("append").parquet(self.path)
                self.written += len(rows)
            return len(rows)

    def _sweep(self) -> None:
        last = time.monotonic()
        while not self.stopping.wait(0.1):
            if self.slots.full() or time.monotonic() - last >= self.settings.flush_seconds:
                self.flush()
                last = time.monotonic()

    def __enter__(self):
        from pyspark.java_gateway import ensure_callback_server_started

        ensure_callback_server_started(self.spark.sparkContext._gateway)
        self.next = 1 + self._logged()
        # what ran before is none of this log's business
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        self.spark._jsparkSession.listenerManager().register(self.listener)
        self.sweeper = threading.Thread(target=self._sweep, daemon=True)
        self.sweeper.start()
        return self

    def __exit__(self, *_):
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        self.spark._jsparkSession.listenerManager().unregister(self.listener)
        self.stopping.set()
        self.sweeper.join()
        self.flush()
