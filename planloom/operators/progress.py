"""Progress of running queries from snapshots of their plans.

States flow from the root down, points from the leaves up.  Both are folds over one small tree, so a snapshot's nodes
go through one function per plan; plans meet that function in Arrow batches, many in one call, side by side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..plans import flatten, schema

WAITING, RUNNING, FINISHED = "WAITING", "RUNNING", "FINISHED"
ONE_CHILD = ["Hash", "Sort", "Incremental Sort", "Gather", "Gather Merge", "WindowAgg", "Aggregate", "Group", "Unique", "SetOp", "Limit", "LockRows", "Materialize", "Memoize", "ProjectSet", "Subquery Scan", "Result"]


@dataclass
class Node:
    number: int
    parent: int
    type: str
    relationship: str | None
    plan: float
    actual: float
    loops: float
    removed: float
    merge: bool
    filters: bool
    coef2: float = 0.0
    state: str = WAITING
    expected: float = 0.0
    plan_points: float = 0.0
    actual_points: float = 0.0
    children: list[Node] = field(default_factory=list)

    @property
    def scan(self) -> bool:
        return any(s in self.type for s in ("Scan",))


def build(rows: list[dict]) -> Node:
    """The tree of a plan's rows."""
    by_number: dict[int, Node] = {}
    for r in sorted(rows, key=lambda r: r["node_no"]):
        node = Node(r["node_no"], r["parent_no"] or 0, r["node_type"], r["relationship"], r["plan_rows"] or 0.0, r["actual_rows"] or 0.0, r["actual_loops"] or 0.0, r["removed_rows"] or 0.0, bool(r["merge_flag"]), bool(r["conds"]) and any(c["kind"] == "Join Filter" for c in r["conds"]), r.get("coef2") or 0.0)
        by_number[node.number] = node
        if node.parent:
            by_number[node.parent].children.append(node)
    return by_number[min(by_number)]


def set_states(root: Node, finished: bool = False) -> None:
    """Waiting nodes run once they show rows, loops or removed rows; below a running node a scan whose previous
    sibling has begun (for the root: any scan) is finished.  With regression parameters all count as finished."""

    def settle(node: Node, state: str, begun: bool) -> None:
        if state == WAITING:
            node.state = RUNNING if node.actual or node.loops or node.removed else WAITING
        elif state == RUNNING:
            node.state = FINISHED if begun and node.scan else RUNNING
        else:
            node.state = FINISHED
        before = False
        for child in node.children:
            settle(child, node.state, before)
            before = child.loops > 0

    settle(root, FINISHED if finished else WAITING, True)


def apply_rules(root: Node) -> None:
    """Six corrections of the states, parents before children."""
    stack = [root]
    while stack:
        n = stack.pop()
        running = n.state == RUNNING
        if running and n.type == "Hash Join" and n.filters and n.plan <= n.actual:
            for c in n.children:
                c.state = FINISHED
        if (running and n.type == "Materialize" or n.type == "Hash") and (n.loops > 0 or n.actual > 0 or n.merge):
            n.state = FINISHED
        if n.state == RUNNING and n.scan:
            if n.relationship == "Inner" and n.loops > 0 or n.relationship == "Outer" and n.plan <= n.actual or n.relationship not in ("Inner", "Outer"):
                n.state = FINISHED
        if n.state == RUNNING and n.type in schema.SUM_JOINS and not n.filters and 5 * n.plan < n.actual:
            for c in n.children:
                if c.relationship == "Outer":
                    n.plan = c.plan
        stack += reversed(n.children)


def weight(node_type: str, n: float) -> float:
    """Work of n rows: n ln n for sorts, else n."""
    if node_type not in schema.SORTS:
        return n
    return n * math.log(int(n)) if n >= 1 else 0.0


def _simple(node: Node, source: Node, regression: bool) -> None:
    if regression:
        node.plan_points, node.actual_points = weight(node.type, max(node.plan, node.actual)), weight(node.type, node.actual)
    elif node.state == FINISHED:
        node.expected = source.actual
        node.plan_points = node.actual_points = weight(node.type, node.actual + node.removed)
    else:
        node.expected = max(source.plan, source.actual)
        node.plan_points, node.actual_points = weight(node.type, node.expected + node.removed), weight(node.type, node.actual + node.removed)


def _join(node: Node, regression: bool) -> None:
    real = [c for c in node.children if c.relationship not in ("InitPlan", "SubPlan")]
    member = node.type in schema.MEMBER_NODES
    outer = next((c for c in real if c.relationship == "Outer"), real[0])
    inner = next((c for c in real if c is not outer), None)
    if regression:
        o, v = max(outer.plan, outer.actual), max(inner.plan, inner.actual) if inner else 0.0
        a, b = outer.actual, inner.actual if inner else 0.0
        if member:
            node.plan_points, node.actual_points = sum(max(c.plan, c.actual) for c in real), sum(c.actual for c in real) + node.removed
        elif node.type in schema.SUM_JOINS and node.coef2 <= 0:
            node.plan_points, node.actual_points = o + v, a + b + node.removed
        else:
            node.plan_points, node.actual_points = o * v, a * b + node.removed
        return
    if member:
        points = sum(c.expected for c in real)
    elif node.type == "Merge Join":
        points = outer.expected
    elif node.type == "Hash Join":
        points = outer.expected + (inner.expected if inner else 0.0)
    else:
        points = outer.expected * (inner.expected if inner else 0.0)
    node.plan_points = points
    if node.state == FINISHED:
        node.expected, node.actual_points = points, node.actual
    elif points - node.removed == node.actual:
        node.expected, node.actual_points = node.actual, points
    else:
        node.expected = max(node.plan, node.actual if node.type in schema.SUM_JOINS else points - node.removed)
        node.actual_points = node.actual + node.removed


def set_points(node: Node, regression: bool = False) -> None:
    for child in node.children:
        set_points(child, regression)
    real = [c for c in node.children if c.relationship not in ("InitPlan", "SubPlan")]
    if real and (node.type in schema.PRODUCT_NODES or node.type in schema.SUM_JOINS):
        _join(node, regression)
    elif real and node.type in ONE_CHILD:
        for child in real:
            _simple(node, child, regression)
    else:
        _simple(node, node, regression)


def ratio(root: Node, leaves: bool = False) -> float:
    """Actual by planned points over the nodes that have children (or over all), at most 1."""
    plan = actual = 0.0
    stack = [root]
    while stack:
        n = stack.pop()
        stack += n.children
        if n.children or leaves:
            plan += n.plan_points
            actual += n.actual_points
    return round(min(actual / plan, 1.0), 6) if plan else 0.0


def progress_of(rows: list[dict], regression: bool = False, leaves: bool = False) -> float:
    """Progress of one plan.  ``regression``: its estimates have been replaced by learnt ones."""
    root = build(rows)
    set_states(root, regression)
    if not regression:
        apply_rules(root)
    set_points(root, regression)
    return ratio(root, leaves)


#: Plans whose nodes a worker holds as Python objects at a time.
PLANS = 1000


def progress(nodes: DataFrame, keys: list[str], regression: bool = False, leaves: bool = False) -> DataFrame:
    """keys, progress for each plan of a node table (rules, or learnt estimates already in place)."""
    kinds = dict(nodes.dtypes)
    filters = F.filter("conds", lambda c: c["kind"] == "Join Filter").alias("conds")
    entry = F.struct(*(c for c in flatten.PROGRESS if c != "conds"), filters, *(["coef2"] if "coef2" in kinds else []))
    plans = nodes.groupBy(*keys).agg(F.collect_list(entry).alias("__plan"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, PLANS):
                part = batch.slice(k, PLANS)
                found = pa.array([progress_of(rows, regression, leaves) for rows in part.column(len(keys)).to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], found], names=[*keys, "progress"])

    return plans.mapInArrow(run, StructType([*(nodes.schema[k] for k in keys), StructField("progress", DoubleType())]))


def log_progress(log: DataFrame, keys: list[str], regression: bool = False, leaves: bool = False, finished: bool = False) -> DataFrame:
    """keys (columns of the log), progress for each row of a plan log, its document taken as it is or, ``finished``, with
    worker rows merged in: ``progress`` of its nodes, in one map without a shuffle."""
    source = log.where("planid is not null and plan_json is not null").select(*keys, "plan_json")

    def one(text: str) -> float:
        rows = flatten.rows(text, flatten.PROGRESS)
        if finished:
            flatten.merged(rows)
        return progress_of(rows, regression, leaves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, PLANS):
                part = batch.slice(k, PLANS)
                found = pa.array([one(text) for text in part.column(len(keys)).to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], found], names=[*keys, "progress"])

    return source.mapInArrow(run, StructType([*(source.schema[k] for k in keys), StructField("progress", DoubleType())]))


def bar(value: float, width: int = 50) -> str:
    """A progress bar with the percentage floored to two decimals."""
    done = int(value * width)
    return "[" + "#" * done + "." * (width - done) + f"] {math.floor(value * 10_000) / 100:.2f} %"
