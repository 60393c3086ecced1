"""Plan documents (JSON) to rows, one for each node.

The tree is walked once in pre-order; numbering, parents, depths, parallel regions, the relations below each node and,
where asked for, the rows of its children come out of the same walk.  Everything after it is column arithmetic on flat
rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import schema


def root_of(document: str | dict) -> dict:
    """The root node of a document: ``{"Plan": {...}}``, or the node itself."""
    tree = json.loads(document) if isinstance(document, str) else document
    if isinstance(tree, list):
        tree = tree[0]
    return tree.get("Plan", tree)


def walk(document: str | dict) -> list[tuple[dict, int, int, int]]:
    """(node, parent number or 0, child index, depth) in pre-order; numbers count from 1."""
    out, stack = [], [(root_of(document), 0, 0, 0)]
    while stack:
        node, parent, child, depth = stack.pop()
        out.append((node, parent, child, depth))
        number = len(out)
        kids = [k for k in node.get("Plans", []) if "Node Type" in k]
        stack += [(k, number, i, depth + 1) for i, k in reversed(list(enumerate(kids)))]
    return out


def parallel_flags(nodes: list[tuple[dict, int, int, int]]) -> list[tuple[bool, int, int]]:
    """(merge_flag, norm, norm_plan) of each node.

    A region of workers begins at a node that plans workers and follows first children; once any worker has been
    planned, a later child leaves the region with all that is below it and after it.  Worker counts add up over the
    document.  Aggregates work within workers but their rows are never merged.
    """
    out: list[tuple[bool, int, int]] = []
    parallel, planned, launched = False, 0, 0
    left: dict[int, bool] = {}  # parent number: one of its children has left the region
    outside: list[bool] = []
    for node, parent, child, _ in nodes:
        away = bool(parent) and (outside[parent - 1] or left.get(parent, False))
        # a document that turned parallel before this later child
        if parallel and child:
            away = left[parent] = True
        outside.append(away)
        if "Workers Planned" in node:
            parallel = True
            planned += int(node["Workers Planned"])
            launched += int(node.get("Workers Launched", 0))
        if parallel and not away and node["Node Type"] != "Aggregate":
            out.append((True, launched + 1, planned + 1))
        else:
            out.append((False, 1, 1))
    return out


def _text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value)


#: What a document's rows have in any case; the rest is made where it is wanted.
_ALWAYS = {"node_no", "parent_no", "relationship", "node_type", "plan_rows", "actual_rows", "actual_loops", "removed_rows", "workers", "merge_flag", "norm", "norm_plan"}
_PLAIN = {"strategy": "Strategy", "partial_mode": "Partial Mode", "join_type": "Join Type", "workers_planned": "Workers Planned", "workers_launched": "Workers Launched", "schema": "Schema", "relation": "Relation Name", "alias": "Alias", "sort_space_kb": "Sort Space Used", "sort_space_type": "Sort Space Type"}
#: Columns that say which relations are below a node.
_RELATIONS = {"relations", "outer_rels", "inner_rels"}
#: The columns that progress is told from.
PROGRESS = ("node_no", "parent_no", "node_type", "relationship", "plan_rows", "actual_rows", "actual_loops", "removed_rows", "merge_flag", "conds")


def _number(value) -> float | None:
    return None if value is None else float(value)


def rows(document: str | dict, wanted: Collection[str] | None = None) -> list[dict]:
    """The rows of a document, without the columns that name it; with ``wanted`` only those columns, and what
    ``merged``, ``add_inputs`` and ``replace.replaced`` work on."""
    nodes = walk(document)
    flags = parallel_flags(nodes)
    every = wanted is None
    conds, props, plain = every or "conds" in wanted, every or "props" in wanted, [(c, k) for c, k in _PLAIN.items() if every or c in wanted]
    placed, related = every or not {"child_ix", "depth", "last_no"}.isdisjoint(wanted), every or not _RELATIONS.isdisjoint(wanted)
    if placed or related:
        last = list(range(1, len(nodes) + 1))
        below: list[set[str]] = [set() for _ in nodes]
        for n in range(len(nodes), 0, -1):
            node, parent = nodes[n - 1][:2]
            if "Relation Name" in node:
                below[n - 1].add(f"{node.get('Schema', 'public')}.{node['Relation Name']}")
            if parent:
                last[parent - 1] = max(last[parent - 1], last[n - 1])
                below[parent - 1] |= below[n - 1]
    out = []
    for n, ((node, parent, child, depth), (flag, norm, norm_plan)) in enumerate(zip(nodes, flags), 1):
        get = node.get
        row = {
            "node_no": n, "parent_no": parent or None, "relationship": get("Parent Relationship"), "node_type": node["Node Type"],
            "plan_rows": _number(get("Plan Rows")), "actual_rows": _number(get("Actual Rows")), "actual_loops": _number(get("Actual Loops")),
            "removed_rows": sum([float(node[k]) for k in schema.REMOVED if k in node], 0.0), "merge_flag": flag, "norm": norm, "norm_plan": norm_plan,
            "workers": [{"no": int(w.get("Worker Number", i)), "rows": float(w.get("Actual Rows", 0)), "loops": float(w.get("Actual Loops", 0))} for i, w in enumerate(get("Workers", ()))],
        }
        if placed:
            row |= {"child_ix": child, "depth": depth, "last_no": last[n - 1]}
        if related:
            row["relations"] = sorted(below[n - 1])
        if conds:
            row["conds"] = [{"kind": k, "expr": _text(get(k))} for k in schema.CONDITIONS if k in node]
        if props:
            row["props"] = {k: _text(v) for k, v in node.items() if k not in ("Plans", "Workers") and v is not None}
        for column, key in plain:
            row[column] = get(key)
        out.append(row)
    return out


def merged(found: list[dict]) -> None:
    """Finished plans: rows and loops of listed workers added, and the estimate scaled to all workers, in place."""
    for r in found:
        if r["merge_flag"] and r["workers"]:
            if r["plan_rows"] is not None:
                r["plan_rows"] *= r["norm_plan"]
            for column, part in (("actual_rows", "rows"), ("actual_loops", "loops")):
                if r[column] is not None:
                    r[column] += sum(w[part] for w in r["workers"])


def add_inputs(found: list[dict]) -> None:
    """The rows of each node's children alongside, in place (see ``children``; members count as a sum), and the
    relations below either side."""
    sides: dict[int, dict] = {}
    for r in found:
        if not r["parent_no"] or (r["relationship"] or "Outer") in ("InitPlan", "SubPlan"):
            continue
        held = sides.setdefault(r["parent_no"], {})
        side = "outer" if (r["relationship"] or "Outer") == "Outer" else "inner"
        if "relations" in r:
            held[f"{side}_rels"] = max(held.get(f"{side}_rels", r["relations"]), r["relations"])
        for kind in ("plan", "actual"):
            value = r[f"{kind}_rows"]
            if value is not None:
                held[f"{kind}_{side}"] = max(held.get(f"{kind}_{side}", value), value)
                held[f"{kind}_members"] = held.get(f"{kind}_members", 0.0) + value
    for r in found:
        held = sides.get(r["node_no"], {})
        member = r["node_type"] in schema.MEMBER_NODES
        for kind in ("plan", "actual"):
            r[f"{kind}_members"] = held.get(f"{kind}_members")
            r[f"{kind}_outer"] = r[f"{kind}_members"] if member else held.get(f"{kind}_outer")
            r[f"{kind}_inner"] = 1.0 if member else held.get(f"{kind}_inner")
        if "relations" in r:
            r["outer_rels"], r["inner_rels"] = held.get("outer_rels"), held.get("inner_rels")


def plan_nodes(log: DataFrame, server_id: str = "local", finished: bool = False, extra: list[str] | None = None, columns: Collection[str] | None = None, change: tuple[str, Callable] | None = None) -> DataFrame:
    """The ``plan_node`` table of a plan log; rows without planid (nothing was captured) are left out.

    A narrow map in Arrow batches: one log row in, its nodes out, no shuffle.  ``finished``: with worker rows merged in
    and children's rows and relations alongside, as ``regression.with_inputs(workers.merge_finished(...))`` and
    ``lineage.relation_sets`` give them.  ``extra``: further columns of the log that each node carries.  ``columns``: the
    columns of a node that are wanted, all if None; others are not even made.  ``change``: a column of the log and a
    function that alters a document's rows in place, called with the rows and the column's value.
    """
    keys = ["server_id", "seqid", "queryid", "planid", *(extra or [])]
    keyed = log if "server_id" in log.columns else log.withColumn("server_id", F.lit(server_id))
    source = keyed.where("planid is not null and plan_json is not null").select(*keys, "plan_json", *(change[:1] if change else []))
    fields = [f for f in StructType.fromDDL(schema.NODE + (", " + schema.INPUTS if finished else "")).fields if columns is None or f.name in columns]
    out = StructType([source.schema[k] for k in keys] + fields)
    arrow = to_arrow_schema(out)
    names = out.names[len(keys) :]
    inputs = finished and not {f.split(" ")[0] for f in schema.INPUTS.split(", ")}.isdisjoint(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                held: list[list] = [[] for _ in names]
                per = []
                values = part.column(len(keys) + 1).to_pylist() if change else [None] * part.num_rows
                for text, value in zip(part.column(len(keys)).to_pylist(), values):
                    found = rows(text, columns)
                    if finished:
                        merged(found)
                    if inputs:
                        add_inputs(found)
                    if change:
                        change[1](found, value)
                    per.append(len(found))
                    for column, name in zip(held, names):
                        column += [r[name] for r in found]
                owner = pa.array([i for i, n in enumerate(per) for _ in range(n)], pa.int64())
                named = [part.column(i).take(owner).cast(arrow.field(i).type) for i in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*named, *(_array(c, arrow.field(len(keys) + i).type) for i, c in enumerate(held))], schema=arrow)

    return source.mapInArrow(run, out)


def _array(values: list, kind: pa.DataType) -> pa.Array:
    if pa.types.is_map(kind):
        values = [list(v.items()) for v in values]
    return pa.array(values, kind)


def children(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Of each parent the rows of its outer and inner child (plan and actual), by relationship and not by place.

    ``Outer`` is the outer child and any other non-subplan child the inner one; children of Append and the like are
    all members, and only their sums make sense.
    """
    real = nodes.where("parent_no is not null and coalesce(relationship, 'Outer') not in ('InitPlan', 'SubPlan')")
    outer = F.coalesce(F.col("relationship"), F.lit("Outer")) == "Outer"
    return real.groupBy(*keys, F.col("parent_no").alias("node_no")).agg(
        F.max(F.when(outer, F.col("plan_rows"))).alias("plan_outer"),
        F.max(F.when(outer, F.col("actual_rows"))).alias("actual_outer"),
        F.max(F.when(~outer, F.col("plan_rows"))).alias("plan_inner"),
        F.max(F.when(~outer, F.col("actual_rows"))).alias("actual_inner"),
        F.sum("plan_rows").alias("plan_members"),
        F.sum("actual_rows").alias("actual_members"),
    )
