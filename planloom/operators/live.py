"""Progress of running queries: from snapshots of leaders and workers to one number for each query.

Snapshot rows name the query that they belong to; workers that don't (queryid 0) are told by the hash of the query's
text.  Rows of a query's workers are added to its leader's, scaled up where workers have left, and then one of three
modes holds for each query:

* ``pushed``: its learnt parameters were pushed to the planner, whose estimates have them already: rules, nothing replaced;
* ``regression``: parameters are known for the plan: its estimates are replaced by what they say;
* ``rules``: neither.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions.scalar import query_hash
from ..plans import flatten
from . import progress, replace


def named(snapshot: DataFrame, keys: list[str]) -> DataFrame:
    """Snapshot rows with their queryid, that of a row with the same text where their own is missing or 0; rows for
    which there is none are left out."""
    rows = snapshot.withColumn("__hash", query_hash(F.col("query")))
    none = F.coalesce("queryid", F.lit("0")) == "0"
    known = rows.where(~none).groupBy(*keys, "__hash").agg(F.max("queryid").alias("__known"))
    # rows with a name of their own don't cross the network for one
    found = rows.where(none).join(known, [*keys, "__hash"]).withColumn("queryid", F.col("__known"))
    return rows.where(~none).drop("__hash").unionByName(found.drop("__hash", "__known"))


def _joined(leaders: list[dict], others: list[dict], running: int) -> list[dict]:
    """A query's rows with its workers' in: ``workers.merge_live`` and ``workers.extrapolate`` on lists."""
    size = max(r["node_no"] for r in leaders)
    extra: dict[int, float] = {}
    for rows in others:
        most = max(r["node_no"] for r in rows)
        for r in rows:
            if r["actual_rows"] is not None:
                extra[most - r["node_no"]] = extra.get(most - r["node_no"], 0.0) + r["actual_rows"]
    for r in leaders:
        if not r["merge_flag"]:
            continue
        more = extra.get(size - r["node_no"])
        if more is not None:
            r["plan_rows"] = None if r["plan_rows"] is None else r["plan_rows"] * r["norm_plan"]
            r["actual_rows"] = None if r["actual_rows"] is None else r["actual_rows"] + more
        if running < r["norm"] and r["actual_rows"] is not None:
            r["actual_rows"] = r["actual_rows"] * r["norm"] / running
    return leaders


def _told(seen: list[tuple]) -> list[tuple[str, float]]:
    """mode, progress of a query from its snapshot rows (leader, pid, planid, plan_json, parameters, pushed)."""
    leaders: list[dict] = []
    parts: list[tuple[str, str | None, list[dict]]] = []
    others: dict[int, list[dict]] = {}
    for leader, pid, _, text, learnt, pushed in sorted(seen, key=lambda r: tuple((v is None, v) for v in r[1:4])) if len(seen) > 1 else seen:
        if leader:
            rows = flatten.rows(text, flatten.PROGRESS)
            parts.append(("pushed" if pushed else "rules" if learnt is None else "regression", learnt, rows))
            leaders += rows
        elif pid is not None:
            others.setdefault(pid, []).extend(flatten.rows(text, ()))
    if not leaders:
        return []
    _joined(leaders, list(others.values()), len(others) + 1)
    modes: dict[str, list[dict]] = {}
    for mode, learnt, rows in parts:
        if mode == "regression":
            replace.replaced(rows, learnt)
        modes.setdefault(mode, []).extend(rows)
    return [(mode, progress.progress_of(rows, mode == "regression")) for mode, rows in modes.items()]


def drive(snapshot: DataFrame, keys: list[str] | None = None, pushed: DataFrame | None = None, parameters: DataFrame | None = None) -> DataFrame:
    """keys, queryid, mode, progress of each query in a table of snapshots (``schema.SNAPSHOT``).

    ``keys`` tell the snapshots of different moments apart; ``pushed`` is the ``reg`` table, ``parameters`` that of
    ``regression.parameters``.  The documents of a query and moment meet once, sorted, and all that follows is done on
    their rows in one walk; what a task holds is one query's documents beside an Arrow batch.
    """
    groups = [*(keys or []), "queryid"]
    rows = named(snapshot, keys or []).withColumn("__leader", F.col("worker_type") == "leader").where("plan_json is not null and __leader is not null and (planid is not null or not __leader)")
    none = {"__parameters": F.lit(None).cast("string"), "__pushed": F.lit(None).cast("boolean")}
    if parameters is not None:
        rows = rows.join(replace.parameter_texts(parameters), ["queryid", "planid"], "left")
        del none["__parameters"]
    if pushed is not None:
        rows = rows.join(pushed.where("params <> ''").select("queryid").distinct().withColumn("__pushed", F.lit(True)), "queryid", "left")
        del none["__pushed"]
    own = ["__leader", F.col("pid").cast("long").alias("pid"), "planid", "plan_json", "__parameters", "__pushed"]
    rows = rows.withColumns(none).select(*groups, *own).repartition(*groups).sortWithinPartitions(*groups)
    out = StructType([*(rows.schema[k] for k in groups), StructField("mode", StringType()), StructField("progress", DoubleType())])
    types = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name: tuple | None = None
        seen: list[tuple] = []
        for batch in batches:
            done: list[tuple] = []
            columns = [c.to_pylist() for c in batch.columns]
            for key, row in zip(zip(*columns[: len(groups)]), zip(*columns[len(groups) :])):
                if key != name:
                    done += [(*name, *told) for told in _told(seen)] if seen else []
                    name, seen = key, []
                seen.append(row)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), types)], schema=types)
        done = [(*name, *told) for told in _told(seen)] if seen else []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), types)], schema=types)

    return rows.mapInArrow(run, out)
