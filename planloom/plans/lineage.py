"""Relations, schemas and aliases below a node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flatten import root_of


def nested(document: str | dict, key: str = "Relation Name"):
    """Bottom-up: a node's own value, else that of its only child, else [outer, inner]."""
    node = document if isinstance(document, dict) and "Node Type" in document else root_of(document)
    if key in node:
        return node[key]
    found = [v for v in (nested(k, key) for k in node.get("Plans", []) if "Node Type" in k and k.get("Parent Relationship") not in ("InitPlan", "SubPlan")) if v is not None]
    return None if not found else found[0] if len(found) == 1 else found[:2]


def flat(value) -> list[str]:
    """A nested lineage as one list."""
    if value is None:
        return []
    return [value] if isinstance(value, str) else [x for v in value for x in flat(v)]


def relation_sets(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """relations, outer_rels and inner_rels of each node as sorted arrays."""
    kids = nodes.where("parent_no is not null and coalesce(relationship, 'Outer') not in ('InitPlan', 'SubPlan')")
    outer = F.coalesce(F.col("relationship"), F.lit("Outer")) == "Outer"
    sides = kids.groupBy(*keys, F.col("parent_no").alias("node_no")).agg(
        F.max(F.when(outer, F.col("relations"))).alias("outer_rels"),
        F.max(F.when(~outer, F.col("relations"))).alias("inner_rels"),
    )
    return nodes.select(*keys, "node_no", "node_type", "relations").join(sides, [*keys, "node_no"], "left")
