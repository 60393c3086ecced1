"""The text form of pushed parameters: encoding from parameter rows, and parsing.

    {"Node Type":("schema.rel", ...):("outer", ...):("inner", ...):[coef, ...]:[coef2]:[intercept]:"True"};...

Items are written for leaves with a relation and for the three joins, the last node first.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import schema


@dataclass(frozen=True)
class Item:
    node_type: str
    relations: tuple[str, ...]
    outer: tuple[str, ...]
    inner: tuple[str, ...]
    coef: tuple[float, ...]
    coef2: tuple[float, ...]
    intercept: tuple[float, ...]
    merge: bool


def _names(rels: Column) -> Column:
    quoted = F.transform(F.coalesce(rels, F.array().cast("array<string>")), lambda r: F.concat(F.lit('"'), r, F.lit('"')))
    return F.concat(F.lit("("), F.array_join(quoted, ", "), F.lit(")"))


def _numbers(*values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.array(*(v.cast("string") for v in values)), ", "), F.lit("]"))


def encode(parameters: DataFrame) -> DataFrame:
    """queryid, planid, sort_space_used, params of parameter rows (with relations, outer_rels, inner_rels, last_no)."""
    join = F.col("node_type").isin(schema.JOINS)
    leaf = (F.col("last_no") == F.col("node_no")) & (F.size("relations") > 0)
    coefs = F.when(F.col("node_type").isin(schema.SUM_JOINS), _numbers(F.col("coef_outer"), F.col("coef_inner"))).otherwise(_numbers(F.col("coef_outer")))
    item = F.concat(
        F.lit('{"'), F.col("node_type"), F.lit('":'), _names(F.col("relations")), F.lit(":"), _names(F.col("outer_rels")), F.lit(":"), _names(F.col("inner_rels")), F.lit(":"),
        coefs, F.lit(":"), F.when(F.col("node_type").isin(schema.SUM_JOINS), _numbers(F.col("coef2"))).otherwise(F.lit("[]")), F.lit(":"), _numbers(F.col("intercept")), F.lit(":"),
        F.when(F.col("merge_flag"), F.lit('"True"')).otherwise(F.lit('"False"')), F.lit("}"),
    )
    kept = parameters.where(join | leaf).withColumn("__item", F.struct((-F.col("node_no")).alias("o"), item.alias("i")))
    return kept.groupBy("queryid", "planid").agg(F.max("sort_space_used").cast("int").alias("sort_space_used"), F.array_join(F.transform(F.array_sort(F.collect_list("__item")), lambda x: x["i"]), ";").alias("params"))


def latest_plan(log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The plan of each query's last log row."""
    return log.groupBy(*(keys or ["database", "queryid"])).agg(F.max_by("planid", "seqid").alias("planid"))


def push(parameters: DataFrame, log: DataFrame) -> DataFrame:
    """The ``reg`` table: for each database and query the parameters of its newest plan."""
    return latest_plan(log).join(encode(parameters), ["queryid", "planid"]).select("database", "queryid", "sort_space_used", "params")


_ITEM = re.compile(r'\{"([^"]*)":\(([^)]*)\):\(([^)]*)\):\(([^)]*)\):\[([^\]]*)\]:\[([^\]]*)\]:\[([^\]]*)\]:"(True|False)"\}$')


def parse(params: str) -> list[Item]:
    """The items of a parameter text; a ValueError names what doesn't fit the form."""
    out = []
    for text in filter(None, params.split(";")):
        m = _ITEM.match(text.strip())
        if not m:
            raise ValueError(f"not a parameter item: {text!r}")
        names = [tuple(re.findall(r'"([^"]*)"', m[k])) for k in (2, 3, 4)]
        numbers = [tuple(float(x) for x in m[k].split(",") if x.strip()) for k in (5, 6, 7)]
        out.append(Item(m[1], *names, *numbers, m[8] == "True"))
    return out
