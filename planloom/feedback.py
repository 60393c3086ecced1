"""Learnt parameters fed back: join methods as hints, estimates for broadcast choices, partitions for spilling sorts.

A recorded join is recognised by the sets of relations on its two sides, in either order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .functions.params import Item, parse
from .plans import schema
from .sources.capture import Settings

#: Hint for each recorded join method.
HINTS = {"Hash Join": "shuffle_hash", "Merge Join": "merge", "Nested Loop": "shuffle_replicate_nl"}
MOST_SORT_KB, GROWTH = 204_800, 8


@dataclass(frozen=True)
class Advice:
    method: str | None
    rows: float | None
    flipped: bool = False


class Feedback:
    """The parameters of one query."""

    def __init__(self, params: str | list[Item], sort_space_used: int | None = None, settings: Settings | None = None):
        self.items = parse(params) if isinstance(params, str) else params
        self.sort_space_used = sort_space_used
        self.settings = settings or Settings()

    def scan_rows(self, relation: str, estimated: float) -> float:
        """The corrected estimate of a base relation; the estimate itself with ``enable_adjust_rel_rows`` off."""
        if not self.settings.enable_adjust_rel_rows:
            return estimated
        for item in self.items:
            if item.node_type not in schema.JOINS and item.relations == (relation,):
                return max(1.0, round(estimated * item.coef[0] + (item.intercept or (0.0,))[0]))
        return estimated

    def join(self, outer: set[str], inner: set[str], outer_rows: float, inner_rows: float) -> Advice:
        """Method and corrected rows of the join of two sets of relations; coefficients follow the sides.  No rows with
        ``enable_adjust_joinrel_rows`` off."""
        for item in self.items:
            if item.node_type not in schema.JOINS:
                continue
            sides = (set(item.outer), set(item.inner))
            flipped = sides == (inner, outer) and sides != (outer, inner)
            if not flipped and sides != (outer, inner):
                continue
            o, v = (inner_rows, outer_rows) if flipped else (outer_rows, inner_rows)
            intercept = (item.intercept or (0.0,))[0]
            if item.node_type == "Nested Loop":
                rows = item.coef[0] * o * v + intercept
            elif any(item.coef):
                rows = item.coef[0] * o + item.coef[1] * v + intercept
            else:
                rows = (item.coef2 or (0.0,))[0] * o * v + intercept
            return Advice(item.node_type, max(1.0, round(rows)) if self.settings.enable_adjust_joinrel_rows else None, flipped)
        return Advice(None, None)

    def hinted_join(self, left: DataFrame, right: DataFrame, on, how: str, outer: set[str], inner: set[str], inner_rows: float | None = None, row_bytes: int | None = None) -> DataFrame:
        """The join with the recorded method; a hash join whose build side is small by the corrected estimate (rows
        times width within the session's broadcast threshold) is broadcast.  Without ``row_bytes`` the width follows
        from the right side's types, as the optimizer reckons it."""
        row_bytes = row_bytes or 8 + right._jdf.schema().defaultSize()
        advice = self.join(outer, inner, 1.0, inner_rows or 1.0)
        if advice.method is None:
            return left.join(right, on, how)
        hint = HINTS[advice.method]
        limit = left.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
        if advice.method == "Hash Join" and inner_rows is not None and inner_rows * row_bytes <= _bytes(limit):
            hint = "broadcast"
        if hint == "shuffle_replicate_nl" and how != "inner":
            hint = "broadcast" if inner_rows is not None and inner_rows * row_bytes <= _bytes(limit) else None
        return left.join(right.hint(hint) if hint else right, on, how)

    def sort_memory_kb(self, work_mem_kb: int) -> int:
        """Memory that would have kept the recorded sort from the disk."""
        if not self.sort_space_used:
            return work_mem_kb
        return min(GROWTH * (self.sort_space_used + work_mem_kb), MOST_SORT_KB)

    def shuffle_partitions(self, current: int, target_kb: int = 65_536) -> int:
        """Partitions for which each part of the recorded spill fits the target."""
        if not self.sort_space_used:
            return current
        return max(current, math.ceil(self.sort_space_used / target_kb) * current)


def _bytes(text: str) -> int:
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    low = text.strip().lower().rstrip("b")
    return int(float(low[:-1]) * units[low[-1]]) if low and low[-1] in units else int(low)


def load(reg: DataFrame, queryid: str) -> Feedback | None:
    row = reg.where(reg.queryid == queryid).select("params", "sort_space_used").first()
    return Feedback(row.params, row.sort_space_used) if row else None


class tuned_session:  # noqa: N801
    """Within the block the session has the partitions that the feedback asks for."""

    def __init__(self, spark: SparkSession, feedback: Feedback | None):
        self.spark, self.feedback = spark, feedback

    def __enter__(self):
        self.before = self.spark.conf.get("spark.sql.shuffle.partitions")
        if self.feedback:
            self.spark.conf.set("spark.sql.shuffle.partitions", str(self.feedback.shuffle_partitions(int(self.before))))
        return self.spark

    def __exit__(self, *_):
        self.spark.conf.set("spark.sql.shuffle.partitions", self.before)
