"""Compositions against their plain meaning, on hypothesis-made rows."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from planloom.operators import relational as rel
from planloom.sources.shared import checkpointer

ROWS = st.lists(st.tuples(st.integers(0, 3), st.one_of(st.none(), st.integers(0, 5))), min_size=1, max_size=15)
FAST = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@FAST
@given(ROWS, st.integers(1, 5))
def test_with_ties(spark, rows, n):
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rows)], "k int, v int, i int")
    got = sorted(r.i for r in rel.top_with_ties(df, n, ["v"]).collect())
    value = lambda r: (r[1] is None, r[1] or 0)
    last = sorted(map(value, rows))[: n][-1]
    assert got == [i for i, r in enumerate(rows) if value(r) <= last]


@FAST
@given(ROWS)
def test_groups_frame(spark, rows):
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rows)], "k int, v int, i int")
    got = {r.i: r.n for r in rel.groups_frame(df, ["k"], "v", 1, 0, {"n": lambda: F.count("*")}).collect()}
    for i, (k, v) in enumerate(rows):
        groups = sorted({-1 if b is None else b for a, b in rows if a == k})
        at = groups.index(-1 if v is None else v)
        near = groups[max(0, at - 1) : at + 1]
        assert got[i] == sum(a == k and (-1 if b is None else b) in near for a, b in rows)


def test_recursion_ends_and_is_distinct(spark):
    edges = {0: [1, 2], 1: [0], 2: [3, 3], 3: [1]}
    moves = spark.createDataFrame([(a, b) for a, bs in edges.items() for b in bs], "a int, b int")
    step = lambda new: new.join(moves, new.k == moves.a).select(F.col("b").alias("k"))
    got = rel.recursive_union(spark.createDataFrame([(0,), (0,)], "k int"), step, checkpointer(spark))
    assert sorted(r.k for r in got.collect()) == [0, 1, 2, 3]
