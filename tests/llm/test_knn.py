import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from planloom.llm import knn, oracles


def plain(rows, k, every=100):
    """Every row but those with the query's vec_id is a candidate; rows that repeat a query are asked together."""
    vectors = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i in sorted({i for i, _ in vectors if i % every == 0}):
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for own, q in vectors if own == i for j, v in vectors if j != i)
        out += [(i, r + 1, j, max(-(2**63), min(2**63 - 1, -s))) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def corpus(n=900, dim=6, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [rng.gauss(rng.choice([0, 1, -2]), 0.3) for _ in range(dim)]
        rows.append((i - 100, v if i % 9 else [0.25] * dim))  # many equal vectors
    rows += [(5000, None), (5100, [0.1, None, 0.2]), (5200, [float("nan")] * dim), (5300, [float("inf")] * dim), (5400, [0.5, 0.5]), (5500, []), (None, [1.0] * dim), (200, [-9.0] * dim), (201, [9.0] * dim)]
    return rows


SCHEMA = "vec_id long, embedding array<float>, rank int"


@pytest.mark.parametrize("options", [{}, {"pivots": 40, "group": 2, "slice_rows": 100}, {"pivots": 3, "group": 1, "slice_rows": 50}, {"k": 3}])
def test_matches_brute_force(spark, options):
    rows = corpus()
    table = spark.createDataFrame([(i, v, 7) for i, v in rows], SCHEMA)
    got = sorted(tuple(r) for r in knn.nearest(table, **options).collect())
    assert got == plain(rows, options.get("k", 10))


def test_bounds_leave_vectors_out(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8)) * 10
    near = {j: [(0.1, 20 * j + i) for i in range(11)] for j in range(12)}
    between = knn._distances(centres, centres)
    ranges = knn.windows([0], between, {0: 0.5}, near, 10)
    needless = (ranges[:, 0] > 1.0).sum()
    assert needless >= 8  # far cells are needed only for vectors far from their pivots


def test_large_values_and_few_rows(spark):
    rows = [(0, [3e18, 1.0]), (1, [2e18, -1.0]), (2, [1e10, 7.0]), (100, [-2.0, 5.0])]
    table = spark.createDataFrame([(i, v, 7) for i, v in rows], SCHEMA)
    assert sorted(tuple(r) for r in knn.nearest(table).collect()) == plain(rows, 10)


REPEATS = [
    [(100, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.5, 0.0])],
    [(i % 7 * 50, [float(i % 3), float(i % 5), -0.5]) for i in range(140)],
    [(i, [float(i % 2), 0.25]) for i in [0, 100, 3, 4, 4] * 40],
]


@pytest.mark.parametrize("rows", REPEATS)
@pytest.mark.parametrize("options", [{}, {"pivots": 4, "group": 1, "slice_rows": 10}])
def test_repeated_rows(spark, rows, options):
    got = sorted(tuple(r) for r in knn.nearest(spark.createDataFrame([(i, v, 7) for i, v in rows], SCHEMA), **options).collect())
    assert got == plain(rows, 10)
    embeddings = pd.DataFrame(rows, columns=["vec_id", "embedding"])  # noqa: F841 (DuckDB finds it by name)
    by_sql = duckdb.connect().execute(oracles.ORACLES["op5_voronoi_knn"]).fetchall()
    assert got == sorted((q, r, v, s) for q, r, v, s in by_sql)


def test_own_rows_are_no_candidates_for_the_bound(spark):
    rng = random.Random(1)
    rows = [(100, [rng.gauss(5, 0.01), 5.0]) for _ in range(60)] + [(1 + i, [rng.gauss(0, 1), rng.gauss(0, 1)]) for i in range(90)]
    table = spark.createDataFrame([(i, v, 7) for i, v in rows], SCHEMA)
    assert sorted(tuple(r) for r in knn.nearest(table, pivots=8, group=1).collect()) == plain(rows, 10)


def test_scores_beyond_64_bits_are_ranked_by_all_their_bits(spark):
    rows = [(0, [1e30, 1e30]), *((i, [1e10 * i, -1e9]) for i in range(1, 9)), *((i, [-1e10 * i, 1.0]) for i in range(11, 15))]
    table = spark.createDataFrame([(i, v, 7) for i, v in rows], SCHEMA)
    assert sorted(tuple(r) for r in knn.nearest(table, slice_rows=3).collect()) == plain(rows, 10)


def test_empty_tables(spark):
    assert knn.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert knn.nearest(spark.createDataFrame([(1, [0.5], 1), (2, [0.5], 1)], SCHEMA)).count() == 0
