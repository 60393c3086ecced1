"""Exact top-k by inner product: a Voronoi nearest-neighbour join.

Every component x becomes floor(1024 x).  Inner products turn into distances by one more coordinate: data vectors get
``sqrt(M - |v|^2)`` (M: the largest squared norm), queries get 0, and then ``|q - v|^2 = |q|^2 + M - 2 q.v``.

Rows that agree in vec_id and vector are one row with their number, which never needs to pass k.

1. Pivots: the data vectors with the smallest seeded hashes of vec_id, about sqrt(n) / 4 and at most ``MAX_PIVOTS``.
2. Every vector goes to the cell of its nearest pivot and keeps the distance to it.
3. Summaries for each cell: count, and the k + 1 smallest distances of different vec_ids (bounded by pivots times k + 1).
4. Query cells are put together, neighbours first, into groups of about ``GROUP`` queries (larger ones once there
   would be more than ``MAX_GROUPS``).  From the summaries follows, for each member cell, a bound that the k-th best
   distance of its queries can't exceed; by the triangle inequality a data vector of cell j is needed only if its
   distance to pivot j lies between ``d(i, j) - U(i) - bound(i)`` and ``d(i, j) + U(i) + bound(i)`` for some member i.
5. A data vector is sent to the groups that need it, in each to one of as many slices as keep a slice near ``SLICE``
   vectors or ``SLICE_BYTES``; a group's queries go to all of its slices.  A slice is solved by blocked matrix products with exact ties,
   and the slices' winners are merged.  A cell with a third of all vectors is thus dealt over many tasks.

Scores are exact while sums stay below 2^53, and computed in Python integers beyond that.  A score outside 64 bits is
ranked by all its bits, which go along as a sortable binary, and returned as the nearest 64-bit value.

Edge cases: null vectors and vectors with null or non-finite components take no part, nor do rows without vec_id;
shorter vectors count as padded with zeros; a query's candidates are all rows with another vec_id, each as often as it
occurs; rows that repeat a query's vec_id are asked together, and a candidate counts once for each of them; with k or
fewer candidates all are returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, slices

SCALE, K, EVERY = 1024.0, 10, 100
MAX_PIVOTS, GROUP, MAX_GROUPS, SLICE, SEED = 1024, 1024, 4096, 65_536, 5
#: Doubles of a slice's vectors, at most.
SLICE_BYTES = 64 << 20
#: Bytes of the binary form of scores beyond 64 bits: products and sums of doubles stay far below.
WIDE = 300


def scaled(table: DataFrame, k: int = K) -> DataFrame:
    """vec_id, vec (array of whole doubles), n (how often the row occurs, k at most) of the rows that take part."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    # x - x is 0 for every finite x and NaN otherwise; null stays null
    good = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: F.coalesce(x - x == 0, F.lit(False)))
    vec = F.transform("v", _floor)
    return rows.where(good).select("vec_id", vec.alias("vec")).groupBy("vec_id", "vec").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))


def _floor(x):
    """floor(1024 x) as a double, for values beyond 64 bits too."""
    y = x * SCALE
    return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)


def _matrix(column, dim: int) -> np.ndarray:
    """Rows of an Arrow list column, padded with zeros."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    length = np.diff(offsets)
    out = np.zeros((len(column), dim))
    row = np.repeat(np.arange(len(column)), length)
    out[row, np.arange(offsets[0], offsets[-1]) - offsets[:-1][row]] = flat[offsets[0] : offsets[-1]]
    return out


def _lift(m: np.ndarray, top: float, query: bool) -> np.ndarray:
    """The vectors with their further coordinate."""
    extra = np.zeros(len(m)) if query else np.sqrt(np.maximum(0.0, top - (m * m).sum(axis=1)))
    return np.hstack([m, extra[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T))


def _placer(pivots: np.ndarray, dim: int, top: float, every: int):
    """vec_id, vec, n to these, cell, dist and, for queries, the same in the queries' space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max(1, SLICE_BYTES // (8 * dim * 4))):
            m = _matrix(batch.column(1), dim)
            ids = batch.column(0).to_numpy()
            for query in (False, True):
                rows = np.flatnonzero(ids % every == 0) if query else np.arange(len(ids))
                if len(rows):
                    d = _distances(_lift(m[rows], top, query), pivots)
                    cell = d.argmin(axis=1)
                    own = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.full(len(rows), query)), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(rows)), cell])], names=["vec_id", "vec", "n", "query", "cell", "dist"])

    return run


def grouping(pivot_distances: np.ndarray, counts: dict[int, int], size: float) -> list[list[int]]:
    """Cells of queries in groups of about ``size`` queries: from a first cell on, its nearest free ones."""
    free, out = set(counts), []
    while free:
        cell = max(free, key=lambda c: (counts[c], -c))
        group, n = [], 0
        for c in sorted(free, key=lambda c: (pivot_distances[cell, c], c)):
            if group and n + counts[c] > size:
                break
            group.append(c)
            n += counts[c]
        free -= set(group)
        out.append(group)
    return out


def windows(group: list[int], between: np.ndarray, reach: dict[int, float], nearest: dict[int, list[tuple[float, int]]], k: int) -> np.ndarray:
    """``nearest``: distance and vec_id of the summaries.  For each data cell the range of distances to its pivot within which a group needs the vectors: (cells, 2)."""
    cells = len(between)
    low, high = np.full(cells, np.inf), np.full(cells, -np.inf)
    owner = np.array([j for j, ds in nearest.items() for _ in ds], np.int64)
    dist = np.array([d for ds in nearest.values() for d, _ in ds])
    ids = np.array([v for ds in nearest.values() for _, v in ds], np.int64)
    for i in group:
        at_most = reach[i] + between[i, owner] + dist
        order = np.argsort(at_most, kind="stable")
        # one vec_id more than k: the query's own may be among them
        other = order[np.sort(np.unique(ids[order], return_index=True)[1])]
        bound = at_most[other[k]] if len(other) > k else np.inf
        slack = 1e-6 * (1 + abs(between[i]) + reach[i] + (0 if math.isinf(bound) else bound))
        low = np.minimum(low, between[i] - reach[i] - bound - slack)
        high = np.maximum(high, between[i] + reach[i] + bound + slack)
    return np.stack([low, high], axis=1)


def wide(score: int) -> bytes:
    """A binary that sorts like the score."""
    return (score + (1 << (8 * WIDE - 1))).to_bytes(WIDE, "big")


def top_k(queries: np.ndarray, q_ids: np.ndarray, data: np.ndarray, d_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Query row, data row, score (and its binary form, if it has more than 64 bits) of each query's k best: highest
    score, ties to the smaller vec_id.  Rows with the query's vec_id are no candidates."""
    order = np.argsort(d_ids, kind="stable")
    data, d_ids = data[order], d_ids[order]
    n, out, wides = len(d_ids), ([], [], []), []
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * data.shape[1]
    exact = most < 2.0**53
    packed = most < 2.0**44 and n < 1 << 17
    whole = None if exact else [[int(x) for x in v] for v in data]
    low, high = -(1 << 63), (1 << 63) - 1
    for a in range(0, len(queries), 64):
        part, own = queries[a : a + 64], q_ids[a : a + 64]
        first, last = np.searchsorted(d_ids, own, "left"), np.searchsorted(d_ids, own, "right")
        if exact:
            score = (part @ data.T).astype(np.int64)
        for r in range(len(part)):
            if exact:
                row = score[r]
            else:
                query = [int(x) for x in part[r]]
                row = np.array([sum(x * y for x, y in zip(query, v)) for v in whole] + [0], object)[:-1]
            if packed:  # score and place in one number: all differ, so a partial sort is exact
                key = row * (1 << 17) + np.arange(n - 1, -1, -1)
                key[first[r] : last[r]] = low + 1  # its negative is a 64-bit number too
                best = np.argpartition(-key, k - 1)[:k] if n > k else np.arange(n)
                best = best[np.argsort(-key[best])]
                best = best[key[best] > low + 1]
            else:
                best = np.lexsort((d_ids, -row))
                best = best[(best < first[r]) | (best >= last[r])][:k]
            out[0].append(np.full(len(best), a + r))
            out[1].append(order[best])
            found = row[best].tolist()
            wides += [None if low < s < high else wide(s) for s in found]
            out[2].append(np.array([max(low, min(high, s)) for s in found], np.int64))
    return *(np.concatenate([np.zeros(0, np.int64), *x]) for x in out), wides


SOLVED = "query_id long, vec_id long, score long, wide binary, n int"


def _solver(dim: int, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        q, d = (t.combine_chunks() for t in (left, right))
        if not q.num_rows or not d.num_rows:
            return pa.table({c: pa.array([], t) for c, t in zip(("query_id", "vec_id", "score", "wide", "n"), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32()))})
        column = lambda t: pa.concat_arrays(t["vec"].chunks) if isinstance(t["vec"], pa.ChunkedArray) else t["vec"]
        q_ids, d_ids = q["vec_id"].to_numpy(), d["vec_id"].to_numpy()
        row, at, score, wides = top_k(_matrix(column(q), dim), q_ids, _matrix(column(d), dim), d_ids, k)
        times = np.minimum(k, q["n"].to_numpy()[row].astype(np.int64) * d["n"].to_numpy()[at])
        return pa.table({"query_id": q_ids[row], "vec_id": d_ids[at], "score": score, "wide": pa.array(wides, pa.binary()), "n": times.astype(np.int32)})

    return run


def nearest(table: DataFrame, k: int = K, every: int = EVERY, pivots: int | None = None, group: int = GROUP, slice_rows: int = SLICE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose vec_id is divisible by ``every``."""
    spark = table.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    vectors = scratch(scaled(table, k), "vectors")
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    n, dim, top = vectors.agg(F.count("*"), F.max(F.size("vec")), F.max(norm)).first()
    if not n:
        return empty
    dim = max(dim, 1)
    wanted = pivots or max(16, min(MAX_PIVOTS, int(math.sqrt(n) / 4)))
    some = vectors.select("vec_id").distinct().orderBy(F.xxhash64(F.lit(SEED), "vec_id"), "vec_id").limit(wanted)
    chosen = sorted(vectors.join(F.broadcast(some), "vec_id").groupBy("vec_id").agg(F.min("vec").alias("vec")).collect())
    centres = np.zeros((len(chosen), dim))
    for c, r in zip(centres, chosen):
        c[: len(r.vec)] = r.vec
    centres = _lift(centres, top, False)
    placed = scratch(vectors.mapInArrow(_placer(centres, dim, top, every), "vec_id long, vec array<double>, n int, query boolean, cell int, dist double"), "placed")
    # summaries, bounded by the number of pivots
    order = Window.partitionBy("cell").orderBy("dist", "vec_id")
    near: dict[int, list[tuple[float, int]]] = {}
    for r in placed.where("not query").groupBy("cell", "vec_id").agg(F.min("dist").alias("dist")).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1).collect():
        near.setdefault(r.cell, []).append((r.dist, r.vec_id))
    reach, counts = {}, {}
    for r in placed.where("query").groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("reach")).collect():
        reach[r.cell], counts[r.cell] = r.reach, r.n
    if not counts:
        return empty
    between = _distances(centres, centres)
    np.fill_diagonal(between, 0.0)
    groups = grouping(between, counts, max(group, sum(counts.values()) / MAX_GROUPS))
    ranges = np.stack([windows(g, between, reach, near, k) for g in groups])
    group_of = {c: g for g, members in enumerate(groups) for c in members}

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, dist = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for g, r in enumerate(ranges):
                take = np.flatnonzero((dist >= r[cell, 0]) & (dist <= r[cell, 1]))
                if len(take):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(take), g, np.int32)), *(batch.column(c).take(pa.array(take)) for c in (0, 1, 4))], names=["g", "vec_id", "vec", "n"])

    sent = placed.where("not query").select("vec_id", "vec", "cell", "dist", "n").mapInArrow(needed, "g int, vec_id long, vec array<double>, n int")
    # vectors that a group needs, at most: whole cells
    sizes = {r.cell: r["count"] for r in placed.where("not query").groupBy("cell").count().collect()}
    slice_rows = max(1, min(slice_rows, SLICE_BYTES // (8 * dim)))
    shares = [max(1, math.ceil(sum(c for j, c in sizes.items() if r[j, 0] <= r[j, 1]) / slice_rows)) for r in ranges]
    # a group larger than its bound (one cell with very many queries) is dealt as well
    parts = [max(1, math.ceil(sum(counts[c] for c in members) / (2 * max(group, 1)))) for members in groups]
    by_group = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("g") + 1)
    hashed = F.xxhash64("vec_id", "vec")
    data = sent.withColumn("s", F.pmod(hashed, by_group(shares)).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), by_group(parts) - 1)))
    cells = F.element_at(F.array(*(F.lit(group_of.get(c, 0)) for c in range(len(centres)))), F.col("cell") + 1)
    asked = placed.where("query").select("vec_id", "vec", "n", cells.alias("g"))
    asked = asked.withColumn("p", F.pmod(hashed, by_group(parts)).cast("int")).withColumn("s", F.explode(F.sequence(F.lit(0), by_group(shares) - 1)))
    keys = ["g", "p", "s"]
    solved = asked.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(_solver(dim, k), SOLVED)
    solved = solved.withColumn("copy", F.explode(F.sequence(F.lit(1), "n")))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("wide").desc_nulls_last(), "vec_id")
    return solved.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
