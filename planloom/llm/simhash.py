"""SimHash near-duplicate detection over a Gray-order hierarchical index.

Fingerprints: a 64-bit majority vote over the XXH64 values of three-word shingles.  Two documents are linked when
their fingerprints differ in at most ``max_bits`` bits; classes are the connected components of the links.

The search.  Let the 64 bits be cut into ``b`` blocks.  Fingerprints at distance <= 3 agree on at least ``b - 3``
blocks, so for each choice of ``b - 3`` blocks (a *table*) the code is permuted to bring those blocks to the front
and replaced by its rank in the reflected Gray sequence.  A rank's prefix depends on the code's prefix alone:
sorting by rank makes all codes that agree on the leading blocks one contiguous run, and within a run neighbours
differ in few bits.  Each run becomes a tree: a leaf holds a few consecutive codes, a node keeps the bits that all
codes below it share (mask and pattern).  The run is joined with itself from the root; a pair of nodes adds to the
differences accumulated so far those in the bits that have newly become shared, and the pair is dropped with all
that is below it once the sum exceeds ``max_bits``.

Scale.  Only distinct fingerprints enter the search (exact copies collapse in a map-side aggregate).  A run emits a
spanning forest, never its pairs.  A run over ``run_limit`` codes is dealt into chunks, and each pair of chunks is a
task of its own, so no task holds more than two chunks.  The number of blocks follows the number of distinct codes
(4 blocks: 4 tables on 16 bits; 5: 10 tables on 25; 6: 20 tables on 31), which keeps runs short and the result the same.

Edge cases: null or blank text has fingerprint 0 and is linked like any other; fewer than three words form one
shingle; repeated rows give repeated result rows; a null doc_id keeps its row and never becomes a component id
unless a class has nothing else; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, narrow, scratch, text_slices, without_ids

SEED = 42
LEAF, FAN = 8, 8
RUN_LIMIT = 16_384
#: Rows of a run joined at a time and node pairs expanded at a time, in one task.
BATCH_ROWS, SLICE = 65_536, 16_384


def shingle_hashes(data: bytes, width: int = 3) -> np.ndarray:
    """XXH64 of each shingle of a text in UTF-8, repeats included; fewer words are one shingle, none have none."""
    words = data.lower().split()
    digest, n = xxhash.xxh64_intdigest, len(words) - width + 1
    if not words:
        return np.zeros(0, np.uint64)
    if n < 1:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(width))))
    return np.fromiter((digest(g, SEED) for g in grams), np.uint64, n)


def vote(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 without any."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 65_536):
        part = hashes[k : k + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(data: bytes, width: int = 3) -> int:
    """The SimHash of a text in UTF-8, unsigned; 0 without words."""
    return vote(shingle_hashes(data, width))


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, 1):
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        codes = np.array([fingerprint(t) if t else 0 for t in texts], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (long: the 64 bits, signed) for each row."""
    return narrow(docs).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


# --- the index -------------------------------------------------------------------------------------------------


def layouts(blocks: int, max_bits: int) -> list[tuple[list[tuple[int, int]], int]]:
    """For each table the (shift, width) fields of the permuted code, first to last, and the width of its leading part."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    fields = [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(blocks)]
    out = []
    for lead in combinations(range(blocks), blocks - max_bits):
        order = [*lead, *(i for i in range(blocks) if i not in lead)]
        out.append(([fields[i] for i in order], sum(fields[i][1] for i in lead)))
    return out


def blocks_for(n_codes: int, max_bits: int) -> int:
    """Blocks for which a run of random codes stays near a thousand codes; any number gives the same links."""
    blocks = max_bits + 1
    while n_codes > 1024 << min(w for _, w in layouts(blocks, max_bits)) and blocks < max_bits + 3:
        blocks += 1
    return blocks


def gray_rank(codes: np.ndarray, fields: list[tuple[int, int]]) -> np.ndarray:
    """Rank of the permuted codes in the reflected Gray sequence: the inverse of the Gray code."""
    rank, at = np.zeros(len(codes), dtype=np.uint64), 64
    for shift, width in fields:
        at -= width
        rank |= (codes >> np.uint64(shift) & np.uint64((1 << width) - 1)) << np.uint64(at)
    for step in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(step)
    return rank


def _ranker(tables: list[tuple[list[tuple[int, int]], int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(0).to_numpy().view(np.uint64)
            for t, (fields, lead) in enumerate(tables):
                rank = gray_rank(codes, fields)
                # the top bit is flipped so that signed order is the order of the ranks
                columns = [np.full(len(codes), t, np.int32), (rank >> np.uint64(64 - lead)).view(np.int64), (rank ^ np.uint64(1 << 63)).view(np.int64), codes.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["t", "run", "rank", "fp"])

    return run


def _expand(a, b, starts, ends):
    """All pairs of children of node pairs; of a node with itself each pair once."""
    na, nb = ends[a] - starts[a], ends[b] - starts[b]
    total = na * nb
    parent = np.repeat(np.arange(len(a)), total)
    within = np.arange(len(parent)) - np.repeat(np.cumsum(total) - total, total)
    x = starts[a][parent] + within // nb[parent]
    y = starts[b][parent] + within % nb[parent]
    return x, y, parent


class _Forest:
    """Trees over the runs of one batch, level by level; level 0 are the leaves."""

    def __init__(self, codes: np.ndarray, run_starts: np.ndarray):
        self.codes, self.levels = codes, []
        starts, low_and, low_or, fan, n = run_starts, codes, codes, LEAF, len(codes)
        while True:
            ends = np.append(starts[1:], n)
            per = -(-(ends - starts) // fan)
            run = np.repeat(np.arange(len(starts)), per)
            nth = np.arange(len(run)) - np.repeat(np.cumsum(per) - per, per)
            first = starts[run] + nth * fan
            last = np.minimum(first + fan, ends[run])
            low_and, low_or = np.bitwise_and.reduceat(low_and, first), np.bitwise_or.reduceat(low_or, first)
            mask = ~(low_and ^ low_or)
            self.levels.append((first, last, mask, low_and & mask))
            if len(run) == len(starts):
                return
            starts, fan, n = np.cumsum(per) - per, FAN, len(run)

    def links(self, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        roots = np.arange(len(self.levels[-1][0]))
        none = np.zeros(len(roots), dtype=np.uint64)
        yield from self._down(len(self.levels) - 1, roots, roots, none, np.zeros(len(roots), dtype=np.int64), max_bits)

    def _down(self, level, a, b, common, sums, max_bits):
        first, last, mask, pattern = self.levels[level]
        for k in range(0, len(a), SLICE):
            x, y = a[k : k + SLICE], b[k : k + SLICE]
            now = mask[x] & mask[y]
            total = sums[k : k + SLICE] + np.bitwise_count((pattern[x] ^ pattern[y]) & now & ~common[k : k + SLICE])
            near = total <= max_bits
            x, y, now, total = x[near], y[near], now[near], total[near]
            same = x == y
            i, j, parent = _expand(x, y, first, last)
            if level:
                once = ~same[parent] | (i <= j)
                yield from self._down(level - 1, i[once], j[once], now[parent][once], total[parent][once], max_bits)
            else:
                once = ~same[parent] | (i < j)
                i, j = i[once], j[once]
                near = np.bitwise_count(self.codes[i] ^ self.codes[j]) <= max_bits
                if near.any():
                    yield i[near], j[near]


def spanning_links(codes: np.ndarray, run_starts: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, root of i) that connect what the links within each run connect."""
    label = np.arange(len(codes))
    for i, j in _Forest(codes, run_starts).links(max_bits):
        while True:
            li, lj = label[i], label[j]
            apart = li != lj
            if not apart.any():
                break
            i, j, li, lj = i[apart], j[apart], li[apart], lj[apart]
            np.minimum.at(label, np.maximum(li, lj), np.minimum(li, lj))
            while (label[label] != label).any():
                label = label[label]
    moved = np.flatnonzero(label != np.arange(len(codes)))
    return moved, label[moved]


def _joiner(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush(keys, codes):
            starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
            # runs of one code have no partner
            sizes = np.diff(np.append(starts, len(codes)))
            keep = np.repeat(sizes > 1, sizes)
            codes, sizes = codes[keep], sizes[sizes > 1]
            if len(codes):
                i, root = spanning_links(codes, np.cumsum(sizes) - sizes, max_bits)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(codes[i].view(np.int64)), pa.array(codes[root].view(np.int64))], names=["u", "v"])

        rows = 0
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)], axis=1)
            held.append((keys, batch.column(4).to_numpy().view(np.uint64)))
            rows += len(keys)
            if rows < BATCH_ROWS:
                continue
            keys, codes = (np.concatenate(x) for x in zip(*held))
            inner = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1))
            if len(inner):  # the last run may go on in the next batch
                cut = inner[-1] + 1
                yield from flush(keys[:cut], codes[:cut])
                keys, codes = keys[cut:], codes[cut:]
            held, rows = [(keys, codes)], len(codes)
        if rows:
            yield from flush(*(np.concatenate(x) for x in zip(*held)))

    return run


def code_links(codes: DataFrame, max_bits: int = 3, run_limit: int = RUN_LIMIT, blocks: int | None = None) -> DataFrame:
    """Edges u, v between distinct codes (column fp) whose components are those of all pairs within ``max_bits``."""
    blocks = blocks or blocks_for(codes.count(), max_bits)
    tables = layouts(blocks, max_bits)
    rows = codes.select("fp").mapInArrow(_ranker(tables), "t int, run long, rank long, fp long")
    long_runs = rows.groupBy("t", "run").count().where(F.col("count") > run_limit).select("t", "run", F.ceil(F.col("count") / run_limit).cast("int").alias("chunks"))
    dealt = rows.join(long_runs, ["t", "run"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    # a chunk meets every chunk of its run once, itself included
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("t", "run", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "rank")
    keyed = dealt.repartition("t", "run", "i", "j").sortWithinPartitions("t", "run", "i", "j", "rank")
    return keyed.select("t", "run", "i", "j", "fp").mapInArrow(_joiner(max_bits), "u long, v long")


# --- components ------------------------------------------------------------------------------------------------


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root for each node of an edge table u, v: root is the smallest node of its component.

    Alternates the large-star and small-star steps (O(log^2 n) rounds); each round is two aggregates and two joins on
    the node, and is written to the shared folder.
    """
    edges = scratch(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        after = scratch(small, "edges")
        before_mark, mark = mark, _mark(after)
        drop_scratch(edges)
        edges = after
        if mark == before_mark:
            break
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def near_duplicates(docs: DataFrame, max_bits: int = 3, run_limit: int = RUN_LIMIT, blocks: int | None = None) -> DataFrame:
    """doc_id, fp, component_id for each row of ``docs``: the class of each document under the links."""
    marked = scratch(fingerprints(docs), "fingerprints")
    codes = scratch(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "codes")
    nodes = components(code_links(codes.select("fp"), max_bits, run_limit, blocks))
    linked = nodes.withColumnRenamed("node", "fp").join(codes, "fp")
    smallest = linked.groupBy("root").agg(F.min("least").alias("first"))
    linked = linked.select("fp", "root").join(smallest, "root").select("fp", "first")
    named = codes.join(linked, "fp", "left").select("fp", F.coalesce("first", "least").alias("component_id"))
    # written, so that the last join has two exchanges of its own and the engine can split a fingerprint that many share
    return marked.join(scratch(named, "classes"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, max_bits: int = 3) -> DataFrame:
    """The rows of ``docs`` without all but the smallest doc_id of each near-duplicate class; columns unchanged.

    Rows that repeat the kept doc_id all stay, as do rows without doc_id.
    """
    classes = near_duplicates(docs, max_bits)
    return without_ids(docs, classes.where("doc_id <> component_id").select("doc_id"))


def hex_code(fp: str = "fp"):
    """16 lowercase hex digits of a signed 64-bit code."""
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
