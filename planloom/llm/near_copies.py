"""Near copies by five-word SimHash and exact Jaccard similarity: operator 1 as the near-dedup stage sets it.

A text's set holds the XXH64 values of its five-word shingles (ASCII lower case; fewer words form one shingle).  Two
texts are linked when their sets' Jaccard similarity is 0.8 or more; classes are the connected components of the links.

Fingerprints of the shingles are linked by the Gray-order index of ``simhash``, and each member of a class of
fingerprints is compared, set by set, with the class's first text.  A similarity of 0.8 is some 10 bits of 64 on
average and up to 18, a radius at which that index leaves out next to nothing; so the fingerprints find the closest
copies only, and the rest is found by a prefix filter over the same shingles, which misses no link.  In any one order
of all shingles, two linked sets of sizes m and n share one of their first m // 5 + 1 and n // 5 + 1 shingles, and the
first that they share stands so early in both that enough can follow (1 + the shorter rest must reach 4/9 of m + n).  The
order here is by hash, with shingles that a sample finds in many texts last, so that boilerplate seldom stands in a
prefix.  Of the pairs that meet so and aren't in one class by then, those go whose sizes, numbers of shared prefix
shingles or parities rule the similarity out, and the rest is compared set by set.  A set's parities are ``PARITY`` bits,
each flipped once for every shingle that falls to it: two sets differ in at least as many shingles as bits, and linked
ones in a ninth of m + n at most.

Scale.  Texts with equal sets are one node (64-bit digest of the set).  Prefixes alone are kept; whole sets are made
again from the texts, for the nodes to be compared.  Long buckets (shingles that many prefixes hold, in large classes of
near copies) first link their members to a few of their own, in rounds as long as that merges many classes; after that
only members of different classes make pairs,
so a large class costs about its size and not its square.  Shingles that a sample finds in very many texts are counted
apart, so that none of them is one task's window.  The order and the first links change the work alone, never the result.

Edge cases: null and blank texts have the empty set and are one class; rows that repeat stay or go together; a null
doc_id is never a component id unless a class has nothing else; 64-bit hashes may agree by chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, drop_scratch, give_back, narrow, scratch, shrink_heaps, temporary, text_slices, without_ids
from .simhash import code_links, components, shingle_hashes, vote

WIDTH, MAX_BITS = 5, 3
#: A shingle that HOT of the texts hold, of one in SAMPLE, comes last in the order; at most HOT_ROWS are sent to every
#: task.  One that FLOOD of them hold is counted apart.
SAMPLE, HOT, HOT_ROWS, FLOOD = 16, 4, 500_000, 1000
#: Bits of parity, a multiple of 64.
PARITY = 512
#: Sizes of two sets together beyond which prefixes are compared before sets.
LARGE = 2 * PARITY
#: Members of a bucket beyond which it is first linked to a few of its own.
LONG_BUCKET = 32
#: Rounds of links to a few of a long bucket's own after the first, at most, as long as the last round put a share of WORTH
#: of the classes into others.
ROUNDS, WORTH = 4, 0.1
#: Sets that a task remembers to write once.
SEEN = 200_000


def shingles(data: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingle hashes of a text in UTF-8; none without words."""
    return np.unique(shingle_hashes(data, width))


def parities(own: np.ndarray) -> np.ndarray:
    """The parity bits of a set's hashes, as longs."""
    bits = np.bincount((own >> np.uint64(20)).astype(np.int64) % PARITY, minlength=PARITY) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _key(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes())


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to key, shingles, once for each set that the task remembers."""
    seen: set[int] = set()
    for batch in text_slices(batches, 0, 500):
        keys, sets = [], []
        for text in batch.column(0).cast(pa.binary()).to_pylist():
            own = shingles(text)
            key = _key(own)
            if key in seen:
                continue
            if len(seen) < SEEN:
                seen.add(key)
            keys.append(key)
            sets.append(own.view(np.int64))
        yield pa.RecordBatch.from_arrays([_longs(keys), pa.array(sets, pa.list_(pa.int64()))], names=["key", "shingles"])


def _marker(hot: np.ndarray):
    """doc_id, hash of the text, text to the node's key, size, fingerprint and, once for each node that the task
    remembers, its prefix and parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in text_slices(batches, 2, 500):
            keys, sizes, codes, prefixes, bits = [], [], [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                every = shingle_hashes(text or b"", WIDTH)
                own = np.unique(every)
                key = _key(own)
                keys.append(key)
                sizes.append(len(own))
                codes.append(vote(every))
                if key in seen or not len(own):
                    prefixes.append(None)
                    bits.append(None)
                    continue
                if len(seen) < SEEN:
                    seen.add(key)
                late = hot[np.minimum(np.searchsorted(hot, own), len(hot) - 1)] == own if len(hot) else np.zeros(len(own), bool)
                size = len(own) // 5 + 1
                early = own[~late]
                bits.append(parities(own))
                prefixes.append((early[:size] if len(early) >= size else np.concatenate([early, own[late]])[:size]).view(np.int64))
            columns = [batch.column(0), batch.column(1), _longs(keys), pa.array(sizes, pa.int32()), _longs(codes), pa.array(prefixes, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "key", "n", "fp", "prefix", "parity"])
        del seen
        give_back()

    return run


def _frequent(texts: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Shingles that many sampled texts hold, ascending, and those that very many do."""
    sample = texts.where(F.pmod("text_hash", F.lit(SAMPLE)) == 0).select("text").mapInArrow(_sets, "key long, shingles array<long>").dropDuplicates(["key"])
    often = sample.select(F.explode("shingles").alias("hash")).groupBy("hash").count().where(F.col("count") >= HOT)
    rows = often.orderBy(F.desc("count"), "hash").limit(HOT_ROWS).collect()
    return np.sort(np.array([r.hash for r in rows], np.int64).view(np.uint64)), [r.hash for r in rows if r["count"] >= FLOOD]


def _similar(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """u, v of the pairs of keys whose sets are similar."""
    pairs = scratch(pairs, "pairs")
    keys = pairs.select(F.col("u").alias("key")).union(pairs.select("v")).distinct()
    wanted = scratch(nodes.join(keys, "key", "left_semi").select("text_hash").distinct(), "wanted")
    # few hashes go to every task, so that texts don't cross the network
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    held = scratch(texts.join(wanted, "text_hash", "left_semi").select("text").mapInArrow(_sets, "key long, shingles array<long>").dropDuplicates(["key"]), "held")
    both = pairs.join(held.toDF("u", "su"), "u").join(held.toDF("v", "sv"), "v")
    shared = F.size(F.array_intersect("su", "sv"))
    return both.where(9 * shared >= 4 * (F.size("su") + F.size("sv"))).select("u", "v")


def _fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """key, other, n, m: each node and the first one of its class of fingerprints."""
    codes = scratch(nodes.groupBy("fp").agg(F.min(F.struct("key", "n")).alias("least")), "codes")
    linked = components(code_links(codes.select("fp"), MAX_BITS))
    placed = codes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = placed.groupBy("root").agg(F.min("least").alias("first"))
    named = scratch(placed.join(first, "root").select("fp", "first"), "first-texts")
    return nodes.select("key", "n", "fp").join(named, "fp").select("key", F.col("first.key").alias("other"), "n", F.col("first.n").alias("m"))


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """u, v, nu, nv of the pairs of keys whose parities don't rule the similarity out: far less crosses the network than for sets."""
    pairs = scratch(pairs, "met")
    keys = pairs.select(F.col("u").alias("key")).union(pairs.select("v")).distinct()
    held = scratch(nodes.join(keys, "key", "left_semi").select("key", "n", "parity").dropDuplicates(["key"]), "parities")
    both = pairs.join(held.toDF("u", "nu", "pu"), "u").join(held.toDF("v", "nv", "pv"), "v")
    apart = " + ".join(f"bit_count(pu[{i}] ^ pv[{i}])" for i in range(PARITY // 64))
    return both.where(f"9 * ({apart}) <= nu + nv").select("u", "v", "nu", "nv")


def _close_prefixes(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """u, v of the pairs of keys whose whole prefixes share enough: beyond the prefixes no more than the longer rest can be
    shared.  A fifth of what the sets would take crosses the network."""
    keys = pairs.select(F.col("u").alias("key")).union(pairs.select("v")).distinct()
    held = scratch(nodes.join(keys, "key", "left_semi").select("key", "prefix").dropDuplicates(["key"]), "prefixes")
    both = pairs.join(held.toDF("u", "pu"), "u").join(held.toDF("v", "pv"), "v")
    shared = F.size(F.array_intersect("pu", "pv")) + F.greatest(F.col("nu") - F.size("pu"), F.col("nv") - F.size("pv"))
    return both.where(9 * shared >= 4 * (F.col("nu") + F.col("nv"))).select("u", "v")


def _meeting(placed: DataFrame, words: list[int]) -> DataFrame:
    """u, v, nu, nv, lu, lv for each shingle that two nodes of different classes share early enough in both; with the
    words of the parities, if given, not ruling the pair out."""
    side = lambda key: placed.select("hash", F.col("key").alias(key), F.col("n").alias(f"n{key}"), F.col("root").alias(f"r{key}"), (F.col("n") - F.col("pos")).alias(f"l{key}"), *(F.col("parity")[i].alias(f"{key}{i}") for i in words))
    # what can still be shared from a shared shingle on falls along the prefix: with a pair's first one all that reach are met
    pairs = side("u").join(side("v"), "hash").where("u > v and ru <> rv and 5 * least(nu, nv) >= 4 * greatest(nu, nv) and 9 * least(lu, lv) >= 4 * (nu + nv)")
    if words:
        pairs = pairs.where(f"9 * ({' + '.join(f'bit_count(u{i} ^ v{i})' for i in words)}) <= nu + nv")
    return pairs.select("u", "v", "nu", "nv", "lu", "lv")


def _again(long: DataFrame, nodes: DataFrame, texts: DataFrame, turn: int) -> DataFrame:
    """u, v of similar pairs of a long bucket's members and four of the bucket's own, others in each turn, of other classes."""
    one = F.struct(F.col("key").alias("other"), F.col("n").alias("m"), F.col("root").alias("place"))
    picks = [pick(one, F.xxhash64("key", F.lit(2 * turn + k))) for k in range(2) for pick in (F.min_by, F.max_by)]
    own = long.groupBy("hash").agg(F.array(*picks).alias("own"), F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("hash", "own")
    star = long.join(own, "hash").select("key", "n", "root", F.explode(F.array_distinct("own")).alias("o")).where("root <> o.place and 5 * least(n, o.m) >= 4 * greatest(n, o.m)")
    pairs = star.select(F.greatest("key", "o.other").alias("u"), F.least("key", "o.other").alias("v")).distinct()
    return _similar(_possible(pairs, nodes).select("u", "v"), nodes, texts)


def links(nodes: DataFrame, texts: DataFrame, flood: list[int], long_bucket: int = LONG_BUCKET) -> DataFrame:
    """Edges u, v between keys whose components are those of all similar pairs."""
    nodes = nodes.where("prefix is not null")
    rows = nodes.select(F.posexplode("prefix").alias("pos", "hash"), "key", "n").select("hash", "key", "n", "pos")
    common = nodes.sparkSession.createDataFrame([(h,) for h in flood], "hash long")
    rest = rows.join(F.broadcast(common), "hash", "left_anti") if flood else rows
    # one exchange serves the distinct rows and their counts
    rest = rest.repartition("hash").distinct().withColumn("members", F.count("*").over(Window.partitionBy("hash")))
    if flood:
        rest = rest.unionByName(rows.join(F.broadcast(common), "hash", "left_semi").withColumn("members", F.lit(long_bucket + 1).cast("long")))
    buckets = scratch(rest.where("members > 1"), "buckets")
    long, one = buckets.where(F.col("members") > long_bucket), F.struct(F.col("key").alias("other"), F.col("n").alias("m"))
    own = long.groupBy("hash").agg(F.array(F.min(one), F.max(one), F.min_by(one, F.xxhash64("key")), F.max_by(one, F.xxhash64("key"))).alias("own"))
    star = long.join(own, "hash").select("key", "n", F.explode(F.array_distinct("own")).alias("o")).select("key", "o.other", "n", "o.m")
    close = F.expr("key <> other and 5 * least(n, m) >= 4 * greatest(n, m)")
    star = star.where(close).groupBy("key", "other").agg(F.count("*").alias("met"), F.min(F.least("n", "m")).alias("n")).where("20 * met >= n").select("key", "other")
    star = star.union(_fingerprint_pairs(nodes).where(close).select("key", "other"))
    # these links only save work: a pair left out here is met again below
    first = scratch(_similar(star.select(F.greatest("key", "other").alias("u"), F.least("key", "other").alias("v")).distinct(), nodes, texts), "first")
    place = lambda roots: scratch(buckets.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")), "placed")
    placed = place(components(first))
    # where links among the members of long buckets are many, more of them are found by a few of each bucket's own again
    apart = lambda of: placed.where(F.col("members") > long_bucket).agg(F.count_distinct(of)).first()[0]
    before = apart("key")
    for turn in range(1, ROUNDS + 1):
        left = apart("root")
        if left >= (1 - WORTH) * before:
            break
        more = _again(placed.where(F.col("members") > long_bucket), nodes, texts, turn)
        first, before, old = scratch(first.union(more), "first"), left, placed
        placed = place(components(first))
        drop_scratch(old)
    # buckets within one class have nothing left to find, nor have places from which no partner of any size can be met
    placed = placed.where("9 * (n - pos) >= 4 * (n + ceil(0.8 * n))")
    mixed = scratch(placed.groupBy("hash").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("hash"), "mixed")
    placed = scratch(placed.join(mixed, "hash", "left_semi"), "open")
    shrink_heaps(nodes.sparkSession)
    met = _meeting(placed.where(F.col("members") <= long_bucket), [])
    # in long buckets parities go along, so that pairs which they rule out are never made
    several = placed.where(F.col("members") > long_bucket).join(nodes.select("key", "parity").dropDuplicates(["key"]), "key")
    met = met.unionByName(_meeting(several, list(range(PARITY // 64))))
    met = met.groupBy("u", "v", "nu", "nv").agg(F.count("*").alias("met"), F.min("lu").alias("lu"), F.min("lv").alias("lv"))
    # after the last of these no more than the shorter rest can be shared
    met = met.where("9 * (met + least(lu, lv) - 1) >= 4 * (nu + nv)").select("u", "v")
    possible = scratch(_possible(met, nodes), "possible")
    # the parities of large sets say little, their prefixes much
    few = possible.where(F.col("nu") + F.col("nv") <= LARGE).select("u", "v")
    return first.union(_similar(few.union(_close_prefixes(possible.where(F.col("nu") + F.col("nv") > LARGE), nodes)), nodes, texts))


def classes(docs: DataFrame, long_bucket: int = LONG_BUCKET) -> DataFrame:
    """doc_id, component_id for each row of ``docs``: the smallest doc_id of its class of near copies."""
    texts = narrow(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    hot, flood = _frequent(texts.where("text is not null"))
    marked = scratch(texts.mapInArrow(_marker(hot), "doc_id long, text_hash long, key long, n int, fp long, prefix array<long>, parity array<long>"), "sets")
    nodes = scratch(components(links(marked, texts.where("text is not null"), flood, long_bucket)), "nodes")
    named = marked.select("doc_id", "key").join(nodes.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    smallest = scratch(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "smallest")
    return named.join(smallest, "root").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without all but the smallest doc_id of each class of near copies; columns unchanged.

    Rows that repeat the kept doc_id all stay, as do rows without doc_id.
    """
    with temporary(docs.sparkSession, "gone"):
        return without_ids(docs, classes(docs).where("doc_id <> component_id").select("doc_id"))
