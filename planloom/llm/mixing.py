"""Mixing sources to target weights by capped water-filling, on DataFrame and SQL functions alone.

Sources in ascending order (by code point, null last) get the weights in turn.  Together they share ``budget`` times
the corpus's words; a source's target stops at ``max_epochs`` times its own words, and what it can't take is shared
anew by weight among the others until none is above.  The end of that process is known in closed form: each target is
``min(cap, level * weight)`` for one water level, and in ascending order of cap / weight exactly a prefix is capped.

Sampling: a document is repeated as often as whole epochs fit into its source's target, and the rest is a seeded
sample of whole documents.  The sample takes documents in the order of a seeded hash until the words run out; what is
then left (less than one document) goes to further rounds with other seeds over documents that still fit, so that a
source's words end within a small document's size of its target.  No order over all of a source's rows is ever made:
words are summed by (source, hash bucket) first, and only the bucket in which they run out is looked at row by row.
Rows that agree in source, doc_id and size hash alike; they enter as one row with their number, and a round may take
some of them.  Each round ends in one threshold per source, so whether a document is taken is an expression over its own
row; only the rows of the few units (one for each source and round at most) that are taken in part are numbered, by
the partitions they lie in, so that a hot unit is never one task.

Scale: windows without a partition hold one row for each source (a million sources are some 100 MB in one task);
windows over a source hold its 4,096 buckets, or the units of one of them.

Edge cases: null text has size 0 and is taken 0 times its words; a null source is a source; of equal rows as many are
taken as there is room for, and which of them is not defined; with no words all targets are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, scratch, temporary, word_count

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET, MAX_EPOCHS, SEED, ROUNDS = 1.5, 2.0, 20_240_229, 4
BUCKETS = 4096


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target of a table source, size.  The windows hold one row for each source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("place", place).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1))
    per = per.withColumn("cap", F.lit(max_epochs) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before, on = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    # the level if all before this source are capped and it is not
    level = (F.lit(budget) * total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(on)
    per = per.withColumn("level", level).withColumn("free", F.col("cap") / F.col("weight") > F.col("level"))
    water = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), "place", "level"))).over(Window.partitionBy())["level"]
    target = F.when(water.isNull(), F.col("cap")).otherwise(F.least("cap", water * F.col("weight")))
    return per.select("source", "source_size", target.alias("target"))


def _hash(seed: int) -> Column:
    """60 bits of a digest that SQL engines have in common."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _at(k: int, seed: int) -> Column:
    return F.struct(_hash(seed + k).alias("h"), F.col("doc_id").alias("d"))


def _taken(rounds: int, seed: int) -> Column:
    """Whether the rounds' thresholds, columns of the source, take a document's further repetition."""
    out = F.lit(False)
    for k in range(rounds):
        out = out | ((F.col("size") <= F.col(f"room{k}")) & (_at(k, seed) <= F.col(f"last{k}")))
    return F.coalesce(out, F.lit(False))


def _counted(units: DataFrame, rounds: int, seed: int) -> DataFrame:
    """Units with ``got``: how many of their n rows the rounds take."""
    units = units.withColumn("got", F.lit(0).cast("long"))
    for k in range(rounds):
        fits = F.col("size") <= F.col(f"room{k}")
        more = F.when(fits & (_at(k, seed) <= F.col(f"last{k}")), F.col("n") - F.col("got")).when(fits & (_at(k, seed) == F.col(f"edge{k}")), F.col(f"part{k}")).otherwise(F.lit(0))
        units = units.withColumn("got", F.col("got") + more)
    return units


def _join(left: DataFrame, sources: DataFrame) -> DataFrame:
    return left.join(sources.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")


def thresholds(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS, seed: int = SEED, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Of a table doc_id, source, size: a row for each source with source_size, target, whole repetitions and what each
    round takes; and source, doc_id, size, got, unit of the units for which that isn't all or none of their rows."""
    sources = targets(sizes, weights, budget, max_epochs)
    units = scratch(sizes.where(F.col("size") > 0).groupBy("source", "doc_id", "size").agg(F.count("*").alias("n")), "units")
    # a target of 2 epochs to the last bit of a double is 2 whole epochs
    sources = sources.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    sources = sources.withColumn("room0", F.col("target") - F.col("whole") * F.col("source_size"))
    for k in range(rounds):
        sources = scratch(sources, f"mix-{k}")
        room = F.col(f"room{k}")
        left = _counted(_join(units, sources), k, seed).withColumn("left", F.col("n") - F.col("got")).where((F.col("left") > 0) & (F.col("size") <= room))
        left = left.select("source", "doc_id", "size", room.alias("room"), (F.col("left") * F.col("size")).alias("words"), _hash(seed + k).alias("h"))
        left = left.withColumn("bucket", F.shiftright("h", 60 - BUCKETS.bit_length() + 1))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        buckets = left.groupBy("source", "bucket").agg(F.sum("words").alias("words"), F.first("room").alias("room"))
        buckets = buckets.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
        # every bucket whose words fit goes in whole; the first that doesn't is looked at row by row
        full = buckets.where(F.col("before") + F.col("words") <= F.col("room")).groupBy("source").agg(F.max("bucket").alias("full"), F.sum("words").alias("full_words"))
        edge = buckets.where((F.col("before") <= F.col("room")) & (F.col("before") + F.col("words") > F.col("room"))).select("source", F.col("bucket").alias("edge"), "before")
        run = Window.partitionBy("source").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
        rows = _join(left, edge).where(F.col("bucket") == F.col("edge")).withColumn("sum", F.col("before") + F.sum("words").over(run))
        fits, at = F.col("sum") <= F.col("room"), F.struct(F.col("h"), F.col("doc_id").alias("d"))
        # of the first unit that doesn't fit, as many rows as do
        some = F.floor((F.col("room") - F.col("sum") + F.col("words")) / F.col("size"))
        within = rows.groupBy("source").agg(F.max(F.when(fits, at)).alias("edge_last"), F.sum(F.when(fits, F.col("words"))).alias("edge_words"), F.min(F.when(~fits, F.struct(at.alias("at"), some.alias("some"), "size"))).alias("cut"))
        # the last hash of the full buckets, if the edge bucket adds none
        top = F.shiftleft(F.col("full") + 1, 60 - BUCKETS.bit_length() + 1) - 1
        ends = full.join(within.withColumnRenamed("source", "__w"), F.col("source").eqNullSafe(F.col("__w")), "full")
        last = F.coalesce("edge_last", F.when(F.col("full").isNotNull(), F.struct(top.alias("h"), F.lit((1 << 63) - 1).alias("d"))))
        used = F.coalesce("full_words", F.lit(0)) + F.coalesce("edge_words", F.lit(0)) + F.coalesce(F.col("cut.some") * F.col("cut.size"), F.lit(0))
        ends = ends.select(F.coalesce("source", "__w").alias("__s"), last.alias(f"last{k}"), F.col("cut.at").alias(f"edge{k}"), F.col("cut.some").alias(f"part{k}"), used.alias("used"))
        sources = sources.join(ends, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
        sources = sources.withColumn(f"room{k + 1}", F.col(f"room{k}") - F.coalesce("used", F.lit(0))).drop("used")
    sources = scratch(sources, "mix-end")
    several = _counted(_join(units.where("n > 1"), sources), rounds, seed).where(F.col("got") != F.when(_taken(rounds, seed), F.col("n")).otherwise(F.lit(0)))
    return sources, scratch(several.select("source", "doc_id", "size", "got", F.monotonically_increasing_id().alias("unit")), "split-units")


def planned(rows: DataFrame, sources: DataFrame, split: DataFrame, seed: int = SEED) -> DataFrame:
    """Rows (source, doc_id, size and others) with their source's columns and ``__n``, their number of repetitions."""
    rounds = sum(c.startswith("last") for c in sources.columns)
    out = _join(rows, sources).withColumn("__n", F.col("whole") + F.when((F.col("size") > 0) & _taken(rounds, seed), 1).otherwise(0))
    units = split.count()
    if not units:
        return out
    split = split.toDF("__s", "__d", "__z", "__got", "__unit")
    split = F.broadcast(split) if units <= BROADCAST_ROWS else split
    out = out.join(split, F.col("source").eqNullSafe(F.col("__s")) & F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("size") == F.col("__z")), "left").drop("__s", "__d", "__z")
    part = scratch(out.where("__unit is not null").withColumn("__row", F.monotonically_increasing_id()), "split-rows").withColumn("__slab", F.shiftright("__row", 33))
    slabs = part.groupBy("__unit", "__slab").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("__unit").orderBy("__slab").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = part.join(slabs.select("__unit", "__slab", before.alias("__before")), ["__unit", "__slab"])
    nth = F.col("__before") + F.row_number().over(Window.partitionBy("__unit", "__slab").orderBy("__row"))
    part = part.withColumn("__nth", nth).withColumn("__n", F.col("whole") + F.when(F.col("__nth") <= F.col("__got"), 1).otherwise(0))
    return out.where("__unit is null").drop("__unit", "__got").unionByName(part.drop("__unit", "__got", "__row", "__slab", "__before", "__nth"))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) of each row, written to the shared folder: the texts are read once."""
    return scratch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")).select("doc_id", "source", word_count().alias("size")), "sizes")


def mix(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes, repetitions counted) for each row of ``docs``."""
    rows = sizes(docs)
    sources, split = thresholds(rows, seed=seed, **options)
    return planned(rows, sources, split, seed).select("doc_id", "size", "source_size", "target", (F.col("__n") * F.col("size")).alias("taken"))


def repeat(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The mixed corpus: the rows of ``docs`` as often as the plan takes them; columns unchanged.

    Each row decides by its own source's thresholds: texts meet only the small table of sources.
    """
    with temporary(docs.sparkSession, "mix-end", "split-units"):
        sources, split = thresholds(sizes(docs), seed=seed, **options)
    held = {f"__c{i}": c for i, c in enumerate(docs.columns)}
    at = {c: k for k, c in held.items()}
    rows = docs.toDF(*held).withColumns({"doc_id": F.col(at["doc_id"]).cast("long"), "source": F.col(at["source"]).cast("string"), "text": F.col(at["text"]).cast("string")})
    rows = rows.withColumn("size", word_count()).drop("text")
    repeated = planned(rows, sources, split, seed).where("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    return repeated.select(*held).toDF(*docs.columns)
