"""Multi-column statistics and selectivity arithmetic, as aggregates and column expressions."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


# --- functional dependencies -----------------------------------------------------------------------------------------


def _degrees(df: DataFrame, cases: list[tuple[list[str], str]]) -> DataFrame:
    """case, degree of each dependency (given, to): one scan, whose rows are expanded to one for each case.

    Two aggregates, both pre-aggregated map-side: the rows of each pair of values, then of each given value with the
    number of its pairs.  No group's rows are ever collected.
    """
    columns = list(dict.fromkeys(c for given, to in cases for c in (*given, to)))
    kept = df.select(*(F.col(c).alias(f"__v{i}") for i, c in enumerate(columns)))
    place = {c: i for i, c in enumerate(columns)}
    # a value that a case doesn't use is null in its copy of the row
    copies = [F.struct(F.lit(k).alias("case"), *(F.when(F.lit(c in given or c == to), F.col(f"__v{place[c]}")).alias(f"v{i}") for i, c in enumerate(columns))) for k, (given, to) in enumerate(cases)]
    rows = kept.select(F.explode(F.array(*copies)).alias("r")).select("r.*")
    pairs = rows.groupBy("case", *(f"v{i}" for i in range(len(columns)))).agg(F.count("*").alias("n"))
    given_of = [F.create_map(*(x for k, (given, _) in enumerate(cases) for x in (F.lit(k), F.lit(c in given)))) for c in columns]
    keys = [F.when(given_of[i][F.col("case")], F.col(f"v{i}")).alias(f"g{i}") for i in range(len(columns))]
    groups = pairs.groupBy("case", *keys).agg(F.sum("n").alias("n"), F.count("*").alias("values"))
    return groups.groupBy("case").agg((F.coalesce(F.sum(F.when(F.col("values") == 1, F.col("n"))), F.lit(0)) / F.sum("n")).alias("degree"))


def dependency_degree(df: DataFrame, given: list[str], to: str) -> DataFrame:
    """degree: share of the rows whose values of ``given`` occur with a single value of ``to`` (null is a value)."""
    return _degrees(df, [(given, to)]).select("degree")


def dependency_cases(columns: list[str]) -> list[tuple[list[str], str]]:
    """Every dependency (given, to) among two or more of the columns, given in order of name."""
    return [(sorted(given), to) for size in range(2, len(columns) + 1) for to in columns for given in combinations([c for c in columns if c != to], size - 1)]


def dependencies(df: DataFrame, columns: list[str], cases: list[tuple[list[str], str]] | None = None) -> DataFrame:
    """given, to, degree of every dependency among two or more of the columns (or of the stated ones), in one scan."""
    cases = cases or dependency_cases(columns)
    given, to = (F.create_map(*(x for k, case in enumerate(cases) for x in (F.lit(k), F.array(*map(F.lit, case[0])) if side == 0 else F.lit(case[1])))) for side in (0, 1))
    return _degrees(df, cases).select(given[F.col("case")].alias("given"), to[F.col("case")].alias("to"), "degree")


def strongest_dependency(found: DataFrame, present: list[str]) -> DataFrame:
    """The dependency to apply first: of those over ``present`` columns the widest, then the one of highest degree."""
    usable = found.where(F.size(F.array_except("given", F.array(*map(F.lit, present)))) == 0).where(F.col("to").isin(present))
    return usable.orderBy(F.size("given").desc(), F.col("degree").desc(), F.concat_ws(",", "given"), "to").limit(1)


def dependent_selectivity(degree: Column, a: Column, b: Column) -> Column:
    """P(a and b) where a determines b to that degree."""
    return degree * F.least(a, b) + (1 - degree) * a * b


#: The share of the total in the least count, the default of a range, how far its sum may fall below
#: zero, and what it is then.
COUNT_SHARE, RANGE_DEFAULT, RANGE_SLACK, RANGE_TINY = 0.04, 0.005, -0.01, 1e-10


# --- most common values ------------------------------------------------------------------------------------------------


def mcv_min_count(n: Column, total: Column) -> Column:
    """Rows that a value needs in a sample of n out of total rows to be reliably common."""
    below = total - n + F.lit(COUNT_SHARE) * n * (total - 1)
    return F.when(below == 0, F.lit(0.0)).otherwise(n * (total - n) / below)


def mcv_list(df: DataFrame, columns: list[str], most: int = 100, total: float | None = None) -> DataFrame:
    """The most common value combinations: columns, n, frequency, base_frequency (as if columns were independent).

    ``total``: rows of the table that ``df`` samples; without it ``df`` is the whole table and every value counts.
    """
    n = df.agg(F.count("*").alias("__all"))
    groups = df.groupBy(*columns).agg(F.count("*").alias("n"))
    top = groups.orderBy(F.col("n").desc(), *(F.col(c).asc_nulls_last() for c in columns)).limit(most).crossJoin(F.broadcast(n))
    if total is not None:
        top = top.where(F.col("n") >= mcv_min_count(F.col("__all").cast("double"), F.lit(float(total))))
    base = F.lit(1.0)
    for c in columns:
        per = df.groupBy(F.col(c).alias(f"__{c}")).agg(F.count("*").alias(f"__n_{c}"))
        top = top.join(per, F.col(c).eqNullSafe(F.col(f"__{c}"))).drop(f"__{c}")
        base = base * (F.col(f"__n_{c}") / F.col("__all"))
    return top.select(*columns, "n", (F.col("n") / F.col("__all")).alias("frequency"), base.alias("base_frequency"))


def mcv_match(mcv: DataFrame, clauses: list[Column], any_of: bool = False) -> DataFrame:
    """selectivity, base, total of the listed values that match all (or any) of the clauses; null matches nothing."""
    held = [F.coalesce(c, F.lit(False)) for c in clauses]
    both = reduce((lambda a, b: a | b) if any_of else (lambda a, b: a & b), held)
    zero = F.lit(0.0)
    return mcv.agg(F.coalesce(F.sum(F.when(both, F.col("frequency"))), zero).alias("selectivity"), F.coalesce(F.sum(F.when(both, F.col("base_frequency"))), zero).alias("base"), F.coalesce(F.sum("frequency"), zero).alias("total"))


def mcv_combine(simple: Column, mcv: Column, base: Column, total: Column) -> Column:
    """Selectivity of a clause set from the listed values and, for what is not listed, from the simple estimate."""
    other = F.least(clamp(simple - base), 1.0 - total)
    return clamp(mcv + other)


# --- selectivities ------------------------------------------------------------------------------------------------------


def and_selectivity(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(1.0), lambda s, x: s * x)


def or_selectivity(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x - s * x)


#: Fixed value: of the rows of a table the share that the groups of several columns make at most.
GROUP_SHARE = 0.1


def group_count(distinct: list[Column], total: Column, rows: Column) -> Column:
    """Groups to expect of ``rows`` out of ``total`` rows: the product of the columns' distinct values, at most a tenth of
    the table for several columns, less what a selection of rows is expected to miss."""
    product = reduce(lambda a, b: a * b, [d.cast("double") for d in distinct])
    whole = F.least(product, total * (GROUP_SHARE if len(distinct) > 1 else 1.0))
    whole = F.greatest(whole, *(d.cast("double") for d in distinct), F.lit(1.0)) if len(distinct) > 1 else F.greatest(whole, F.lit(1.0))
    share = 1 - F.pow(F.greatest((total - rows) / total, F.lit(0.0)), total / whole)
    return F.when(rows <= 0, F.lit(1.0)).otherwise(F.greatest(F.bround(whole * share), F.lit(1.0)))


def range_selectivity(low: Column, high: Column, null_fraction: Column, default: float = RANGE_DEFAULT) -> Column:
    """Of ``low < x and x < high`` from those of both sides: hi + lo + nulls - 1; a tiny default where that fails."""
    value = high + low + null_fraction - 1
    return F.when(value > 0, value).when(value >= RANGE_SLACK, F.lit(RANGE_TINY)).otherwise(F.lit(default))


def best_statistics(objects: DataFrame, present: list[str]) -> DataFrame:
    """Of statistics objects (name, columns) the one that covers most of the columns present, then has fewest."""
    covered = F.size(F.array_intersect("columns", F.array(*map(F.lit, present))))
    ranked = objects.withColumn("__m", covered).where("__m >= 2")
    return ranked.withColumn("__r", F.row_number().over(Window.orderBy(F.col("__m").desc(), F.size("columns"), "name"))).where("__r = 1").drop("__m", "__r")


def expression_statistics(df: DataFrame, expression: Column) -> DataFrame:
    """rows, null_fraction, n_distinct, average width, minimum and maximum of an expression."""
    value = df.select(expression.alias("v"))
    return value.agg(
        F.count("*").alias("n"),
        (F.sum(F.col("v").isNull().cast("int")) / F.count("*")).alias("null_fraction"),
        F.count_distinct("v").alias("n_distinct"),
        F.avg(F.octet_length(F.col("v").cast("string"))).alias("width"),
        F.min("v").alias("low"),
        F.max("v").alias("high"),
    )


def sampled(df: DataFrame, rows: int, seed: int = 0, widest: int = 1024) -> DataFrame:
    """A seeded sample of that many rows (all, if there are fewer), in the order of the columns; rows that hold a value
    of over ``widest`` bytes are skipped, as they would be when a statistics object is built.

    A bounded top-n over a hash of the row: one pass, no count, and the same sample however the rows are dealt.
    """
    wide = [F.octet_length(c) > widest for c, t in df.dtypes if t in ("string", "binary")]
    narrow = df.where(~F.coalesce(reduce(lambda a, b: a | b, wide), F.lit(False))) if wide else df
    chosen = narrow.withColumn("__h", F.xxhash64(F.lit(seed), *df.columns)).orderBy("__h", *df.columns).limit(rows)
    return chosen.drop("__h").orderBy(*df.columns)
