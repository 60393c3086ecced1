import random
import re

import duckdb
import pytest

from planloom.llm import mixing, oracles


def plain_targets(sizes, weights=(5, 2, 1), budget=1.5, epochs=2):
    """Reshare the excess by weight until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, total = set(), budget * sum(sizes.values())
    while True:
        rest = total - sum(epochs * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        out = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if out[s] > epochs * sizes[s]}
        if not over:
            return out | {s: epochs * sizes[s] for s in capped}
        capped |= over


def corpus(seed, n=1500):
    rng = random.Random(seed)
    texts = [" ".join(["w"] * min(4000, int(rng.paretovariate(0.9) * 12))) for _ in range(n)]
    rows = [(i, t, rng.choice(["src0"] * 5 + ["src1", "b", "Z", "é", None, "src10"]), "x") for i, t in enumerate(texts)]
    return [*rows, rows[7], (None, "no id here", "b", "x"), (5000, None, "b", "x"), (5001, "", None, "x"), (5002, "\x0b\x1c é\t", "b", "y")]


def test_word_count_is_the_stated_pattern(spark):
    texts = ["", None, " ", "a", "  a\x1cb\x85", "a\tb\nc\x0bd\x0ce\rf  g ", "  \n"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(mixing.word_count().alias("n"))
    assert [r.n for r in df.collect()] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(got, key=str) == sorted(again, key=str) and len(got) == len(rows)
    size = {}
    for _, t, s, _ in rows:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = plain_targets(size)
    taken = {}
    for r in got:
        s = next(s for s in size if size[s] == r.source_size)
        assert r.target == pytest.approx(want[s], rel=1e-12)
        assert r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0)
        taken[s] = taken.get(s, 0) + r.taken
    for s in size:
        assert abs(taken[s] - want[s]) <= max(10, 0.005 * want[s]), (s, taken[s], want[s])


def test_repeat_gives_what_mix_counts(spark):
    docs = spark.createDataFrame(corpus(3), "doc_id long, text string, source string, __x string")
    out = mixing.repeat(docs)
    assert out.columns == docs.columns
    count = {}
    for r in out.collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in count.items() if v}


def by_sql(spark, docs):
    """The rows of the query's SQL over the same table."""
    documents = docs.toArrow()  # noqa: F841 (DuckDB finds it by name)
    return sorted(map(str, duckdb.connect().execute(oracles.ORACLES["op9_water_filling"]).fetchall()))


def test_equal_rows_are_taken_as_there_is_room(spark):
    docs = spark.createDataFrame([(1, "w " * 10, "a")] * 1000, "doc_id long, text string, source string").repartition(7)
    got = mixing.mix(docs).collect()
    assert len(got) == 1000 and sum(r.taken for r in got) == 15_000 and {r.taken for r in got} == {10, 20}
    assert sorted(str(tuple(r)) for r in got) == by_sql(spark, docs)
    assert mixing.repeat(docs).count() == 1500


@pytest.mark.parametrize("seed", range(4))
def test_many_ties(spark, seed):
    rng = random.Random(seed)
    kinds = [(rng.choice([None, 1, 2, 3]), "w " * rng.randint(0, 40), rng.choice(["a", "b", None, "c"]), "x") for _ in range(25)]
    rows = [k for k in kinds for _ in range(rng.choice([1, 2, 30, 400]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __n string").repartition(5)
    got = mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(str(tuple(r)) for r in got) == by_sql(spark, docs.drop("__n"))
    assert mixing.repeat(docs).selectExpr("sum(size(filter(split(text, ' '), w -> w <> ''))) as n").first().n == sum(r.taken for r in got)


def test_empty_and_wordless(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, " ", "b")], "doc_id long, text string, source string")).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
