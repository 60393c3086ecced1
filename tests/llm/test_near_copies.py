import random

import pytest

from planloom.llm import near_copies as nc


def plain_sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain_classes(texts):
    sets, root = [plain_sets(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return [find(i) for i in range(len(texts))]


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choices(words, k=rng.randint(1, 150)) for _ in range(60)]
    passage = rng.choices(words, k=30)
    texts = ["", None, " \n", "one", "ONE", "a b c d", "a b c d e"]
    for b in base:
        texts.append(" ".join(b))
        for _ in range(rng.randint(0, 3)):  # edits on both sides of the limit
            edited = list(b)
            for _ in range(rng.randint(0, 1 + len(b) // 20)):
                edited[rng.randrange(len(b))] = rng.choice(words)
            texts.append(" ".join(edited))
        if rng.random() < 0.3:
            texts.append(" ".join(b + passage))
    large = rng.choices(words, k=100)
    for k in range(60):
        edited = list(large)
        edited[k] = "changed"
        texts.append(" ".join(edited))
    return texts


@pytest.mark.parametrize("long_bucket, large", [(32, nc.LARGE), (2, 0), (10_000, 150)])
def test_classes_match_brute_force(spark, long_bucket, large, monkeypatch):
    monkeypatch.setattr(nc, "LARGE", large)
    texts = corpus()
    want = plain_classes(texts)
    got = {r.doc_id: r.component_id for r in nc.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), long_bucket).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert 90 < sum(w != i for i, w in enumerate(want)) < len(texts) - 30


def test_stage_drops_edited_copies_beyond_three_bits(spark):
    from planloom.llm import simhash

    import corpus_pipeline as cp

    rng = random.Random(1)
    base = [f"w{rng.randrange(300)}" for _ in range(200)]
    edited = [w if i % 60 != 30 else "other" for i, w in enumerate(base)]
    a, b = " ".join(base), " ".join(edited)
    assert bin(simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).count("1") > 3
    docs = spark.createDataFrame([(2, b, "x"), (1, a, "x"), (1, a, "x"), (None, b, "x")], "doc_id long, text string, lang string")
    kept = dict(cp.STAGES)["near_dedup"](spark, docs, "")
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "None"]


def test_empty_table(spark):
    assert nc.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rounds_find_links_and_change_no_class(spark, monkeypatch):
    rng = random.Random(7)
    base = [f"b{i}" for i in range(120)]
    # near copies by up to three edits each: some two of them are linked, many are not
    texts = [" ".join(w if i not in cut else f"x{k}" for i, w in enumerate(base)) for k in range(150) for cut in [set(rng.sample(range(40, 120), rng.randint(1, 3)))]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    met, whole = [], nc._meeting

    def meeting(placed, words):
        met.append(whole(placed, words).count())
        return whole(placed, words)

    monkeypatch.setattr(nc, "_meeting", meeting)
    counts, found = [], []
    for rounds in (0, 4):
        monkeypatch.setattr(nc, "ROUNDS", rounds)
        met.clear()
        found.append([r.component_id for r in nc.classes(docs).orderBy("doc_id").collect()])
        counts.append(sum(met))
    assert found[0] == found[1] == plain_classes(texts)
    assert counts[1] < counts[0]
