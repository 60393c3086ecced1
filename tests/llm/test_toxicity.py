import itertools
import math
import random
import zlib

import numpy as np

from planloom.llm import toxicity as tox

BAD = ["grobnik", "grobnaker", "vilst", "snarf"]


def corpus(n=700, seed=4):
    rng = random.Random(seed)
    plain = ["".join(rng.choices(["ta", "ro", "mi", "len", "so", "vi", "gro"], k=rng.randint(1, 4))) for _ in range(900)]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randint(3, 120))
        toxic = i % 6 == 0
        if toxic:
            for w in rng.choices(BAD, k=rng.randint(2, 4)):
                words.insert(rng.randrange(len(words)), w)
        docs.append((i, " ".join(words).capitalize(), "x"))
        if i % 10:
            labels.append((i, 1, int(toxic)))
    return docs, labels


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    bias, moves = -0.7, (0.3, -0.4, 0.1, 0.9)
    unary = [rng.normal(size=k) for k in (0, 1, 5, 2, 7)]
    for u, got in zip(unary, tox.marginals(unary, bias, moves)):
        total, hit = 0.0, np.zeros(len(u))
        for states in itertools.product((0, 1), repeat=len(u)):
            w = math.exp(sum(s * (x + bias) for s, x in zip(states, u)) + sum(moves[2 * a + b] for a, b in zip(states, states[1:])))
            total += w
            hit += w * np.array(states)
        assert np.allclose(got, hit / total if len(u) else [])


def test_slope_is_that_of_the_enumerated_likelihood():
    rng = np.random.default_rng(3)
    lengths, features = [5, 1, 3], 4
    mask, gold = np.zeros((6, 3), bool), np.zeros((6, 3))
    at, which = [], []
    for c, length in enumerate(lengths):
        mask[:length, c] = True
        gold[:length, c] = rng.integers(0, 2, length)
        for t in range(length):
            for f in rng.choice(features, rng.integers(0, 3), replace=False):
                at.append(t * 3 + c)
                which.append(f)
    at, which = np.array(at), np.array(which)
    theta = rng.normal(size=features + 5)

    def likelihood(theta):
        unary = np.bincount(at, theta[which], 18).reshape(6, 3) + theta[features]
        moves, total = theta[features + 1 :], 0.0
        for c, length in enumerate(lengths):
            score = lambda states: sum(s * u for s, u in zip(states, unary[:length, c])) + sum(moves[2 * a + b] for a, b in zip(states, states[1:]))  # noqa: B023, E731
            total += score([int(g) for g in gold[:length, c]]) - math.log(sum(math.exp(score(states)) for states in itertools.product((0, 1), repeat=length)))
        return total

    step = 1e-6 * np.eye(len(theta))
    want = [(likelihood(theta + e) - likelihood(theta - e)) / 2e-6 for e in step]
    assert np.allclose(tox.likelihood_slope(theta, at, which, mask, gold), want, atol=1e-5)


def test_every_toxic_document_gives_a_stretch():
    bad = "grobnik vilst snarf "
    long = [bad * 3000 + f"end{i}" for i in range(3)]
    texts = long + [f"{bad}alone{i} grobnik" for i in range(40)] + [f"plain words only {i}" for i in range(40)]
    model = tox.fit_chain(texts, [1] * 43 + [0] * 40, plain_stretches=30)
    assert model.weights and all(v.max() > 0.5 for v in model.marginals(["snarf grobnik vilst"]))


def test_memory_of_long_batches_is_bounded():
    """What a batch of long texts holds follows its bytes, not its rows."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(400)), "held_out": [False] * 400, "text": ["taro miro " * 12_000] * 400})
    sizes = [b.num_rows for b in tox.text_slices(iter([batch]), 2, 5000)]
    assert max(sizes) * 120_000 <= 8 << 20 and sum(sizes) == 400


def test_held_out_documents(spark):
    docs, labels = corpus()
    docs += [(9000, None, "x"), (9001, "", "x"), (9002, "grobnik vilst " * 3, "x"), (9003, "taro " * 30_000 + "snarf vilst", "x"), (None, "taro", "x"), docs[6]]
    labels += [labels[0], (9900, 1, 1), (12, 0, None), (None, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    m = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = tox.toxicity(d, m).collect()
    assert len(got) == len(docs)
    by_id = {r.doc_id: r for r in got}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [r for r in got if r.held_out and r.doc_id < 700]
    assert len(held) > 100 and sum(r.predicted == (r.doc_id % 6 == 0) for r in held) / len(held) > 0.98
    assert by_id[9002].predicted == 1 and by_id[9000].score == by_id[9001].score < 0.1
    # labels of held-out rows play no part
    other = m.selectExpr("doc_id", "quality", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - toxic else toxic end as toxic")
    assert sorted(map(str, tox.toxicity(d, other).collect())) == sorted(map(str, got))


def test_spans(spark):
    docs, labels = corpus()
    model = tox.fit_chain([t for _, t, _ in docs], [int(i % 6 == 0) for i, _, _ in docs])
    texts = [(1, "Taro, GROBNIK! miro"), (2, None), (3, "taro miro")]
    rows = tox.spans(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()
    assert [(r.doc_id, r.first, r.last) for r in rows] == [(1, 6, 13)]


def test_nothing_to_learn(spark):
    d = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in tox.toxicity(d, none).collect()] == [(0.0, 0)]
    assert tox.toxicity(d.limit(0), none).count() == 0
