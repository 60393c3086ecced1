import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from planloom.llm import language

SYLLABLES = {"xx": ["ka", "to", "mi", "ré"], "yy": ["sch", "ung", "lü", "en"], "zz": ["ti", "on", "the", "ing"]}


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(3, 60))]
        text = " ".join(words)
        rows.append((i, text.upper() if i % 7 == 0 else text, lang if i % 5 else None, "s"))
    return rows


def plain_grams(text):
    data = text.lower().encode()
    return {data[i : i + n] for n in (1, 2, 3) for i in range(len(data) - n + 1)}


def test_presence_is_the_set_of_grams():
    flags = np.zeros(language.DIM, bool)
    for text in ["a", "ab", "The the THE", "éü漢" * 50]:
        got = language.present(text, flags)
        assert not flags.any() and 0.97 * len(plain_grams(text)) <= len(got) <= len(plain_grams(text))
    assert not len(language.present("", flags))


def test_matrix_products_equal_the_plain_kernel():
    rng = random.Random(5)
    texts = [t for _, t, _, _ in corpus(60)]
    flags = np.zeros(language.DIM, bool)
    rows = np.zeros((60, language.DIM), np.uint8)
    for r, t in zip(rows, texts):
        r[language.present(t, flags)] = 1
    model = language.fit([rng.choice("ab") for _ in texts], rows, landmarks=12)
    sets = [set(np.flatnonzero(r)) for r in rows]
    kernel = np.array([[len(a & set(model.columns[np.flatnonzero(m)])) / np.sqrt(len(a)) * m.max() for m in model.landmarks] for a in sets])
    want = kernel @ model.coefficients + model.bias
    assert np.allclose(model.scores(rows[:, model.columns].astype(np.float32), rows.sum(axis=1).astype(np.float32)), want, atol=1e-3)


def test_the_fit_is_weighted_ridge_regression_on_nystroem_features():
    texts = [(t, next(k for k, v in SYLLABLES.items() if any(s in t.lower() for s in v[:2]))) for _, t, _, _ in corpus(90)]
    names, flags = [lang for _, lang in texts], np.zeros(language.DIM, bool)
    rows = np.zeros((len(texts), language.DIM), np.uint8)
    for r, (t, _) in zip(rows, texts):
        r[language.present(t, flags)] = 1
    model = language.fit(names, rows, landmarks=9)
    languages = sorted(set(names))
    seen, marks = {}, []
    for i, lang in enumerate(names):
        seen.setdefault(lang, []).append(i)
    marks = [seen[lang][k] for k in range(3) for lang in languages]
    kernel = lambda a, b: (a.astype(float) @ b.T) / np.sqrt(np.outer(a.sum(1), b.sum(1)))
    inner, outer = kernel(rows[marks], rows[marks]), kernel(rows, rows[marks])
    values, vectors = np.linalg.eigh(inner)
    z = np.hstack([outer @ vectors @ np.diag(values**-0.5) @ vectors.T, np.ones((len(rows), 1))])
    # least squares with the penalty as further rows: the plain statement of ridge regression
    weight = np.array([1 / names.count(n) for n in names])
    penalty = np.sqrt(language.RIDGE * len(languages) / z.shape[1]) * np.eye(z.shape[1])[:-1]
    want = np.where(np.array(names)[:, None] == np.array(languages), 1.0, -1.0)
    solved = np.linalg.lstsq(np.vstack([z * np.sqrt(weight)[:, None], penalty]), np.vstack([want * np.sqrt(weight)[:, None], np.zeros((len(penalty), 3))]), rcond=None)[0]
    got = model.scores(rows[:, model.columns].astype(np.float32), rows.sum(axis=1).astype(np.float32))
    assert model.languages == languages and np.allclose(got, z @ solved, atol=2e-3)


def test_many_languages_with_many_rows_stay_small(spark):
    """Two hundred languages: what comes to the driver are landmarks and kernel values, not bit rows."""
    rng = random.Random(3)
    rows = [(200 * k + j, " ".join("".join(rng.choices("abcdefghij", k=5)) + f"x{k}y" for _ in range(6)), f"l{k:03d}") for k in range(200) for j in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs, F.lit(True), per_language=5, max_languages=200, landmarks=64)
    assert len(model.languages) == 200 and model.landmarks.shape[0] == 64


def test_identify(spark):
    rows = [*corpus(), (900, None, "xx", "s"), (901, "", "xx", "s"), (902, "12 -- 34!", "xx", "s"), (903, "漢字" * 9000, None, "s"), (None, "kato mito", "xx", "s"), (5, corpus()[5][1], "xx", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = language.identify(docs).collect()
    assert len(got) == len(rows)
    truth = {i: (t, next(k for k, v in SYLLABLES.items() if any(s in t.lower() for s in v[:2]))) for i, t, _, _ in corpus()}
    right = [r.lang_pred == truth[r.doc_id][1] for r in got if r.doc_id in truth]
    assert sum(right) / len(right) > 0.97
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (r.doc_id in (900, 901, 902))
    # labels of held-out rows play no part
    other = docs.selectExpr("doc_id", "text", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 'qq' else lang end as lang", "score")
    assert sorted(map(str, language.identify(other).collect())) == sorted(map(str, got))
    kept = language.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3


def test_nothing_to_learn(spark):
    schema = "doc_id long, text string, lang string"
    assert language.identify(spark.createDataFrame([], schema)).count() == 0
    assert [r.lang_pred for r in language.identify(spark.createDataFrame([(1, "abc", None)], schema)).collect()] == ["und"]
