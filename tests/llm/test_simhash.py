import random
import re

import numpy as np
import pytest
import xxhash

from planloom.llm import simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(codes):
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if bin(codes[i] ^ codes[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


TEXTS = ["", None, "one", "One TWO", "a b c d e f g", "A B C D E F G", "a b c d e f", "É é x y z w", "x\x1cy z a b", "word " * 30_000, " \t\n", "a b c d e f g h"]


def test_fingerprint_matches_the_definition():
    for text in TEXTS:
        assert simhash.fingerprint((text or "").encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("blocks", [4, 5, 6])
def test_links_match_brute_force(spark, blocks):
    rng = random.Random(blocks)
    codes = [rng.getrandbits(64) for _ in range(150)]
    for c in codes[:40]:
        for _ in range(6):
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                c ^= 1 << bit
            codes.append(c)
    codes = sorted({*codes, 0, 7, (1 << 64) - 1})
    signed = np.array(codes, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(c,) for c in signed], "fp long")
    want = plain_components(codes)
    for limit in (16_384, 8):  # runs of up to 8 codes force the dealing in chunks
        got = {r.node: r.root for r in simhash.components(simhash.code_links(df, 3, limit, blocks)).collect()}
        classes = {}
        for code, k in zip(signed, want):
            classes.setdefault(k, []).append(code)
        for members in classes.values():
            assert {got.get(m, m) for m in members} == {min(members)}


def test_whole_operator(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=120)) for _ in range(25)]
    texts = [*TEXTS, *base, *base[:5], *[t.replace(" ", "  ", 1) for t in base[:5]], *[t + " tail" for t in base[5:12]]]
    rows = [(1000 - i, t, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[4], (None, base[0], 9)], "doc_id long, text string, fp int")
    codes = [plain_fingerprint(r[1]) for r in rows]
    roots = plain_components(codes)
    want = {}
    for k, (i, _, _) in zip(roots, rows):
        want[k] = min(want.get(k, i), i)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows) + 2
    by_id = {r.doc_id: r for r in got}
    for k, code, (i, _, _) in zip(roots, codes, rows):
        assert by_id[i].component_id == want[k]
        assert by_id[i].fp & (1 << 64) - 1 == code
    assert by_id[None].component_id == by_id[rows[len(TEXTS)][0]].component_id
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").select("doc_id").distinct().collect()) == sorted(set(want.values()))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0


def test_hex(spark):
    assert spark.createDataFrame([(-1,), (5,)], "fp long").select(simhash.hex_code()).collect() == [("f" * 16,), ("0" * 15 + "5",)]
