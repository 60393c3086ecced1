import random
import re

from planloom.llm import spans as sp


def plain_spans(text):
    parts = [" ".join(text[a:b].lower().split()) for a, b, _ in sp.cut(text)]
    out = []
    for i in range(len(parts)):
        words = 0
        for j in range(i, len(parts)):
            words += len(parts[j].split())
            if (j - i + 1 >= 3 and words >= 12) or (j - i + 1 >= 2 and words >= 20):
                out.append((tuple(parts[i : j + 1]), i, j + 1))
                break
    return out


def plain(rows):
    first, gone = {}, {}
    for i, t in sorted((i, t) for i, t, *_ in rows if i is not None and t):
        for span, a, _ in plain_spans(t):
            first[span] = min(first.get(span, (i, a)), (i, a))
    for i, t in ((i, t) for i, t, *_ in rows if i is not None and t):
        gone[i] = {k for span, a, b in plain_spans(t) if first[span] != (i, a) for k in range(a, b)}
    return gone


def corpus():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(500)]
    sentence = lambda n: " ".join(rng.choices(words, k=n)).capitalize() + "."
    passage = " ".join(sentence(rng.randint(6, 14)) for _ in range(7))
    long = " ".join(rng.choices(words, k=70))
    rows = []
    for i in range(40):
        parts = [sentence(rng.randint(1, 20)) for _ in range(rng.randint(0, 15))]
        if i % 4 == 1:
            parts.insert(rng.randrange(len(parts) + 1), passage.replace(" ", "\n", 1) if i % 8 == 1 else passage)
        if i % 5 == 2:
            parts.append("\n" + long + "\n")
        rows.append((i * 7 % 41, rng.choice([" ", "\n", "  "]).join(parts), "x"))
    line = "Buy now! Click here to go on. No spam, ever and ever again today."
    rows += [(100, line * 300, "x"), (101, "The. And. Of.", "x"), (102, "In. The. And. Of.", "x"), (103, None, "x"), (104, "", "x"), (105, "...\n\n!! \n", "x"), (None, rows[1][1], "x"), rows[5], (106, rows[5][1], "x"), (107, "word " * 30_000, "x")]
    return rows


def test_cut_keeps_every_character():
    for text in ["A b. C d! \"E?\" f\n\n g", "...", "x", "a.b c. ", "\n\nq. \n", "He said \"no.\" Then."]:
        parts = sp.cut(text)
        assert all(c == parts[k + 1][0] for k, (_, _, c) in enumerate(parts[:-1])) and (not parts or parts[-1][2] == len(text))
    assert [t[a:b] for t in ["One, two; 3,4: \"five,\" six. Seven"] for a, b, _ in sp.cut(t)] == ["One,", "two;", "3,4:", "\"five,\" six.", "Seven"]
    assert [t[a:b] for t in ["One two. \"Three!\" four\nfive"] for a, b, _ in sp.cut(t)] == ["One two.", "\"Three!\"", "four", "five"]


def test_matches_brute_force(spark):
    rows = corpus()
    gone = plain(rows)
    got = sp.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string, pos string")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t, _ in rows if i == r.doc_id)
        parts = sp.cut(text or "")
        away = gone.get(r.doc_id, set())
        assert (r.sentences, r.removed) == (len(parts), len(away))
        assert r.text == (text if not away else "".join(text[a:c] for k, (a, _, c) in enumerate(parts) if k not in away))
    by_id = {r.doc_id: r for r in got}
    assert sum(r.removed > 0 for r in got) >= 10 and by_id[106].removed and not by_id[101].removed + by_id[102].removed
    assert len(re.findall("Click", by_id[100].text)) <= 2


def test_empty_table(spark):
    assert sp.remove_repeated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_under_one_doc_id_are_documents_of_their_own(spark):
    sentence = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n)) + "."
    passage = " ".join(sentence(f"p{k}", 9) for k in range(4))
    other = " ".join(sentence(f"c{k}", 9) for k in range(4))
    rows = [(1, passage + " " + sentence("a", 5)), (2, passage + " " + sentence("b", 5)), (2, other), (2, other), (3, sentence("d", 7) + " " + other)]
    got = sp.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted((r.doc_id, r.sentences, r.removed) for r in got)
    assert found == [(1, 5, 0), (2, 4, 0), (2, 4, 0), (2, 5, 4), (3, 5, 4)]
