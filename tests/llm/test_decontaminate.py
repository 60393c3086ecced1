import random

import pytest

from planloom.llm import decontaminate as dec

ITEMS = [
    (0, "John Smith has 5 apples and gives 3 apples to Mary. How many apples does John Smith have left?"),
    (1, "A train leaves Paris at 60 km per hour and reaches the next station after 2 hours of travel."),
    (2, "short one"),
    (3, None),
    (4, "The quick brown fox jumps over the lazy dog while the cat sleeps under the old wooden table."),
]
FILLER = "some other plain text about nothing much that goes on for a while".split()


def wrap(text, rng):
    return " ".join(rng.choices(FILLER, k=20)) + ".\n" + text + " " + " ".join(rng.choices(FILLER, k=30))


def corpus():
    rng = random.Random(2)
    one, two = ITEMS[0][1], ITEMS[1][1]
    texts = [
        wrap(one, rng),
        wrap(one.replace("John Smith", "Anna").replace("5", "17").replace("3", "eleven").replace("Mary", "Lu Chen"), rng),
        wrap(one.replace("John Smith has", "Bob has").replace("Mary", "Eve"), rng),  # John stays in the question
        wrap(two.replace("60 km", "90 miles").replace("Paris", "Rome").replace("2 hours", "4 hours"), rng),
        wrap(ITEMS[4][1].replace("lazy", "sleepy"), rng),
        wrap(" ".join(ITEMS[4][1].split()[:7]), rng),
        " ".join(rng.choices(FILLER, k=4000)) + " " + two + " " + two,
        "1 2 3 4 5 6 7 8 9 10 11 12",
        "",
        None,
        "John Smith",
    ]
    return [(10 * i, t, "extra") for i, t in enumerate(texts)]


def tokens(text):
    out = []
    for kind, value in map(dec.canonical, (text or "").split()):
        if kind == dec.NAME and out and out[-1][0] == dec.NAME:
            out[-1] = (kind, out[-1][1] + " " + value)
        elif kind != dec.NOTHING:
            out.append((kind, value))
    return out


def plain(docs, items, coverage=dec.COVERAGE):
    def windows(text):
        t = tokens(text)
        parts = [(k, t[k : k + dec.WINDOW]) for k in range(len(t) - dec.WINDOW + 1)]
        parts = [(k, w) for k, w in parts if sum(kind == dec.PLAIN for kind, _ in w) >= dec.LITERALS]
        return [(k, tuple(v if kind == dec.PLAIN else (kind,) for kind, v in w), [f"{kind}:{v}" for kind, v in w if kind != dec.PLAIN]) for k, w in parts]

    out = set()
    for i, text, *_ in docs:
        mine = windows(text)
        for j, item in items:
            theirs = windows(item)
            rows = [(p, q, a, b) for p, x, a in theirs for q, y, b in mine if x == y]
            if theirs and len({r[0] for r in rows}) >= coverage * len(theirs):
                found, same = dec.consistent(rows)
                if len(found) >= coverage * len(theirs):
                    out.add((i, j, len(found), "verbatim" if same else "reparameterised"))
    return out


def run(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id, r.windows, r.kind) for r in dec.contaminated(d, b, **options).collect()}


def test_matches_brute_force(spark):
    docs = corpus()
    want = plain(docs, ITEMS)
    assert run(spark, docs, ITEMS) == want
    assert run(spark, docs, ITEMS, max_filter=3) == want  # the plain hash join
    pairs = {(i, j): kind for i, j, _, kind in want}
    assert pairs[0, 0] == "verbatim" and pairs[10, 0] == "reparameterised" and pairs[30, 1] == "reparameterised" and pairs[60, 1] == "verbatim"
    assert (50, 4) not in pairs and not any(i in (70, 80, 90, 100) for i, _ in pairs)


def test_slots_must_agree():
    item = [(k, k, [f"3:n{k % 2}"], [f"3:m{k % 2}"]) for k in range(10)]
    assert dec.consistent(item) == (set(range(10)), False)
    mixed = [(k, k, ["3:n"], [f"3:m{k}"]) for k in range(10)]
    assert len(dec.consistent(mixed)[0]) == 1


def test_two_values_must_not_become_one():
    item = [(k, k, [f"3:n{k % 2}"], ["3:m"]) for k in range(10)]
    assert len(dec.consistent(item)[0]) == 5
    same = [(k, k, [f"3:n{k % 2}"], [f"3:n{k % 2}"]) for k in range(10)]
    assert dec.consistent(same) == (set(range(10)), True)


QUESTIONS = [
    "If {a} buys {x} apples and gives {y} of them to {b} on the way home, how many apples does {a} still carry when {b} asks about the {x} that were bought?",
    "A tank that holds {x} liters is filled by {a} at a steady rate of {y} liters per minute, and then {b} opens a drain until only {y} liters of the {x} remain inside.",
    "When {a} walks from the station to the market it takes {x} minutes, but {b} needs {y} minutes for the same way, so how much sooner than {b} does {a} arrive there?",
    "The school of {a} ordered {x} pencils for every class and {b} found that {y} boxes were missing, which means that {a} must order {y} more before the {x} are handed out.",
]


def question(k, rng, names, numbers):
    a, b = rng.sample(names, 2)
    x, y = rng.sample(numbers, 2)
    return QUESTIONS[k % len(QUESTIONS)].format(a=a, b=b, x=x, y=y)


def test_reparameterised_questions_are_found(spark):
    """Every question anew with other names and numbers, in plain prose; and with values that don't agree."""
    rng = random.Random(11)
    items = [(k, question(k, rng, ["Anna", "Omar", "Jun", "Pia"], [3, 12, 45, 160])) for k in range(4)]
    docs = []
    for i in range(80):
        docs.append((i, wrap(question(i, rng, ["Lena", "Ravi Kumar", "Zoe", "Ito"], [7, 19, "eleven", "2,500"]), rng)))
    for i in range(80, 120):  # every slot on its own: one name stands for two, or for none twice
        parts = QUESTIONS[i % 4].replace("{a}", "{}").replace("{b}", "{}").replace("{x}", "{}").replace("{y}", "{}")
        n = parts.count("{}")
        docs.append((i, wrap(parts.format(*(rng.choice(["Lena", "Ravi", "Zoe", "Ito", "Max", "Eve"]) if k % 2 else rng.randint(2, 99) for k in range(n))), rng)))
    docs += [(i, wrap("", rng)) for i in range(120, 160)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r.doc_id, r.item_id): r.kind for r in dec.contaminated(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    right = sum(found.get((i, i % 4)) == "reparameterised" for i in range(80))
    assert right >= 72 and not any(i >= 120 for i, _ in found), (right, len(found))
    assert sum((i, i % 4) in found for i in range(80, 120)) <= 20


@pytest.mark.parametrize("word, kind", [("5", 1), ("$1,000.50", 1), ("twelve,", 1), ("3rd", 1), ("5kg", 1), ("(km)", 2), ("Mary's", 3), ("The", 0), ("DE!!", 0), ("--", 4), ("É", 3), ("fox.", 0)])
def test_canonical(word, kind):
    assert dec.canonical(word)[0] == kind


def test_keep_clean_and_empty(spark):
    d = spark.createDataFrame([*corpus(), (None, ITEMS[0][1], "no id"), corpus()[0]], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = dec.keep_clean(d, b)
    assert kept.columns == d.columns
    bad = {i for i, *_ in plain(corpus(), ITEMS)}
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(i) for i in [*(r[0] for r in corpus()), None] if i not in bad)
    assert dec.contaminated(d, b.limit(0)).count() == 0 and dec.contaminated(d.limit(0), b).count() == 0
