from planloom.llm import decontaminate as dec

LONG = " ".join(f"alpha{k} beta{k}" for k in range(100))
ITEMS = [(0, "What is 17 + 25?"), (1, "1 2 3 4 5 6 7 8"), (2, LONG), (3, " ".join(f"gamma{k}" for k in range(20))), (4, "..."), (5, None)]


def test_short_long_and_split_items(spark):
    words, filler = LONG.split(), " ".join(["plain"] * 20)
    split = ITEMS[3][1].split()
    docs = [
        (0, f"so {filler} what is 17 25 {filler}"),
        (1, f"{filler} 1 2 3 4 5 6 7 8 {filler}"),
        (2, f"{filler} {' '.join(words[30:110])} {filler}"),
        (3, " ".join(split[:10]) + f" {filler} " + " ".join(split[10:])),
        (4, f"{filler} what is 18 25 {filler}"),
        (5, f"{filler} 1 2 3 4 5 6 7 9 {filler}"),
        (6, f"{filler} {' '.join(words[30:42])} {filler}"),
        (7, f"{filler} {' '.join(words[30:43])} {filler}"),
    ]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    for limit in (dec.MAX_FILTER, 3):
        got = {(r.doc_id, r.item_id): r.kind for r in dec.contaminated(d, b, max_filter=limit).collect()}
        assert got == {(0, 0): "verbatim", (1, 1): "verbatim", (2, 2): "verbatim", (3, 3): "verbatim", (7, 2): "verbatim"}
    assert sorted(r.doc_id for r in dec.keep_clean(d, b).collect()) == [4, 5, 6]
