from test_spans import corpus

from planloom.llm import spans as sp


def all_runs(text):
    """Every run of sentences that is long enough, whatever its length."""
    parts = [" ".join(text[a:b].lower().split()) for a, b, _ in sp.cut(text)]
    for i in range(len(parts)):
        words = 0
        for j in range(i, min(len(parts), i + 12)):
            words += len(parts[j].split())
            if any(j - i + 1 >= count and words >= least for count, least in sp.RUNS):
                yield tuple(parts[i : j + 1]), i, j + 1


def plain(rows):
    rows = [(i, t) for i, t, *_ in rows if i is not None and t]
    first = {}
    for i, t in rows:
        for run, a, _ in all_runs(t):
            first[run] = min(first.get(run, (i, a)), (i, a))
    return {i: {k for run, a, b in all_runs(t) if first[run] != (i, a) for k in range(a, b)} for i, t in rows}


def sentence(tag, n):
    return " ".join(f"{tag}{k}" for k in range(n)) + "."


def test_tail_of_a_repeated_run(spark):
    run = "\n".join([sentence("a", 40).replace(".", ""), sentence("b", 19)])
    rows = [(1, run + "\n" + sentence("c", 9)), (2, run + "\n" + sentence("d", 9))]
    got = {r.doc_id: r for r in sp.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].removed == 0 and got[2].removed == 2 and got[2].text == sentence("d", 9)


def test_matches_brute_force_over_all_runs(spark):
    tails = [(200 + k, "\n".join([sentence("p", 13), sentence("q", 5), sentence("r", 31), sentence("s", 2), sentence("t", 3), sentence(f"u{k}x", 4)])) for k in range(3)]
    rows = [r for r in [*corpus(), *((i, t, "x") for i, t in tails)] if not r[1] or len(r[1]) < 15_000]
    want = plain(rows)
    got = sp.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string, pos string")).where("doc_id is not null").collect()
    assert all(r.removed == len(want.get(r.doc_id, ())) for r in got)
    assert {r.doc_id: r.removed for r in got}[202] == 5
