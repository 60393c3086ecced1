import hashlib
import pathlib

import pytest

from planloom.llm import licences as lic


def plain(rows):
    found = {}
    for name, unit, digest in lic.known():
        found.setdefault((unit, digest), []).append(name)
    out = []
    for i, text, *_ in rows:
        units = [] if text is None else [("text", 0, text), *(("line", k + 1, part) for k, part in enumerate(text.split("\n")))]
        for unit, line, part in units:
            digest = hashlib.sha256(lic.normal_form(part).encode()).hexdigest()
            out += [(i, unit, line, name) for name in found.get((unit, digest), [])]
    return sorted(out, key=str)


MIT = lic.TEXTS[0][1]
ROWS = [
    (1, MIT, "x"),
    (2, "Copyright (c) 2024 Somebody\nCopyright 2020 Other\n\n" + MIT.upper().replace(" ", "  ").replace("SUBLICENSE", "sub-licence"), "x"),
    (3, "MIT Licence\n\nAll rights reserved.\n" + MIT.replace("\n\n", "\n"), "x"),
    (4, MIT + " more", "x"),
    (5, "prose here.\nlicensed UNDER the MIT licence\nmore é prose\n  // SPDX-License-Identifier: Apache-2.0", "x"),
    (6, None, "x"),
    (7, "", "x"),
    (8, "\n\n", "x"),
    (9, "This work is licensed under the GPL v3!", "x"),
    (10, "word " * 40_000, "x"),
    (None, "Licensed under CC BY-NC 4.0.", "x"),
    (1, MIT, "x"),
]


def test_matches_brute_force(spark):
    got = lic.scan(spark.createDataFrame(ROWS, "doc_id long, text string, line string"))
    found = sorted(map(tuple, got.collect()), key=str)
    assert found == plain(ROWS)
    names = {(i, unit): name for i, unit, _, name in found}
    assert names[1, "text"] == names[2, "text"] == names[3, "text"] == "MIT" and (4, "text") not in names
    assert names[5, "line"] in ("MIT", "Apache-2.0") and names[9, "line"] == "GPL-3.0" and names[None, "line"] == "CC-BY-NC-4.0"


@pytest.mark.parametrize("name", sorted({n for n, _ in lic.TEXTS}))
def test_licences_differ(name):
    digests = {d for n, u, d in lic.known() if n == name and u == "text"}
    assert digests and not digests & {d for n, u, d in lic.known() if n != name}


def test_every_known_text_has_a_mark():
    texts = [t for _, t in lic.TEXTS + lic.NOTICES] + [f"SPDX-License-Identifier: {n}" for n in lic.SPDX]
    assert all(any(m in lic.normal_form(t) for m in lic.MARKS) for t in texts)
    # no rule makes a mark out of other letters
    assert not any(any(m in to for m in lic.MARKS) for p, to in lic.RULES if not any(m in p for m in lic.MARKS))


def test_empty_table(spark):
    assert lic.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


COMMON = pathlib.Path("/usr/share/common-licenses")


@pytest.mark.skipif(not COMMON.is_dir(), reason="needs published licence texts")
def test_whole_published_texts(spark):
    files = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = {name: (COMMON / f).read_text() for name, f in files.items()}
    cut = {name: t[: t.index("END OF TERMS AND CONDITIONS")] for name, t in texts.items() if "END OF TERMS AND CONDITIONS" in t}
    rows = [(i, t if i % 2 else t.upper().replace("\n\n", "\n \n\t")) for i, t in enumerate([*texts.values(), *cut.values()])]
    got = {r.doc_id: r.licence for r in lic.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("unit = 'text'").collect()}
    assert got == dict(enumerate([*texts, *cut]))
    assert all(any(m in lic.normal_form(t) for m in lic.MARKS) for t in [*texts.values(), *cut.values()])
    assert all(dict((d, n) for n, d in lic.DIGESTS)[lic.digest_table([(n, "text", t)])[0][2]] == n for n, t in texts.items())


def test_other_digests(spark):
    own = lic.digest_table([("House", "text", "Do as you\nlike."), ("House", "line", "House rules apply")])
    table = spark.createDataFrame(own, "licence string, unit string, digest string")
    docs = spark.createDataFrame([(1, "do AS you like"), (2, "a\n# house rules, apply\n"), (3, MIT)], "doc_id long, text string")
    for marks in (None, ["like", "house"]):
        assert sorted(map(tuple, lic.scan(docs, table, marks).collect())) == [(1, "text", 0, "House"), (2, "line", 2, "House")]
    assert lic.scan(docs, table.limit(0)).count() == 0
