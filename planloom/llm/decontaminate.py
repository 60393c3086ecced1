"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers, units of measure and names (capitalised words that are not common sentence
openers; neighbouring ones make one name) become typed placeholders, everything else its lower-cased form without
outer punctuation.  A template window is ``WINDOW`` tokens in a row with at least ``LITERALS`` that are no
placeholder.  Window hashes of documents and benchmark are joined; the pairs of (document, item) whose shared windows
reach ``coverage`` of the item's windows go on to the slot check: every slot value of the item must stand for one value
throughout the document's passage (the most frequent one counts), and no two for the same one; windows that break the
mapping no longer count.
A pair is contaminated if the consistent windows still reach ``coverage``; it is ``verbatim`` if the mapping is the
identity and ``reparameterised`` otherwise.  Windows that are equal word for word count wherever they stand, so a
verbatim item that foreign text splits is found as well.

Besides these, runs of words are compared literally (lower-cased, without outer punctuation): ``LITERAL_RUN`` words of an
item in a row contaminate a document whatever their share of the item, and an item without a template window (few
words, or few that are no placeholder) is found if all its words, or ``LITERAL_RUN`` of them, stand in a row.  For pairs
found by these alone ``windows`` and ``coverage`` count literal runs of the item.

Scale: the benchmark's window hashes go to every task as a filter only if they are at most ``MAX_FILTER`` (16 MB);
beyond that every window of the documents enters the hash join.  The join of windows is left to the engine (broadcast
by size, skew-split otherwise); counts are pre-aggregated, and a group that is worked on in Python holds one document's
windows for one item.

Edge cases: null or short texts have no window; an item without a template window is found verbatim only, and one without words never; equal items are each
reported; rows that repeat a doc_id are taken as one document; rows without doc_id or item_id take no part.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, scratch, temporary, text_slices, without_ids

WINDOW, LITERALS, COVERAGE = 5, 2, 0.5
LITERAL_RUN = 13
MAX_FILTER, CACHE_ENTRIES = 2_000_000, 200_000
PLAIN, NUMBER, UNIT, NAME, NOTHING = range(5)

# Words that stand for numbers, units of measure, and common sentence openers that are no names.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half third quarter dozen twice".split())
UNITS = frozenset(
    "mm cm km kg mg ml lb lbs oz ft mph kmh kph hz khz mhz ghz kb mb gb tb kw kwh mw meter meters metre metres centimeter centimeters kilometer kilometers kilometre kilometres mile miles inch inches foot feet yard yards gram grams kilogram kilograms pound pounds ounce ounces ton tons liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros yen rupee rupees degree degrees celsius fahrenheit percent".split()
)
OPENERS = frozenset(
    "a about after again all also although an and another any are as at be because before below between both but by can could did do does during each either even every few find first for from given had has have he her here his how i if in into is it its let like many may might more most my neither no nor not now of on once only or other our over people she should since so some such suppose than that the their them then there these they this those though through thus to today under until up upon was we were what when where whether which while who whose why will with would yet you your".split()
)
_NUMBER = re.compile(r"[+-]?[$€£¥]?\d[\d.,:/]*(?:st|nd|rd|th|%)?$")
_NUMBER_UNIT = re.compile(r"([+-]?[$€£¥]?\d[\d.,:/]*)([A-Za-z]+)$")
_OUTER = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "$%+-") + "“”‘’«»¿¡…"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))


def canonical(word: str) -> tuple[int, str]:
    """Kind and text of a template token: the literal, or the slot's value."""
    core = word.strip(_OUTER)
    low = core.lower()
    if not any(map(str.isalnum, core)):
        return NOTHING, ""
    if _NUMBER.match(core) or low in NUMBER_WORDS:
        return NUMBER, low.strip(".,:/")
    if low in UNITS:
        return UNIT, low
    if (m := _NUMBER_UNIT.match(core)) and m[2].lower() in UNITS:
        return NUMBER, low
    if core[0].isupper() and low not in OPENERS and (len(core) == 1 or not core.isupper()):
        return NAME, core
    return PLAIN, low


class Templates:
    """Template tokens of texts, with the tokens of known words kept."""

    def __init__(self):
        self.reset()

    def reset(self):
        self.number: dict[str, int] = {}
        self.kinds, self.codes, self.words, self.values = array("B"), array("Q"), array("Q"), []

    def add(self, word: str) -> int:
        kind, text = canonical(word)
        n = self.number[word] = len(self.values)
        self.kinds.append(kind)
        self.codes.append(xxhash.xxh3_64_intdigest(f"{kind}" if kind else "=" + text))
        self.words.append(xxhash.xxh3_64_intdigest("w" + text.lower()))
        self.values.append(text)
        return n

    def windows(self, texts: list[str | None], keep=lambda hashes: slice(None), widths: list[int] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[list[str] | None], int, int]]:
        """For each text: its place, hashes and positions of the windows that ``keep`` picks, their slot values, how
        many windows there are, and 0; and the same for its literal runs of each width, without slot values.

        Without ``widths`` a text is an item: its runs are ``LITERAL_RUN`` words wide, or all its words if it has no
        template window.
        """
        if len(self.values) > CACHE_ENTRIES:
            self.reset()
        number, add = self.number, self.add
        ids = [np.array([number[w] if w in number else add(w) for w in t.split()], np.int64) if t else np.zeros(0, np.int64) for t in texts]
        kinds, codes, words, values = np.array(self.kinds, np.uint8), np.array(self.codes, np.uint64), np.array(self.words, np.uint64), self.values
        longest = max(map(len, ids), default=0)
        with np.errstate(over="ignore"):
            up, down = (np.multiply.accumulate(np.append(np.uint64(1), np.full(longest, m, np.uint64)), dtype=np.uint64) for m in (MULTIPLIER, INVERSE))
        for place, own in enumerate(ids):
            own = own[kinds[own] != NOTHING]
            kind = kinds[own]
            begins = np.flatnonzero(np.append(True, (kind[1:] != NAME) | (kind[:-1] != NAME))) if len(own) else np.zeros(0, np.int64)
            kind, code = kind[begins], codes[own[begins]]
            n = len(begins) - WINDOW + 1
            literal = np.convolve(kind == PLAIN, np.ones(WINDOW, np.int64), "valid") if n > 0 else np.zeros(0, np.int64)
            if widths is None:
                runs = [LITERAL_RUN if (literal >= LITERALS).any() else min(len(own), LITERAL_RUN)]
            else:
                runs = widths
            if len(own):
                with np.errstate(over="ignore"):
                    summed = np.append(np.uint64(0), np.cumsum(words[own] * up[: len(own)], dtype=np.uint64))
                    for width in runs:
                        count = len(own) - width + 1
                        if count < 1:
                            continue
                        hashes = (summed[width:] - summed[:-width]) * down[:count] + np.uint64(width)
                        hashes = (hashes ^ (hashes >> np.uint64(31))) * MULTIPLIER
                        hashes ^= hashes >> np.uint64(29)
                        picked = keep(hashes)
                        at = np.arange(count)[picked]
                        # the template token that holds the run's first word
                        yield place, hashes[picked], np.searchsorted(begins, at, "right") - 1, [None] * len(at), count, width
            if n < 1:
                continue
            with np.errstate(over="ignore"):
                total = np.zeros(n, np.uint64)
                for k in range(WINDOW):
                    total = (total ^ code[k : k + n]) * MULTIPLIER
                    total ^= total >> np.uint64(29)
            at = np.flatnonzero(literal >= LITERALS)
            hashes = total[at]
            picked = keep(hashes)
            at, hashes, count = at[picked], hashes[picked], len(at)
            slots = []
            ends = np.append(begins[1:], len(own)) if len(at) else None
            for a in at.tolist():
                slots.append([f"{kind[k]}:" + " ".join(values[i] for i in own[begins[k] : ends[k]]) for k in range(a, a + WINDOW) if kind[k] != PLAIN])
            yield place, hashes, at, slots, count, 0


def _windower(filter_hashes: np.ndarray | None, widths: list[int] | None = None):
    """Batches of id, text to id, hash, pos, slots (null for literal runs), windows (of the whole text), width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        if filter_hashes is None:

            def keep(hashes):
                return slice(None)

        else:
            known = np.sort(filter_hashes)
            marks = np.zeros(1 << 22, bool)
            marks[(known >> np.uint64(42)).astype(np.int64)] = True

            def keep(hashes):
                maybe = np.flatnonzero(marks[(hashes >> np.uint64(42)).astype(np.int64)])
                found = np.searchsorted(known, hashes[maybe])
                return maybe[(found < len(known)) & (known[np.minimum(found, len(known) - 1)] == hashes[maybe])] if len(known) else maybe[:0]

        for part in text_slices(batches, 1, 500):
            ids, out = part.column(0).to_pylist(), ([], [], [], [], [], [])
            for place, hashes, at, slots, count, width in templates.windows(part.column(1).to_pylist(), keep, widths):
                if len(at):
                    for column, values in zip(out, ([ids[place]] * len(at), hashes.view(np.int64).tolist(), at.tolist(), slots, [count] * len(at), [width] * len(at))):
                        column += values
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.int32()))], names=["id", "hash", "pos", "slots", "windows", "width"])
        del templates, keep
        give_back()

    return run


SCHEMA = "id long, hash long, pos int, slots array<string>, windows int, width int"


def consistent(rows: list[tuple[int, int, list[str], list[str]]]) -> tuple[set[int], bool]:
    """Of matches (item position, document position, item slots, document slots) the item positions whose slots follow
    the mapping of item values to document values, and whether all of these map to themselves.

    A passage may stand in a document more than once; each copy (matches that keep the same distance, give or take
    a few words) has a mapping of its own, and the best copy counts.
    """
    copies = defaultdict(list)
    for row in rows:
        copies[(row[1] - row[0]) // 8].append(row)
    best: tuple[set[int], bool] = (set(), False)
    for k in list(copies):
        near = copies[k] + copies.get(k + 1, [])
        votes = defaultdict(Counter)
        for _, _, theirs, ours in near:
            for a, b in zip(theirs, ours):
                votes[a][b] += 1
        mapping = {a: min(c, key=lambda b: (-c[b], b != a, b)) for a, c in votes.items()}
        # and back: of the item's values that stand for one of the document's, the one that does most often
        owner: dict[str, str] = {}
        for a, b in mapping.items():
            owner[b] = min(owner.get(b, a), a, key=lambda x: (-votes[x][b], x != b, x))
        good = [(p, theirs, ours) for p, _, theirs, ours in near if all(mapping[a] == b and owner[b] == a for a, b in zip(theirs, ours))]
        found = {p for p, _, _ in good}, all(a == b for _, theirs, ours in good for a, b in zip(theirs, ours))
        best = max(best, found, key=lambda f: (len(f[0]), f[1]))
    return best


def _judge(coverage: float):
    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(table["ipos"].to_pylist(), table["pos"].to_pylist(), table["islots"].to_pylist(), table["slots"].to_pylist()))
        positions, same = consistent(rows)
        total = table["iwindows"][0].as_py()
        if len(positions) < coverage * total:
            # parts that foreign text splits: windows that are equal word for word
            positions, same = {p for p, _, theirs, ours in rows if theirs == ours}, True
        good = len(positions) >= coverage * total
        own = [r[1] for r in rows if r[0] in positions]
        out = {"doc_id": table["id"][:1], "item_id": table["item_id"][:1], "windows": pa.array([len(positions)], pa.int32()), "coverage": pa.array([len(positions) / total]), "kind": ["verbatim" if same else "reparameterised"], "first": pa.array([min(own, default=0)], pa.int32()), "last": pa.array([max(own, default=0) + WINDOW], pa.int32())}
        return pa.table(out).slice(0, 1 if good else 0)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, max_filter: int = MAX_FILTER) -> DataFrame:
    """doc_id, item_id, windows, coverage, kind, first, last (template tokens) for each contaminated pair."""
    ours = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where(F.col("id").isNotNull())
    theirs = benchmark.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where(F.col("id").isNotNull())
    items = theirs.mapInArrow(_windower(None), SCHEMA).select(F.col("id").alias("item_id"), "hash", F.col("pos").alias("ipos"), F.col("slots").alias("islots"), F.col("windows").alias("iwindows"), "width")
    items = scratch(items, "items")
    widths = sorted(r.width for r in items.where("width > 0").select("width").distinct().collect())
    distinct = items.select("hash").distinct()
    hashes = distinct.limit(max_filter + 1).toArrow()["hash"]
    known = hashes.to_numpy().astype(np.int64).view(np.uint64) if len(hashes) <= max_filter else None
    # written once: the texts are gone through a single time
    found = scratch(ours.mapInArrow(_windower(known, widths), SCHEMA).drop("windows").join(items, ["hash", "width"]), "windows")
    literal, found = found.where("width > 0"), found.where("width = 0")
    enough = found.groupBy("id", "item_id").agg(F.count_distinct("ipos").alias("n"), F.max("iwindows").alias("most")).where(F.col("n") >= coverage * F.col("most"))
    pairs = found.join(enough.select("id", "item_id"), ["id", "item_id"], "left_semi").distinct()
    schema = "doc_id long, item_id long, windows int, coverage double, kind string, first int, last int"
    judged = scratch(pairs.groupBy("id", "item_id").applyInArrow(_judge(coverage), schema), "judged")
    runs = literal.groupBy("id", "item_id").agg(F.count_distinct("ipos").cast("int").alias("windows"), F.max("iwindows").alias("of"), F.min("pos").alias("first"), F.max(F.col("pos") + F.col("width")).alias("last"))
    runs = runs.select(F.col("id").alias("doc_id"), "item_id", "windows", (F.col("windows") / F.col("of")).alias("coverage"), F.lit("verbatim").alias("kind"), "first", "last")
    return judged.union(runs.join(judged.select("doc_id", "item_id"), ["doc_id", "item_id"], "left_anti").select(*judged.columns))


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item; columns unchanged.  Rows without doc_id stay."""
    with temporary(docs.sparkSession, "gone"):
        return without_ids(docs, contaminated(docs, benchmark, **options).select("doc_id"))
