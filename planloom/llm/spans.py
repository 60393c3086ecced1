"""Substring deduplication by sliding sentence spans.

A text is cut into sentences (after ``.``, ``!`` or ``?`` with closing marks and white space, and at line breaks) and each
of these at its commas, semicolons and colons, whatever its length, so that what repeats within a long sentence can be
seen; below, a sentence is such a part.  From every sentence on, and back from every sentence, there is one span: the
shortest run of several sentences that reaches any of the ``RUNS`` (three sentences and twelve words, or two and twenty),
so that passages of some fifty words that begin and end within sentences still hold a whole span.  A run that holds one
that reaches reaches too, so each sentence of any repeated run that reaches lies in a repeated span: in the one from it on
if that ends within the run, else in the one back from the run's end.  The span's hash is a polynomial over the hashes of
its sentences (lower-cased, white space collapsed).  Spans are joined globally on the hash; the first is the one with the
smallest (doc_id, text, position), and every sentence that a non-first repeated span covers is removed.

Scale: what crosses the network is one or two narrow rows for each sentence (hash, doc_id, position, length), in a partial
aggregate and once more in the join with the hashes that occur again; a hash held by a third of all rows collapses in
the first and is split by the engine's skew join in the second.  Nothing but a document's own spans is ever brought
together in one place.

Edge cases: null text stays null; texts without any span stay as they are; rows without doc_id are left alone and
not searched; a document is a doc_id with a text: rows that repeat both count as one, and of different texts under one
doc_id the one with the smaller hash comes first; 64-bit hashes of different spans may agree by chance (about n^2 / 2^65
pairs for n spans).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, scratch, text_slices

#: (sentences, words) that make a run long enough to count as a span.
RUNS = ((3, 12), (2, 20))
_BREAK = re.compile(r"(?<=[.!?])[\"'”’»)\]]*\s+|\s*\n\s*|(?<=[,;:])\s+(?=\S)")
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)


def cut(text: str) -> list[tuple[int, int, int]]:
    """(start, end, next start) of each sentence; what stands between end and next start separates."""
    out, at = [], 0
    for m in _BREAK.finditer(text):
        a, b = m.span()
        stop = a + len(m[0]) - len(m[0].lstrip("\"'”’»)]"))
        if stop > at:
            out.append((at, stop, b))
            at = b
        elif out:
            out[-1] = (*out[-1][:2], b)
            at = b
    if at < len(text):
        out.append((at, len(text), len(text)))
    return out


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.append(np.uint64(1), np.full(n - 1, base, np.uint64)), dtype=np.uint64)


def spans(hashes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and hash of the spans from each sentence on and back from each sentence."""
    n = len(hashes)
    total = np.append(0, np.cumsum(words))
    start = np.arange(n)
    last = np.minimum.reduce([np.maximum(start + count - 1, np.searchsorted(total, total[:-1] + least) - 1) for count, least in RUNS])
    back = np.maximum.reduce([np.minimum(start - count + 1, np.searchsorted(total, total[1:] - least, "right") - 1) for count, least in RUNS])
    # both ways give many spans twice
    start, last = np.divmod(np.unique(np.append((start * n + last)[last < n], (back * n + start)[back >= 0])), n)
    with np.errstate(over="ignore"):
        summed = np.append(np.uint64(0), np.cumsum(hashes * _powers(BASE, n), dtype=np.uint64))
        value = (summed[last + 1] - summed[start]) * _powers(_INVERSE, n)[start] + (last - start).astype(np.uint64)
        value = (value ^ (value >> np.uint64(31))) * np.uint64(BASE)
    return start, last - start + 1, value ^ (value >> np.uint64(29))


def _span_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text's hash, text to hash, doc_id, text's hash, pos, len."""
    digest = xxhash.xxh3_64_intdigest
    for batch in text_slices(batches, 2):
        out = ([], [], [], [], [])
        for doc_id, own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if not text:
                continue
            parts = [text[a:b].lower().split() for a, b, _ in cut(text)]
            if not parts:
                continue
            start, length, value = spans(np.array([digest(" ".join(p)) for p in parts], np.uint64), np.array([len(p) for p in parts]))
            if len(start):
                for column, values in zip(out, (value.view(np.int64), np.full(len(start), doc_id), np.full(len(start), own), start.astype(np.int32), length.astype(np.int32))):
                    column.append(values)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["hash", "doc_id", "of", "pos", "len"])


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the sentences that their spans cover."""
    for batch in text_slices(batches, 1):
        texts, count, gone = batch.column(1).to_pylist(), [], []
        for i, (text, covered) in enumerate(zip(texts, batch.column(2).to_pylist())):
            sentences = cut(text) if text else []
            count.append(len(sentences))
            if not covered:
                gone.append(0)
                continue
            away = np.zeros(len(sentences), bool)
            for s in covered:
                away[s["pos"] : s["pos"] + s["len"]] = True
            gone.append(int(away.sum()))
            texts[i] = "".join(text[a:c] for (a, _, c), lost in zip(sentences, away) if not lost)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(count, pa.int32()), pa.array(gone, pa.int32())], names=["doc_id", "text", "sentences", "removed"])


def _documents(docs: DataFrame) -> DataFrame:
    return narrow(docs).select("doc_id", F.xxhash64("text").alias("of"), "text")


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, of (the text's hash), pos, len of each span that repeats an earlier one."""
    found = scratch(_documents(docs).where(F.col("doc_id").isNotNull()).mapInArrow(_span_batches, "hash long, doc_id long, of long, pos int, len int"), "spans")
    place = F.struct("doc_id", "of", "pos")
    first = found.groupBy("hash").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("hash", "first")
    # written, so that the join has two exchanges of its own and the engine can split the rows of a hot hash
    first = scratch(first, "repeated")
    return found.join(first, "hash").where(place != F.col("first")).select("doc_id", "of", "pos", "len")


def remove_repeated(docs: DataFrame) -> DataFrame:
    """doc_id, text (without repeated sentences), sentences (in the original), removed, for each row of ``docs``."""
    covered = repeated(docs).groupBy("doc_id", "of").agg(F.collect_set(F.struct("pos", "len")).alias("covered")).toDF("__d", "__o", "covered")
    rows = _documents(docs).join(covered, (F.col("doc_id") == F.col("__d")) & (F.col("of") == F.col("__o")), "left").select("doc_id", "text", "covered")
    return rows.mapInArrow(_rewrite, "doc_id long, text string, sentences int, removed int")
