"""Toxic spans with a linear-chain conditional random field over words.

States: plain and toxic.  A word's features are itself and its prefixes of 3 to 7 letters, lower-cased; the chain adds
the transition between neighbouring words.  Token labels: in documents labelled toxic, a word is labelled toxic if one
of its features is tied to toxic documents beyond chance (binomial tail times the number of features tried below
``false_features``); all other words are plain.  The field is fitted by gradient steps on the conditional likelihood
of stretches of up to ``STRETCH`` words.  Scoring runs forward and backward over whole documents, all documents of a
batch side by side, and the marginals are summed up per document (expected toxic words, their share, the largest
marginal); a logistic model on these, fitted to document labels, gives the score.  Words with a marginal of at least
one half are the offending spans.

Fitting uses a bounded sample of labelled rows: of either label the ``per_label`` rows with the smallest seeded hash of
doc_id, but for texts above ``LONGEST`` bytes, and label counts over all rows for the prior.  Of the sampled texts
without copies the chain's weights are fitted to ``2 * plain_stretches`` stretches with tied words in toxic documents (in
the order of a hash, every document's first one before any second) and an even share of about ``plain_stretches`` of the
others.  Scoring covers every row and all of its text, in batches bounded by bytes.

Edge cases: null, empty and wordless texts have no marginals and score what the logistic model gives a document
without any; repeated labels of a document count once, toxic if any is; rows without doc_id are scored but not learned
from; without both labels all scores are 0.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, smallest_hashes, text_slices
from .language import held_out

WORD = re.compile(r"\w+")
PREFIXES = range(3, 8)
STRETCH, STEPS, RATE, DECAY = 64, 120, 0.3, 1e-4
PER_LABEL, LONGEST, PLAIN_STRETCHES, SEED, THRESHOLD, FALSE_FEATURES = 2000, 1 << 16, 3000, 23, 0.3, 20.0
CACHE_ENTRIES = 300_000


def features(word: str) -> list[str]:
    """Of a lower-cased word: itself (with an end mark) and its prefixes."""
    return [word + "$", *(word[:n] for n in PREFIXES if n <= len(word))]


class _Emissions(dict):
    """Log-odds that a word adds to the toxic state."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        get = self.weights.get
        value = sum(get(f, 0.0) for f in features(word))
        if len(self) < CACHE_ENTRIES:
            self[word] = value
        return value


@dataclass
class Model:
    weights: dict[str, float]
    bias: float = -6.0
    #: log-potentials of plain-plain, plain-toxic, toxic-plain, toxic-toxic
    moves: tuple = (0.0, 0.0, 0.0, 0.0)
    logistic: np.ndarray = field(default_factory=lambda: np.zeros(len(SUMMARY) + 1))
    known: bool = False

    def emissions(self):
        if "_emissions" not in self.__dict__:
            self._emissions = _Emissions(self.weights)
        return self._emissions

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_emissions"}

    def marginals(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text the probability of the toxic state at each of its words."""
        get = self.emissions().__getitem__
        unary = [np.array([get(w) for w in WORD.findall(t.lower())] if t else [], np.float64) for t in texts]
        return marginals(unary, self.bias, self.moves)

    def score(self, values: list[np.ndarray]) -> np.ndarray:
        if not self.known:
            return np.zeros(len(values))
        z = summaries(values) @ self.logistic[1:] + self.logistic[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def marginals(unary: list[np.ndarray], bias: float, moves) -> list[np.ndarray]:
    """Forward-backward over chains of any lengths at once: place by place, over the chains that are long enough."""
    length = np.array([len(u) for u in unary])
    order = np.argsort(-length, kind="stable")
    most = int(length.max(initial=0))
    alive = np.searchsorted(-length[order], -np.arange(most), side="left")  # chains longer than t
    start = np.cumsum(alive) - alive
    total = int(alive.sum())
    x = np.empty(total)
    for rank, i in enumerate(order):
        if length[i]:
            x[start[: length[i]] + rank] = unary[i]
    np.exp(np.clip(x + bias, -40, 40), out=x)
    pp, pt, tp, tt = np.exp(moves)
    ahead, back = np.empty(total), np.empty(total)
    for t in range(most):
        here = slice(start[t], start[t] + alive[t])
        if t:
            r = ahead[start[t - 1] : start[t - 1] + alive[t]]
            ahead[here] = x[here] * (pt + tt * r) / (pp + tp * r)
        else:
            ahead[here] = x[here]
    for t in range(most - 1, -1, -1):
        here = slice(start[t], start[t] + alive[t])
        back[here] = 1.0
        if t + 1 < most:
            n = alive[t + 1]
            y = x[start[t + 1] : start[t + 1] + n] * back[start[t + 1] : start[t + 1] + n]
            back[start[t] : start[t] + n] = (tp + tt * y) / (pp + pt * y)
    odds = ahead * back
    p = odds / (1 + odds)
    out = [np.zeros(0)] * len(unary)
    for rank, i in enumerate(order):
        if length[i]:
            out[i] = p[start[: length[i]] + rank]
    return out


SUMMARY = ("log of expected toxic words", "largest marginal", "share of expected toxic words")


def summaries(values: list[np.ndarray]) -> np.ndarray:
    expected = np.array([v.sum() for v in values])
    most = np.array([v.max(initial=0.0) for v in values])
    count = np.array([max(len(v), 1) for v in values])
    return np.stack([np.log1p(expected), most, np.sqrt(expected / count)], axis=1) if len(values) else np.zeros((0, 3))


# --- fitting ---------------------------------------------------------------------------------------------------


def log_tail(hits: int, tries: int, rate: float) -> float:
    """Upper bound of the log probability of that many hits or more (Chernoff)."""
    share = hits / tries
    if share <= rate:
        return 0.0
    other = (1 - share) * math.log((1 - share) / (1 - rate)) if share < 1 else 0.0
    return -tries * (share * math.log(share / rate) + other)


def tied_features(texts: list[str], labels: list[int], false_features: float) -> set[str]:
    toxic = [set(WORD.findall(t.lower())) for t, y in zip(texts, labels) if y]
    hits = Counter()
    for words in toxic:
        hits.update({f for w in words for f in features(w)})
    tried = len(hits)
    hits = {f: n for f, n in hits.items() if n > 1}
    total = Counter(hits)
    for t, y in zip(texts, labels):
        if not y:
            total.update({f for w in set(WORD.findall(t.lower())) for f in features(w) if f in hits})
    rate = len(toxic) / max(1, len(texts))
    tied = {f for f, n in hits.items() if log_tail(n, total[f], rate) + math.log(max(tried, 1)) < math.log(false_features)}
    # a beginning that owes its hits to one continuation, and is less sure than it, says nothing by itself
    vague = set()
    for g in tied:
        for n in PREFIXES:
            f = g[:n]
            if n < len(g) and f in tied and 2 * hits[g] >= hits[f] and hits[g] / total[g] > hits[f] / total[f]:
                vague.add(f)
    return tied - vague


def distinct(texts: list[str], labels: list[int]) -> list[int]:
    """Places of texts without copies: a text goes if the least or the greatest hash of its three-word runs has been
    seen.  Copies of one toxic document would tie all of its words to toxicity."""
    seen, kept = set(), []
    for i, text in enumerate(texts):
        words = [w.encode() for w in WORD.findall(text.lower())]
        hashes = [zlib.crc32(b" ".join(words[k : k + 3])) for k in range(max(1, len(words) - 2))]
        ends = {(labels[i], min(hashes)), (labels[i], -max(hashes))}
        if not ends & seen:
            kept.append(i)
        seen |= ends
    return kept


def likelihood_slope(theta: np.ndarray, at: np.ndarray, which: np.ndarray, mask: np.ndarray, gold: np.ndarray) -> np.ndarray:
    """Slope of the conditional log-likelihood of labelled stretches, one in each column of ``mask`` and ``gold``.

    ``theta``: feature weights, bias, four moves; feature ``which[i]`` stands at place ``at[i]`` of the flattened words.
    """
    (length, n), tied = mask.shape, len(theta) - 5
    weights, bias, moves = theta[:tied], theta[tied], np.exp(theta[tied + 1 :])
    both = mask[1:] & mask[:-1]
    wanted = np.array([(both * (1 - gold[:-1]) * (1 - gold[1:])).sum(), (both * (1 - gold[:-1]) * gold[1:]).sum(), (both * gold[:-1] * (1 - gold[1:])).sum(), (both * gold[:-1] * gold[1:]).sum()])
    x = np.exp(np.clip(np.bincount(at, weights[which], length * n).reshape(length, n) + bias, -40, 40))
    ahead, back = np.empty((length, n)), np.ones((length, n))
    ahead[0] = x[0]
    for t in range(1, length):
        ahead[t] = x[t] * (moves[1] + moves[3] * ahead[t - 1]) / (moves[0] + moves[2] * ahead[t - 1])
    for t in range(length - 2, -1, -1):
        y = x[t + 1] * back[t + 1]
        back[t] = np.where(mask[t + 1], (moves[2] + moves[3] * y) / (moves[0] + moves[1] * y), 1.0)
    odds = ahead * back
    miss = (gold - odds / (1 + odds)) * mask
    # expected moves between neighbours
    r, y = ahead[:-1], x[1:] * back[1:]
    cells = np.stack([np.full_like(r, moves[0]), moves[1] * y, moves[2] * r, moves[3] * r * y])
    cells = cells / cells.sum(axis=0) * both
    return np.concatenate([np.bincount(which, miss.reshape(-1)[at], tied), [miss.sum()], wanted - cells.sum(axis=(1, 2))])


def fit_chain(texts: list[str], labels: list[int], plain_stretches: int = PLAIN_STRETCHES, false_features: float = FALSE_FEATURES) -> Model:
    kept = distinct(texts, labels)
    texts, labels = [texts[i] for i in kept], [labels[i] for i in kept]
    tied = sorted(tied_features(texts, labels, false_features))
    number = {f: i for i, f in enumerate(tied)}
    marked, plain = [], []
    for i, (t, y) in enumerate(zip(texts, labels)):
        words = WORD.findall(t.lower())
        found = [[number[f] for f in features(w) if f in number] for w in words]
        own = []
        for k in range(0, len(words), STRETCH):
            part = found[k : k + STRETCH]
            (own if y and any(part) else plain).append((part, bool(y)))
        own = [own[k] for k in sorted(range(len(own)), key=lambda k: (zlib.crc32(f"{i} {k}".encode()), k))]  # noqa: B023
        marked += [(nth, zlib.crc32(f"{i} {nth}".encode()), i, part) for nth, part in enumerate(own)]
    marked = [part for *_, part in sorted(marked, key=lambda m: m[:3])[: 2 * plain_stretches]]
    stretches = marked + plain[:: max(1, len(plain) // plain_stretches)]
    if not marked:
        return Model({})
    n = len(stretches)
    mask, gold = np.zeros((STRETCH, n), bool), np.zeros((STRETCH, n))
    at, which = [], []
    for c, (part, toxic) in enumerate(stretches):
        mask[: len(part), c] = True
        for t, found in enumerate(part):
            gold[t, c] = bool(found) and toxic
            at += [t * n + c] * len(found)
            which += found
    at, which = np.array(at, np.int64), np.array(which, np.int64)
    theta = np.zeros(len(tied) + 5)
    theta[len(tied)] = -4.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    words = mask.sum()
    for step in range(1, STEPS + 1):
        slope = likelihood_slope(theta, at, which, mask, gold) / words * 100 - DECAY * theta
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta = theta + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model(dict(zip(tied, theta[: len(tied)].tolist())), float(theta[len(tied)]), tuple(theta[len(tied) + 1 :].tolist()))


def fit_logistic(x: np.ndarray, labels: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps on the weighted likelihood; the intercept is not penalised."""
    x = np.hstack([np.ones((len(x), 1)), x])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    theta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (weight * (labels - p)) - penalty * theta
        curve = x.T @ (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]) + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        theta = theta + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return theta


def train(docs: DataFrame, labels: DataFrame, learn_from: Column, per_label: int = PER_LABEL, seed: int = SEED) -> Model:
    """A model of the rows of ``labels`` (doc_id, toxic) for which ``learn_from`` holds, and their texts."""
    marks = labels.where(learn_from & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    count = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}
    chosen = smallest_hashes(marks, "toxic", per_label, seed).orderBy("doc_id").limit(2 * per_label)
    text = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    short = text.join(F.broadcast(chosen), "doc_id").where(F.octet_length("text") <= LONGEST)
    rows = sorted(short.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect())
    texts, toxic = [r.text for r in rows], [r.toxic for r in rows]
    if len(set(toxic)) < 2:
        return Model({})
    model = fit_chain(texts, toxic)
    y = np.array(toxic, np.float64)
    weight = np.where(y == 1, count[1] / y.sum(), count[0] / (len(y) - y.sum()))
    model.logistic = fit_logistic(summaries(model.marginals(texts)), y, weight / weight.mean())
    model.known = True
    return model


# --- scoring ---------------------------------------------------------------------------------------------------


def _scorer(model: Model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 2, 5000):
            score = model.score(model.marginals(batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; learns from labels of rows that are not held out."""
    model = train(docs, labels, ~held_out(4, 2) & F.col("doc_id").isNotNull(), **options)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(4, 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scorer(model, threshold), "doc_id long, held_out boolean, score double, predicted int")


def spans(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, first, last (characters, last exclusive) and probability of each run of words with such a marginal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1):
            ids, texts = batch.column(0).to_pylist(), [(t or "") for t in batch.column(1).to_pylist()]
            out = []
            for i, text, values in zip(ids, texts, model.marginals(texts)):
                if not (values >= least).any():
                    continue
                lowered = text.lower()
                # offsets hold for the text itself where lower-casing keeps its length
                places = [m.span() for m in WORD.finditer(lowered)]
                k = 0
                while k < len(values):
                    if values[k] >= least:
                        j = k
                        while j + 1 < len(values) and values[j + 1] >= least:
                            j += 1
                        out.append((i, places[k][0], places[j][1], float(values[k : j + 1].max())))
                        k = j
                    k += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.float64()))], names=["doc_id", "first", "last", "probability"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, first int, last int, probability double")
