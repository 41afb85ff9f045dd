"""Toxicity: a linear-chain conditional random field over words.

Two states, clean and toxic. The toxic state's score of a word sums hashed weights of the word and of
its first 3 to 8 bytes; two-by-two transitions link neighbours. Only documents are labelled, so the
words of labelled toxic documents whose form (word or beginning) is significantly bound to the toxic
class are taken as toxic, all words of clean documents as clean; toxic documents without such a word
are left out of the tagger's training. Forward-backward gives each word's marginal; a logistic unit,
fitted on sampled documents that the tagger has not seen, turns the document's marginals into a score.
Neighbouring words with a marginal of at least one half form the offending spans.

Everything is fitted on a bounded sample (``classify.SAMPLE_PER_CLASS`` documents of each class, none
over ``classify.SAMPLE_MAX_CHARS`` characters), with class weights that restore the class shares.

Scoring reads whole texts of any length in one pass without a shuffle; input columns pass through. A
null, empty or wordless text has no spans and gets the score of no evidence. With no labels or one
class only, every score is the share of toxic labels (0 without any). Equal texts have equal scores;
repeated rows stay; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake.llm.classify import SAMPLE_MAX_CHARS, SAMPLE_PER_CLASS, Adam, logistic_fit, sigmoid
from offerlake.llm.common import BYTE_VALUES, LOWER, free_name, labelled_sample, mixed, steps, text_steps, with_fields, word_hashes, word_spans

TABLE_BITS = 20
PREFIXES = range(3, 9)
ROUNDS, RATE, RIDGE = 25, 0.15, 1e-5
CHUNK_WORDS = 200_000
#: A form is bound to the toxic class from this likelihood-ratio statistic (about one chance in a
#: million, as hundreds of thousands of forms are tried) and class-balanced share.
LEAST_G2, LEAST_SHARE, LEAST_PLACES = 25.0, 0.95, 4

_SLOTS = np.uint64((1 << TABLE_BITS) - 1)
_OWNER = np.uint64(44)


def forms(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes (words x forms) of the word and its beginnings; a beginning over the word's end is 0."""
    low = BYTE_VALUES[LOWER[data]]
    out = np.zeros((len(starts), 1 + len(PREFIXES)), np.uint64)
    out[:, 0] = word_hashes(data, starts, ends)
    run, at = np.zeros(len(starts), np.uint64), 0
    for k in range(1, max(PREFIXES) + 1):
        place = starts + k - 1
        fits = place < ends
        run = run * np.uint64(0x100000001B3) + low[np.where(fits, place, 0)] if len(data) else run
        if k in PREFIXES:
            at += 1
            out[:, at] = np.where(fits, mixed(run + np.uint64(k)), np.uint64(0))
    return out


@dataclass(frozen=True)
class Weights:
    """Weights of forms in a hash table; an owner tag per slot keeps other forms out."""

    table: np.ndarray
    owner: np.ndarray

    @staticmethod
    def of(hashes: np.ndarray, values: np.ndarray) -> Weights:
        table, owner = np.zeros(1 << TABLE_BITS, np.float32), np.zeros(1 << TABLE_BITS, np.uint32)
        order = np.argsort(np.abs(values), kind="stable")  # of two forms in a slot the heavier one stays
        slot = (hashes[order] & _SLOTS).astype(np.int64)
        table[slot], owner[slot] = values[order], (hashes[order] >> _OWNER).astype(np.uint32)
        return Weights(table, owner)

    def emissions(self, hashes: np.ndarray) -> np.ndarray:
        slot = (hashes & _SLOTS).astype(np.int64)
        return np.where(self.owner[slot] == (hashes >> _OWNER).astype(np.uint32), self.table[slot], 0.0).sum(1, dtype=np.float64)


def scan(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """f[t] = (a f[t-1] + b) / (c f[t-1] + d), in blocks; the first map must be constant (a = c = 0)."""
    n = len(a)
    if not n:
        return np.empty(0)
    length = max(1, int(np.sqrt(n)))
    rows = -(-n // length)
    pad = rows * length - n
    a, b, c, d = (np.concatenate([x, np.full(pad, fill)]).reshape(rows, length).T.copy() for x, fill in ((a, 1.0), (b, 0.0), (c, 0.0), (d, 1.0)))
    # the composed map of each block
    p, q, r, s = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    for i in range(length):
        p, q, r, s = a[i] * p + b[i] * r, a[i] * q + b[i] * s, c[i] * p + d[i] * r, c[i] * q + d[i] * s
        norm = 1.0 / (np.abs(p) + np.abs(q) + np.abs(r) + np.abs(s))
        p, q, r, s = p * norm, q * norm, r * norm, s * norm
    f, begin = 1.0, np.empty(rows)
    for i, (p1, q1, r1, s1) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True)):
        begin[i] = f
        f = (p1 * f + q1) / (r1 * f + s1)
    out, now = np.empty((length, rows)), begin
    for i in range(length):
        now = (a[i] * now + b[i]) / (c[i] * now + d[i])
        out[i] = now
    return out.T.reshape(-1)[:n]


def forward_backward(emit: np.ndarray, at: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of the toxic state, and the forward and backward ratios (toxic over clean).

    ``at`` holds the word offsets of the documents; ``move`` the scores of (clean to clean, clean to
    toxic, toxic to clean, toxic to toxic, toxic at the start).
    """
    n = len(emit)
    if not n:
        return np.empty(0), np.empty(0), np.empty(0)
    e, (t00, t01, t10, t11, start) = np.exp(np.clip(emit, -30, 30)), np.exp(move)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    filled = np.diff(at) > 0
    first[at[:-1][filled]] = True
    last[at[1:][filled] - 1] = True
    one = np.ones(n)
    fore = scan(np.where(first, 0, e * t11), np.where(first, e * start, e * t01), np.where(first, 0, t10), np.where(first, 1, t00))
    ahead = np.concatenate([e[1:], [1.0]])
    back = scan(*(x[::-1] for x in (np.where(last, 0, ahead * t11), np.where(last, 1, t10 * one), np.where(last, 0, ahead * t01), np.where(last, 1, t00 * one))))[::-1]
    both = fore * back
    return both / (1 + both), fore, back


@dataclass(frozen=True)
class Model:
    weights: Weights | None
    move: np.ndarray
    coef: np.ndarray
    intercept: float
    prior: float

    def marginals(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
        return forward_backward(self.weights.emissions(forms(data, starts, ends)), at, self.move)[0]

    def documents(self, p: np.ndarray, at: np.ndarray) -> np.ndarray:
        return sigmoid(evidence(p, at) @ self.coef + self.intercept)


def evidence(p: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per document: log of the expected toxic words, highest marginal, expected share, log of all words."""
    sums = np.concatenate([[0.0], np.cumsum(p)])
    total = np.maximum(sums[at[1:]] - sums[at[:-1]], 0.0)
    top = np.zeros(len(at) - 1)
    filled = np.flatnonzero(np.diff(at) > 0)
    if len(filled):
        top[filled] = np.maximum.reduceat(p, at[:-1][filled])
    words = np.diff(at)
    return np.column_stack([np.log1p(total), top, np.sqrt(total / np.maximum(words, 1)), np.log1p(words) / 10.0])


def word_labels(slots: np.ndarray, none: int, which: np.ndarray, hashes: np.ndarray, at: np.ndarray, y: np.ndarray) -> np.ndarray:
    """True for the words of toxic documents whose word or beginning is bound to the toxic class.

    A place counts once per pair of neighbouring words, so copies and near copies of a document add
    nothing.
    """
    doc = np.repeat(np.arange(len(y)), np.diff(at))
    toxic, size = y[doc] > 0, int(slots.max()) + 1
    value = hashes[which]
    around = np.roll(value, 1) ^ mixed(np.roll(value, -1) + np.uint64(1))
    places = np.unique(mixed(value ^ mixed(around + toxic.astype(np.uint64))), return_index=True)[1]
    del value, around
    totals = np.maximum(np.bincount(toxic[places].astype(int), minlength=2), 1).astype(float)
    seen = np.zeros((2, size))
    for j in range(slots.shape[1]):
        at_slot = slots[which[places], j]
        for k in (0, 1):
            seen[k] += np.bincount(at_slot[toxic[places] == bool(k)], minlength=size)
    both = seen.sum(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        g2 = sum(2 * seen[k] * np.log(np.maximum(seen[k], 1e-12) / (both * totals[k] / totals.sum())) for k in (0, 1))
        share = (seen[1] / totals[1]) / (seen[1] / totals[1] + (seen[0] + 0.5) / totals[0])
    bound = (np.nan_to_num(g2) >= LEAST_G2) & (np.nan_to_num(share) >= LEAST_SHARE) & (seen[1] >= LEAST_PLACES)
    bound[none] = False
    return bound[slots].any(1)[which] & toxic


def fit_tagger(slots: np.ndarray, none: int, which: np.ndarray, at: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximises the conditional likelihood of ``target``, in chunks of documents; (weights, transition scores)."""
    size, n = int(slots.max()) + 1, max(len(which), 1)
    params = {"w": np.zeros(size), "move": np.array([0.0, -3.0, 0.0, -2.0, -4.0])}
    adam = Adam(params, RATE)
    chunks = []
    for low, high in steps(at, CHUNK_WORDS):
        places = at[low : high + 1] - at[low]
        part = slice(at[low], at[high])
        first = places[:-1][np.diff(places) > 0]
        inner = np.ones(at[high] - at[low], bool)
        inner[first] = False
        rows, goal = np.flatnonzero(inner), target[part]
        before, now = goal[rows - 1], goal[rows]
        observed = np.array([(~before & ~now).sum(), (~before & now).sum(), (before & ~now).sum(), (before & now).sum(), goal[first].sum()], float)
        chunks.append((part, places, first, rows, observed))
    for _ in range(ROUNDS):
        error, change = np.zeros(len(slots)), np.zeros(5)
        score, t = params["w"][slots].sum(1), np.exp(params["move"])
        for part, places, first, rows, observed in chunks:
            emit = score[which[part]]
            p, fore, back = forward_backward(emit, places, params["move"])
            error += np.bincount(which[part], weights=p - target[part], minlength=len(slots))
            e, f, b = np.exp(np.clip(emit[rows], -30, 30)), fore[rows - 1], back[rows]
            joint = np.stack([np.full(len(rows), t[0]), t[1] * e * b, t[2] * f, t[3] * f * e * b])
            change += np.append((joint / joint.sum(0)).sum(1), p[first].sum()) - observed
        grad = np.zeros(size)
        for j in range(slots.shape[1]):
            grad += np.bincount(slots[:, j], weights=error, minlength=size)
        grad[none] = 0.0
        adam.step({"w": grad / n * 1e3 + RIDGE * params["w"], "move": change / n * 10 + 1e-4 * params["move"]})
    return params["w"], params["move"]


def fit_texts(texts: list[str], y: np.ndarray, weight: np.ndarray) -> Model:
    prior = float((weight * y).sum() / weight.sum()) if len(y) else 0.0
    if not len(y) or y.min() == y.max():
        return Model(None, np.zeros(5), np.zeros(4), 0.0, prior)
    # every fourth document of either class is kept for the document unit
    turn = np.empty(len(y), int)
    for value in (0, 1):
        turn[y == value] = np.arange((y == value).sum())
    later = turn % 4 == 3

    def tokens(mask: np.ndarray):
        found, kinds, counts = [], [], []
        for _, _, data, offsets in text_steps(pa.array([t for t, m in zip(texts, mask, strict=True) if m], pa.string())):
            starts, ends, at = word_spans(data, offsets)
            hashes = word_hashes(data, starts, ends)
            index = np.unique(hashes, return_index=True)[1]
            found.append(hashes)
            kinds.append(forms(data, starts[index], ends[index]))
            counts.append(np.diff(at))
        kinds = np.concatenate(kinds)
        kinds = kinds[np.unique(kinds[:, 0], return_index=True)[1]]  # by the word's hash
        unique, which = np.unique(np.concatenate(found), return_inverse=True)
        return kinds, which.astype(np.int32), unique, np.concatenate([[0], np.cumsum(np.concatenate(counts))])

    form, which, hashes, at = tokens(~later)
    y1 = y[~later]
    if not len(which):
        return Model(None, np.zeros(5), np.zeros(4), 0.0, prior)
    names, slots = np.unique(np.append(form.ravel(), np.uint64(0)), return_inverse=True)
    slots, none = slots[:-1].reshape(form.shape).astype(np.int32), int(slots[-1])
    target = word_labels(slots, none, which, hashes, at, y1)
    found = np.add.reduceat(np.append(target, False).astype(int), at[:-1]) * (np.diff(at) > 0) if len(at) > 1 else np.zeros(0)
    use = (y1 == 0) | (found > 0)
    chosen = np.repeat(use, np.diff(at))
    kept_at = np.concatenate([[0], np.cumsum(np.diff(at)[use])])
    values, move = fit_tagger(slots, none, which[chosen], kept_at, target[chosen])
    weights = Weights.of(names, values)
    if later.any() and 0 < y[later].sum() < later.sum():
        form, which, _, at = tokens(later)
        y2, w2 = y[later], weight[later]
    else:
        y2, w2 = y1, weight[~later]
    p = forward_backward(weights.emissions(form)[which], at, move)[0]
    coef, intercept = logistic_fit(evidence(p, at), y2, w2)
    return Model(weights, move, coef, intercept, prior)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", per_class: int = SAMPLE_PER_CLASS, max_chars: int = SAMPLE_MAX_CHARS) -> Model:
    """Fits on the bounded sample of ``labels.toxic``; held-out documents are never read."""
    rows = labelled_sample(docs, labels, "toxic", per_class, max_chars, text).orderBy(F.xxhash64("text"), "text", "label").collect()
    return fit_texts([r["text"] for r in rows], np.array([float(r["label"]) for r in rows]), np.array([r["weight"] for r in rows]))


def _spans(p: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> list[list[dict]]:
    """Character spans (from, to, mean marginal) of neighbouring toxic words, per document."""
    out: list[list[dict]] = [[] for _ in range(len(at) - 1)]
    hot = np.flatnonzero(p >= 0.5)
    if not len(hot):
        return out
    doc = np.searchsorted(at, hot, side="right") - 1
    cut = np.flatnonzero((np.diff(hot) != 1) | (np.diff(doc) != 0)) + 1
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    for run in np.split(np.arange(len(hot)), cut):
        d, a, b = doc[run[0]], hot[run[0]], hot[run[-1]]
        base = chars[offsets[d]]
        out[d].append({"start": int(chars[starts[a]] - base), "end": int(chars[ends[b]] - base), "marginal": float(p[a : b + 1].mean())})
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("marginal", T.DoubleType())]))
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score", spans: str = "spans") -> DataFrame:
    """``docs`` with the toxicity (0 to 1) and the offending character spans."""
    at_column = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, places = [np.empty(0)], []
            for first, last, data, offsets in text_steps(batch.column(at_column)):
                if model.weights is None:
                    scores.append(np.full(last - first, model.prior))
                    places.extend([[]] * (last - first))
                    continue
                starts, ends, at = word_spans(data, offsets)
                p = model.marginals(data, starts, ends, at)
                scores.append(model.documents(p, at))
                places.extend(_spans(p, at, starts, ends, data, offsets))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(scores), pa.float64()), pa.array(places, _ARROW_SPANS)], names=[*batch.schema.names, out, spans]
            )

    return docs.mapInArrow(run, with_fields(docs.schema, (out, T.DoubleType()), (spans, SPANS)))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with their columns."""
    out, spans = free_name(docs, "toxic_score"), free_name(docs, "toxic_spans")
    return score(docs, fit(docs, labels), out=out, spans=spans).where(F.col(out) < threshold).drop(out, spans)
