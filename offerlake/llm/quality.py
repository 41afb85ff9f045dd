"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages (runs of ``PASSAGE_WORDS`` words with what stands between them). A
passage is encoded by one dense layer over byte and word statistics; gated attention weighs the
passages of a document (softmax of w . tanh(Vh) * sigmoid(Uh)); a logistic unit scores the weighted
passage representation. Only documents carry labels; encoder, attention and output are trained
together by Adam on a bounded sample of labelled documents (``classify.SAMPLE_PER_CLASS`` of each
class, none over ``classify.SAMPLE_MAX_CHARS`` characters). Class weights restore the class shares
of all labelled documents, so scores are shares of good documents.

Scoring reads whole texts of any length in one pass without a shuffle; every input column passes
through. A null or empty text is one empty passage and gets the score of that. With no labels, or
labels of one class only, every score is the share of good labels (0.5 without any). Equal texts
have equal scores; repeated rows stay; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake.llm.classify import SAMPLE_MAX_CHARS, SAMPLE_PER_CLASS, Adam, sigmoid
from offerlake.llm.common import free_name, labelled_sample, text_steps, with_fields, word_hashes, word_spans

PASSAGE_WORDS = 60
HIDDEN, GATES, ROUNDS, RATE = 24, 12, 300, 0.02


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Statistics of every passage, and the n + 1 passage offsets of the documents."""
    starts, ends, at = word_spans(data, offsets)
    n_docs, n_words = len(offsets) - 1, np.diff(at)
    count = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    bag = np.concatenate([[0], np.cumsum(count)])
    inner = np.arange(bag[-1]) - np.repeat(bag[:-1], count)
    first_word = np.repeat(at[:-1], count) + inner * PASSAGE_WORDS
    # a passage begins at its first word, the first one at the document's start
    edge = np.where(inner == 0, np.repeat(offsets[:-1], count), starts[np.minimum(first_word, max(len(starts) - 1, 0))] if len(starts) else 0)
    edges = np.concatenate([edge, [offsets[-1]]]).astype(np.int64)
    n, size = bag[-1], np.maximum(np.diff(edges), 1)
    which = np.repeat(np.arange(n), np.diff(edges))
    bytes_ = np.bincount(which * 128 + np.where(data < 128, data, 127), minlength=n * 128).reshape(n, 128) / size[:, None] if len(data) else np.zeros((n, 128))
    word_of = np.searchsorted(edges, starts, side="right") - 1
    words = np.maximum(np.bincount(word_of, minlength=n), 1)
    hashes = word_hashes(data, starts, ends)
    same = np.zeros(len(starts), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (word_of[1:] == word_of[:-1])
    seen = np.zeros((n, 64), bool)
    seen[word_of, (hashes >> np.uint64(58)).astype(np.int64)] = True
    length = (ends - starts).astype(float)
    upper, digit = bytes_[:, 65:91].sum(1), bytes_[:, 48:58].sum(1)
    letters = upper + bytes_[:, 97:123].sum(1) + bytes_[:, 127]
    stats = np.column_stack([
        upper, digit, letters, bytes_[:, 127], bytes_[:, 32], bytes_[:, 10], bytes_[:, 0:10].sum(1), bytes_[:, 33], bytes_[:, 35:39].sum(1), bytes_[:, 42],
        bytes_[:, 44], bytes_[:, 46], bytes_[:, 124], bytes_[:, 91:97].sum(1), bytes_[:, 58:65].sum(1), bytes_[:, 123:127].sum(1),
        np.bincount(word_of, weights=same, minlength=n) / words, seen.sum(1) / 64.0, np.bincount(word_of, weights=length, minlength=n) / words / 10.0,
        np.bincount(word_of, weights=length > 20, minlength=n) / words, words / PASSAGE_WORDS, size / (8.0 * words), inner == 0, np.log1p(np.repeat(count, count)) / 5.0,
    ])
    assert n_docs == len(bag) - 1
    return np.sqrt(np.clip(stats, 0.0, 4.0)), bag


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    params: dict[str, np.ndarray] | None
    prior: float

    def score(self, x: np.ndarray, bag: np.ndarray) -> np.ndarray:
        if self.params is None:
            return np.full(len(bag) - 1, self.prior)
        return sigmoid(_forward(self.params, (x - self.mean) / self.scale, bag)["logit"])


def _forward(p: dict[str, np.ndarray], x: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
    """All layers over the passages of many documents; sums run per document."""
    count = np.diff(bag)
    h = np.tanh(x @ p["enc"] + p["enc_b"])
    tanh_gate, sig_gate = np.tanh(h @ p["v"]), sigmoid(h @ p["u"])
    raw = (tanh_gate * sig_gate) @ p["att"]
    top = np.maximum.reduceat(raw, bag[:-1])
    weight = np.exp(raw - np.repeat(top, count))
    weight /= np.repeat(np.add.reduceat(weight, bag[:-1]), count)
    z = np.add.reduceat(weight[:, None] * h, bag[:-1], axis=0)
    return {"h": h, "t": tanh_gate, "s": sig_gate, "a": weight, "z": z, "logit": z @ p["out"] + p["out_b"][0]}


def fit_bags(x: np.ndarray, bag: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 7) -> Model:
    """Trains on passages ``x`` in bags; ``weight`` counts documents per sampled document."""
    prior = float((weight * y).sum() / weight.sum()) if len(y) else 0.5
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1), np.ones(1), None, prior)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x, rng, d = (x - mean) / scale, np.random.default_rng(seed), x.shape[1]
    p = {
        "enc": rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), "enc_b": np.zeros(HIDDEN), "v": rng.normal(0, 0.3, (HIDDEN, GATES)),
        "u": rng.normal(0, 0.3, (HIDDEN, GATES)), "att": rng.normal(0, 0.3, GATES), "out": rng.normal(0, 0.3, HIDDEN), "out_b": np.array([np.log(prior / (1 - prior))]),
    }
    adam, count, share = Adam(p, RATE), np.diff(bag), weight / weight.sum()
    for _ in range(ROUNDS):
        f = _forward(p, x, bag)
        e = share * (sigmoid(f["logit"]) - y)
        dz = e[:, None] * p["out"]
        each = np.repeat(dz, count, axis=0)
        da = (each * f["h"]).sum(1)
        draw = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, bag[:-1]), count))
        gate = draw[:, None] * p["att"]
        dt, ds = gate * f["s"] * (1 - f["t"] ** 2), gate * f["t"] * f["s"] * (1 - f["s"])
        dh = (f["a"][:, None] * each + dt @ p["v"].T + ds @ p["u"].T) * (1 - f["h"] ** 2)
        grads = {"enc": x.T @ dh, "enc_b": dh.sum(0), "v": f["h"].T @ dt, "u": f["h"].T @ ds, "att": (f["t"] * f["s"]).T @ draw, "out": f["z"].T @ e, "out_b": np.array([e.sum()])}
        adam.step({k: g + 1e-4 * p[k] for k, g in grads.items()})
    return Model(mean, scale, p, prior)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", per_class: int = SAMPLE_PER_CLASS, max_chars: int = SAMPLE_MAX_CHARS) -> Model:
    """Fits on the bounded sample of ``labels.quality``; held-out documents are never read."""
    rows = labelled_sample(docs, labels, "quality", per_class, max_chars, text).orderBy("text", "label").collect()
    if not rows:
        return Model(np.zeros(1), np.ones(1), None, 0.5)
    parts = [passages(data, offsets) for _, _, data, offsets in text_steps(pa.array([r["text"] for r in rows], pa.string()))]
    x, bag = np.concatenate([x for x, _ in parts]), np.concatenate([[0], *(np.diff(b) for _, b in parts)]).cumsum()
    return fit_bags(x, bag, np.array([float(r["label"]) for r in rows]), np.array([r["weight"] for r in rows]))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a column ``out``: how likely the document is good, from 0 to 1."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.score(*passages(data, offsets)) for _, _, data, offsets in text_steps(batch.column(at))]
            scores = pa.array(np.concatenate(parts) if parts else np.empty(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, with_fields(docs.schema, (out, T.DoubleType())))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with their columns."""
    out = free_name(docs, "quality_score")
    return score(docs, fit(docs, labels), out=out).where(F.col(out) >= threshold).drop(out)
