"""Quality of documents: attention-based multiple-instance learning over passages, fitted in numpy.

A document is a bag of passages of ``PASSAGE`` words. Each passage has figures of its bytes and words (kinds of
characters, word lengths, function words, repetition within the passage and within the document); a hidden layer encodes
them, gated attention weighs the passages, and a logistic layer scores the weighted sum. Only the document's label is
known in fitting, so the attention learns which passages decide.

The fit uses at most ``SAMPLE`` labelled documents of either label; scoring covers every whole text.

Defined cases: a null or empty text is one passage without words; without labelled rows of both kinds every score is the
share of label 1 among them (0 without any); repeated rows get one row each; a null id is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from trackspark.llm.labelled import sample
from trackspark.llm.tables import id_and_text
from trackspark.llm.text import PLAIN, mix, slices, words
from trackspark.llm.toxicity import FUNCTION_WORDS, hashes_of

PASSAGE = 64
SAMPLE = 3000
HIDDEN, ATTENTION = 16, 8
EPOCHS, BATCH, RATE = 30, 64, 0.01

#: Kinds of bytes.
KINDS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r", ".,;:'\"-()", "!?", "|<>{}[]\\/=_", "#$%&*@^~+`"]
_KIND = np.full(256, len(KINDS), np.int64)
for _k, _chars in enumerate(KINDS):
    _KIND[[ord(c) for c in _chars]] = _k
#: Word lengths up to this one have a figure each.
LENGTHS = 16
FIGURES = len(KINDS) + 1 + LENGTHS + 6
_common: list[np.ndarray] = []


def _is_common(hashes: np.ndarray) -> np.ndarray:
    if not _common:
        _common.append(np.unique(hashes_of(sorted({w for v in FUNCTION_WORDS.values() for w in v.split()}))))
    at = np.minimum(np.searchsorted(_common[0], hashes), len(_common[0]) - 1)
    return _common[0][at] == hashes


def _first_of(values: np.ndarray) -> np.ndarray:
    """Whether each value has not occurred before."""
    out = np.zeros(len(values), bool)
    out[np.unique(values, return_index=True)[1]] = True
    return out


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Figures of each passage, and how many passages came before each text (every text has one at least)."""
    figures, bags = [np.zeros((0, FIGURES))], [np.zeros(1, np.int64)]
    for i, j, raw, at in slices(texts):
        hashes, first, last, counts = words(raw, at, PLAIN)
        docs, total = j - i, np.diff(counts)
        per = np.maximum(1, -(-total // PASSAGE))
        before = np.concatenate((np.zeros(1, np.int64), np.cumsum(per)))
        n = int(before[-1])
        doc = np.repeat(np.arange(docs), total)
        own = before[doc] + (np.arange(len(hashes)) - counts[doc]) // PASSAGE
        # a passage's bytes run from its first word to that of the next passage; a text's first from the text's start
        begin = np.full(n, -1, np.int64)
        begin[before[:-1]] = at[:-1]
        later = (np.arange(len(hashes)) - counts[doc]) % PASSAGE == 0
        later &= np.arange(len(hashes)) > counts[doc]
        begin[own[later]] = first[later]
        length = np.diff(np.append(begin, len(raw)))
        kinds = np.bincount(np.repeat(np.arange(n), length) * (len(KINDS) + 1) + _KIND[raw], minlength=n * (len(KINDS) + 1))
        sizes = np.bincount(own * LENGTHS + np.minimum(last - first, LENGTHS) - 1, minlength=n * LENGTHS)
        many = np.maximum(np.bincount(own, minlength=n), 1)
        salted = mix(hashes ^ mix(doc.astype(np.uint64), 9))
        three = salted.copy()
        three[:-2] += mix(hashes[1:-1], 1) + mix(hashes[2:], 2)

        def share(flag: np.ndarray, own: np.ndarray = own, n: int = n, many: np.ndarray = many) -> np.ndarray:
            return np.bincount(own, flag, n) / many

        figures.append(np.column_stack([
            kinds.reshape(n, -1) / np.maximum(length, 1)[:, None],
            sizes.reshape(n, LENGTHS) / many[:, None],
            share(_is_common(hashes)),
            share(_first_of(mix(hashes ^ mix(own.astype(np.uint64), 10)))),
            share(_first_of(salted)),
            share(_first_of(three)),
            np.log1p(np.repeat(total, per)),
            np.log1p(length / many),
        ]))
        bags.append(bags[-1][-1] + before[1:])
    return np.concatenate(figures), np.concatenate(bags)


def _softmax(score: np.ndarray, bags: np.ndarray) -> np.ndarray:
    sizes, start = np.diff(bags), bags[:-1]
    e = np.exp(score - np.repeat(np.maximum.reduceat(score, start), sizes))
    return e / np.repeat(np.add.reduceat(e, start), sizes)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]  # encoder, its bias; attention: content, gate, direction; output and its bias

    def scaled(self, figures: np.ndarray) -> np.ndarray:
        return np.clip((figures - self.centre) / self.scale, -5, 5)

    def forward(self, x: np.ndarray, bags: np.ndarray) -> tuple[np.ndarray, ...]:
        encode, bias, content, gate, direction, output, offset = self.weights
        hidden = np.maximum(x @ encode + bias, 0)
        c, g = np.tanh(hidden @ content), _sigmoid(hidden @ gate)
        attention = _softmax((c * g) @ direction, bags)
        pooled = np.add.reduceat(attention[:, None] * hidden, bags[:-1], axis=0)
        return hidden, c, g, attention, pooled, _sigmoid(pooled @ output + offset[0])

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        figures, bags = passages(texts)
        return self.forward(self.scaled(figures), bags)[-1]


def fit(texts: list[str], labels: list[int], seed: int = 0) -> Model | float:
    """A model, or the share of label 1 where only one label occurs."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.0
    figures, bags = passages(pa.array(texts, pa.large_string()))
    rng = np.random.default_rng(seed)
    shapes = [(FIGURES, HIDDEN), (HIDDEN,), (HIDDEN, ATTENTION), (HIDDEN, ATTENTION), (ATTENTION,), (HIDDEN,), (1,)]
    weights = [rng.normal(0, s[0] ** -0.5, s) if len(s) > 1 or s[0] > 1 else np.zeros(s) for s in shapes]
    model = Model(figures.mean(0), figures.std(0) + 1e-3, weights)
    x = model.scaled(figures)
    cost = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    mean, square = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    steps = 0
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
            sizes = np.diff(bags)[part]
            own = np.concatenate(([0], np.cumsum(sizes)))
            rows = np.repeat(bags[part] - own[:-1], sizes) + np.arange(own[-1])
            hidden, c, g, attention, pooled, p = model.forward(x[rows], own)
            _, _, content, gate, direction, output, _ = weights
            error = (p - y[part]) * cost[part] / len(part)
            d_pooled = np.repeat(np.outer(error, output), sizes, axis=0)
            d_weight = (d_pooled * hidden).sum(1)
            d_score = attention * (d_weight - np.repeat(np.add.reduceat(attention * d_weight, own[:-1]), sizes))
            d_mixed = np.outer(d_score, direction)
            d_c, d_g = d_mixed * g * (1 - c**2), d_mixed * c * g * (1 - g)
            d_hidden = (attention[:, None] * d_pooled + d_c @ content.T + d_g @ gate.T) * (hidden > 0)
            gradients = [
                x[rows].T @ d_hidden, d_hidden.sum(0), hidden.T @ d_c, hidden.T @ d_g, (c * g).T @ d_score,
                pooled.T @ error, np.array([error.sum()]),
            ]
            steps += 1
            for w, gradient, m, s in zip(weights, gradients, mean, square, strict=True):
                gradient = gradient + 1e-4 * w
                m += 0.1 * (gradient - m)
                s += 0.01 * (gradient**2 - s)
                w -= RATE * (m / (1 - 0.9**steps)) / (np.sqrt(s / (1 - 0.99**steps)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, keep: Column, most: int = SAMPLE) -> Model | float:
    """Fit on at most ``most`` labelled documents of either label for which ``keep`` (on ``doc_id``) holds."""
    return fit(*sample(id_and_text(docs), labels, "quality", keep, most))


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """``doc_id, score`` of every row; at least 0.5 means good."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.full(len(batch), model) if isinstance(model, float) else model.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], schema=schema)

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double")
