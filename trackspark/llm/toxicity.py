"""Toxicity: a convolutional text classifier over hashed words, fitted in numpy, with thresholds by language.

A word is a 64-bit hash of its own and one of its first 6, 7 and 8 bytes each; those that occur in at least
``LEAST_DOCS`` documents of the sample have an embedding, and a word's is their sum. Filters of one, two and three words run over the whole text, each keeps its largest response, and a logistic layer
weighs these. On all labelled documents that took no part in fitting, a threshold is chosen for each language, and one slope;
a language of few documents leans on all others. The language is read off the text's function words, never off a column.
A score of 0.5 is the threshold of the text's language.

The fit uses at most ``SAMPLE`` labelled documents of either label, less a fifth; calibration covers all others for which
labels are known, scoring every whole text.

Defined cases: null and empty texts score as a text without words; without labelled rows of both kinds every score is the
share of label 1 among them (0 without any); repeated rows get one row each; a null id is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackspark.llm.labelled import known, sampled
from trackspark.llm.tables import BROADCAST_IDS, id_and_text, release
from trackspark.llm.text import PLAIN, SMALL_SLICE, slices, words
from trackspark.session import settle

SAMPLE = 1500
LEAST_DOCS = 4
PREFIXES = (6, 7, 8)
WIDTHS = (1, 2, 3)
FILTERS, SIZE = 8, 8
NOISE = 2.2
EPOCHS, BATCH, RATE, DECAY = 4, 32, 0.05, 1e-4
#: For the threshold of a language, all languages together count as much as this many of its own documents of either label.
CALIBRATION = 12
#: Documents are counted by logit, in steps of a part of 1 and up to this far from 0.
PARTS, FARTHEST = 256, 64

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for with as be by this are from on at an",
    "fr": "le la les des du un une et est que qui dans pour sur avec au aux par pas ce",
    "de": "der die das und ist nicht von mit den dem ein eine zu auf für im sich auch es als",
    "es": "el los las una y que es por para con del se su al lo como más pero sus este",
}


def hashes_of(strings: list[str]) -> np.ndarray:
    """Hashes of single words."""
    out = [words(raw, at, PLAIN)[0] for _, _, raw, at in slices(pa.array(strings, pa.large_string()))]
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _language_table(vocabulary: np.ndarray) -> np.ndarray:
    """The language each word of the vocabulary speaks for, 0 for none."""
    table = np.zeros(len(vocabulary) + 2, np.int64)
    listed = {k: set(v.split()) for k, v in FUNCTION_WORDS.items()}
    for number, own in enumerate(listed.values(), 1):
        single = sorted(w for w in own if sum(w in other for other in listed.values()) == 1)
        table[1 + np.searchsorted(vocabulary, hashes_of(single))] = number
    return table


@dataclass
class Model:
    """Token 0 is any unknown hash, the last one is padding; ``responses[k]`` is what a word adds ``k`` words on."""

    vocabulary: np.ndarray
    responses: list[np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    offset: float
    languages: np.ndarray
    thresholds: np.ndarray
    slope: float = 1.0

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def logits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Logit and language number of each text."""
        logit, language = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for i, j, raw, at in slices(texts, SMALL_SLICE):
            hashes, _, _, counts = words(raw, at, PLAIN, PREFIXES)
            known = self.tokens(hashes)
            padded, first = pad(known, counts, len(self.vocabulary) + 1)
            spoken = np.bincount(
                np.repeat(np.arange(j - i), np.diff(counts)) * 5 + self.languages[known[:, 0]], minlength=5 * (j - i)
            ).reshape(-1, 5)[:, 1:]
            language[i:j] = np.where(spoken.max(1) > 0, spoken.argmax(1) + 1, 0)
            n = len(padded)
            sums = np.zeros((n, len(self.bias)), np.float32)
            for k, table in enumerate(self.responses):
                for column in padded[k:].T:
                    sums[: n - k, : table.shape[1]] += table[column]
            # Up to the first row of padding; those after it respond to the next text.
            spans = np.stack((first, first + np.diff(counts) + 1), 1).ravel()
            most = np.maximum.reduceat(sums, spans, axis=0)[::2]
            logit[i:j] = np.maximum(most + self.bias, 0) @ self.weights + self.offset
        return logit, language

    def scores(self, texts: pa.Array) -> np.ndarray:
        logit, language = self.logits(texts)
        return 1 / (1 + np.exp(-np.clip(self.slope * (logit - self.thresholds[language]), -30, 30)))


def pad(tokens: np.ndarray, counts: np.ndarray, padding: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens (a row per word) with every text followed by as much padding as the widest filter spans; and where each text starts."""
    extra = max(WIDTHS)
    docs = len(counts) - 1
    first = counts[:-1] + extra * np.arange(docs)
    out = np.full((len(tokens) + extra * docs, tokens.shape[1]), padding, np.int64)
    out[np.arange(len(tokens)) + extra * np.repeat(np.arange(docs), np.diff(counts))] = tokens
    return out, first


def _held(n: int) -> np.ndarray:
    """Which documents of a sample take no part in fitting."""
    return np.arange(n) % 5 == 0


def fit(texts: list[str], labels: list[int], seed: int = 0) -> Model | float:
    """A model, or the share of label 1 where only one label occurs."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.0
    docs = []
    for i, j, raw, at in slices(pa.array(texts, pa.large_string())):
        hashes, _, _, counts = words(raw, at, PLAIN, PREFIXES)
        docs += [hashes[a:b] for a, b in zip(counts[:j - i], counts[1:], strict=True)]
    listed = np.concatenate([np.unique(d) for d in docs])
    seen, often = np.unique(listed, return_counts=True)
    vocabulary = np.union1d(seen[(often >= LEAST_DOCS) & (seen > 0)], hashes_of([w for v in FUNCTION_WORDS.values() for w in v.split()]))
    shape = Model(vocabulary, [], np.zeros(0), np.zeros(0), 0.0, np.zeros(0), np.zeros(0))
    rng = np.random.default_rng(seed)
    held = _held(len(y))
    rows = len(vocabulary) + 2
    table = rng.normal(0, 0.1, (rows, SIZE))
    coded = [shape.tokens(d).astype(np.int32) for d in docs]
    del docs, listed
    table[:, 0] = _leaning([np.unique(c) for c, h in zip(coded, held, strict=True) if not h], y[~held], rows)
    table[[0, -1]] = 0
    filters = [rng.normal(0, 0.2, (w, SIZE, FILTERS)) for w in WIDTHS]
    for f in filters:
        f[:, 0] += np.where(np.arange(FILTERS) % 2, -0.5, 1.0)
    bias = np.zeros(FILTERS * len(WIDTHS))
    weights, offset = rng.normal(0, 0.3, len(bias)), np.zeros(1)
    parameters = [table, *filters, bias, weights, offset]
    speeds = [np.full_like(p, 1e-3) for p in parameters]
    share = y[~held].mean()
    cost = np.where(y == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))

    def step(p: np.ndarray, speed: np.ndarray, gradient: np.ndarray, at=slice(None)) -> None:
        speed[at] += gradient**2
        p[at] -= RATE * gradient / np.sqrt(speed[at])

    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(np.flatnonzero(~held)), max(1, (~held).sum() // BATCH)):
            counts = np.concatenate(([0], np.cumsum([len(coded[d]) for d in part])))
            padded, first = pad(np.concatenate([coded[d] for d in part]), counts, rows - 1)
            ends = np.append(first[1:], len(padded))
            vectors = table[padded].sum(1)
            where, pooled = [], []
            for w, f in zip(WIDTHS, filters, strict=True):
                sums = sum(vectors[k : len(padded) - w + 1 + k] @ f[k] for k in range(w))
                best = np.stack([a + sums[a : max(b - max(WIDTHS), a + 1)].argmax(0) for a, b in zip(first, ends, strict=True)])
                where.append(best)
                pooled.append(sums[best, np.arange(FILTERS)])
            z = np.concatenate(pooled, 1) + bias
            active = np.maximum(z, 0)
            p = 1 / (1 + np.exp(-np.clip(active @ weights + offset, -30, 30)))
            error = (p - y[part]) * cost[part] / len(part)
            back = np.outer(error, weights) * (z > 0)
            into = np.zeros((0, SIZE))
            touched = np.zeros(0, np.int64)
            for g, (w, f) in enumerate(zip(WIDTHS, filters, strict=True)):
                d = back[:, g * FILTERS : (g + 1) * FILTERS]
                gradient = np.zeros_like(f)
                for k in range(w):
                    at = where[g] + k
                    gradient[k] = np.einsum("dfs,df->sf", vectors[at], d)
                    touched = np.append(touched, padded[at].ravel())
                    into = np.concatenate((into, np.repeat((d[:, :, None] * f[k].T[None]).reshape(-1, SIZE), padded.shape[1], 0)))
                step(f, speeds[1 + g], gradient + DECAY * f)
            ids, inverse = np.unique(touched, return_inverse=True)
            moved = np.zeros((len(ids), SIZE))
            np.add.at(moved, inverse, into)
            step(table, speeds[0], moved + DECAY * table[ids], ids)
            table[[0, -1]] = 0
            step(bias, speeds[-3], back.sum(0))
            step(weights, speeds[-2], active.T @ error + DECAY * weights)
            step(offset, speeds[-1], np.array([error.sum()]))
    responses = [
        np.concatenate([table @ f[k] for f in reversed(filters) if len(f) > k], 1).astype(np.float32) for k in range(max(WIDTHS))
    ]
    flip = np.concatenate([np.arange(g * FILTERS, (g + 1) * FILTERS) for g in reversed(range(len(WIDTHS)))])
    model = Model(vocabulary, responses, bias[flip], weights[flip], float(offset[0]), _language_table(vocabulary), np.zeros(5))
    calibrate(model, *model.logits(pa.array([t for t, h in zip(texts, held, strict=True) if h], pa.large_string())), y[held])
    return model


def _leaning(docs: list[np.ndarray], y: np.ndarray, rows: int) -> np.ndarray:
    """Where embeddings start: by how many standard errors over ``NOISE`` each token leans towards label 1."""
    per = [np.bincount(np.concatenate([np.zeros(0, np.int64), *(d for d, t in zip(docs, y, strict=True) if t == k)]), minlength=rows) + 0.5 for k in (0, 1)]
    odds = np.log(per[1] / (y.sum() + 1)) - np.log(per[0] / ((1 - y).sum() + 1))
    errors = odds / np.sqrt(1 / per[0] + 1 / per[1])
    out = np.sign(errors) * np.clip(np.abs(errors) - NOISE, 0, 4)
    out[0] = 0
    return out


def calibrate(
    model: Model, logit: np.ndarray, language: np.ndarray, y: np.ndarray, often: np.ndarray | None = None, costs: np.ndarray | None = None
) -> None:
    """Set the threshold of each language between logits where the weighted errors are fewest, and the slope of scores.

    Rows stand for ``often`` documents each; ``costs`` are the weights of an error in a document of either label, 1 if not given. To
    the errors in a language come those in all, weighed as if made in ``CALIBRATION`` documents of either label, so that every
    language has a threshold.
    """
    y = y.astype(np.int64)
    often = np.ones(len(y)) if often is None else often.astype(float)
    total = np.bincount(y, often, minlength=2)
    if not total.all():
        return
    costs = np.ones(2) if costs is None else costs
    weight = often * costs[y]
    values, at = np.unique(logit, return_inverse=True)
    cuts = np.concatenate((values[:1] - 1, (values[1:] + values[:-1]) / 2, values[-1:] + 1))
    cells = np.bincount((language * 2 + y) * len(values) + at, weight, minlength=10 * len(values)).reshape(5, 2, -1)
    below = np.concatenate((np.zeros((5, 2, 1)), np.cumsum(cells, 2)), 2)
    missed = below[:, 1] + below[:, 0, -1:] - below[:, 0]
    missed += min(1.0, CALIBRATION * costs.sum() / weight.sum()) * missed.sum(0)
    for k in range(5):
        fewest = missed[k] <= missed[k].min() + 1e-9
        middle = cuts[fewest].mean()
        if not fewest[np.searchsorted(values, middle)]:  # between cuts of fewest errors, but not one itself
            starts = np.flatnonzero(fewest & ~np.append(False, fewest[:-1]))
            stops = np.flatnonzero(fewest & ~np.append(fewest[1:], False))
            widest = np.argmax(cuts[stops] - cuts[starts])
            middle = (cuts[starts[widest]] + cuts[stops[widest]]) / 2
        model.thresholds[k] = middle
    away = logit - model.thresholds[language]
    aim = np.where(y == 1, (total[1] + 1) / (total[1] + 2), 1 / (total[0] + 2))
    low, high = 1 / FARTHEST, float(FARTHEST)
    for _ in range(40):
        slope = np.sqrt(low * high)
        steeper = (weight * away * (aim - 1 / (1 + np.exp(-np.clip(slope * away, -30, 30))))).sum() > 0
        low, high = (slope, high) if steeper else (low, slope)
    model.slope = float(slope)


def _looking(model: Model, fitted: np.ndarray):
    """``doc_id, print, language, logit`` of the documents that took no part in fitting, logits in whole parts."""
    schema = pa.schema([("doc_id", pa.int64()), ("print", pa.int64()), ("language", pa.int64()), ("logit", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(~np.isin(batch.column(0).to_numpy(), fitted)))
            logit, language = model.logits(batch.column(2))
            parts = np.round(np.clip(logit, -FARTHEST, FARTHEST) * PARTS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(language), pa.array(parts)], schema=schema)
        release()

    return run


def _calibration(model: Model, docs: DataFrame, listed: DataFrame, fitted: np.ndarray) -> tuple[np.ndarray, ...]:
    """Logit, language, label and number of the labelled documents that took no part in fitting, one text for each id."""
    texts = id_and_text(docs).where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("print"), "text")
    if listed.count() <= BROADCAST_IDS:  # else the logits of all travel, not the texts
        texts = texts.join(F.broadcast(listed.select("doc_id")), "doc_id", "left_semi")
    found = texts.mapInArrow(_looking(model, fitted), "doc_id long, print long, language long, logit long")
    found = found.groupBy("doc_id").agg(F.min_by(F.struct("language", "logit"), "print").alias("f"))
    counts = found.join(listed, "doc_id").groupBy("f.language", "f.logit", "y").agg(F.count("*").alias("often"))
    rows = counts.toArrow()  # at most a row for each label, language and part of a logit
    return rows["logit"].to_numpy() / PARTS, *(rows[c].to_numpy() for c in ("language", "y", "often"))


def _scoring(model: Model | float):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.full(len(batch), model) if isinstance(model, float) else model.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], schema=schema)

    return run


def train(docs: DataFrame, labels: DataFrame, keep: Column, most: int = SAMPLE) -> Model | float:
    """Fit on at most ``most`` labelled documents of either label for which ``keep`` (on ``doc_id``) holds; calibrate on all others."""
    listed = settle(known(labels, "toxic", keep))
    rows = sampled(id_and_text(docs), listed, most)
    model = fit(rows["text"].to_pylist(), rows["y"].to_pylist())
    if isinstance(model, Model):
        held, y = _held(len(rows)), rows["y"].to_numpy()
        ids = rows["doc_id"].to_numpy()[~held]
        del rows
        found = _calibration(model, docs, listed, ids)
        # either label weighs as much as in the fifth of the sample, however many more documents it has
        calibrate(model, *found, np.bincount(y[held], minlength=2) / np.maximum(np.bincount(found[2], found[3], minlength=2), 1))
    release()
    return model


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """``doc_id, score`` of every row; at least 0.5 means toxic."""
    return id_and_text(docs).mapInArrow(_scoring(model), "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model | float) -> DataFrame:
    """The rows of ``docs`` that score under 0.5, all columns kept."""
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.full(len(batch), model) if isinstance(model, float) else model.scores(batch.column(text))
            yield batch.filter(pa.array(score < 0.5))
        release()

    return docs.mapInArrow(run, docs.schema)
