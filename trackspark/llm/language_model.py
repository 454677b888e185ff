"""Pseudo-likelihood of documents: a bidirectional window network predicts every word from both sides.

A word's log-probability has two factors: that of its frequency class given the ``SPAN`` words before and after it, by a
small network, and that of the word within its class, by its share of the corpus. A document's score is the sum over
all its words, each left out in turn.

Every distinct word (its 64-bit hash) is counted exactly, in a Spark table. Classes cut that table, in order of count, into
ranges of equal mass (words of equal count in order of hash), and a word's share of its class is exact. The at most
``FREQUENT`` most frequent words travel with the model; all others, of which none can be frequent, are looked up by a join of
each chunk's distinct words with the table. Only the network has a fixed size: the ``INPUTS`` most frequent words have an
embedding as context, all others share one.

Documents are encoded once, as classes and inputs of their words in chunks of about ``SLICE`` bytes, and the network is fitted
on these: in each of ``ROUNDS`` rounds every task starts from the same weights, runs through windows of all its documents
(every ``ROUNDS``-th position, another residue in each round, so each word is a target once), and the tasks' weights are
averaged by number of windows, in two steps so that no task gets those of all others. What is gathered of weights is of fixed size per task.

Defined cases: null and empty texts have no words, sum 0 and no mean; contexts end at the document's ends; without any
words in the corpus no model is fitted and there is nothing to score; repeated rows get one row each; words that the
corpus lacks count half an occurrence, as one more word of the last class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.llm.tables import id_and_text
from trackspark.llm.text import slices, words
from trackspark.session import settle

INPUTS, CLASSES = 4096, 64
#: Words that travel with the model; a word beyond them has less than this part of all occurrences.
FREQUENT = 1 << 18
#: Bytes of text in a chunk.
SLICE = 1 << 17
SPAN, SIZE, HIDDEN = 2, 16, 32
ROUNDS, BATCH, RATE = 2, 2048, 0.05
#: Groups of tasks whose weights are summed first; a group holds one task's weights at a time.
GROUPS = 64
#: Positions that are scored at a time.
CHUNK = 1 << 15
OFFSETS = (*range(-SPAN, 0), *range(1, SPAN + 1))


def buckets(hashes: np.ndarray) -> np.ndarray:
    """Keys of words: their hashes as the word table has them."""
    return hashes.view(np.int64)


class Column:
    """One figure of every word, by key, and of an unseen word; collects the word table, so for small corpora only."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, unseen: float) -> None:
        self.keys, self.values, self.unseen = keys, values, unseen

    def __getitem__(self, key):
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], self.unseen)[()]

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        return np.append(self.values, self.values.dtype.type(self.unseen)).astype(dtype or self.values.dtype)


@dataclass
class Model:
    """Input 0 stands for all words without an own one, input 1 for what lies beyond a document's ends."""

    table: DataFrame | None  # key, class and count of every word; not in tasks
    keys: np.ndarray  # frequent words, sorted
    known: np.ndarray  # class of each
    inputs_known: np.ndarray
    share: np.ndarray  # log share of each in its class
    total: np.ndarray  # occurrences by class
    weights: list[np.ndarray] = field(default_factory=list)  # embedding, mixing by offset, bias, output, its bias

    @classmethod
    def of_counts(cls, counts: DataFrame, seed: int = 0) -> Model:
        """Of the exact counts of all words; only figures by count, by class and of frequent words reach the driver."""
        by_count = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).toArrow().sort_by([("n", "descending")])
        value, number = by_count["n"].to_numpy(), by_count["words"].to_numpy()
        mass = np.cumsum(value * number)
        table = settle(counts.mapInArrow(_classing(value, number, mass), "key long, class int, n long"))
        total = np.zeros(CLASSES)
        sums = table.groupBy("class").agg(F.sum("n").alias("n")).toArrow()
        total[sums["class"].to_numpy()] = sums["n"].to_numpy()
        total[-1] += 0.5
        few = int((np.cumsum(number) <= FREQUENT).sum())
        rows = table.where(F.col("n") >= int(value[few - 1])).toArrow().sort_by("key") if few else table.limit(0).toArrow()
        keys, known, n = (rows[c].to_numpy() for c in ("key", "class", "n"))
        inputs = np.zeros(len(keys), np.int16)
        top = np.lexsort((keys, -n))[: INPUTS - 2]
        inputs[top] = np.arange(2, 2 + len(top))
        rng = np.random.default_rng(seed)
        weights = [
            rng.normal(0, 0.3, (INPUTS, SIZE)), rng.normal(0, 0.2, (len(OFFSETS), SIZE, HIDDEN)), np.full(HIDDEN, 0.1),
            rng.normal(0, 0.2, (HIDDEN, CLASSES)), np.log(np.maximum(total, 0.5) / total.sum()),
        ]
        share = np.log(n / total[known])
        return cls(table, keys, known.astype(np.uint8), inputs, share, total, [w.astype(np.float32) for w in weights])

    def for_tasks(self, lookup: bool = True) -> Model:
        """What tasks need: not the table, and frequent words only where words are looked up."""
        none = {} if lookup else {c: getattr(self, c)[:0] for c in ("keys", "known", "inputs_known", "share")}
        return replace(self, table=None, **none)

    def _column(self, name: str) -> Column:
        rows = self.table.toArrow().sort_by("key")
        keys, classes = rows["key"].to_numpy(), rows["class"].to_numpy()
        if name == "classes":
            return Column(keys, classes, CLASSES - 1)
        if name == "within":
            return Column(keys, np.log(rows["n"].to_numpy() / self.total[classes]), self.unseen)
        inputs = np.zeros(len(keys), np.int64)
        inputs[np.searchsorted(keys, self.keys)] = self.inputs_known
        return Column(keys, inputs, 0)

    @cached_property
    def classes(self) -> Column:
        return self._column("classes")

    @cached_property
    def within(self) -> Column:
        """Log share of each word in its class."""
        return self._column("within")

    @cached_property
    def inputs(self) -> Column:
        return self._column("inputs")

    @property
    def unseen(self) -> float:
        return float(np.log(0.5 / self.total[-1]))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words stand among the frequent ones, and which of them do."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def _forward(self, padded: np.ndarray, place: np.ndarray, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        hidden = self.weights[2] + sum(t[padded[place + o]] for t, o in zip(tables, OFFSETS, strict=True))
        hidden = np.maximum(hidden, 0)
        logits = hidden @ self.weights[3] + self.weights[4]
        logits -= logits.max(1, keepdims=True)
        return hidden, logits

    def tables(self) -> list[np.ndarray]:
        """What each input adds to the hidden layer from each offset."""
        return [self.weights[0] @ m for m in self.weights[1]]

    def class_scores(self, classes: np.ndarray, place: np.ndarray, padded: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """Log-probability of each word's class given its context."""
        out = np.empty(len(classes))
        for a in range(0, len(classes), CHUNK):
            part = slice(a, a + CHUNK)
            _, logits = self._forward(padded, place[part], tables)
            own = logits[np.arange(len(logits)), classes[part]]
            out[part] = own - np.log(np.exp(logits).sum(1))
        return out

    def learn(self, classes: np.ndarray, place: np.ndarray, padded: np.ndarray, speeds: list[np.ndarray]) -> None:
        """One step of adaptive gradient descent."""
        embedding, mixing, _, output, _ = self.weights
        around = [padded[place + o] for o in OFFSETS]
        vectors = [embedding[i] for i in around]
        hidden = np.maximum(self.weights[2] + sum(v @ m for v, m in zip(vectors, mixing, strict=True)), 0)
        logits = hidden @ output + self.weights[4]
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(p)), classes] -= 1
        p /= len(p)
        back = (p @ output.T) * (hidden > 0)
        ids = np.concatenate(around)
        order = np.argsort(ids, kind="stable")
        firsts = np.flatnonzero(np.diff(ids[order], prepend=-1))
        ids = ids[order[firsts]]
        moved = np.add.reduceat(np.concatenate([back @ m.T for m in mixing])[order], firsts, axis=0)
        gradients = [
            (ids, moved), (slice(None), np.stack([v.T @ back for v in vectors])), (slice(None), back.sum(0)),
            (slice(None), hidden.T @ p), (slice(None), p.sum(0)),
        ]
        for w, s, (at, gradient) in zip(self.weights, speeds, gradients, strict=True):
            s[at] += gradient**2
            w[at] -= RATE * gradient / np.sqrt(s[at])


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, raw, at in slices(batch.column(0)):
            keys, n = np.unique(buckets(words(raw, at)[0]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])


def count_words(docs: DataFrame) -> DataFrame:
    """``key, n``: occurrences of each word in all documents."""
    counted = docs.select("text").mapInArrow(_counting, "key long, n long")
    return settle(counted.groupBy("key").agg(F.sum("n").alias("n")))


def _classing(value: np.ndarray, number: np.ndarray, mass: np.ndarray):
    """Class of each word by the occurrences of words before it; ``value`` are the counts that occur, from the largest."""
    up, before = value[::-1], (mass - value * number)[::-1]
    among = number[::-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n = batch.column("key").to_numpy(), batch.column("n").to_numpy()
            at = np.searchsorted(up, n)
            rank = np.floor(key.view(np.uint64) / 2.0**64 * among[at])  # hashes are uniform
            number = (before[at] + n * (np.minimum(rank, among[at] - 1) + 0.5)) / mass[-1] * CLASSES
            classes = np.minimum(number, CLASSES - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(classes), batch.column("n")], ["key", "class", "n"])

    return run


ENCODED = "chunk long, ids array<long>, sizes array<int>, shares array<double>, inputs binary, classes binary, rare binary"


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values).tobytes(), codec="zstd", asbytes=True)


def _unpacked(value: pa.Scalar, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(value.as_buffer(), n * np.dtype(kind).itemsize, codec="zstd"), kind)


def _encoding(model: Model):
    """Chunks of documents by the frequent words; ``rare`` holds the keys of all others, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, j, raw, at in slices(batch.column(1), SLICE):
                hashes, _, _, counts = words(raw, at)
                keys, sizes = buckets(hashes), np.diff(counts)
                place, there = model.find(keys)
                classes, inputs = np.zeros(len(keys), np.uint8), np.zeros(len(keys), np.int16)
                classes[there], inputs[there] = model.known[place[there]], model.inputs_known[place[there]]
                shares = np.bincount(np.repeat(np.arange(j - i), sizes)[there], model.share[place[there]], j - i)
                # A frequent word's class counts from 1, 0 stands for a rare word.
                classes[there] += 1
                columns = [
                    pa.array([number], pa.int64()), pa.array([batch.column(0).slice(i, j - i)], pa.list_(pa.int64())),
                    pa.array([sizes], pa.list_(pa.int32())), pa.array([shares], pa.list_(pa.float64())),
                    *(pa.array([_packed(a)], pa.binary()) for a in (inputs, classes, keys[~there])),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "ids", "sizes", "shares", "inputs", "classes", "rare"])
                number += 1

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray]]:
    """Each chunk with its documents' sizes, its words' inputs and classes."""
    for batch in batches:
        for k in range(len(batch)):
            row = {c: batch.column(c)[k] for c in batch.schema.names}
            sizes = row["sizes"].values.to_numpy()
            n = int(sizes.sum())
            yield row, sizes, _unpacked(row["inputs"], n, np.int16), _unpacked(row["classes"], n, np.uint8)


def _rare_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, _, _, classes in _rows(batches):
        keys = np.unique(_unpacked(row["rare"], int((classes == 0).sum()), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), row["chunk"].as_py())), pa.array(keys)], ["chunk", "key"])


def _completing(model: Model):
    """Classes and shares of a chunk's rare words, from what the word table holds of them."""

    def run(chunks: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("key")
        key, known, n = (found[c].to_numpy() for c in ("key", "class", "n"))
        out = []
        for row, sizes, inputs, classes in _rows(iter(chunks.combine_chunks().to_batches())):
            classes, shares = classes.copy(), row["shares"].values.to_numpy().copy()
            rare = np.flatnonzero(classes == 0)
            keys = _unpacked(row["rare"], len(rare), np.int64)
            classes -= 1
            classes[rare] = CLASSES - 1
            own = np.full(len(rare), model.unseen)
            if len(key):
                at = np.minimum(np.searchsorted(key, keys), len(key) - 1)
                there = key[at] == keys
                classes[rare[there]] = known[at[there]]
                own[there] = np.log(n[at[there]] / model.total[known[at[there]]])
            shares += np.bincount(np.repeat(np.arange(len(sizes)), sizes)[rare], own, len(sizes))
            out.append([row["chunk"].as_py(), row["ids"].as_py(), sizes, shares, row["inputs"].as_py(), _packed(classes), b""])
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), chunks.schema.types, strict=True)], chunks.schema.names)

    return run


def encode(docs: DataFrame, model: Model) -> DataFrame:
    """Chunks of documents: ids, numbers of words, sums of log shares, and all words' inputs and classes."""
    light = model.for_tasks()
    chunks = settle(id_and_text(docs).mapInArrow(_encoding(light), ENCODED))
    rare = chunks.select("chunk", "sizes", "inputs", "classes", "rare").mapInArrow(_rare_words, "chunk long, key long")
    found = rare.join(model.table, "key").select("chunk", "key", "class", "n")
    whole = chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_completing(model.for_tasks(False)), ENCODED)
    return settle(whole)


def _contexts(sizes: np.ndarray, inputs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each word in the padded inputs, and these."""
    place = np.arange(len(inputs)) + SPAN * (1 + np.repeat(np.arange(len(sizes)), sizes))
    padded = np.ones(len(inputs) + SPAN * (len(sizes) + 1), np.int32)
    padded[place] = inputs
    return place, padded


def targets(turn: int, n: int) -> np.ndarray:
    """Positions that a round trains on; all rounds together take each once."""
    return np.arange(turn, n, ROUNDS)


def _training(model: Model, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = replace(model, weights=[w.copy() for w in model.weights])
        speeds, windows = [np.full_like(w, 1e-3) for w in own.weights], 0
        for _, sizes, inputs, classes in _rows(batches):
            place, padded = _contexts(sizes, inputs)
            take = targets(turn, len(classes))
            windows += len(take)
            for part in np.array_split(take, max(1, len(take) // BATCH)) if len(take) else ():
                own.learn(classes[part], place[part], padded, speeds)
        if windows:
            flat = np.concatenate([w.ravel() for w in own.weights]).astype(np.float64) * windows
            columns = [[TaskContext.get().partitionId()], [windows], [flat.astype(np.float32).tobytes()]]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["task", "windows", "weights"])

    return run


def _summing(key: tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of windows and weights of a group of tasks, held one row at a time."""
    windows, total = 0, np.zeros(1)
    for batch in rows:
        for n, w in zip(batch.column("windows"), batch.column("weights"), strict=True):
            windows, total = windows + n.as_py(), total + np.frombuffer(w.as_buffer(), np.float32)
    columns = [[key[0].as_py()], [windows], [total.astype(np.float32).tobytes()]]
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *map(pa.array, columns[1:])], ["task", "windows", "weights"])


def _count(docs: DataFrame) -> Model | None:
    counts = count_words(id_and_text(docs))
    return None if counts.isEmpty() else Model.of_counts(counts)


def _fit(chunks: DataFrame, model: Model) -> None:
    """Fit the network on all chunks."""
    for turn in range(ROUNDS):
        light = model.for_tasks(False)
        fitted = chunks.select("sizes", "inputs", "classes").mapInArrow(_training(light, turn), "task long, windows long, weights binary")
        for groups in (GROUPS, 1):
            grouped = fitted.withColumn("task", F.col("task") % groups).groupBy("task")
            fitted = grouped.applyInArrow(_summing, "task long, windows long, weights binary")
        got = fitted.first()
        if got is None:  # too few words for a window in this round
            continue
        flat = np.frombuffer(got["weights"], np.float32).astype(np.float64) / got["windows"]
        cuts = np.cumsum([w.size for w in model.weights])[:-1]
        model.weights = [
            part.reshape(w.shape).astype(np.float32) for part, w in zip(np.split(flat, cuts), model.weights, strict=True)
        ]


def train(docs: DataFrame) -> Model | None:
    """Count, and fit on, all texts of ``docs``; ``None`` for a corpus without words."""
    model = _count(docs)
    if model:
        _fit(encode(docs, model), model)
    return model


def _scores(chunks: DataFrame, model: Model) -> DataFrame:
    light = model.for_tasks(False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = light.tables()
        for row, sizes, inputs, classes in _rows(batches):
            own = light.class_scores(classes, *_contexts(sizes, inputs), tables)
            sums = row["shares"].values.to_numpy() + np.bincount(np.repeat(np.arange(len(sizes)), sizes), own, len(sizes))
            mean = pa.array(sums / np.maximum(sizes, 1), mask=sizes == 0)
            yield pa.RecordBatch.from_arrays(
                [row["ids"].values, pa.array(sizes.astype(np.int64)), pa.array(sums), mean],
                ["doc_id", "n_words", "log_likelihood", "mean_log_likelihood"],
            )

    read = chunks.select("ids", "sizes", "shares", "inputs", "classes")
    return read.mapInArrow(run, "doc_id long, n_words long, log_likelihood double, mean_log_likelihood double")


def _unscored(docs: DataFrame) -> DataFrame:
    none = {"n_words": F.lit(0).cast("long"), "log_likelihood": F.lit(0.0), "mean_log_likelihood": F.lit(None).cast("double")}
    return id_and_text(docs).select("doc_id", *(c.alias(name) for name, c in none.items()))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, n_words, log_likelihood, mean_log_likelihood`` of every row."""
    return _scores(encode(docs, model), model) if model else _unscored(docs)


def train_and_score(docs: DataFrame) -> DataFrame:
    """:func:`score` by a model of the same documents, which are encoded once for both."""
    model = _count(docs)
    if not model:
        return _unscored(docs)
    chunks = encode(docs, model)
    _fit(chunks, model)
    return _scores(chunks, model)
