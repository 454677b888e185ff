"""Personal data: patterns, and a skip-chain conditional random field that makes labels agree across a document.

Patterns find e-mail addresses, IP addresses, payment cards and phone numbers; these spans always stay. The field runs
over the tokens that hold a digit or an at sign. Neighbouring tokens share a chain potential; all tokens of a document
that are the same, or whose last digits are, form a group, and each shares a skip potential with the group's own label, however
far apart they are (n edges for n tokens; a pattern's last token also stands for all digits of its span). A group's label is
seen where a pattern matched one of its tokens, so every recurrence is two edges from what the patterns are sure of and
other recurrences take nothing from it. Loopy belief propagation runs until messages stop changing, and a token outside of
all patterns becomes a span where one kind's marginal reaches ``SURE``.

Weights are fitted by pseudo-likelihood on at most ``SAMPLE`` documents, with the patterns' spans as labels; unmatched
recurrences of matched tokens are no examples of anything. Inference covers every whole text, all documents of a batch in
one graph.

Defined cases: a null text is empty and has no spans; repeated rows get one row each; an empty table gives no rows; without
any token to learn from only patterns are reported. Only id and text are read, and only the text is changed by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.llm.labelled import one_text
from trackspark.llm.tables import id_and_text, release

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 2000
SURE = 0.9
#: Hashed features of a token, label 0 being none.
FEATURES = 512
FIGURES = 9  # features per token
#: Messages that change less than this have come to rest. Steps are halved whenever news had ``PATIENCE`` rounds for each
#: token of the longest document to pass it, so messages that circle come to rest too.
STILL, PATIENCE = 1e-4, 4
#: Log weight of what was seen not to be.
NEVER = -1e6
EPOCHS, RATE = 120, 0.5

# A run of digits that fails to start a pattern fails at all its later digits too, so patterns start at its first one.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = ".,;:!?()[]{}<>\"'|"


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text, start - 1):
            start -= 1
        match = DOMAIN.match(text, at) if start < at else None
        if match:
            end = match.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def patterns(text: str) -> list[tuple[int, int, int]]:
    """``start, kind, end`` of each span, sorted; kinds are numbers into ``KINDS``."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(found)


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def _features(token: str, before: str) -> list[int]:
    digits = sum(c.isdigit() for c in token)
    shape = re.sub(r"[a-z]+", "a", re.sub(r"[0-9]+", "9", token.lower()))[:12]
    names = (
        f"shape {shape}", f"digits {min(digits, 20)}", f"length {min(len(token), 40) // 3}", f"dots {min(token.count('.'), 5)}",
        f"at {'@' in token}", f"plus {token[:1] == '+'}", f"dashes {min(token.count('-'), 4)}", f"all {digits == len(token)}",
        f"before {before.lower()[:12]}",
    )
    return [crc32(n.encode()) % FEATURES for n in names]


class Graph:
    """Tokens of several documents with their edges; tokens of different documents share none."""

    def __init__(self) -> None:
        self.tokens: list[tuple[int, int, int]] = []  # document, start, end
        self.features: list[list[int]] = []
        self.seen: list[int] = []  # label by the patterns, 0 for none
        self.edges: list[tuple[int, int, int]] = []  # two neighbouring tokens and the chain's potential, 0
        self.groups: list[tuple[int, ...]] = []  # tokens that are the same or end in the same digits

    def add(self, number: int, text: str, spans: list[tuple[int, int, int]]) -> None:
        if "@" not in text and not DIGIT.search(text):
            return
        ends = [b for _, b in sorted((a, b) for a, _, b in spans)]
        starts = [(a, k + 1) for a, k, _ in sorted(spans, key=lambda s: (s[2], s[0]))]
        ends.sort()
        alike: dict[str, list[int]] = {}
        previous, before, place, place_before = -1, "", 0, -9
        for match in TOKEN.finditer(text):
            place += 1
            word = match[0]
            if "@" not in word and not DIGIT.search(word):
                before = word
                continue
            core = word.strip(EDGE) or word
            start = match.start() + word.find(core)
            end, node = start + len(core), len(self.tokens)
            k = bisect_left(ends, start + 1)
            label = starts[k][1] if k < len(ends) and starts[k][0] < end else 0
            self.tokens.append((number, start, end))
            self.features.append(_features(core, before))
            self.seen.append(label)
            if previous >= 0 and place - place_before <= 2:
                self.edges.append((previous, node, 0))
            shown = text[starts[k][0] : ends[k]] if label and ends[k] <= match.end() else core
            digits = "".join(c for c in shown if "0" <= c <= "9")
            for name in {core.lower(), "~" + digits[-7:] if len(digits) >= 7 else core.lower()}:
                alike.setdefault(name, []).append(node)
            previous, place_before, before = node, place, word
        chained = {(a, b) for a, b, _ in self.edges}
        self.groups += sorted({tuple(g) for g in alike.values() if len(g) > 1 and (len(g) > 2 or tuple(g) not in chained)})

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = len(self.tokens)
        return (
            np.array(self.tokens, np.int64).reshape(n, 3), np.array(self.features, np.int64).reshape(n, FIGURES),
            np.array(self.seen, np.int64), np.array(self.edges, np.int64).reshape(-1, 3),
        )

    def members(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each token of each group, its group, and how often patterns saw which label in each group."""
        group = np.repeat(np.arange(len(self.groups)), [len(g) for g in self.groups])
        token = np.array([t for g in self.groups for t in g], np.int64)
        tally = np.zeros((len(self.groups), len(KINDS) + 1))
        np.add.at(tally, (group, np.array(self.seen, np.int64)[token]), 1)
        tally[:, 0] = 0
        return token, group, tally


def fit(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features by label, and the potentials of chain and skip edges between two labels."""
    graph, labels = Graph(), len(KINDS) + 1
    for i, text in enumerate(texts):
        graph.add(i, text, patterns(text))
    _, features, y, edges = graph.arrays()
    n = len(y)
    weights, pair = np.zeros((FEATURES, labels)), np.zeros((2, labels, labels))
    if not n:
        return weights, pair
    token, group, tally = graph.members()
    matched = tally.sum(1) > 0
    unknown = np.zeros(n, bool)
    unknown[token[matched[group]]] = True
    unknown &= y == 0
    truth = np.eye(labels)[y]
    near = np.zeros((2, n, labels))  # labels next to each token, by kind of edge
    for a, b in ((0, 1), (1, 0)):
        known = edges[~unknown[edges[:, b]]]
        np.add.at(near[0], (known[:, a], y[known[:, b]]), 1)
    # A group's label as its other tokens show it.
    others = tally[group] - truth[token] * (y[token] > 0)[:, None]
    others[:, 0] = ~matched[group]
    np.add.at(near[1], token, others / np.maximum(others.sum(1, keepdims=True), 1))
    near[:, unknown] = 0
    bare = np.bincount(token[matched[group]], minlength=n) * (near[1, :, 1:].sum(1) > 0) > 0
    for epoch in range(2 * EPOCHS):
        # Every other time, recurrences of what patterns matched are seen in a form that says nothing.
        hidden = bare & (epoch % 2 > 0)
        z = weights[features].sum(1) * ~hidden[:, None] + sum(near[k] @ pair[k] for k in (0, 1))
        p = np.exp(z - z.max(1, keepdims=True))
        error = (p / p.sum(1, keepdims=True) - truth) * ~unknown[:, None]
        gradient = np.zeros_like(weights)
        np.add.at(gradient, features[~hidden], error[~hidden, None, :])
        seen = np.bincount(features.ravel(), minlength=FEATURES)[:, None] + 1
        weights -= RATE * (gradient / seen + 1e-4 * weights)
        for k in (0, 1):
            own = near[k].T @ error / (near[k].sum(0)[:, None] + 1)
            pair[k] -= RATE * ((own + own.T) / 2 + 1e-4 * pair[k])
    return weights, pair


def marginals(graph: Graph, weights: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Probability of each label for each token, by damped loopy belief propagation."""
    tokens, features, seen, edges = graph.arrays()
    token, group, tally = graph.members()
    labels, n = len(KINDS) + 1, len(seen)
    patience = PATIENCE * (10 + int(np.bincount(tokens[:, 0]).max(initial=0)))
    node = weights[features].sum(1) + np.where(np.eye(labels, dtype=bool)[seen] & (seen > 0)[:, None], 12.0, 0.0)
    shares = tally / np.maximum(tally.sum(1, keepdims=True), 1)
    groups = np.where(tally > 0, np.log(np.maximum(shares, 1e-9)), NEVER) * (tally.sum(1, keepdims=True) > 0)
    edges = np.concatenate((edges, np.stack((token, n + group, np.ones_like(token)), 1)))
    source, target = np.concatenate((edges[:, 0], edges[:, 1])), np.concatenate((edges[:, 1], edges[:, 0]))
    kind, m = np.concatenate((edges[:, 2], edges[:, 2])), len(edges)
    back = np.concatenate((np.arange(m, 2 * m), np.arange(m)))
    message, total = np.zeros((2 * m, labels)), np.concatenate((node, groups))
    step, rounds, live = 0.5, 0, np.arange(2 * m)
    while len(live):
        sent = (total[source[live]] - message[back[live]])[:, :, None] + pair[kind[live]]
        most = sent.max(1, keepdims=True)
        new = np.log(np.exp(sent - most).sum(1)) + most[:, 0]
        new -= new.max(1, keepdims=True)
        change = step * (new - message[live])
        message[live] += change
        np.add.at(total, target[live], change)
        moved = np.abs(change).max(1) > STILL * step
        # Next come messages still on their way, and those out of tokens whose belief has moved.
        again, reached = np.zeros(2 * m, bool), np.zeros(len(total), bool)
        again[live[moved]] = reached[target[live[moved]]] = True
        rounds += 1
        step = 0.5 ** (1 + rounds // patience)
        live = np.flatnonzero(again | reached[source]) if step > STILL else live[:0]
    total = total[:n]
    p = np.exp(total - total.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def find(texts: list[str], model: tuple[np.ndarray, np.ndarray]) -> tuple[list[list], list[list]]:
    """Spans by patterns, and those that the field adds, of each text."""
    base = [patterns(t) for t in texts]
    graph = Graph()
    for i, (text, spans) in enumerate(zip(texts, base, strict=True)):
        graph.add(i, text, spans)
    added: list[list] = [[] for _ in texts]
    if graph.tokens:
        p = marginals(graph, *model)
        best = p[:, 1:].argmax(1)
        for node in np.flatnonzero((p[np.arange(len(p)), best + 1] >= SURE) & (np.array(graph.seen) == 0)).tolist():
            i, start, end = graph.tokens[node]
            if all(b <= start or end <= a for a, _, b in base[i]):
                added[i].append((start, int(best[node]), end))
    return base, added


def train(docs: DataFrame, most: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Fit on at most ``most`` documents, picked by hash of the id; of several texts under one id one is taken."""
    docs = id_and_text(docs)
    ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = one_text(docs.where("text is not null").join(F.broadcast(ids), "doc_id", "leftsemi")).toArrow().sort_by("doc_id")["text"].to_pylist()
    model = fit(texts)
    release()
    return model


def scan(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``doc_id, base, added`` of every row: spans as kind:start:end, comma-joined, in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, added = find([t or "" for t in batch.column(1).to_pylist()], model)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(shown, base), pa.string()), pa.array(map(shown, added), pa.string())],
                ["doc_id", "base", "added"],
            )

    return id_and_text(docs).mapInArrow(run, "doc_id long, base string, added string")


def report(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Counts of the patterns' spans, their digest, and all spans of every row."""
    names = [f"n_{k}" for k in KINDS]
    schema = "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, added = find([t or "" for t in batch.column(1).to_pylist()], model)
            counts = [pa.array([sum(s[1] == k for s in spans) for spans in base], pa.int64()) for k in range(len(KINDS))]
            digest = [hashlib.sha256(shown(spans).encode()).hexdigest() for spans in base]
            every = [shown(a + b) for a, b in zip(base, added, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(digest, pa.string()), pa.array(every, pa.string())],
                ["doc_id", *names, "base_sha256", "spans"],
            )

    return id_and_text(docs).mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind; overlapping spans go as one, named after the first."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``docs`` with all spans of ``text`` masked, other columns as they are."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            base, added = find([t or "" for t in texts], model)
            new = [t and masked(t, a + b) for t, a, b in zip(texts, base, added, strict=True)]
            yield batch.set_column(place, batch.schema.field(place), pa.array(new, batch.schema.field(place).type))
        release()

    return docs.mapInArrow(run, docs.schema)
