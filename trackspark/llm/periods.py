"""Periodic runs of words, found by the branching-tandem test over an enhanced suffix array.

A run is a stretch of words with smallest period q that is at least ``max(LEAST, TIMES * q)`` words long and that no
neighbouring word extends. Where a run ends lies its last square: two suffixes q words apart whose longest common prefix is
exactly q. Both are in the LCP interval of depth q, in different children of it. So for each LCP interval the suffixes of all
children but the largest are taken, and the inverse suffix array says at once whether the suffix ``depth`` words before or after
lies in the interval as well (small to large: n log n tests). A square found is rotated to the left as long as its words agree,
in strides of powers of two; equal stretches merge into one run of the smallest period.

Everything is arrays: ranks of the words' prefixes of length 1, 2, 4, ... (each suffix only as long as it isn't alone) give the
suffix array, its inverse, and by descending over the lengths all longest common prefixes and rotations. Interval borders are
next smaller values, found by descending over range minima. There are no tree nodes and no stack.

Words of many documents are handled together; a word is numbered apart in each document, so no prefix is shared by two
documents. Two necessary conditions spare work, nothing else: in a run some ``WINDOW`` words come again within the document, so
documents without such words have none; and an interval of depth q needs as many suffixes as a run has whole periods.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+`` of the whole text; null and empty texts have no words, no run and an empty
collapsed text; a null id changes no words; every row gives one row, whether or not its id is repeated.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trackspark.llm.tables import id_and_text
from trackspark.llm.text import mix

LEAST, TIMES = 24, 3
#: log2 of the words that come again at least: a run of period q repeats max(LEAST - q, (TIMES - 1) * q) words.
LEVELS = (LEAST * (TIMES - 1) // TIMES).bit_length() - 1
WINDOW = 1 << LEVELS
#: Words that are handled at a time; a longer document is handled alone.
WORDS = 1 << 18

Run = tuple[int, int, int]


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of one document in ten, chosen by its id, made periodic from some word on."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _numbered(documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, equal for equal words, and the document of each word."""
    codes: dict[bytes, int] = {}
    total = sum(map(len, documents))
    numbers = np.fromiter((codes.setdefault(w, len(codes)) for d in documents for w in d), np.int64, total)
    return numbers, np.repeat(np.arange(len(documents)), [len(d) for d in documents])


def _repeating(numbers: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The documents in which some ``WINDOW`` words come twice (others may be named too, by chance)."""
    hashes = mix((owner << 40 | numbers).astype(np.uint64), 21)
    for level in range(LEVELS):
        step = 1 << level
        if len(hashes) <= step:
            return np.zeros(0, np.int64)
        hashes = mix(hashes[:-step] * np.uint64(0x9E3779B97F4A7C15) + hashes[step:], 22)
    tagged = np.sort(owner[: len(hashes)].astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24))
    return np.unique(tagged[1:][tagged[1:] == tagged[:-1]] >> np.uint64(40)).astype(np.int64)


# --- enhanced suffix array ---------------------------------------------------------


def _ranks(symbols: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... symbols, until no two are equal.

    A rank is the number of suffixes with a smaller prefix, so the last is the inverse suffix array. Each array has one more
    element, -1, for the end.
    """
    n = len(symbols)
    _, inverse, count = np.unique(symbols, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - count)[inverse]
    out, active = [np.append(rank, -1)], np.flatnonzero(count[inverse] > 1)
    while len(active):
        step = 1 << (len(out) - 1)
        first = rank[active]
        second = out[-1][np.minimum(active + step, n)] + 1
        order = np.argsort(first * (n + 2) + second, kind="stable")
        active, first, second = active[order], first[order], second[order]
        place = np.arange(len(active))
        group = np.append(True, first[1:] != first[:-1])
        new = group | np.append(True, second[1:] != second[:-1])
        at = np.maximum.accumulate(np.where(new, place, 0))
        rank = rank.copy()
        rank[active] = first + at - np.maximum.accumulate(np.where(group, place, 0))
        out.append(np.append(rank, -1))
        alone = new & np.append(new[1:], True)
        active = active[~alone]
    return out


def _common(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Longest common prefixes of the suffixes at ``i`` and ``j``."""
    i, j = i.copy(), j.copy()
    start = i.copy()
    for level in range(len(ranks) - 1, -1, -1):
        same = (ranks[level][i] == ranks[level][j]).astype(np.int64) << level
        i += same
        j += same
    return i - start


def _smaller(lcp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest places before and after ``at`` with smaller values; both ends of ``lcp`` hold 0."""
    minima = [lcp]
    while True:
        step = 1 << (len(minima) - 1)
        if len(minima[-1]) <= step:
            break
        wider = np.minimum(minima[-1][:-step], minima[-1][step:])
        if not (wider > 0).any():
            break
        minima.append(wider)
    left, right, value = at - 1, at + 1, lcp[at]
    for level in range(len(minima) - 1, -1, -1):
        step, low = 1 << level, minima[level]
        start = left - step + 1
        left = left - (((start >= 0) & (low[np.clip(start, 0, len(low) - 1)] >= value)).astype(np.int64) << level)
        right = right + (((right < len(low)) & (low[np.minimum(right, len(low) - 1)] >= value)).astype(np.int64) << level)
    return left, right


def _children(lcp: np.ndarray, least: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, ...]:
    """All children but the largest of each LCP interval: first and last place, depth, and borders of the interval.

    ``least`` gives how many suffixes an interval of some depth needs.
    """
    at = np.flatnonzero(lcp > 0)
    low, after = _smaller(lcp, at)
    use = after - low >= least(lcp[at])
    at, low, high = at[use], low[use], after[use] - 1
    order = np.lexsort((at, high, low))
    at, low, high = at[order], low[order], high[order]
    new = np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]))[: len(at)]
    last = np.append(new[1:], True)[: len(at)]
    # a child begins at the interval's border and at each place of its depth, and ends before the next
    first = np.concatenate((low[new], at))
    end = np.concatenate((at[new] - 1, np.where(last, high, np.append(at[1:], 0)[: len(at)] - 1)))
    interval = np.concatenate((np.cumsum(new)[new], np.cumsum(new)))
    depth, low, high = (np.concatenate((x[new], x)) for x in (lcp[at], low, high))
    order = np.lexsort((end - first, interval))
    largest = np.append(interval[order][1:] != interval[order][:-1], True)[: len(order)]
    rest = order[~largest]
    return first[rest], end[rest], depth[rest], low[rest], high[rest]


def _squares(ranks: list[np.ndarray], lcp: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the last squares of runs begin, and half their lengths."""
    n = len(suffix)
    first, end, depth, low, high = _children(lcp, lambda q: np.maximum(LEAST, TIMES * q) // q)
    size = end - first + 1
    place = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
    depth, low, high = (np.repeat(x, size) for x in (depth, low, high))
    word, inverse, at = ranks[0], ranks[-1], suffix[place]
    found = []
    for start, other in ((at, at + depth), (at - depth, at - depth)):
        inside = (other >= 0) & (other < n)
        there = inverse[np.clip(other, 0, n)]
        inside &= (low <= there) & (there <= high)
        start, q = start[inside], depth[inside]
        branching = word[start + q] != word[np.minimum(start + 2 * q, n)]
        found.append((start[branching] * (n + 1)) + q[branching])
    return np.divmod(np.unique(np.concatenate(found)), n + 1)


def runs_of(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of all runs, by start and period."""
    none = np.zeros(0, np.int64)
    if not len(symbols):
        return none, none, none
    ranks = _ranks(symbols)
    suffix = np.empty(len(symbols), np.int64)
    suffix[ranks[-1][:-1]] = np.arange(len(symbols))
    lcp = np.concatenate(([0], _common(ranks, suffix[:-1], suffix[1:]), [0]))
    square, q = _squares(ranks, lcp, suffix)
    start, end = square.copy(), square + 2 * q
    for level in range(len(ranks) - 1, -1, -1):
        back = start - (1 << level)
        same = (back >= 0) & (ranks[level][np.maximum(back, 0)] == ranks[level][np.maximum(back, 0) + q])
        start = np.where(same, back, start)
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    least = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))[: len(start)]
    least &= end - start >= np.maximum(LEAST, TIMES * q)
    start, length, q = start[least], (end - start)[least], q[least]
    order = np.lexsort((q, start))
    return start[order], length[order], q[order]


def runs(documents: list[list[bytes]]) -> list[list[Run]]:
    """The runs ``(start, length, period)`` of each document, by start and period."""
    out: list[list[Run]] = [[] for _ in documents]
    if not any(documents):
        return out
    numbers, owner = _numbered(documents)
    with_runs = _repeating(numbers, owner)
    if len(with_runs):
        use = np.isin(owner, with_runs)
        numbers, owner = numbers[use], owner[use]
        begins = np.searchsorted(owner, with_runs)
        for start, length, period in zip(*(x.tolist() for x in runs_of(owner << 40 | numbers)), strict=True):
            d = int(owner[start])
            out[d].append((start - int(begins[np.searchsorted(with_runs, d)]), length, period))
    return out


# --- documents -----------------------------------------------------------------------


def collapsed(words: list[bytes], found: list[Run]) -> list[bytes]:
    """The words outside of runs, and of each run its first period."""
    if not found:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in found:
        keep[start + period : start + length] = False
    return list(compress(words, keep.tolist()))


def _report(doc_id: int | None, words: list[bytes], found: list[Run]) -> tuple:
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (
        doc_id, len(found), *(best or (None, None, None)), None if best is None else 1000 * best[1] // best[2],
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest(),
    )


SCHEMA = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")]
    + [(c, pa.string()) for c in ("runs_sha256", "collapsed_sha256")]
)


def _groups(batch: pa.RecordBatch, change: Callable[[int | None, list[bytes]], list[bytes]]) -> Iterator[tuple[list, list[list[bytes]]]]:
    ids, documents, held = [], [], 0
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        words = change(doc_id, (text.as_buffer().to_pybytes() if text.is_valid else b"").split())
        if held and held + len(words) > WORDS:
            yield ids, documents
            ids, documents, held = [], [], 0
        ids.append(doc_id)
        documents.append(words)
        held += len(words)
    if ids:
        yield ids, documents


def report(docs: DataFrame, change: Callable[[int | None, list[bytes]], list[bytes]] = planted) -> DataFrame:
    """Number of runs, the run of most periods, and digests of runs and collapsed text, of every row of ``docs``.

    ``change`` is applied to the words of each document first.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, documents in _groups(batch, change):
                rows = [_report(*x) for x in zip(ids, documents, runs(documents), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)

    return id_and_text(docs).mapInArrow(run, ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in SCHEMA))


def collapse(docs: DataFrame) -> DataFrame:
    """``docs`` with the words of each text that a run repeats taken out; texts without runs stay as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            words = [(t or "").encode().split() for t in texts]
            cut, first, held = [], 0, 0
            for i, own in enumerate([*words, []]):
                if i == len(words) or held and held + len(own) > WORDS:
                    cut += [b" ".join(collapsed(w, r)).decode() if r else None for w, r in zip(words[first:i], runs(words[first:i]), strict=True)]
                    first, held = i, 0
                held += len(own)
            new = pa.array([t if c is None else c for t, c in zip(texts, cut, strict=True)], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), new)

    return docs.mapInArrow(run, docs.schema)


def oracle() -> str:
    """DuckDB SQL for :func:`report` over documents: all pairs of equal windows of words, at all distances."""
    crc = (
        "xor(4294967295, list_reduce(flatten(list_transform(range(1, length({0}) + 1), lambda i: [ascii({0}[i]), -1, -1, -1, -1, -1, -1, -1, -1])), "
        "lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, 4294967295))"
    ).format("CAST(doc_id AS VARCHAR)")
    return f"""
    WITH t AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, CAST({crc} AS BIGINT) AS h FROM documents),
    c AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM t),
    d AS MATERIALIZED (SELECT k, doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1]
          ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) END AS w, n FROM c),
    x AS MATERIALIZED (SELECT k, i, hash(w[i + 1:i + {WINDOW}]) AS s FROM (SELECT k, w, unnest(range(0, n - {WINDOW} + 1)) AS i FROM d)),
    m AS (SELECT x.k, x.i, y.i - x.i AS q FROM x JOIN x AS y ON x.k = y.k AND x.s = y.s AND x.i < y.i),
    e AS (SELECT k, q, min(i) AS start, max(i) - min(i) + {WINDOW} + q AS length FROM (
          SELECT k, q, i, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS z FROM m) GROUP BY k, q, z),
    r AS MATERIALIZED (SELECT k, start, length, min(q) AS period FROM e WHERE length >= greatest({LEAST}, {TIMES} * q) GROUP BY k, start, length),
    b AS (SELECT k, count(*) AS n_runs, arg_min(struct_pack(start := start, length := length, period := period), struct_pack(
          e := -CAST(length AS DOUBLE) / period, s := start, p := period)) AS best,
          sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256 FROM r GROUP BY k),
    u AS (SELECT DISTINCT k, unnest(range(start + period, start + length)) AS i FROM r),
    v AS (SELECT k, w[i + 1] AS word, i FROM (SELECT k, w, unnest(range(0, n)) AS i FROM d)),
    o AS (SELECT v.k, string_agg(word, ' ' ORDER BY v.i) AS kept FROM v LEFT JOIN u ON u.k = v.k AND u.i = v.i WHERE u.k IS NULL GROUP BY v.k)
    SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, best.start AS start, best.length AS length, best.period AS period,
        1000 * best.length // best.period AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
    FROM d LEFT JOIN b USING (k) LEFT JOIN o USING (k)"""
