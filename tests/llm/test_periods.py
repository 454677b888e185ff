"""Periodic runs against brute force, and on awkward tables."""

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest

from trackspark.llm import periods


def brute(words):
    """All maximal stretches by comparing words at every distance, those of the smallest period."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i:
                found.setdefault((i, j + q), q)  # periods ascend
            i = max(j, i) + 1
    return sorted((s, e - s, q) for (s, e), q in found.items() if e - s >= max(24, 3 * q))


def texts(rng):
    out = [[], [b"a"], [b"a"] * 23, [b"a"] * 24, [b"a", b"b"] * 300, [b"x"] + [b"a", b"b", b"c"] * 8 + [b"x"]]
    for size in (2, 3, 30):
        out += [[b"%d" % i for i in rng.integers(0, size, n)] for n in (40, 90, 200)]
    for _ in range(40):
        words = [b"%d" % i for i in rng.integers(0, 3 if rng.random() < 0.4 else 50, int(rng.integers(0, 60)))]
        for _ in range(int(rng.integers(1, 4))):
            unit = [b"%d" % i for i in rng.integers(0, int(rng.integers(2, 9)), int(rng.integers(1, 20)))]
            many = int(rng.integers(2, 9))
            words += (unit * many)[: len(unit) * many - int(rng.integers(0, len(unit)))]
            words += [b"%d" % i for i in rng.integers(0, 50, int(rng.integers(0, 9)))]
        out.append(words)
    inner = ([b"p", b"q"] * 14 + [b"r"]) * 5  # runs within the periods of a run
    return [*out, inner, [b"f"] + inner + [b"f"] + inner]


def test_runs_equal_brute_force():
    documents = texts(np.random.default_rng(3))
    assert periods.runs(documents) == [brute(d) for d in documents]
    assert sum(map(len, periods.runs(documents))) > 50
    assert periods.runs(documents * 2) == periods.runs(documents) * 2


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(4)
    symbols = np.concatenate((rng.integers(0, 3, 300), np.tile([0, 1], 90), rng.integers(5, 8, 40)))
    ranks = periods._ranks(symbols)
    suffix = np.argsort(ranks[-1][:-1])
    s = symbols.tolist()
    assert suffix.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
    lcp = periods._common(ranks, suffix[:-1], suffix[1:])
    for i, j, n in zip(suffix[:-1].tolist(), suffix[1:].tolist(), lcp.tolist(), strict=True):
        assert s[i : i + n] == s[j : j + n] and (max(i, j) + n == len(s) or s[i + n] != s[j + n])


def test_planted_words():
    words = [b"%d" % i for i in range(100)]
    changed = 0
    for doc_id in range(300):
        h = zlib.crc32(str(doc_id).encode())
        got = periods.planted(doc_id, words)
        if h % 10:
            assert got == words
            continue
        g = h // 10
        a = g % 100
        p = 1 + (100 - a) // (3 + g % 8)
        assert got == [words[i if i < a else a + (i - a) % p] for i in range(100)]
        changed += 1
    assert changed and periods.planted(None, words) == words


DOCS = "doc_id long, text string, start long, length string, n_runs int"


@pytest.fixture(scope="module")
def awkward(spark):
    rng = np.random.default_rng(6)
    long = " ".join(f"w{i}" for i in rng.integers(0, 300, 300_000)) + " one two three" * 20_000
    rows = [(0, None), (1, ""), (2, " \n\t"), (None, "A\u00a0b " * 40), (4, long), (5, "x y " * 30), (5, "x y " * 30), (6, "é 日本 \x1f " * 20)]
    return spark.createDataFrame([(*r, 1, "l", 2) for r in rows], DOCS)


def test_report_on_awkward_tables(spark, awkward):
    got = periods.report(awkward).collect()
    assert len(got) == 8
    want = sorted((str(expected(r)) for r in awkward.where("doc_id <> 4 or doc_id is null").collect()))
    assert sorted(str(tuple(r)[:5]) for r in got if r.doc_id != 4) == want
    empty = hashlib.sha256(b"").hexdigest()
    for r in got:
        if r.doc_id in (0, 1, 2):
            assert tuple(r)[1:] == (0, None, None, None, None, empty, empty)
    nameless = next(r for r in got if r.doc_id is None)  # a no-break space is part of a word
    assert tuple(nameless)[1:6] == (1, 0, 40, 1, 40_000)
    twice = [r for r in got if r.doc_id == 5]
    assert len(twice) == 2 and twice[0] == twice[1]
    long = next(r for r in got if r.doc_id == 4)
    if zlib.crc32(b"4") % 10:
        assert (long.start, long.length, long.period) == (300_000, 60_000, 3)
    assert periods.report(awkward.where("false")).count() == 0


def expected(row):
    found = brute(periods.planted(row.doc_id, (row.text or "").encode().split()))
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    return (row.doc_id, len(found), *best)


def test_collapse(spark, awkward):
    got = {(r.doc_id, r.text) for r in periods.collapse(awkward).collect()}
    assert {(0, None), (1, ""), (2, " \n\t"), (5, "x y"), (None, "A\u00a0b"), (6, "é 日本 \x1f")} <= got
    assert periods.collapse(awkward).schema == awkward.schema
    assert len(next(t for i, t in got if i == 4).split()) == 300_003
    assert periods.collapse(awkward.where("false")).count() == 0
