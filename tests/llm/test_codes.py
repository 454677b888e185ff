"""Vector codes against comparing every part with every entry."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from trackspark.llm import codes

VECTORS = "vec_id long, embedding array<float>, label int, code string, error long, part int, entry string, near long"


def brute(rows):
    """Rows ``(id, vector, label)`` coded with Python integers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    wide = max(1, -(-max(len(r[1]) for r in kept) // 16))
    whole = [[math.floor(256 * x) for x in r[1]] + [0] * (16 * wide - len(r[1])) for r in kept]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0], kept[i][1]))[:64]
    books = [[whole[i][wide * j : wide * (j + 1)] for i in first] for j in range(16)]

    def assign():
        out = []
        for v in whole:
            row = []
            for j, book in enumerate(books):
                x = v[wide * j : wide * (j + 1)]
                row.append(min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book)))
            out.append(row)
        return out

    for _ in range(2):
        members = defaultdict(list)
        for v, row in zip(whole, assign(), strict=True):
            for j, (_, k) in enumerate(row):
                members[j, k].append(v[wide * j : wide * (j + 1)])
        for (j, k), xs in members.items():
            books[j][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    final = assign()
    errors = [sum(d for d, _ in row) for row in final]
    by_label = defaultdict(int)
    for r, e in zip(kept, errors, strict=True):
        by_label[r[2]] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(r[0], "".join(f"{k:02x}" for _, k in row), e, by_label[r[2]], sha) for r, row, e in zip(kept, final, errors, strict=True)]


def check(spark, rows):
    table = spark.createDataFrame([(*r, "c", 1, 2, "e", 3) for r in rows], VECTORS).repartition(3)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], n) for i, v, n in rows]
    got = sorted(map(tuple, codes.compress(table).collect()), key=str)
    assert got == sorted(brute(rows), key=str)


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(int(i), (rng.normal(size=32) / 4).tolist(), int(i) % 3 or None) for i in rng.permutation(250)]
    check(spark, rows)


def test_awkward_vectors(spark):
    rng = np.random.default_rng(10)
    nan, inf = float("nan"), float("inf")
    rows = [(i, rng.integers(-2, 2, 16).tolist(), None) for i in range(90)]  # ties everywhere, equal parts
    rows += [(3, [0.5] * 16, 1), (3, [0.25] * 16, 1), (None, [-0.001] * 16, 2), (100, None, 1), (101, [1.0, None], 1), (102, [nan] * 16, 1)]
    rows += [(103, [inf] * 16, 1), (104, [], 1), (105, [0.3] * 5, 1), (106, [40_000.0] * 17, 1)]
    check(spark, [(i, None if v is None else [None if x is None else float(x) for x in v], n) for i, v, n in rows])
    check(spark, [(5, [1.0, -1.0, 0.5], None)])


def test_empty_table_and_huge_components(spark):
    table = spark.createDataFrame([(1, [1e38] * 16, 0, "c", 1, 2, "e", 3), (2, [-1e38] * 16, 0, "c", 1, 2, "e", 3)], VECTORS)
    assert [r.error for r in codes.compress(table).collect()] == [0, 0]
    assert codes.compress(table.where("false")).count() == 0
    assert codes.compress(table.where("embedding is null")).count() == 0


@pytest.mark.parametrize("spread", [3, 300])
def test_pruning_is_exact_and_spares_most_entries(spread):
    rng = np.random.default_rng(11)
    parts, entries = rng.integers(-spread, spread, (2000, 4)), rng.integers(-spread, spread, (64, 4))
    pivots = codes.choose_pivots(entries[None])[0]
    near = codes.to_pivots(parts[:, None], pivots[None])[:, 0]
    index, least, evaluated = codes.nearest(parts, near, entries, pivots)
    squared = ((parts[:, None] - entries[None]) ** 2).sum(2)
    assert (index == squared.argmin(1)).all() and (least == squared.min(1)).all()
    assert evaluated < 0.25 * squared.size
