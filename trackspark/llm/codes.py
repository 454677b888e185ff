"""Vector codes by part codebooks, entries found through LAESA pivots.

Components become integers and vectors are cut into equal parts; each part position has a codebook that starts as that part of
the smallest ids and moves to the means of the parts it is nearest to. All distances are exact integers.

Each part position has a few fixed pivots, chosen once among the starting entries so that they lie far from each other. The
distances of every part to its pivots are computed once and stored with the integers. In a round only the distances from
entries to pivots are new: by the triangle inequality the largest difference of the two is a lower bound of the distance from
part to entry. Entries are tried in the order of their bounds, and a part is done when the next bound exceeds the best distance
found, so most entries are never compared. Bounds carry a margin for rounding; ties always go to the lower index.

Tasks sum up their parts by entry, so a round sends at most one row per task, part, entry and position; the driver holds
codebooks, which do not grow with the table.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped; vectors of other lengths are
filled up with zeros to the longest length, rounded up to a multiple of the parts (an empty vector is all zeros); integers
beyond ``LARGEST`` are held at it; rows with equal ids are separate rows, ordered by their vectors where the smallest ids are
taken; null ids come last there; with fewer rows than entries there are as many entries as rows; null labels are equal to each
other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.llm.tables import small
from trackspark.session import settle

SCALE = 256
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Pivots of each part position.
PIVOTS = 5
#: Largest size of a component: squared distances and their sums stay within longs.
LARGEST = 1 << 24
#: Parts that are compared at a time.
STEP = 1 << 14
#: Relative error of the stored distances to pivots, with room to spare.
MARGIN = 1e-6


@dataclass
class Codebooks:
    """``entries``: integers by part, entry and position; ``pivots`` likewise, fixed from the start."""

    entries: np.ndarray
    pivots: np.ndarray

    def moved(self, sums: dict[tuple[int, int, int], int]) -> Codebooks:
        """Entries replaced by the means, rounded down, of the parts assigned to them; position -1 holds the count."""
        entries = self.entries.copy()
        for (part, entry, position), total in sums.items():
            if position >= 0:
                entries[part, entry, position] = total // sums[part, entry, -1]
        return Codebooks(entries, self.pivots)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integers(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * values.astype(np.float64)), -LARGEST, LARGEST).astype(np.int64)


def choose_pivots(entries: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Of each part position, entries of largest summed distance to those chosen before; the first is entry 0."""
    out = []
    for part in entries:
        chosen, total = [0], np.zeros(len(part))
        while len(chosen) < min(count, len(part)):
            total += _distance(part, part[chosen[-1]])
            total[chosen] = -1
            chosen.append(int(total.argmax()))
        out.append(part[chosen])
    return np.array(out)


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - y) ** 2).sum(-1, dtype=np.int64).astype(np.float64))


def to_pivots(parts: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of parts (rows, part, position) to the pivots of their part position: (rows, part, pivot)."""
    return np.stack([_distance(parts, pivots[:, k]) for k in range(pivots.shape[1])], -1).astype(np.float32)


def nearest(parts: np.ndarray, near: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of parts of one position: index and squared distance of the nearest entry, and how many distances were evaluated.

    ``near`` holds the parts' distances to the pivots. Entries with smaller bounds come first.
    """
    own = np.stack([_distance(entries, p) for p in pivots], -1)
    bound = np.zeros((len(parts), len(entries)))
    for k in range(len(pivots)):
        x, y = near[:, k].astype(np.float64)[:, None], own[None, :, k]
        np.maximum(bound, np.abs(x - y) - MARGIN * (x + y), out=bound)
    order = np.argsort(bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, 1)
    index = np.zeros(len(parts), np.int64)
    least = np.full(len(parts), np.iinfo(np.int64).max)
    active, evaluated = np.arange(len(parts)), 0
    for k in range(len(entries)):
        active = active[bound[active, k] <= np.sqrt(least[active].astype(np.float64)) * (1 + 1e-12)]
        if not len(active):
            break
        entry = order[active, k]
        found = ((parts[active] - entries[entry]) ** 2).sum(1)
        evaluated += len(active)
        better = (found < least[active]) | ((found == least[active]) & (entry < index[active]))
        index[active[better]], least[active[better]] = entry[better], found[better]
    return index, least, evaluated


# --- tasks -----------------------------------------------------------------------


def _prepared(width: int, books: Codebooks):
    """Integers of each vector, and their distances to the pivots."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2).cast(pa.list_(pa.float64()))
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            values = integers(lists.flatten().to_numpy(zero_copy_only=False))
            rows = np.repeat(np.arange(len(size)), size)
            whole = np.zeros((len(size), width), np.int64)
            whole[rows, np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
            near = to_pivots(whole.reshape(len(size), PARTS, -1), books.pivots)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), _packed(whole.astype(np.int32)), _packed(near.reshape(len(size), -1))],
                ["vec_id", "label_key", "whole", "near"],
            )

    return run


def _packed(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _read(batch: pa.RecordBatch, books: Codebooks) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Steps of a batch: first row, integers by row, part and position, and distances to pivots."""
    for at in range(0, len(batch), STEP):
        step = batch.slice(at, STEP)
        whole, near = (
            np.frombuffer(b"".join(step.column(c).to_pylist()), kind).reshape(len(step), PARTS, -1)
            for c, kind in (("whole", np.int32), ("near", np.float32))
        )
        yield at, whole.astype(np.int64), near


def _assigned(whole: np.ndarray, near: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    index, squared = (np.zeros(whole.shape[:2], np.int64) for _ in range(2))
    for part in range(PARTS):
        index[:, part], squared[:, part], _ = nearest(whole[:, part], near[:, part], books.entries[part], books.pivots[part])
    return index, squared


def _summed(books: Codebooks):
    """What the parts of a task add up to by entry, in one row for each number that isn't zero."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, wide = books.entries.shape
        sums, counts = np.zeros((parts, entries, wide), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for _, whole, near in _read(batch, books):
                index, _ = _assigned(whole, near, books)
                for part in range(parts):
                    np.add.at(sums[part], index[:, part], whole[:, part])
                    counts[part] += np.bincount(index[:, part], minlength=entries)
        part, entry = np.nonzero(counts)
        n = wide + 1
        total = np.concatenate((counts[part, entry][:, None], sums[part, entry]), 1).ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(part, n)), pa.array(np.repeat(entry, n)), pa.array(np.tile(np.arange(-1, wide), len(part))), pa.array(total)],
            ["part", "entry", "position", "total"],
        )

    return run


def _coded(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, whole, near in _read(batch, books):
                index, squared = _assigned(whole, near, books)
                codes = [bytes(row).hex() for row in index.astype(np.uint8)]
                step = batch.slice(at, len(whole))
                yield pa.RecordBatch.from_arrays(
                    [step.column("vec_id"), step.column("label_key"), pa.array(codes, pa.string()), pa.array(squared.sum(1))],
                    ["vec_id", "label_key", "code", "error"],
                )

    return run


# --- jobs ------------------------------------------------------------------------


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every row with a whole vector."""
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label_key"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    )
    rows = rows.where("vector is not null and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    longest = rows.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    width = max(1, -(-longest // PARTS)) * PARTS
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).select("vector").collect()
    start = np.zeros((len(first), width), np.int64)
    for row, at in zip(first, start, strict=True):
        at[: len(row.vector)] = integers(np.array(row.vector, float))
    entries = start.reshape(len(first), PARTS, -1).transpose(1, 0, 2).copy()
    books = Codebooks(entries, choose_pivots(entries))
    stored = settle(rows.mapInArrow(_prepared(width, books), "vec_id long, label_key string, whole binary, near binary"))
    for _ in range(ROUNDS):
        sums = stored.select("whole", "near").mapInArrow(_summed(books), "part long, entry long, position long, total long")
        # at most a row for each number of the codebooks
        books = books.moved({(r.part, r.entry, r.position): r.total for r in sums.groupBy("part", "entry", "position").agg(F.sum("total").alias("total")).collect()})
    coded = settle(stored.mapInArrow(_coded(books), "vec_id long, label_key string, code string, error long"))
    by_label = small(coded.groupBy("label_key").agg(F.sum("error").alias("label_error")).withColumnRenamed("label_key", "own_key"))
    return coded.join(by_label, F.col("label_key").eqNullSafe(F.col("own_key"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")
    )


def oracle() -> str:
    """DuckDB SQL for :func:`compress` over embeddings, comparing every part with every entry."""
    def assigned(books: str) -> str:
        return f"""(SELECT vec_id, label, part, min({ENTRIES} * d + entry) AS m FROM (
            SELECT p.vec_id, p.label, p.part, c.entry, sum((p.x - c.x) * (p.x - c.x)) AS d FROM p JOIN {books} AS c USING (part, position)
            GROUP BY ALL) GROUP BY ALL)"""

    def moved(books: str, found: str) -> str:
        return f"""(SELECT c.part, c.entry, c.position, coalesce(s.mean, c.x) AS x FROM {books} AS c LEFT JOIN (
            SELECT part, entry, position, CAST((t - ((t % n) + n) % n) // n AS BIGINT) AS mean FROM (
            SELECT p.part, a.m % {ENTRIES} AS entry, p.position, sum(p.x) AS t, count(*) AS n FROM p JOIN {found} AS a USING (vec_id, part) GROUP BY ALL)
            ) AS s USING (part, entry, position))"""

    rounds = "".join(f"a{k} AS MATERIALIZED {assigned(f'c{k}')}, c{k + 1} AS MATERIALIZED {moved(f'c{k}', f'a{k}')}, " for k in range(ROUNDS))
    return f"""
    WITH v AS (SELECT vec_id, label, embedding AS e, len(embedding) // {PARTS} AS w FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS MATERIALIZED (SELECT vec_id, label, (i - 1) // w AS part, (i - 1) % w AS position, CAST(floor({SCALE} * CAST(e[i] AS DOUBLE)) AS BIGINT) AS x
          FROM (SELECT *, unnest(range(1, len(e) + 1)) AS i FROM v)),
    o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v),
    c0 AS MATERIALIZED (SELECT part, entry, position, x FROM p JOIN o USING (vec_id) WHERE entry < {ENTRIES}),
    {rounds}f AS MATERIALIZED {assigned(f"c{ROUNDS}")},
    g AS (SELECT vec_id, label, string_agg(printf('%02x', CAST(m % {ENTRIES} AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(m // {ENTRIES}) AS BIGINT) AS error
          FROM f GROUP BY ALL),
    h AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, position)) AS codebooks_sha256 FROM c{ROUNDS})
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM g, h"""
