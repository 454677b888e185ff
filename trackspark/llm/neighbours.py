"""Nearest neighbours by largest inner product: a vantage-point tree per shard.

Vectors get one more component so that all have the length of the longest; then the nearest by distance are those with
the largest inner product, and the triangle inequality may prune. Rows are dealt into shards of bounded size by hash of
their id, and each shard becomes one tree. Blocks of queries of bounded size go through every tree, all queries of a
block at once, and each query's best of every shard are merged.

A branch is skipped for a query if the triangle inequality puts it farther than ``factor`` times the distance of the
query's k-th best so far. Factor one is exact; smaller factors skip more and may miss neighbours.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component take no part, neither do rows
without id; vectors of different lengths are never compared; a query's own id is no candidate; ties go to the smaller id; a
query with fewer than k candidates gets all; repeated rows count each; empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.session import settle

SHARD_ROWS, BLOCK_ROWS, LEAF = 8192, 1024, 128


class Tree:
    """Rows in the order of the leaves, with inner and outer radius of each half around the node's vantage point."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        square = np.einsum("ij,ij->i", self.vectors, self.vectors)
        self.longest = max(longest, float(square.max()))
        self.rest = np.sqrt(np.maximum(self.longest - square, 0))
        self.nodes: list[tuple] = []  # first, last row; vantage row and (child, inner, outer) of both halves, or None
        self.rows = np.arange(len(ids))
        self._split(0, len(ids))

    def _distances(self, row: int, rows: np.ndarray) -> np.ndarray:
        inner = self.vectors[rows] @ self.vectors[row] + self.rest[rows] * self.rest[row]
        return np.sqrt(np.maximum(2 * (self.longest - inner), 0))

    def _split(self, first: int, last: int) -> int:
        number = len(self.nodes)
        self.nodes.append((first, last, None, None, None))
        if last - first <= LEAF:
            return number
        rows = self.rows[first:last]
        far = self._distances(rows[0], rows)
        vantage = int(rows[far.argmax()])
        far = self._distances(vantage, rows)
        order = np.argsort(far, kind="stable")
        self.rows[first:last] = rows[order]
        far, half = far[order], (last - first) // 2
        inner = (self._split(first, first + half), far[0], far[half - 1])
        outer = (self._split(first + half, last), far[half], far[-1])
        self.nodes[number] = (first, last, vantage, inner, outer)
        return number

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, row id and inner product of the ``k`` best of each query, best first."""
        n = len(ids)
        square = np.einsum("ij,ij->i", queries, queries)
        least = np.full(n, -np.inf)  # k-th best inner product so far
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        slack = 1e-9 * math.sqrt(self.longest) * np.sqrt(square)

        def radius(active: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(square[active] + self.longest - 2 * least[active], 0)) * factor + 1e-9

        def visit(active: np.ndarray, first: int, last: int) -> None:
            nonlocal found
            rows = self.rows[first:last]
            near = queries[active] @ self.vectors[rows].T >= (least - slack)[active][:, None]
            near &= ids[active][:, None] != self.ids[rows][None]
            q, x = np.nonzero(near)
            if not len(q):
                return
            q, x = active[q], rows[x]
            # summed in order, row by row, so that equal vectors have equal scores
            score = np.cumsum(queries[q] * self.vectors[x], axis=1)[:, -1]
            touched = np.isin(found[0], np.unique(q))
            kept = tuple(f[~touched] for f in found)
            q, x, score = (np.concatenate((f[touched], new)) for f, new in zip(found, (q, self.ids[x], score), strict=True))
            order = np.lexsort((x, -score, q))
            q, x, score = q[order], x[order], score[order]
            start = np.searchsorted(q, q)
            place = np.arange(len(q)) - start
            full = place == k - 1
            least[q[full]] = score[full]
            best = place < k
            found = tuple(np.concatenate((f, new[best])) for f, new in zip(kept, (q, x, score), strict=True))

        def span(active: np.ndarray, vantage: int) -> np.ndarray:
            inner = queries[active] @ self.vectors[vantage]  # a query's additional component is zero
            return np.sqrt(np.maximum(square[active] + self.longest - 2 * inner, 0))

        home = np.zeros(n, np.int64)
        todo = [(0, np.arange(n))]
        while todo:  # each query's own leaf first, for a radius to prune with
            node, active = todo.pop()
            first, last, vantage, inner, outer = self.nodes[node]
            if vantage is None:
                home[active] = node
                visit(active, first, last)
                continue
            goes_in = span(active, vantage) <= (inner[2] + outer[1]) / 2
            todo += [(c[0], active[g]) for c, g in ((inner, goes_in), (outer, ~goes_in)) if g.any()]
        todo = [(0, np.arange(n))]
        while todo:
            node, active = todo.pop()
            first, last, vantage, *halves = self.nodes[node]
            if vantage is None:
                active = active[home[active] != node]
                if len(active):
                    visit(active, first, last)
                continue
            far, reach = span(active, vantage), radius(active)
            for child, low, high in halves:
                meets = (far >= low - reach) & (far <= high + reach)
                if meets.any():
                    todo.append((child, active[meets]))
        return found


def _packed(key: tuple, rows: pa.Table, name: str) -> pa.Table:
    vectors = np.asarray(rows["vector"].combine_chunks().flatten())
    return pa.table({
        "dim": pa.array([key[0].as_py()], pa.int32()), name: pa.array([key[1].as_py()], pa.int64()),
        f"{name}_ids": pa.array([np.asarray(rows["vec_id"]).tobytes()], pa.binary()),
        f"{name}_vectors": pa.array([vectors.astype(np.float64).tobytes()], pa.binary()),
    })


def _pack(rows: DataFrame, name: str) -> DataFrame:
    """One row per group of vectors."""
    return rows.groupBy("dim", name).applyInArrow(
        lambda key, group: _packed(key, group, name), f"dim int, {name} long, {name}_ids binary, {name}_vectors binary"
    )


def valid(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """``vec_id, vector, dim`` of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & F.coalesce(usable, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector"), F.size(v).alias("dim")
    )


def search(vectors: DataFrame, is_query: Column, k: int = 20, factor: float = 1.0, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of all rows for those where ``is_query`` (on ``vec_id``) holds."""
    rows = settle(valid(vectors))
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    # one row per length of vectors
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"), F.max(length).alias("longest")).collect()
    shards = {r["dim"]: max(1, -(-r["n"] // shard_rows)) for r in sizes}
    blocks = {r["dim"]: max(1, -(-r["q"] // block_rows)) for r in sizes}
    longest = {r["dim"]: r["longest"] for r in sizes}

    def by_dim(values: dict) -> Column:
        return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), F.col("dim")) if values else F.lit(1)

    bucket = F.xxhash64("vec_id")
    index = _pack(rows.withColumn("shard", F.pmod(bucket, by_dim(shards).cast("long"))), "shard")
    asked = _pack(rows.where(is_query).withColumn("block", F.pmod(bucket, by_dim(blocks).cast("long"))), "block")
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), by_dim(shards).cast("long") - 1)))

    def run(key: tuple, group: pa.Table) -> pa.Table:
        row, dim = group.to_pylist()[0], key[0].as_py()
        ids, asked_ids = (np.frombuffer(row[c], np.int64) for c in ("shard_ids", "block_ids"))
        own, queries = (np.frombuffer(row[c], np.float64).reshape(-1, dim) for c in ("shard_vectors", "block_vectors"))
        q, x, score = Tree(ids, own, longest[dim]).search(asked_ids, queries, k, factor)
        return pa.table({"query_id": asked_ids[q], "vec_id": x, "score": score})

    met = asked.join(index, ["dim", "shard"]).groupBy("dim", "shard", "block").applyInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def oracle(k: int = 20, every: int = 20) -> str:
    """DuckDB SQL for :func:`search` of each ``every``-th id over embeddings."""
    return f"""
    WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
    u AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
          FROM u AS q JOIN u AS c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % {every} = 0),
    r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
