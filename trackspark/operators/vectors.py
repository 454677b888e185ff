"""Curation of frame embeddings: spread, clusters, medoids, neighbours.

Embedding tables are ``(id, embedding[, grp])``. Distances are Euclidean on
unit vectors unless ``normalize=False``.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackspark.functions.blocks import spread, top_per_group
from trackspark.functions.geometry import l2_normalize as unit
from trackspark.session import scratch_dir, settle

# The driver keeps this many candidate vectors while it picks greedily.
CANDIDATES = 2048
# Queries up to this number are sent to every task.
QUERY_LIMIT = 4096
# Rows of a cell's part and queries of a crowd that meet, and pivots at most; cells hold more rows beyond that.
CELL_ROWS, MOST_CELLS = 8192, 4096
# Times as many candidates as wanted, on average, before the best of them are selected.
MANY = 8


def l2_normalize(features: DataFrame) -> DataFrame:
    return features.withColumn("embedding", unit("embedding"))


def _matrix(column: pd.Series, normalize: bool) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(float)
    if normalize:
        x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)
    return x


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of each row of x to each row of y, by differences for exact ties."""
    return np.stack([np.linalg.norm(x - row, axis=1) for row in y], axis=1)


def _nearest(x: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    best = np.full(len(x), np.inf)
    for row in chosen:
        np.minimum(best, np.linalg.norm(x - row, axis=1), out=best)
    return best


# --- farthest-point sampling ---------------------------------------------------

def _candidates(
    features: DataFrame, chosen: dict, group: str | None, normalize: bool, keep: int
) -> pd.DataFrame:
    """The ``keep + 1`` rows of each group farthest from what it has chosen.

    Every task keeps only that many rows per group, so little is shuffled and
    the driver sees a bounded number of vectors.
    """
    taken = {g: (set(ids), np.array(vecs)) for g, (ids, vecs) in chosen.items()}
    width = keep + 1

    def scan_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict = {}
        for pdf in batches:
            if not len(pdf):
                continue
            x = _matrix(pdf["embedding"], normalize)
            ids, groups = pdf["id"].to_numpy(), pdf["_g"].to_numpy()
            for g in pd.unique(pdf["_g"]):
                if g not in taken:
                    continue
                at = np.flatnonzero(groups == g)
                seen, vecs = taken[g]
                at = at[[i not in seen for i in ids[at]]]
                dist = _nearest(x[at], vecs)
                rows = (ids[at], dist, x[at])
                if g in best:
                    rows = tuple(np.concatenate([a, b]) for a, b in zip(best[g], rows))
                order = np.lexsort((rows[0], -rows[1]))[:width]
                best[g] = tuple(a[order] for a in rows)
        for g, (i, d, v) in best.items():
            if not len(i):
                continue
            yield pd.DataFrame({"_g": [g] * len(i), "id": i, "dist": d, "vec": list(v)})

    kind = features.schema[group].dataType if group else T.IntegerType()
    schema = T.StructType(
        [
            T.StructField("_g", kind),
            T.StructField("id", features.schema["id"].dataType),
            T.StructField("dist", T.DoubleType()),
            T.StructField("vec", T.ArrayType(T.DoubleType())),
        ]
    )
    rows = features.select("id", "embedding", (F.col(group) if group else F.lit(0)).alias("_g"))
    found = rows.mapInPandas(scan_part, schema)
    order = [F.desc("dist"), F.asc("id")]
    if group is None:
        return found.orderBy(*order).limit(width).toPandas()
    return top_per_group(found, ["_g"], order, width, salt_on=["id"], salts=16).drop("rank").toPandas()


def _pick(cands: pd.DataFrame, want: int, keep: int) -> list[tuple]:
    """Greedy picks that are certain to be the farthest of *all* rows.

    Distances only shrink, so no row outside the candidates can ever be farther
    than the first of them is; picks stop below that bound. Equally far rows
    outside have larger ids, so ties need no further pass.
    """
    cands = cands.sort_values(["dist", "id"], ascending=[False, True])
    bound = cands["dist"].iloc[keep] if len(cands) > keep else -1.0
    cands = cands.iloc[:keep]
    ids, dist = cands["id"].to_numpy(), cands["dist"].to_numpy().copy()
    vecs = np.stack(cands["vec"].to_numpy()) if len(cands) else np.empty((0, 0))
    picks: list[tuple] = []
    while len(picks) < want and len(picks) < len(ids):
        far = dist.max()
        if picks and far < bound:
            break
        ties = np.flatnonzero(dist == far)
        i = ties[np.argmin(ids[ties])]
        picks.append((ids[i], float(far), vecs[i]))
        dist = np.minimum(dist, np.linalg.norm(vecs - vecs[i], axis=1))
        dist[i] = -np.inf
    return picks


def _sample_groups(
    features: DataFrame, quotas: dict, group: str | None, starts: dict, normalize: bool
) -> dict:
    """Farthest-point order of each group: ``{group: [(id, radius, vector)]}``.

    One pass over the table serves all groups and yields many picks each.
    """
    chosen = {g: list(rows) for g, rows in starts.items()}
    keep = max(16, CANDIDATES // max(1, len(quotas)))
    open_groups = {g for g, n in quotas.items() if len(chosen[g]) < n}
    while open_groups:
        state = {g: ([r[0] for r in chosen[g]], [r[2] for r in chosen[g]]) for g in open_groups}
        found = _candidates(features, state, group, normalize, keep)
        by_group = dict(iter(found.groupby("_g", sort=False)))
        for g in list(open_groups):
            rows = by_group.get(g)
            picks = _pick(rows, quotas[g] - len(chosen[g]), keep) if rows is not None else []
            chosen[g].extend(picks)
            if not picks or len(chosen[g]) >= quotas[g]:
                open_groups.discard(g)
    return {g: rows[: quotas[g]] for g, rows in chosen.items()}


def _fetch(features: DataFrame, ids: Sequence[int], normalize: bool) -> list[tuple]:
    wanted = features.sparkSession.createDataFrame([(int(i),) for i in ids], "id long")
    got = features.select("id", "embedding").join(F.broadcast(wanted), "id").toPandas()  # as many rows as picks
    vecs = dict(zip(got["id"], _matrix(got["embedding"], normalize))) if len(got) else {}
    missing = [i for i in ids if i not in vecs]
    if missing:
        raise ValueError(f"unknown ids: {missing[:5]}")
    return [(i, math.inf, vecs[i]) for i in ids]


def farthest_point_sample(
    features: DataFrame,
    n: int,
    *,
    start: int | None = None,
    seed: int | None = None,
    preselected: Sequence[int] | None = None,
    normalize: bool = True,
    return_radii: bool = False,
) -> DataFrame:
    """Greedy max-min selection of ``n`` rows: ``(rank, id[, radius])``, exact.

    Starts at ``start`` (default: the lowest id, or a row drawn by ``seed``) or
    continues from ``preselected``. Equally far rows go by lowest id. The
    driver holds the ``n`` picks and a fixed number of candidates, and reads
    the table once per batch of picks rather than once per pick.
    """
    spark = features.sparkSession
    if not return_radii:
        # Only learn whether there are more than n rows.
        if features.select("id").limit(n + 1).count() <= n:
            w = Window.partitionBy(F.lit(0)).orderBy("id")
            return features.select((F.row_number().over(w) - 1).cast("int").alias("rank"), "id")
    if preselected:
        ids = list(dict.fromkeys(int(i) for i in preselected))
    elif start is not None:
        ids = [int(start)]
    elif seed is not None:
        ids = [r["id"] for r in features.orderBy(F.xxhash64("id", F.lit(seed)), "id").select("id").head(1)]
    else:
        ids = [features.agg(F.min("id")).first()[0]]
    first = _fetch(features, ids, normalize)
    picks = _sample_groups(features, {0: n}, None, {0: first}, normalize)[0]
    rows = [(k, int(i), float(r)) for k, (i, r, _) in enumerate(picks)]
    out = spark.createDataFrame(rows, "rank int, id long, radius double")
    return out if return_radii else out.drop("radius")


def select_within_radius(order: DataFrame, min_dist: float, floor: Iterable[int] = ()) -> DataFrame:
    """Ids whose capture radius is at least ``min_dist``, plus those in ``floor``."""
    kept = order.where(F.col("radius") >= min_dist).select("id")
    extra = order.sparkSession.createDataFrame([(int(i),) for i in floor], "id long")
    return kept.unionByName(extra).distinct()


# --- clusters --------------------------------------------------------------------

def _with_vector(features: DataFrame, normalize: bool) -> DataFrame:
    vec = unit("embedding") if normalize else F.col("embedding").cast("array<double>")
    return features.withColumn("_vec", array_to_vector(vec))


def cluster(
    features: DataFrame,
    n_clusters: int,
    *,
    normalize: bool = True,
    seed: int = 0,
    n_init: int = 10,
) -> DataFrame:
    """Assign each row to a cluster: ``(id, cluster)``, by the best of ``n_init`` k-means starts."""
    rows = _with_vector(features.select("id", "embedding"), normalize).select("id", "_vec").persist()
    try:
        best = None
        for i in range(max(1, n_init)):
            model = KMeans(k=n_clusters, seed=seed + i, featuresCol="_vec", predictionCol="cluster").fit(rows)
            if best is None or model.summary.trainingCost < best.summary.trainingCost:
                best = model
    finally:
        rows.unpersist()
    source = _with_vector(features.select("id", "embedding"), normalize)
    return best.transform(source).select("id", "cluster")


def cluster_medoids(features: DataFrame, labels: DataFrame, *, normalize: bool = True) -> DataFrame:
    """The member nearest the mean of its cluster: ``(cluster, id, distance)``."""
    rows = features.select("id", "embedding").join(labels.select("id", "cluster"), "id")
    rows = _with_vector(rows, normalize)
    means = rows.groupBy("cluster").agg(Summarizer.mean(F.col("_vec")).alias("_mean"))
    means = means.select("cluster", vector_to_array("_mean").alias("_mean"))
    square = F.aggregate(
        F.zip_with(vector_to_array("_vec"), F.col("_mean"), lambda a, b: (a - b) * (a - b)),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )
    near = rows.join(means, "cluster").select("cluster", "id", F.sqrt(square).alias("distance"))
    return near.groupBy("cluster").agg(
        F.min_by("id", F.struct("distance", "id")).alias("id"), F.min("distance").alias("distance")
    )


# --- neighbours --------------------------------------------------------------------

def _first_of(at: np.ndarray, ids: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` most similar for each number in ``at``, in order, ties to the smaller id."""
    order = np.lexsort((ids, -sim, at))
    at, ids, sim = at[order], ids[order], sim[order]
    keep = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[keep], ids[keep], sim[keep]


def _most_similar(
    q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` rows of ``x`` most similar to each query: numbers of queries, ids, similarities.

    With ``floor``, only those at least so similar to each query. A product of vectors of length one, in single precision, rules
    out what lies further below than it rounds off; the others are scored once more, each by itself: equal rows get equal similarities.
    """
    top = min(k, len(ids))
    if not top or not len(q):
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    # Bound the similarity block in memory.
    step = max(1, 1_000_000 // len(ids))
    parts = []
    long_q, long_x = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1).max() or 1.0
    long_q[long_q == 0] = 1.0
    q_unit, x_unit = (q / long_q[:, None]).astype(np.float32), (x / long_x).astype(np.float32).T
    slack = (x.shape[1] + 8) * 2.0**-23
    least = np.full(len(q), -np.inf) if floor is None else floor / long_q / long_x - slack
    for a in range(0, len(q), step):
        sim = q_unit[a : a + step] @ x_unit
        cut = least[a : a + step].astype(np.float32)
        near = np.flatnonzero(sim >= cut[:, None]) if np.isfinite(cut).all() else None
        if near is None or len(near) > MANY * top * len(sim):
            kth = np.partition(sim, len(ids) - top, axis=1)[:, len(ids) - top]
            near = np.flatnonzero(sim >= np.maximum(cut, kth - np.float32(2 * slack))[:, None])
        at, row = np.divmod(near, len(ids))
        at += a
        exact = [np.einsum("ij,ij->i", q[at[b : b + 65536]], x[row[b : b + 65536]]) for b in range(0, len(at), 65536)]
        parts.append(_first_of(at, ids[row], np.concatenate([np.empty(0), *exact]), top))
    return tuple(np.concatenate(column) for column in zip(*parts, strict=True))


def knn(
    features: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    normalize: bool = True,
    query_limit: int = QUERY_LIMIT,
    cells: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """The ``k`` most similar rows per query: ``(query_id, rank, id, similarity)``.

    Few queries travel to every task. With more than ``query_limit`` the rows
    are dealt into ``cells`` around pivots and stored once. Queries read their own
    cell and then only the cells within reach of their k-th best so far, so neither
    pairs nor copies of rows are written. Query ids are unique.
    """
    wanted = queries.select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    schema = "query_id long, id long, similarity double"

    def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> pd.DataFrame:
        at, found, sim = _most_similar(q, ids, x, k)
        return pd.DataFrame({"query_id": q_ids[at], "id": found, "similarity": sim})

    head = wanted.limit(query_limit + 1).toPandas()
    if len(head) <= query_limit:
        q_ids = head["query_id"].to_numpy()
        q = _matrix(head["query"], normalize) if len(head) else np.empty((0, 0))

        def scan_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf) and len(q_ids):
                    yield best(q_ids, q, pdf["id"].to_numpy(), _matrix(pdf["embedding"], normalize))

        found = features.select("id", "embedding").mapInPandas(scan_part, schema)
    else:
        found = _by_cells(features, wanted, schema, k, normalize, cells, CELL_ROWS if rows is None else rows)
    order = [F.desc("similarity"), F.asc("id")]
    ranked = top_per_group(found, ["query_id"], order, k, salt_on=["id"], salts=8)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "similarity")


class Cells:
    """Pivots of a table of vectors, and for each cell of rows nearest to one how near and how far its rows lie.

    Inner products become distances by one more component that brings all rows to the length ``longest``: the more similar,
    the nearer. So the triangle inequality tells which cells can hold one of a query's best.
    """

    def __init__(self, pivots: np.ndarray, longest: float, normalize: bool):
        self.pivots, self.longest, self.normalize = pivots, longest, normalize
        self.inner, self.outer, self.rows = np.full(len(pivots), np.inf), np.zeros(len(pivots)), np.zeros(len(pivots), int)

    def lifted(self, column: pd.Series, *, query: bool = False) -> np.ndarray:
        x = _matrix(column, self.normalize)
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, self.longest**2 - (x * x).sum(1)))
        return np.concatenate([x, more[:, None]], axis=1)

    def to_pivots(self, x: np.ndarray) -> np.ndarray:
        return _distances(x, self.pivots)

    def reach(self, x: np.ndarray, similarity: np.ndarray) -> np.ndarray:
        """Distance within which rows of at least this similarity lie from each query."""
        return np.sqrt(np.maximum(0.0, (x * x).sum(1) + self.longest**2 - 2.0 * similarity))

    def within(self, x: np.ndarray, cell: int, reach: np.ndarray) -> np.ndarray:
        """Which queries may have a row of this cell within their reach."""
        distance = np.linalg.norm(x - self.pivots[cell], axis=1)
        return np.maximum(distance - self.outer[cell], self.inner[cell] - distance) <= reach * (1 + 1e-9) + 1e-7

    def reached(self, distance: np.ndarray, reach: float) -> np.ndarray:
        """The cells that may hold a row within ``reach`` of a query, given its distances to the pivots."""
        least = np.maximum(distance - self.outer, self.inner - distance)
        return np.flatnonzero((self.rows > 0) & (least <= reach * (1 + 1e-9) + 1e-7))


def cells_of(features: DataFrame, n_cells: int, normalize: bool) -> tuple[Cells, DataFrame]:
    """Cells around rows drawn by hash, and every row with its cell: ``(cell, id, vec)``."""
    longest = 1.0
    if not normalize:
        square = F.aggregate(F.transform("embedding", lambda v: v.cast("double") * v.cast("double")), F.lit(0.0), lambda s_, v: s_ + v)
        longest = math.sqrt(features.agg(F.max(square)).first()[0] or 0.0)
    drawn = features.select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(n_cells).toPandas()
    cells = Cells(np.zeros((0, 0)), longest, normalize)
    cells = Cells(cells.lifted(drawn["embedding"]), longest, normalize)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = cells.lifted(pdf["embedding"])
                far = cells.to_pivots(x)
                own = far.argmin(1)
                yield pd.DataFrame({"cell": own, "far": far[np.arange(len(x)), own], "id": pdf["id"], "vec": list(x)})

    placed = settle(features.select("id", "embedding").mapInPandas(place, "cell long, far double, id long, vec array<double>"))
    # One row per pivot.
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("a"), F.max("far").alias("b")).collect():
        cells.rows[r.cell], cells.inner[r.cell], cells.outer[r.cell] = r.n, r.a, r.b
    return cells, placed.select("cell", "id", "vec")


def _by_cells(features, wanted, schema, k, normalize, n_cells, rows) -> DataFrame:
    """The best of each query: of its own cell, then of the cells that the k-th best so far does not rule out.

    Cells are stored once in the shared folder. A crowd of queries of one cell reads them, ``rows`` rows at a time, nearest
    cells first, and keeps ``k`` rows per query, so what is written grows with rows and queries, not with their meetings.
    Larger tables are met in larger pieces: a sixteenth of the table, ``CELL_ROWS`` rows at most.
    """
    n_cells = n_cells or min(MOST_CELLS, max(2, math.ceil(features.count() / rows)))
    cells, placed = cells_of(features, n_cells, normalize)
    rows = max(rows, min(CELL_ROWS, math.ceil(int(cells.rows.sum()) / 16)))
    pieces = lambda counted: F.ceil(counted / rows).cast("long")
    sizes = F.create_map(*[F.lit(v) for c, n in enumerate(cells.rows.tolist()) if n for v in (c, n)])
    folder = scratch_dir(features.sparkSession, "cells")
    part = F.pmod(F.xxhash64("id"), pieces(F.element_at(sizes, F.col("cell"))))
    spread(placed.withColumn("part", part), "cell", "part").drop("part").write.partitionBy("cell").parquet(folder)

    def own_cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = cells.lifted(pdf["query"], query=True)
                far = np.where(cells.rows > 0, cells.to_pivots(x), np.inf)
                yield pd.DataFrame({"query_id": pdf["query_id"], "vec": list(x), "cell": far.argmin(1)})

    def stored(cell: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        system, root = fs.FileSystem.from_uri(f"{folder}/cell={cell}")
        for file in system.get_file_info(fs.FileSelector(root)):
            if not file.base_name.endswith(".parquet") or file.base_name.startswith((".", "_")):
                continue
            with system.open_input_file(file.path) as source:
                for batch in pq.ParquetFile(source).iter_batches(batch_size=rows, columns=["id", "vec"]):
                    ids, vec = batch.column(0).to_numpy(), batch.column(1)
                    yield ids, vec.flatten().to_numpy().reshape(len(ids), -1)

    def search(asked: pd.DataFrame) -> pd.DataFrame:
        x, q_ids, own = np.stack(asked["vec"]), asked["query_id"].to_numpy(), int(asked["cell"].iloc[0])
        best = np.empty(0, int), np.empty(0, int), np.empty(0)
        reach, kth = np.full(len(x), np.inf), np.full(len(x), -np.inf)
        from_own = np.linalg.norm(cells.pivots - cells.pivots[own], axis=1)
        from_own[own] = -1.0  # first, also where pivots are equal
        for cell in np.argsort(from_own, kind="stable"):
            near = np.flatnonzero(cells.within(x, cell, reach)) if cells.rows[cell] else []
            if not len(near):
                continue
            for ids, vec in stored(cell):
                at, found, sim = _most_similar(x[near], ids, vec, k, kth[near])
                if not len(at):
                    continue
                best = _first_of(*(np.concatenate(pair) for pair in zip(best, (near[at], found, sim), strict=True)), k)
                n = np.bincount(best[0], minlength=len(x))
                full = n >= k
                kth[full] = best[2][np.cumsum(n)[full] - 1]
            full = np.isfinite(kth)
            reach[full] = cells.reach(x[full], kth[full])
        return pd.DataFrame({"query_id": q_ids[best[0]], "id": best[1], "similarity": best[2]})

    asked = settle(wanted.mapInPandas(own_cell, "query_id long, vec array<double>, cell long"))
    crowds = asked.groupBy("cell").agg(pieces(F.count(F.lit(1))).alias("crowds"))
    asked = asked.join(crowds, "cell").withColumn("crowd", F.pmod(F.xxhash64("query_id"), F.col("crowds"))).drop("crowds")
    return spread(asked, "cell", "crowd").groupBy("cell", "crowd").applyInPandas(search, schema)


# --- budgets over groups -------------------------------------------------------------

def balanced_alloc(sizes: DataFrame, total: int, *, group: str = "grp", size: str = "size") -> DataFrame:
    """Split a total over groups as water fills vessels: all to the same level, none above its size.

    ``sizes`` has one row per group and gets a column ``n``. What is left below one more unit for every unfilled group goes to
    the first of them in sorted order. For every distinct size the level is what remains beyond all smaller groups, shared by
    the others, but not above the size; the highest of these is the level. The sums of smaller sizes come in two steps, over
    ranges of sizes and inside each range, so no step holds all groups.
    """
    sizes = settle(sizes.select(group, F.col(size).cast("long").alias(size)))
    largest = sizes.agg(F.max(size)).first()[0] or 0
    shift = max(0, largest.bit_length() // 2)
    same = sizes.groupBy(size).agg(F.count(F.lit(1)).alias("_c")).withColumn("_range", F.shiftright(size, shift))
    ranges = same.groupBy("_range").agg(F.sum("_c").alias("_rc"), F.sum(F.col("_c") * F.col(size)).alias("_rs"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    after = Window.orderBy("_range").rowsBetween(0, Window.unboundedFollowing)
    ranges = ranges.select("_range", F.coalesce(F.sum("_rs").over(before), F.lit(0)).alias("_below"), F.sum("_rc").over(after).alias("_left"))
    inner = Window.partitionBy("_range").orderBy(size).rowsBetween(Window.unboundedPreceding, -1)
    same = same.withColumns(
        {"_s": F.coalesce(F.sum(F.col("_c") * F.col(size)).over(inner), F.lit(0)), "_n": F.coalesce(F.sum("_c").over(inner), F.lit(0))}
    ).join(ranges, "_range")
    share = F.floor((F.lit(total) - F.col("_below") - F.col("_s")) / (F.col("_left") - F.col("_n")))
    level = max(0, same.agg(F.max(F.least(F.col(size), share))).first()[0] or 0)
    filled = F.least(F.col(size), F.lit(level))
    left = max(0, total - (sizes.agg(F.sum(filled)).first()[0] or 0))
    # Fewer are left over than groups are unfilled.
    more = sizes.where(F.col(size) > level).orderBy(group).limit(left).select(group, F.lit(1).cast("long").alias("_more"))
    return sizes.join(more, group, "left").select(group, size, (filled + F.coalesce("_more", F.lit(0))).alias("n"))


def _group_sample(
    features: DataFrame, group: str, quotas: dict, normalize: bool
) -> list[int]:
    """Farthest points inside each group, each started at its lowest id; groups in sorted order."""
    quotas = {g: n for g, n in quotas.items() if n > 0}
    if not quotas:
        return []
    named = features.sparkSession.createDataFrame([(g,) for g in quotas], T.StructType([T.StructField(group, features.schema[group].dataType)]))
    inside = features.join(F.broadcast(named), group, "left_semi")  # at most as many groups as picks
    firsts = inside.groupBy(group).agg(F.min("id").alias("id")).collect()
    got = {r[0]: r for r in _fetch(features, [r["id"] for r in firsts], normalize)}
    starts = {r[group]: [got[r["id"]]] for r in firsts}
    picks = _sample_groups(inside, {g: quotas[g] for g in starts}, group, starts, normalize)
    return [int(i) for g in sorted(picks) for i, _, _ in picks[g]]


def _cluster_balanced_ids(
    features: DataFrame, m: int, exclude: Sequence[int], n_clusters: int | None, normalize: bool, seed: int, n_init: int,
    labels: DataFrame | None = None,
) -> list[int]:
    if labels is None:
        k = n_clusters or max(2, min(m, 8))
        k = min(k, features.select("id").limit(k).count())
        # The clusters are read in several passes, so they are fixed once.
        labels = settle(cluster(features, k, normalize=normalize, seed=seed, n_init=n_init))
    free = features.select("id", "embedding").join(labels.select("id", "cluster"), "id")
    if exclude:
        gone = features.sparkSession.createDataFrame([(int(i),) for i in exclude], "id long")
        free = free.join(F.broadcast(gone), "id", "left_anti")  # fewer than m rows
    sizes = free.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    shares = balanced_alloc(sizes, m, group="cluster").where("n > 0").collect()  # at most m rows
    return _group_sample(free, "cluster", {r["cluster"]: r["n"] for r in shares}, normalize)


def _ranked_ids(features: DataFrame, ids: Sequence[int]) -> DataFrame:
    return features.sparkSession.createDataFrame([(k, int(i)) for k, i in enumerate(ids)], "rank int, id long")


def cluster_balanced_fps(
    features: DataFrame,
    m: int,
    *,
    exclude: Sequence[int] = (),
    n_clusters: int | None = None,
    normalize: bool = True,
    seed: int = 0,
    n_init: int = 10,
    labels: DataFrame | None = None,
) -> DataFrame:
    """Give every cluster an equal share of ``m`` picks, spread inside it: ``(rank, id)``.

    ``labels`` (id, cluster) are clusters that are known already.
    """
    return _ranked_ids(features, _cluster_balanced_ids(features, m, exclude, n_clusters, normalize, seed, n_init, labels))


def select_diverse(
    features: DataFrame,
    n: int,
    *,
    group: str | None = None,
    min_per_group: int = 0,
    cluster_balance: bool = False,
    n_clusters: int | None = None,
    normalize: bool = True,
    seed: int = 0,
    n_init: int = 10,
) -> DataFrame:
    """Choose ``n`` diverse rows: ``(rank, id)``.

    With ``min_per_group`` every group, in sorted order, first gets that many;
    the rest continues the same spread, or is shared over clusters.
    """
    if features.select("id").limit(n + 1).count() <= n:
        return farthest_point_sample(features, n)
    chosen: list[int] = []
    if group is not None and min_per_group > 0:
        # Every group takes at least one pick, so the first n groups are enough.
        sizes = features.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).orderBy(group).limit(n).collect()
        quotas, room = {}, n
        for r in sizes:
            quotas[r[group]] = min(min_per_group, r["_n"], room)
            room -= quotas[r[group]]
        chosen = _group_sample(features, group, quotas, normalize)
    if len(chosen) < n:
        if not cluster_balance:
            return farthest_point_sample(features, n, preselected=chosen or None, normalize=normalize)
        chosen += _cluster_balanced_ids(features, n - len(chosen), chosen, n_clusters, normalize, seed, n_init)
    return _ranked_ids(features, chosen[:n])


# The numbers a review starts with.
REVIEW_CLUSTERS = (6, 20, 40)  # least and most to begin with, most ever
REVIEW_TARGET = 120
REVIEW_ORDER = 512


def review_defaults(n: int, radii: Sequence[float] | None = None) -> dict:
    """Cluster count and minimum distance to start a review of ``n`` frames with.

    An eighth of the frames bounds the clusters (two at least) and is the target of kept frames, which lies between twice
    the clusters and ``REVIEW_TARGET``; clusters start at half the root of ``n``. Where limits cross, the upper one wins.
    """
    least, first_most, most = REVIEW_CLUSTERS
    eighth = n // 8
    ever = min(most, max(2, eighth))
    start = min(max(least, round(n**0.5 / 2)), first_most, ever)
    target = min(REVIEW_TARGET, max(2 * start, eighth))
    settings = {"k_max": ever, "k": start, "target": target, "n_order": min(n, REVIEW_ORDER)}
    if radii:
        settings["min_dist"] = float(radii[target] if target < len(radii) else radii[-1])
    return settings


def review_selection(features: DataFrame, *, normalize: bool = True) -> DataFrame:
    """The default review without a reviewer: ids spread at the default distance.

    Every default cluster also keeps its medoid.
    """
    n = features.count()
    order = farthest_point_sample(features, min(n, REVIEW_ORDER), normalize=normalize, return_radii=True)
    radii = [r["radius"] for r in order.orderBy("rank").collect()]
    settings = review_defaults(n, radii)
    spread_ids = select_within_radius(order, settings["min_dist"])
    groups = cluster(features, settings["k"], normalize=normalize)
    medoids = cluster_medoids(features, groups, normalize=normalize).select("id")
    return spread_ids.unionByName(medoids).distinct()
