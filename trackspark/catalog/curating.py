"""Queries over embeddings."""

from pyspark.sql import functions as F

from trackspark.catalog.base import query
from trackspark.functions.geometry import norm
from trackspark.operators import vectors
from trackspark.sources import adapters as src

UNIT = """
vec AS (SELECT vec_id AS id, label AS grp, list_transform(embedding, lambda v: v::DOUBLE / (sqrt(list_sum(list_transform(embedding, lambda u: u::DOUBLE * u::DOUBLE))) + 1e-12)) AS e FROM embeddings)
"""


@query(
    f"""WITH {UNIT} SELECT id, round(e[1], 6) AS first, round(e[64], 6) AS last, round(sqrt(list_sum(list_transform(e, lambda u: u * u))), 6) AS length,
    round(list_sum(e), 6) AS total FROM vec"""
)
def l2_normalize(spark, d):
    rows = vectors.l2_normalize(src.embeddings(spark, d))
    return rows.select(
        "id",
        F.element_at("embedding", 1).alias("first"),
        F.element_at("embedding", -1).alias("last"),
        norm("embedding").alias("length"),
        F.aggregate("embedding", F.lit(0.0), lambda acc, v: acc + v).alias("total"),
    )


# Greedy farthest-point order as a recursive walk over all vectors.
SPREAD = UNIT + """,
walk AS (
  SELECT 0 AS rank, v.id, v.e, list_distance(v.e, f.e) AS d, f.id AS picked, CAST('inf' AS DOUBLE) AS radius
  FROM vec v, (SELECT * FROM vec ORDER BY id LIMIT 1) f
  UNION ALL
  SELECT w.rank + 1, w.id, w.e, least(w.d, list_distance(w.e, p.e)), p.id, p.d FROM walk w,
    (SELECT id, e, d, rank FROM walk ORDER BY d DESC, id LIMIT 1) p WHERE w.rank < {n} - 1),
ranked AS (SELECT DISTINCT rank, picked AS id, radius FROM walk)
"""


@query(f"WITH RECURSIVE {SPREAD.format(n=12)} SELECT CAST(rank AS BIGINT) AS rank, id, CASE WHEN isinf(radius) THEN 99 ELSE round(radius, 6) END AS radius FROM ranked")
def farthest_point_sample(spark, d):
    order = vectors.farthest_point_sample(src.embeddings(spark, d), 12, return_radii=True)
    return order.withColumn("radius", F.when(F.col("rank") == 0, 99.0).otherwise(F.col("radius")))


@query(f"WITH RECURSIVE {SPREAD.format(n=12)} SELECT id FROM ranked WHERE radius >= 1.15 UNION SELECT * FROM (VALUES (3), (7)) t(id)")
def select_within_radius(spark, d):
    order = vectors.farthest_point_sample(src.embeddings(spark, d), 12, return_radii=True)
    return vectors.select_within_radius(order, 1.15, [3, 7])


@query(
    f"""WITH {UNIT}, dims AS (SELECT id, grp, unnest(e) AS v, generate_subscripts(e, 1) AS i FROM vec),
    mean AS (SELECT grp, i, avg(v) AS m FROM dims GROUP BY grp, i),
    dist AS (SELECT d.grp, d.id, sqrt(sum((v - m) * (v - m))) AS distance FROM dims d JOIN mean ON mean.grp = d.grp AND mean.i = d.i GROUP BY d.grp, d.id)
    SELECT CAST(grp AS BIGINT) AS cluster, arg_min(id, distance) AS id, round(min(distance), 6) AS distance FROM dist GROUP BY grp"""
)
def cluster_medoids(spark, d):
    features = src.embeddings(spark, d)
    return vectors.cluster_medoids(features, features.select("id", F.col("grp").alias("cluster")))


KNN = UNIT + """,
sims AS (SELECT q.id AS query_id, v.id, list_dot_product(q.e, v.e) AS similarity FROM vec q, vec v),
nn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM sims)
SELECT query_id, rank, id, round(similarity, 6) AS similarity FROM nn WHERE rank <= 5"""


@query(f"WITH {KNN}")
def knn(spark, d):
    """Neighbours of all embeddings; few enough on small tables for every task to hold them."""
    features = src.embeddings(spark, d)
    return vectors.knn(features, features, 5)


@query(f"WITH {KNN}")
def knn_many_queries(spark, d):
    """The same neighbours by cells around pivots, as for query tables too large to send around."""
    features = src.embeddings(spark, d)
    return vectors.knn(features, features, 5, query_limit=10, cells=12, rows=100)


@query("SELECT CAST(10 AS BIGINT) AS n_clusters, count(*) AS n_rows, true AS mostly_nearest FROM embeddings")
def cluster_kmeans(spark, d):
    """Clusters of all embeddings, checked: all rows placed, ten clusters, and rows nearest to their own cluster's mean."""
    features = src.embeddings(spark, d)
    placed = features.join(vectors.cluster(features, 10, n_init=3), "id")
    unit = F.transform("embedding", lambda x: x / F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v)))
    placed = placed.select("id", "cluster", F.posexplode(unit).alias("i", "x"))
    means = placed.groupBy("cluster", "i").agg(F.avg("x").alias("m")).withColumnRenamed("cluster", "other")
    far = placed.join(means, "i").groupBy("id", "cluster", "other").agg(F.sum((F.col("x") - F.col("m")) ** 2).alias("d"))
    nearest = far.groupBy("id", "cluster").agg(F.min_by("other", "d").alias("nearest"))
    return nearest.agg(
        F.count_distinct("cluster").alias("n_clusters"), F.count("*").alias("n_rows"),
        (F.avg((F.col("nearest") == F.col("cluster")).cast("int")) > 0.9).alias("mostly_nearest"),
    )


# Water levels: with sizes sorted, the level is where the budget left over for k groups, divided evenly, is below the next size.
LEVEL = """s AS (SELECT grp, count(*) AS n, row_number() OVER (ORDER BY count(*), grp) AS r, count(*) OVER () AS g,
      sum(count(*)) OVER (ORDER BY count(*), grp) AS below FROM ({groups}) GROUP BY grp),
    l AS (SELECT max(least(n, ({total} - (below - n)) // (g - r + 1))) AS level FROM s),
    f AS (SELECT grp, n, least(n, level) AS base, sum(least(n, level)) OVER () AS used, n > level AS open FROM s, l),
    o AS (SELECT *, row_number() OVER (PARTITION BY open ORDER BY grp) AS p FROM f),
    quota AS (SELECT grp, CAST(n AS BIGINT) AS size, CAST(base + CASE WHEN open AND p <= {total} - used THEN 1 ELSE 0 END AS BIGINT) AS n FROM o)"""
# Uneven groups of all embeddings: half of them in the first, a quarter in the second, and so on.
UNEVEN = "SELECT CAST(floor(log2(64 / (vec_id % 64 + 1))) AS BIGINT) AS grp FROM embeddings"


@query(f"WITH {LEVEL.format(groups=UNEVEN, total=60)} SELECT grp, size, n FROM quota")
def balanced_alloc(spark, d):
    """A budget of 60 over uneven groups of all embeddings, one row per group."""
    grp = F.floor(F.log2(F.lit(64) / (F.col("id") % 64 + 1)))
    sizes = src.embeddings(spark, d).groupBy(grp.alias("grp")).agg(F.count(F.lit(1)).alias("size"))
    return vectors.balanced_alloc(sizes, 60)


# A farthest-point walk inside each group, as long as the group's share.
@query(
    f"""WITH RECURSIVE {UNIT}, {LEVEL.format(groups="SELECT grp FROM vec", total=24)},
    walk AS (
      SELECT 0 AS step, v.grp, v.id, v.e, list_distance(v.e, f.e) AS d, f.id AS picked
      FROM vec v JOIN (SELECT grp, min(id) AS id, arg_min(e, id) AS e FROM vec GROUP BY grp) f ON f.grp = v.grp
      UNION ALL
      SELECT w.step + 1, w.grp, w.id, w.e, least(w.d, list_distance(w.e, p.e)), p.id FROM walk w
      JOIN (SELECT grp, id, e FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY d DESC, id) AS k FROM walk) WHERE k = 1) p ON p.grp = w.grp
      WHERE w.step < 8)
    SELECT row_number() OVER (ORDER BY grp, step) - 1 AS rank, id FROM (
      SELECT DISTINCT w.grp, w.step, w.picked AS id FROM walk w JOIN quota q ON q.grp = w.grp WHERE w.step < q.n)"""
)
def cluster_balanced_given(spark, d):
    """Equal shares of 24 picks over clusters that are known already."""
    features = src.embeddings(spark, d)
    return vectors.cluster_balanced_fps(features, 24, labels=features.select("id", F.col("grp").alias("cluster")))


# The farthest point of every group from its first vector.
@query(
    f"""WITH {UNIT}, f AS (SELECT grp, arg_min(e, id) AS e0, min(id) AS id0 FROM vec GROUP BY grp),
    far AS (SELECT v.grp, v.id, row_number() OVER (PARTITION BY v.grp ORDER BY list_distance(v.e, f.e0) DESC, v.id) AS r FROM vec v JOIN f ON f.grp = v.grp)
    SELECT row_number() OVER (ORDER BY grp, o) - 1 AS rank, id FROM (
      SELECT grp, id0 AS id, 0 AS o FROM f UNION ALL SELECT grp, id, 1 FROM far WHERE r = 1)"""
)
def select_diverse_floor(spark, d):
    """Two picks of each of the ten groups fill the budget of twenty."""
    features = src.embeddings(spark, d)
    return vectors.select_diverse(features, 20, group="grp", min_per_group=2)


# The first vector of every group, then the farthest from all chosen so far.
CONTINUED = UNIT + """,
base AS (SELECT id, e, row_number() OVER (ORDER BY grp) - 1 AS rank FROM (SELECT * FROM vec WHERE id IN (SELECT min(id) FROM vec GROUP BY grp))),
walk AS (
  SELECT (SELECT count(*) FROM base) - 1 AS rank, v.id, v.e, min(list_distance(v.e, b.e)) AS d, CAST(-1 AS BIGINT) AS picked
  FROM vec v, base b GROUP BY v.id, v.e
  UNION ALL
  SELECT w.rank + 1, w.id, w.e, least(w.d, list_distance(w.e, p.e)), p.id FROM walk w,
    (SELECT id, e, d FROM walk ORDER BY d DESC, id LIMIT 1) p WHERE w.rank < 39)
SELECT rank, id FROM base UNION ALL SELECT DISTINCT rank, picked FROM walk WHERE picked >= 0"""


@query(f"WITH RECURSIVE {CONTINUED}")
def select_diverse(spark, d):
    return vectors.select_diverse(src.embeddings(spark, d), 40, group="grp", min_per_group=1)


@query()
def cluster_balanced_fps(spark, d):
    return vectors.cluster_balanced_fps(src.embeddings(spark, d), 24, n_init=2)


@query()
def review_selection(spark, d):
    return vectors.review_selection(src.embeddings(spark, d))


@query()
def curate_frames(spark, d):
    """Labelled and erroneous frames that have an embedding, thinned to a diverse set."""
    from trackspark.plans import workflows

    frames = src.event_frames(spark, d).select(
        "video", "frame", F.lit(None).cast("string").alias("image"), F.col("event_id").alias("id")
    )
    features = frames.join(src.embeddings(spark, d).select("id", "embedding"), "id")
    manual = src.manual_layer(spark, d).select("video", F.lit("img000000.png").alias("image")).distinct()
    return workflows.curate_frames(manual, src.predictions(spark, d), src.flow(spark, d), features, block=src.event_block(spark, d))
