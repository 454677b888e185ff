"""The pipeline's stages on the smallest tables, and the registered queries against their SQL."""

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from trackspark.llm import catalog, jaccard
from trackspark.llm.labelled import fold
from trackspark.session import scratch_dir, settle

TINY = "/root/testdata/sf0.001"


def test_every_stage_takes_effect(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_dir(spark, name)
        stage(spark, docs, TINY).write.parquet(path)
        out = spark.read.parquet(path)
        if name == "toxicity":
            model = corpus_pipeline.toxicity.train(docs, spark.read.parquet(f"{TINY}/labels.parquet"), fold(F.col("doc_id"), 5) != 0)
            kept = corpus_pipeline.toxicity.score(docs, model).where("score < 0.5")
            assert out.count() == kept.count() < docs.count()
        if name == "near_duplicates":
            assert out.count() == jaccard.join(docs).select("component_id").distinct().count() < docs.count()
        if name == "decontamination":
            hit = corpus_pipeline.decontamination.find(docs, spark.read.parquet(f"{TINY}/benchmark.parquet"))
            assert out.count() == docs.count() - hit.select("doc_id").distinct().count()
        if name == "personal_data":
            assert out.count() == docs.count() and out.where("n_chars <> length(text)").count() == 0
        if name == "packing":
            assert out.select("doc_id").distinct().count() == docs.count()
        else:
            assert out.columns == columns
        docs = out
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]


def test_stages_on_awkward_tables(spark):
    rng = np.random.default_rng(21)
    prose = lambda n: " ".join(f"w{int(i)}" for i in rng.integers(0, 10**6, n))
    item = spark.read.parquet(f"{TINY}/benchmark.parquet").where("length(text) > 200").first().text
    a, long = prose(50), prose(60_000)
    rows = [
        (1, a), (1, a), (2, a + " end"), (2, prose(40)), (None, a + " tail"), (None, prose(30)), (3, None), (4, ""), (5, " \n"), (6, long), (7, long + " x"),
        (8, prose(20) + " " + item), (8, prose(35)), (None, item + " " + prose(20)), (9, "mail me: ann.lee@example.com, or +44 20 7946 0958"),
    ]
    table = spark.createDataFrame([(i, t, "k", 1.5, 7) for i, t in rows], "doc_id long, text string, key string, score double, hub int")
    docs = corpus_pipeline.drop_near_duplicates(spark, table, TINY)
    assert docs.columns == table.columns
    kept = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(kept, key=str) == sorted([rows[k] for k in (0, 3, 5, 6, 7, 8, 9, 11, 12, 13, 14)], key=str)
    docs = corpus_pipeline.drop_benchmark_overlaps(spark, settle(docs), TINY)
    kept = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(kept, key=str) == sorted([rows[k] for k in (0, 3, 5, 6, 7, 8, 9, 12, 14)], key=str)
    docs = corpus_pipeline.mask_personal_data(spark, settle(docs), TINY)
    assert docs.columns == table.columns and docs.count() == 9
    masked = docs.where("doc_id = 9").first().text
    assert "ann.lee" not in masked and "7946" not in masked and masked.startswith("mail me: ")
    assert docs.where("doc_id = 3").first().text is None
    packed = corpus_pipeline.pack(spark, docs, TINY)
    assert packed.select("doc_id").distinct().count() == len({r.doc_id for r in docs.collect()})


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_dir(spark, name)
        stage(spark, docs, TINY).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_queries_equal_their_sql(spark, name):
    mine = catalog.QUERIES[name](spark, TINY)
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings", "pages"):
        connection.execute(f"create view {table} as select * from '{TINY}/{table}.parquet'")
    other = connection.execute(catalog.ORACLES[name])
    names = [c[0] for c in other.description]
    assert sorted(mine.columns) == sorted(names)
    assert sorted(map(tuple, mine.select(names).collect()), key=str) == sorted(other.fetchall(), key=str)
