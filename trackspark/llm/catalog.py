"""The registered queries of this subpackage and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trackspark.llm.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


@query("op7_packing")
def _packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from trackspark.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op5_sharding")
def _sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from trackspark.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents"), 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _decontamination_sql() -> str:
    from trackspark.llm.decontamination import oracle

    return oracle()


@query("op4_decontamination", _decontamination_sql())
def _decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackspark.llm.decontamination import find

    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _license_sql() -> str:
    from trackspark.llm.licenses import oracle

    return oracle()


@query("op8_licenses", _license_sql())
def _licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackspark.llm.licenses import scan, templates

    return scan(table(spark, sf_dir, "documents"), templates(spark))


@query("op3_toxicity")
def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from trackspark.llm.labelled import fold
    from trackspark.llm.toxicity import score, train

    docs, folds = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5)
    model = train(docs, table(spark, sf_dir, "labels"), folds != 0)
    return score(docs, model).select(
        "doc_id", (folds == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def _jaccard_sql() -> str:
    from trackspark.llm.jaccard import oracle

    return oracle()


@query("op1_ngram_jaccard_join", _jaccard_sql())
def _jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackspark.llm.jaccard import join

    return join(table(spark, sf_dir, "documents"))


@query("op10_quality")
def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from trackspark.llm.labelled import fold
    from trackspark.llm.quality import score, train

    docs, folds = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 3)
    model = train(docs, table(spark, sf_dir, "labels"), folds != 1)
    return score(docs, model).select(
        "doc_id", (folds == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query("op9_pii")
def _pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackspark.llm.pii import report, train

    docs = table(spark, sf_dir, "documents")
    return report(docs, train(docs))


def _neighbours_sql() -> str:
    from trackspark.llm.neighbours import oracle

    return oracle()


@query("op2_nearest_neighbours", _neighbours_sql())
def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from trackspark.llm.neighbours import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op6_pseudo_likelihood")
def _pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackspark.llm.language_model import train_and_score

    return train_and_score(table(spark, sf_dir, "documents"))


def _codes_sql() -> str:
    from trackspark.llm.codes import oracle

    return oracle()


@query("op11_vector_codes", _codes_sql())
def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackspark.llm.codes import compress

    return compress(table(spark, sf_dir, "embeddings"))


def _periods_sql() -> str:
    from trackspark.llm.periods import oracle

    return oracle()


@query("op12_periodic_runs", _periods_sql())
def _periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackspark.llm.periods import report

    return report(table(spark, sf_dir, "documents"))


def _urls_sql() -> str:
    from trackspark.llm.urls import oracle

    return oracle()


@query("op13_url_filters", _urls_sql())
def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackspark.llm.urls import RULES, judge, rules_of

    return judge(table(spark, sf_dir, "pages"), rules_of(spark, RULES))
