"""Finding benchmark text in documents by spaced seeds.

A mask keeps some of nine consecutive words and ignores the others; a document and a benchmark item that agree in the
kept words are a hit. Around each hit the two texts are compared word by word on the hit's diagonal: they overlap if some
window of ``WINDOW`` words (the whole item, if that is shorter) agrees in at least ``AGREE`` of its words. The two masks
together hit every window of 15 words with at most three substitutions, wherever these are (tested exhaustively).

Texts are cut into overlapping chunks, so the work of a position does not depend on how long its document is. Before
masks are evaluated, positions must start with a pair of words that starts a mask in some item. Item tables are broadcast
only if their number of words is at most ``BROADCAST_WORDS``; beyond that the same joins shuffle.

Defined cases: words are what white space separates, lower-cased; null and empty texts have none; an item of fewer words
than a mask is long never hits; repeated rows with one id count as that id once; empty tables give no rows. Only ids and
texts are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackspark.llm.tables import small

MASKS = ("110001011", "110100011")
SPAN = 9
WINDOW = 15
AGREE = 0.8
#: Words of a document per chunk; on either side come a window and a mask more as context.
CORE = 256
BROADCAST_WORDS = 500_000

SPACE = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """The lower-cased words of a text; null for texts without words."""
    plain = F.btrim(F.lower(text.cast("string")), F.lit(" \t\n\x0b\f\r"))
    return F.when(F.octet_length(plain) > 0, F.split(plain, SPACE))


def _key(array: Column, at: Column, mask: str) -> Column:
    return F.xxhash64(*(F.get(array, at + i) for i, c in enumerate(mask) if c == "1"))


def _chunks(docs: DataFrame, window: int) -> DataFrame:
    margin = window + SPAN
    listed = docs.select("doc_id", words(F.col("text")).alias("all")).where("all is not null")
    starts = F.sequence(F.lit(0), F.size("all") - 1, F.lit(CORE))

    def cut(s: Column) -> Column:
        lo = F.greatest(s - margin, F.lit(0))
        return F.struct(s.alias("s"), lo.alias("lo"), F.slice("all", lo + 1, s - lo + CORE + margin).alias("w"))

    return listed.select("doc_id", F.explode(F.transform(starts, cut)).alias("c")).select(
        "doc_id", "c.s", "c.lo", "c.w",
    )


def find(docs: DataFrame, items: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW, agree: float = AGREE) -> DataFrame:
    """``doc_id, item_id, matched, compared, first_word``: the best window of each overlap.

    ``docs`` holds ``doc_id, text``, ``items`` holds ``item_id, text``. ``matched`` of ``compared`` words agree, and
    ``first_word`` is where in the document the first hit of an overlapping window lies.
    """
    listed = items.select("item_id", words(F.col("text")).alias("iw")).where(F.size("iw") >= SPAN).distinct()
    total = listed.agg(F.sum(F.size("iw"))).first()[0] or 0
    sized = F.broadcast if total <= BROADCAST_WORDS else lambda df: df
    at = listed.select("item_id", "iw", F.explode(F.sequence(F.lit(0), F.size("iw") - SPAN)).alias("j"))
    seeds = at.select(
        "item_id", "j", F.posexplode(F.array(*(_key(F.col("iw"), F.col("j"), m) for m in masks))).alias("mask", "seed")
    )
    pairs = at.select(F.xxhash64(F.get("iw", F.col("j")), F.get("iw", F.col("j") + 1)).alias("pair")).distinct()
    chunks = _chunks(docs, window)
    core = F.sequence(F.col("s") - F.col("lo"), F.least(F.col("s") - F.col("lo") + CORE, F.size("w")) - 1)
    here = chunks.select(
        "doc_id", "lo", "w", (F.col("s") - F.col("lo")).alias("first"),
        F.transform(core, lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1))).alias("keys"),
    ).select("doc_id", "lo", "w", "first", F.posexplode("keys").alias("p", "pair"))
    here = here.join(sized(pairs), "pair", "leftsemi").select("doc_id", "lo", "w", (F.col("first") + F.col("p")).alias("i"))
    here = here.where(F.col("i") + SPAN <= F.size("w"))
    keyed = here.select("*", F.posexplode(F.array(*(_key(F.col("w"), F.col("i"), m) for m in masks))).alias("mask", "seed"))
    hits = keyed.join(sized(seeds), ["mask", "seed"]).join(sized(listed), "item_id")
    length = F.least(F.lit(window), F.size("iw"))
    before = F.greatest(SPAN - length, -F.col("j"), -F.col("i"))
    after = F.least(length - 1, F.size("iw") - 1 - F.col("j"), F.size("w") - 1 - F.col("i"))
    agrees = F.transform(
        F.sequence("before", "after"),
        lambda t: (F.get("w", F.col("i") + t) == F.get("iw", F.col("j") + t)).cast("int"),
    )
    best = F.array_max(
        F.transform(
            F.sequence(F.lit(0), F.col("after") - F.col("before") + 1 - F.col("length")),
            lambda s: F.aggregate(F.slice("agrees", s + 1, F.col("length")), F.lit(0), lambda a, x: a + x),
        )
    )
    found = (
        hits.withColumns({"length": length, "before": before, "after": after})
        .where("after - before + 1 >= length")
        .withColumn("agrees", agrees)
        .withColumn("best", best)
        .where(F.col("best") >= F.ceil(F.col("length") * agree))
    )
    return found.groupBy("doc_id", "item_id").agg(
        F.max("best").cast("long").alias("matched"),
        F.max("length").cast("long").alias("compared"),
        F.min(F.col("lo") + F.col("i")).cast("long").alias("first_word"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` whose text overlaps with no item, whatever their ids are."""
    text = F.col("text").cast("string")
    hit = find(docs.select(F.xxhash64(text).alias("doc_id"), text.alias("text")), items, **settings)
    hit = small(hit.select(F.col("doc_id").alias("__text")).distinct())
    return docs.join(hit, F.xxhash64(text) == F.col("__text"), "leftanti").select([F.col(f"`{c}`") for c in docs.columns])


def oracle(masks: tuple[str, ...] = MASKS, window: int = WINDOW, agree: float = AGREE) -> str:
    """DuckDB SQL for :func:`find` over documents and benchmark."""
    def keys(a: str, i: str) -> str:
        return " UNION ALL ".join(
            f"SELECT *, {k} AS mask, concat_ws(' ', {', '.join(f'{a}[{i} + {o + 1}]' for o, c in enumerate(m) if c == '1')}) AS seed FROM {{0}}"
            for k, m in enumerate(masks)
        )

    word = "regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+')"
    num, den = round(agree * 1000), 1000
    assert math.isclose(num / den, agree)
    return f"""
    WITH d AS (SELECT doc_id, {word} AS w FROM documents WHERE text IS NOT NULL),
    b AS (SELECT DISTINCT item_id, {word} AS iw FROM benchmark WHERE text IS NOT NULL),
    dp AS (SELECT *, unnest(range(len(w) - {SPAN - 1})) AS i FROM d WHERE len(w) >= {SPAN}),
    bp AS (SELECT *, unnest(range(len(iw) - {SPAN - 1})) AS j FROM b WHERE len(iw) >= {SPAN}),
    ds AS ({keys('w', 'i').format('dp')}), bs AS ({keys('iw', 'j').format('bp')}),
    hits AS (SELECT DISTINCT doc_id, w, i, item_id, iw, j, least({window}, len(iw)) AS l FROM ds JOIN bs USING (mask, seed)),
    aligned AS (SELECT *, greatest({SPAN} - l, -j, -i) AS lo, least(l - 1, len(iw) - 1 - j, len(w) - 1 - i) AS hi FROM hits),
    windows AS (SELECT *, unnest(range(lo, hi - l + 2)) AS s FROM aligned WHERE hi - lo + 1 >= l),
    scored AS (SELECT doc_id, item_id, i, l, list_sum(list_transform(range(s, s + l), lambda t: CAST(w[i + t + 1] = iw[j + t + 1] AS INTEGER))) AS m FROM windows)
    SELECT doc_id, item_id, CAST(max(m) AS BIGINT) AS matched, CAST(max(l) AS BIGINT) AS compared, CAST(min(i) AS BIGINT) AS first_word
    FROM scored WHERE m * {den} >= l * {num} GROUP BY ALL"""
