"""License notices in documents: MinHash bands over overlapping windows find templates, shingle containment verifies.

Words are lower-cased runs of anything but ASCII punctuation, space and control; a shingle is five words. A template of n
words is compared with windows of n + n // 4 - 1 words (n at least) that start at every (n // 4)-th word, so a complete
copy lies wholly in some window whose Jaccard similarity with the template is about 0.8. With 24 bands of two rows a window of
similarity 0.8 collides with certainty for all practical purposes (1 - 2e-11), one of similarity 0.5 with 0.999. A
collision counts if the window holds at least ``CONTAINED`` of the template's distinct shingles.

A window can only collide in a band if it contains the shingles that attain the template's minima. So positions are
joined with those shingles first, and minima of windows are computed only around them; the collisions are the same as if
all windows had been hashed.

Defined cases: null and empty texts hold no notice; a template of fewer than five words never matches; repeated rows with
one id count as that id once; empty tables give no rows; a document may match several templates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K = 5
BANDS, ROWS = 24, 2
CONTAINED = 0.75
#: Words of a document per chunk.
CORE = 1024
BROADCAST_SHINGLES = 200_000

BETWEEN = "[\\x00-/:-@\\[-`{-\\x7f]+"

# Public license notices.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("mit", "Released under the MIT License."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def templates(spark: SparkSession) -> DataFrame:
    """``template_id, license, text`` of the notices known here."""
    rows = [(i, name, text) for i, (name, text) in enumerate(TEMPLATES)]
    return spark.createDataFrame(rows, "template_id long, license string, text string")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text.cast("string")), BETWEEN), lambda w: F.octet_length(w) > 0)


def _shingles(words: str) -> Column:
    ends = F.sequence(F.lit(0), F.size(words) - K)
    whole = F.transform(ends, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(K))))
    return F.when(F.size(words) >= K, whole)


def _hashed(row: int):
    """The hash function of one row of a band, as it applies to a shingle."""
    return lambda shingle: F.xxhash64(shingle, F.col("band") * ROWS + row)


def _template_bands(known: DataFrame) -> DataFrame:
    """For each template and band the shingle of its first minimum, and the minima of all rows."""
    listed = known.select("template_id", "license", _words(F.col("text")).alias("w")).where(F.size("w") >= K)
    listed = listed.select("template_id", "license", F.size("w").alias("n"), F.array_distinct(_shingles("w")).alias("t"))
    step = F.greatest(F.floor(F.col("n") / 4).cast("int"), F.lit(1))
    bands = listed.withColumns({"step": step, "width": F.col("n") + step - 1, "band": F.explode(F.array(*map(F.lit, range(BANDS))))})
    least = [
        F.array_min(F.arrays_zip(F.transform("t", _hashed(r)).alias("h"), F.col("t").alias("x")))
        for r in range(ROWS)
    ]
    return bands.select(
        "template_id", "license", "t", "step", "width", "band",
        least[0]["x"].alias("shingle"), F.array(*(m["h"] for m in least)).alias("minima"),
    )


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``doc_id, template_id, license, matched, shingles, first_word`` of each template found in a document.

    ``known`` holds ``template_id, license, text``. ``matched`` of the template's ``shingles`` lie in the best window;
    ``first_word`` is where the first such window starts.
    """
    bands = _template_bands(known)
    sizes = bands.agg(F.count("*"), F.max("width")).first()
    small = F.broadcast if sizes[0] <= BROADCAST_SHINGLES else lambda df: df
    widest = sizes[1] or K
    listed = docs.select("doc_id", _words(F.col("text")).alias("all")).where(F.size("all") >= K)
    starts = F.sequence(F.lit(0), F.size("all") - K, F.lit(CORE))
    chunks = listed.select(
        "doc_id",
        F.explode(F.transform(starts, lambda s: F.struct(s.alias("s"), F.slice("all", s + 1, CORE + widest).alias("w")))).alias("c"),
    ).select("doc_id", F.col("c.s").alias("s"), _shingles("c.w").alias("h")).where("h is not null")
    hits = chunks.select("doc_id", "s", "h", F.posexplode("h").alias("p", "shingle")).join(small(bands), "shingle")
    # windows that hold the position and start in this chunk; starts are multiples of the step in the document
    lowest = F.greatest(F.col("s"), F.col("s") + F.col("p") + K - F.col("width"))
    first = F.ceil(lowest / F.col("step")) * F.col("step")
    last = F.least(F.col("s") + F.col("p"), F.col("s") + CORE - 1)
    windows = hits.where(first <= last).withColumn("start", F.explode(F.sequence(first, last.cast("long"), F.col("step").cast("long"))))
    inside = F.slice("h", (F.col("start") - F.col("s") + 1).cast("int"), F.col("width") - K + 1)
    windows = windows.withColumn("v", inside)
    collides = [
        F.array_min(F.transform("v", _hashed(r))) == F.get("minima", F.lit(r))
        for r in range(ROWS)
    ]
    for c in collides:
        windows = windows.where(c)
    matched = windows.withColumn("m", F.size(F.array_intersect("t", "v"))).where(F.col("m") >= F.size("t") * CONTAINED)
    return matched.groupBy("doc_id", "template_id", "license").agg(
        F.max("m").cast("long").alias("matched"),
        F.max(F.size("t")).cast("long").alias("shingles"),
        F.min_by("start", F.struct(-F.col("m"), "start")).cast("long").alias("first_word"),
    )


def oracle() -> str:
    """DuckDB SQL that compares every window with every template."""
    word = "regexp_extract_all(lower(text), '[^\\x00-/:-@\\[-`{-\\x7f]+')"
    rows = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(TEMPLATES))
    gram = f"list_transform(range(1, len(w) - {K - 2}), lambda i: array_to_string(w[i:i + {K - 1}], ' '))"
    return f"""
    WITH t AS (SELECT template_id, license, {word} AS w FROM (VALUES {rows}) AS v(template_id, license, text)),
    tt AS (SELECT template_id, license, len(w) AS n, greatest(len(w) // 4, 1) AS step, list_distinct({gram}) AS g FROM t),
    d AS (SELECT doc_id, {word} AS w FROM documents WHERE text IS NOT NULL),
    dd AS (SELECT doc_id, {gram} AS g FROM d WHERE len(w) >= {K}),
    pairs AS (SELECT doc_id, template_id, license, n, step, tt.g AS tg, dd.g AS dg FROM dd, tt WHERE list_has_any(dd.g, tt.g)),
    windows AS (SELECT *, unnest(range(0, len(dg), step)) AS s FROM pairs),
    scored AS (SELECT doc_id, template_id, license, len(tg) AS total, s,
               len(list_intersect(tg, dg[s + 1:s + n + step - {K}])) AS m FROM windows)
    SELECT doc_id, CAST(template_id AS BIGINT) AS template_id, license, CAST(max(m) AS BIGINT) AS matched,
           CAST(max(total) AS BIGINT) AS shingles, arg_min(s, -m * 100000000 + s) AS first_word
    FROM scored WHERE m >= {CONTAINED} * total GROUP BY ALL"""
