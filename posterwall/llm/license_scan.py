"""License scans by MinHash bands over overlapping windows, in DataFrame functions alone.

Texts and templates become words of ASCII letters and digits and shingles of two words. A text is
cut into blocks of BLOCK shingles; a window is two neighbouring blocks, so every run of BLOCK + 1
shingles lies whole in some window. For each of BANDS random targets a window keeps the hash
nearest to the target (of least exclusive or): a MinHash value, as all shingles are equally likely to
be the nearest. Bands are of one row: a window that holds a run of R shingles shares a given band with
it with probability R / (2 * BLOCK), and all bands miss with (1 - R / (2 * BLOCK)) ** BANDS, 0.000003
for the shortest template here (R = 4). Templates are indexed by runs of at most BLOCK + 1 shingles.

Retrieved pairs of text and template are verified exactly: the text's regions of twice the template's
length, each starting half a region after the last, are searched for the template's distinct shingles.
The share found in the best region is the containment.

Null and empty texts match nothing. Rows that repeat an id count as one document; a null id is an
id like others. Extra columns are ignored. Tables without a match give no rows.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from posterwall.llm.store import written
from posterwall.session import broadcast_if_small

BLOCK = 6
BANDS = 32
LEAST_CONTAINMENT = 0.8

# License notices as they stand in texts, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or any later version",
    ),
)


def _targets(n: int) -> list[int]:
    """Random 64-bit numbers by a fixed rule."""
    out, x = [], 1
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) & (2**64 - 1)
        out.append(x - 2**64 if x >= 2**63 else x)
    return out


def shingles(text: Column) -> tuple[Column, Column]:
    """(words, hashes of pairs of neighbouring words) of a text."""
    words = F.filter(F.split(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]+", " ")), " "), lambda w: w != "")
    return words, F.zip_with(
        F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))),
        F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))),
        lambda a, b: F.xxhash64(a, b),
    )


def with_shingles(rows: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` and h, the shingle hashes of text."""
    words, pairs = shingles(F.col("text"))
    return rows.select(*keep, words.alias("words")).select(*keep, pairs.alias("h"))


def _banded(runs: DataFrame, key: str, width: int) -> DataFrame:
    """key, band, value of every row of runs(key, w), w being at most `width` hashes.

    Targets become rows before the distances are taken, so one short expression serves all bands.
    """
    targets = F.array(*map(F.lit, _targets(BANDS)))
    each = runs.select(key, "w", F.posexplode(targets).alias("band", "target"))
    nearest = F.least(*(F.get("w", F.lit(i)).bitwiseXOR(F.col("target")) for i in range(width)))
    return each.select(key, "band", nearest.alias("value"))


def window_bands(rows: DataFrame, key: str) -> DataFrame:
    """key, band, value of every window of rows(key, h); values are null without shingles.

    The explode is outer, as the inner one adds a filter on its array, which would be computed twice.
    """
    last = F.greatest(F.floor((F.size("h") - 1) / BLOCK), F.lit(0)).cast("int")
    windows = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice("h", k * BLOCK + 1, 2 * BLOCK))
    return _banded(rows.select(key, F.explode_outer(windows).alias("w")), key, 2 * BLOCK)


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """template, license, h of each template with a shingle."""
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "template int, license string, text string")
    return with_shingles(rows, "template", "license")


def template_bands(templates: DataFrame) -> DataFrame:
    """template, band, value of every indexed run."""
    run = BLOCK + 1
    starts = F.sequence(F.lit(1), F.greatest(F.size("h") - run + 1, F.lit(1)))
    runs = F.transform(starts, lambda k: F.slice("h", k, run))
    return _banded(templates.select("template", F.explode_outer(runs).alias("w")), "template", run).distinct()


def verify(texts: DataFrame, pairs: DataFrame, templates: DataFrame, least: float) -> DataFrame:
    """doc_id, license, template, n_shingles, matched, containment of pairs(doc_id, template) by exact shingles."""
    parts = templates.select("template", "license", F.explode(F.array_distinct("h")).alias("s"), F.size("h").alias("span"),
                             F.size(F.array_distinct("h")).alias("n_shingles"))
    places = with_shingles(texts, "doc_id").select("doc_id", F.posexplode_outer("h").alias("pos", "s"))
    met = places.join(broadcast_if_small(parts), "s")
    regions = met.withColumn("half", F.floor(F.col("pos") / F.col("span"))).select(
        "doc_id", "template", "license", "n_shingles", "s", F.explode(F.array(F.col("half"), F.col("half") - 1)).alias("region")
    )
    counted = regions.groupBy("doc_id", "template", "license", "n_shingles", "region").agg(F.countDistinct("s").alias("matched"))
    best = counted.groupBy("doc_id", "template", "license", "n_shingles").agg(F.max("matched").alias("matched"))
    wanted = pairs.select(F.col("doc_id").alias("_id"), F.col("template").alias("_template"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("template") == F.col("_template"))
    return (
        best.join(wanted, same, "left_semi")
        .withColumn("containment", F.col("matched") / F.col("n_shingles"))
        .where(F.col("containment") >= least)
        .select("doc_id", "license", "template", F.col("n_shingles").cast("long").alias("n_shingles"), "matched", "containment")
    )


def scan(docs: DataFrame, templates: DataFrame | None = None, least: float = LEAST_CONTAINMENT) -> DataFrame:
    """doc_id, license, template, n_shingles, matched, containment of every match in docs(doc_id, text)."""
    templates = template_table(docs.sparkSession) if templates is None else templates
    index = broadcast_if_small(template_bands(templates))
    retrieved = window_bands(with_shingles(docs, "doc_id"), "doc_id").join(index, ["band", "value"])
    pairs = written(retrieved.select("doc_id", "template").distinct(), "license-pairs")
    ids = pairs.select(F.col("doc_id").alias("_id")).distinct()
    texts = docs.select("doc_id", "text").join(broadcast_if_small(ids), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return verify(texts, pairs, templates, least)


def oracle(templates=TEMPLATES, least: float = LEAST_CONTAINMENT) -> str:
    """The same rows by exact search of all texts for all templates, in DuckDB's SQL."""
    values = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(templates))
    words = "list_filter(string_split(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')"
    return f"""
WITH t(template, license, text) AS (VALUES {values}),
tw AS (SELECT template, license, {words} AS w FROM t),
ts AS (SELECT template, license, len(w) - 1 AS span,
              unnest(list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) AS s FROM tw WHERE len(w) > 1),
parts AS (SELECT *, count(*) OVER (PARTITION BY template) AS n_shingles FROM ts),
dw AS (SELECT doc_id, {words} AS w FROM documents),
dp AS (SELECT doc_id, unnest(range(len(w) - 1)) AS pos, unnest(list_zip(w[:-2], w[2:])) AS p FROM dw WHERE len(w) > 1),
places AS (SELECT doc_id, pos, p[1] || ' ' || p[2] AS s FROM dp),
met AS (SELECT doc_id, template, license, n_shingles, s, pos // span AS half FROM places JOIN parts USING (s)),
regions AS (SELECT * EXCLUDE half, unnest([half, half - 1]) AS region FROM met),
counted AS (SELECT doc_id, template, license, n_shingles, region, count(DISTINCT s) AS matched FROM regions GROUP BY ALL)
SELECT doc_id, license, CAST(template AS INTEGER) AS template, n_shingles, max(matched) AS matched,
       max(matched) / n_shingles AS containment
FROM counted GROUP BY doc_id, template, license, n_shingles HAVING max(matched) / n_shingles >= {least}
"""
