"""License scans: MinHash bands of overlapping text windows find templates, exact containment confirms.

All of it is column expressions.  A text becomes an array of hashes of five-word
shingles.  Windows of 8, 16, 32, ... shingles overlap by half; a template of T
shingles is looked for in windows of the smallest size that is at least 2T, so each
occurrence lies wholly inside some window.  For a window w and template t with
containment 0.8 or more the resemblance J is at least 0.8 / (2 * r + 0.2), r = size
of half a window over T, at most 2; each band is one minimum, so all BANDS miss with
probability (1 - J) ** BANDS: 0.3 % for T equal to half a window and a whole
occurrence 0.002 %, 3 % at the worst size.  A template of one shingle is its own
minimum and is never missed.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from likeness.llm.common import stored, text_of
from likeness.plans.materialise import BROADCAST_ROWS

WORDS = 5
BANDS = 16
SMALLEST = 4
CONTAINMENT = 0.8
# Up to so many template shingles, texts without any of them are told apart first.
SCREENED = 5000

# Notices by which texts state these licenses.
TEMPLATES = {
    "MIT": ["Released under the MIT License."],
    "MIT-permission": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software"
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
}


def words_of(text: str | Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text_of(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingles_of(words: Column) -> Column:
    """Hashes of all runs of WORDS words; fewer words are one shingle, none have none."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), n - (WORDS - 1)), lambda i: F.xxhash64(F.slice(words, i, WORDS)))
    none = F.array().cast("array<bigint>")
    return F.when(n >= WORDS, runs).when(n > 0, F.array(F.xxhash64(words))).otherwise(none)


def _seed(band: int) -> Column:
    """XOR with a random number is a permutation whose minimum is one member, each as likely."""
    return F.lit(((band + 1) * 0x9E3779B97F4A7C15 ^ (band + 1) * 0xC2B2AE3D27D4EB4F << 7) % (1 << 63))


def _least(hashes: str | Column, seed: Column) -> Column:
    return F.array_min(F.transform(hashes, lambda x: x.bitwiseXOR(seed)))


def _block_minima(shingles: Column, band: int) -> Column:
    """The band's minimum of each block of SMALLEST shingles."""
    blocks = F.ceil(F.size(shingles) / SMALLEST).cast("int")
    seed = _seed(band)
    return F.transform(
        F.sequence(F.lit(1), F.greatest(blocks, F.lit(1))),
        lambda b: _least(F.slice(shingles, (b - 1) * SMALLEST + 1, SMALLEST), seed),
    )


def _larger_blocks(minima: str) -> Column:
    """Minima of blocks twice as large."""
    return F.transform(
        F.sequence(F.lit(1), F.size(minima), F.lit(2)), lambda i: F.least(F.get(minima, i - 1), F.get(minima, i))
    )


def _windows(minima: list[str], half: int) -> Column:
    """Structs (half, at, window, least): all windows of two neighbouring blocks with their 16 minima."""
    last = F.greatest(F.size(minima[0]) - 1, F.lit(1))

    def one(i: Column) -> Column:
        least = [F.least(F.get(m, i - 1), F.get(m, i)) for m in minima]
        return F.struct(
            F.lit(half).alias("half"),
            (i - 1).cast("int").alias("at"),
            F.slice("_h", (i - 1) * half + 1, 2 * half).alias("window"),
            F.array(*least).alias("least"),
        )

    return F.transform(F.sequence(F.lit(1), last), one)


def _single(x: Column, i: Column) -> Column:
    return F.struct(
        F.lit(0).alias("half"), i.cast("int").alias("at"), F.array(x).alias("window"), F.array(x).alias("least")
    )


def template_table(spark: SparkSession, templates: Mapping[str, list[str]] = TEMPLATES) -> DataFrame:
    """template, license, shingles, half of every notice (stored)."""
    rows = [(f"{name}-{i}", name, text) for name, texts in templates.items() for i, text in enumerate(texts)]
    table = spark.createDataFrame(rows, "template string, license string, text string")
    table = table.select("template", "license", F.array_distinct(shingles_of(words_of("text"))).alias("shingles"))
    half = F.lit(SMALLEST)
    size = F.size("shingles")
    grown = F.when(size <= 1, F.lit(0)).otherwise(
        F.greatest(half, F.pow(F.lit(2.0), F.ceil(F.log2(size.cast("double")))).cast("int"))
    )
    return stored(table.withColumn("half", grown).filter(size > 0))


def _band_keys(table: DataFrame) -> DataFrame:
    """(half, band, least) of every template."""
    least = [
        F.struct(F.lit(j).alias("band"), _least("shingles", _seed(j)).alias("least")) for j in range(BANDS)
    ]
    itself = F.array(F.struct(F.lit(0).alias("band"), F.get("shingles", F.lit(0)).alias("least")))
    keys = table.withColumn("key", F.explode(F.when(F.col("half") == 0, itself).otherwise(F.array(*least))))
    return keys.select("template", "license", F.col("shingles").alias("wanted"), "half", "key.band", "key.least")


def scan(
    docs: DataFrame,
    templates: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    containment: float = CONTAINMENT,
) -> DataFrame:
    """One row per document and template it contains.

    Columns: doc_id, license, template, containment (the best window's), windows
    (how many contain it), first_word (where the first of them begins).  NULL and
    wordless texts have none.  Rows that repeat an id count as one document.  The
    templates are a parameter; their keys are broadcast up to a checked number and
    otherwise joined by key.
    """
    halves = sorted(r["half"] for r in templates.select("half").distinct().collect())
    keys = stored(_band_keys(templates))
    small = keys.count() <= BROADCAST_ROWS // 10
    rows = docs.select(F.col(id_col).alias("doc_id"), words_of(text_col).alias("_words"))
    rows = rows.select("doc_id", shingles_of(F.col("_words")).alias("_h"))
    # A text that shares no shingle with any template has containment 0 everywhere; its windows
    # need not be cut.  (Not a filter: pushed down, it would repeat the words inside the lambda.)
    known = templates.select(F.explode("shingles")).distinct().limit(SCREENED + 1).collect()
    if len(known) <= SCREENED:
        shared = F.arrays_overlap("_h", F.array(*[F.lit(r[0]) for r in known]).cast("array<bigint>"))
        rows = rows.select("doc_id", F.when(shared, F.col("_h")).alias("_h"))
    looked = [F.transform("_h", _single)] if 0 in halves else []
    wide = [h for h in halves if h]
    level = SMALLEST
    while wide and level <= wide[-1]:
        finer = [f"_m{j}_{level // 2}" for j in range(BANDS)]
        names = [f"_m{j}_{level}" for j in range(BANDS)]
        if level == SMALLEST:
            rows = rows.withColumns({n: _block_minima(F.col("_h"), j) for j, n in enumerate(names)})
        else:
            rows = rows.withColumns({n: _larger_blocks(f) for f, n in zip(finer, names)})
        if level in wide:
            looked.append(_windows(names, level))
        level *= 2
    # A window takes its shingles along, so that no row carries its whole text's.
    windows = rows.select("doc_id", F.explode(F.concat(*looked)).alias("w")).select("doc_id", "w.*")
    probes = windows.select("doc_id", "half", "at", "window", F.posexplode("least").alias("band", "least"))
    hits = probes.join(F.broadcast(keys) if small else keys, ["half", "band", "least"])
    start = F.col("at") * F.greatest("half", F.lit(1))
    share = F.size(F.array_intersect("wanted", "window")) / F.size("wanted")
    sure = hits.select("doc_id", "license", "template", start.alias("first_word"), share.alias("containment"))
    sure = sure.filter(F.col("containment") >= containment)
    return sure.groupBy("doc_id", "license", "template").agg(
        F.max("containment").alias("containment"),
        F.count_distinct("first_word").alias("windows"),
        F.min("first_word").alias("first_word"),
    )
