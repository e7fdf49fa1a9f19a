"""License notices in texts, by MinHash bands over overlapping windows.

DataFrame functions only. Words are runs of a-z and 0-9 of the lower-cased text, shingles
five words. Each template of L shingles is looked for in windows of 3 L shingles that start
every L, so any 2 L shingles in a row lie within one: a notice broken by other words is found
wherever it starts as long as it spans at most 2 L; one spread wider can be lost. A window in
which no template's shingle occurs cannot match and is left out before it is hashed. Windows
meet templates of their length in any of ``BANDS`` bands of ``ROWS`` MinHash values: a window
with 0.8 of a template's shingles has a Jaccard similarity of 0.25 or more with it, and
``1 - (1 - 0.25 ** ROWS) ** BANDS`` is above 0.9999998. Pairs that met are verified by the
exact share of the template's shingles that the window contains.

Null, empty and short texts hold no notice. Rows that agree in id and text give one result
per template; null ids are kept. Fewer than five words make no template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.llm.common import keyed

SHINGLE = 5
LEAST = 0.8
BANDS = 56
ROWS = 1
# Lengths of a template in a window; one less is the widest span that is always covered.
SPAN = 3

# Public license notices.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "mit-line": "Released under the MIT License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
        "file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed "
        "to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the "
        "License for the specific language governing permissions and limitations under the "
        "License."
    ),
    "mit-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in "
        "all copies or substantial portions of the Software."
    ),
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version."
    ),
}


def shingles(text: Column) -> Column:
    """Hashes of a text's shingles in order."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda word: word != "")
    hashes = F.transform(words, lambda word: F.xxhash64(word))

    def joined(hashes: Column) -> Column:
        whole = F.slice(hashes, 1, F.greatest(F.size(hashes) - (SHINGLE - 1), F.lit(0)))
        return F.transform(
            whole, lambda x, i: F.xxhash64(x, *[F.get(hashes, i + at) for at in range(1, SHINGLE)])
        )

    # A one-element transform names the words' hashes, so that they are computed once.
    return F.transform(F.array(hashes), joined)[0]


def bands(window: Column) -> Column:
    """The band keys of a set of shingles."""

    def least_of(seed: int) -> Column:
        return F.array_min(F.transform(window, lambda x: F.xxhash64(x, F.lit(seed))))

    least = [least_of(seed) for seed in range(BANDS * ROWS)]
    return F.array(
        *[
            F.xxhash64(F.lit(band), *least[band * ROWS : (band + 1) * ROWS])
            for band in range(BANDS)
        ]
    )


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """``(license, wanted, n_wanted)``: the distinct shingles of each template."""
    raw = spark.createDataFrame(list(templates.items()), "license string, text string")
    wanted = raw.select("license", shingles(F.col("text")).alias("all"))
    found = wanted.select(
        "license", F.array_distinct("all").alias("wanted"), F.size("all").alias("length")
    )
    return found.where("length > 0")


def scan(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    templates: dict[str, str] | None = None,
) -> DataFrame:
    """``(doc_id, text_key, license, containment, first_shingle)``: the best window of each
    template that a text contains to 0.8 or more within a span of twice its length, and the
    place of the first of the template's shingles in it."""
    spark = df.sparkSession
    # The templates are constants of the caller: a few rows, whatever the data.
    known = template_table(spark, TEMPLATES if templates is None else templates).collect()
    every = sorted({shingle for row in known for shingle in row["wanted"]})
    lengths = sorted({row["length"] for row in known})
    wanted = spark.createDataFrame(
        [(row["license"], row["wanted"], row["length"]) for row in known],
        "license string, wanted array<long>, length int",
    )
    listed = F.broadcast(
        wanted.withColumn("band", F.explode(bands(F.col("wanted"))))
    )
    literal = F.array(*[F.lit(shingle) for shingle in every]).cast("array<long>")
    rows = keyed(df, doc_id, text).select(
        "doc_id", "text_key", shingles(F.col("text")).alias("all")
    )
    hit = rows.where(F.arrays_overlap("all", literal))
    sized = hit.withColumn(
        "length", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"))
    )
    starts = sized.withColumn(
        "start", F.explode(F.sequence(F.lit(0), F.size("all") - 1, F.col("length")))
    )
    windows = starts.select(
        "doc_id",
        "text_key",
        "length",
        "start",
        F.slice("all", F.col("start") + 1, F.col("length") * SPAN).alias("window"),
    ).where(F.arrays_overlap("window", literal))
    banded = windows.withColumn("band", F.explode(bands(F.col("window"))))
    met = banded.join(listed, ["length", "band"])
    shared = F.size(F.array_intersect("window", "wanted")) / F.size("wanted")
    verified = met.withColumn("containment", shared).where(F.col("containment") >= LEAST)
    places = F.transform(
        F.array_intersect("window", "wanted"), lambda x: F.array_position("window", x)
    )
    first = (F.col("start") + F.array_min(places) - 1).cast("int")
    best = F.max(F.struct("containment", (-first).alias("back"))).alias("best")
    return verified.groupBy("doc_id", "text_key", "license").agg(best).select(
        "doc_id",
        "text_key",
        "license",
        F.col("best.containment").alias("containment"),
        (-F.col("best.back")).alias("first_shingle"),
    )
