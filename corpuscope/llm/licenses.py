"""License notices in documents: MinHash bands over text windows, then exact containment.

A text is its words (runs of letters and digits, lower case) and their 5-word shingles. Templates
of about the same size form a class of c = 1, 2, 4 ... shingles (the next power of two), whose
windows are 2c shingles long and c apart, so that every passage of up to c shingles lies in one.
A window that holds a template to 0.75 has a Jaccard similarity of at least ``LEAST`` with it,
whatever else it holds; bands of one MinHash value each then collide with a probability of
1 - (1 - LEAST) ** BANDS, and BANDS is chosen for 0.9999. Windows that share a band value with a
template are verified by counting its shingles in the window. Windows without any shingle of a
template cannot pass that test and are not hashed.

Only DataFrame functions are used. Edge cases: null and empty texts and texts of fewer than five
words hold no notice; templates of fewer than five words are not looked for; rows that share an
id (null too) are reported together.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from corpuscope.llm.common import text_of

# Notices as their licenses ask for them to be printed.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."
                   " You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by"
                " the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
]

SHINGLE, CONTAINMENT = 5, 0.75
#: Least similarity of a window and a template it holds: 0.75 m of at most 2c + 0.25 m shingles, c < 2 m.
LEAST = 0.75 / 4.25
BANDS = math.ceil(math.log(1e-4) / math.log(1 - LEAST))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingles(w: Column) -> Column:
    """Hashes of the 5-word shingles in order; the words are sliced once, outside the lambda."""
    n = F.size(w) - (SHINGLE - 1)
    parts = [F.slice(w, i + 1, F.greatest(n, F.lit(0))).alias(f"w{i}") for i in range(SHINGLE)]
    return F.transform(F.arrays_zip(*parts), lambda z: F.xxhash64(*[z[f"w{i}"] for i in range(SHINGLE)]))


def bands(window: Column) -> Column:
    """MinHash values of a window, one a band."""
    def least(band: int) -> Column:
        return F.array_min(F.transform(window, lambda x: F.xxhash64(x, F.lit(band))))
    return F.array(*[least(band) for band in range(BANDS)])


def template_table(spark, templates: list[tuple[str, str]]) -> DataFrame:
    """template, license, class, shingles of the given notices: as many rows as the caller lists."""
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, text string")
    made = rows.select("template", "license", F.array_distinct(shingles(words(F.col("text")))).alias("own")).filter(F.size("own") > 0)
    return made.withColumn("class", F.pow(F.lit(2), F.ceil(F.log2(F.size("own")))).cast("int"))


def find_notices(docs: DataFrame, templates: list[tuple[str, str]] = NOTICES, doc_id: str = "doc_id", text: str = "text",
                 containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, license, n_windows and containment (the largest) of every document and license found in it."""
    known = template_table(docs.sparkSession, templates)
    listed = known.select("class", "own").collect()
    every = sorted({x for r in listed for x in r["own"]})
    classes = sorted({r["class"] for r in listed})
    if not every:
        return docs.select(F.col(doc_id).alias("doc_id"), F.lit("").alias("license"), F.lit(0).cast("long").alias("n_windows"), F.lit(0.0).alias("containment")).limit(0)
    # one row an element: Spark then computes words and shingles once and not in every use below
    hashed = (docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.array(words(text_of(text)))).alias("w"))
              .select("doc_id", F.explode(F.array(shingles(F.col("w")))).alias("h")).filter(F.exists("h", lambda x: x.isin(every))))
    placed = hashed.select("doc_id", "h", F.filter(F.transform("h", lambda x, i: F.when(x.isin(every), i)), lambda i: i.isNotNull()).alias("at"))

    def starts(c: int) -> Column:
        first = F.transform("at", lambda p: p - F.pmod(p, F.lit(c)))
        all_starts = F.array_distinct(F.concat(first, F.transform(first, lambda s: F.greatest(s - c, F.lit(0)))))
        return F.transform(all_starts, lambda s: F.struct(F.lit(c).alias("class"), s.alias("start")))

    windows = (placed.select("doc_id", "h", F.explode(F.concat(*[starts(c) for c in classes])).alias("p"))
               .select("doc_id", F.col("p.class").alias("class"), F.col("p.start").alias("start"),
                       F.explode(F.array(F.array_distinct(F.slice("h", F.col("p.start") + 1, 2 * F.col("p.class"))))).alias("window")))
    keyed = windows.select("doc_id", "class", "start", "window", F.posexplode(bands(F.col("window"))).alias("band", "value"))
    keys = known.select("template", "license", "own", "class", F.posexplode(bands(F.col("own"))).alias("band", "value"))
    met = keyed.join(F.broadcast(keys), ["class", "band", "value"])
    inside = F.size(F.array_intersect("window", "own")) / F.size("own")
    return (met.withColumn("inside", inside).filter(F.col("inside") >= containment)
            .groupBy("doc_id", "license").agg(F.countDistinct("template", "start").alias("n_windows"), F.max("inside").alias("containment")))


def duckdb_sql(templates: list[tuple[str, str]] = NOTICES, containment: float = CONTAINMENT) -> str:
    """The same result by brute force: every window against every template."""
    values = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(templates))
    cut = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    made = "list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))"
    return f"""
WITH notices(template, license, text) AS (VALUES {values}),
own AS (SELECT DISTINCT template, license, unnest(s) AS shingle FROM (SELECT template, license, {made} AS s FROM (SELECT template, license, {cut} AS w FROM notices))),
sized AS (SELECT template, license, count(*) AS m, CAST(pow(2, ceil(log2(count(*)))) AS BIGINT) AS c FROM own GROUP BY ALL),
cut AS (SELECT doc_id, row_number() OVER () AS r, {cut} AS w FROM documents),
every AS (SELECT doc_id, r, unnest(s) AS shingle, unnest(range(len(s))) AS p FROM (SELECT doc_id, r, {made} AS s FROM cut WHERE len(w) >= 5)),
hit AS (SELECT doc_id, r, p, shingle, template, license, m, c FROM every JOIN own USING (shingle) JOIN sized USING (template, license)),
windowed AS (
  SELECT *, p - p % c AS start FROM hit
  UNION ALL SELECT *, p - p % c - c FROM hit WHERE p - p % c >= c),
counted AS (SELECT doc_id, r, template, license, start, count(DISTINCT shingle) / m AS inside FROM windowed GROUP BY doc_id, r, template, license, start, m)
SELECT doc_id, license, count(DISTINCT (template, start)) AS n_windows, max(inside) AS containment FROM counted
WHERE inside >= {containment} GROUP BY doc_id, license"""
