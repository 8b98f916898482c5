"""License scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Every line and sentence of a file is compared with the sentences of license
templates, as term vectors: term frequency times the term's inverse document
frequency over all files, in whole thousandths so that sums are exact. Terms
outside the templates weigh as a term of a single file. The best cosine of at
least ``MIN_COSINE`` names the file's license.

A file named like LICENSE or COPYING speaks for its directory. A file without
a license of its own takes that of the nearest directory above it that has
one; the directories' ancestors are joined to the licence files' directories.

Only SQL functions are used. Sentences that share no weighty term with any
template are left out before anything is exploded: by the Cauchy-Schwarz
inequality the light terms alone can't reach the least cosine. Templates are a
small table written here; their vocabulary is what is broadcast or put into
expressions.

Defined results: null and empty texts have no license of their own. Null paths
lie in the root directory. Of several licence files in a directory the one with
the highest cosine speaks, then the first by license and path. Equal cosines:
the license first by name. Repeated rows each get a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.session import materialize

MIN_COSINE = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = "[a-z0-9]+"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)(\.[^/]*)?$"

# Sentences by which licenses are declared.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def sentences_of(text: Column) -> Column:
    return F.split(F.replace(text, F.lit(". "), F.lit(".\n")), "\n")


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(TERM), 0)


def template_terms(spark: SparkSession, templates: tuple) -> DataFrame:
    """(template, license, term, tf)."""
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "template int, license string, sentence string")
    return rows.select("template", "license", F.explode(terms_of(F.col("sentence"))).alias("term")).groupBy("template", "license", "term").agg(F.count(F.lit(1)).alias("tf"))


def term_weights(files: DataFrame, vocabulary: list[str]) -> tuple[dict[str, int], int]:
    """Whole-number weights of the templates' terms, and of a term of one file."""
    known = F.array(*[F.lit(t) for t in vocabulary])
    here = files.select(F.explode(F.concat(F.array_intersect(terms_of(F.coalesce("__text", F.lit(""))), known), F.array(F.lit("")))).alias("term"))
    counts = {r["term"]: r["n"] for r in here.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = counts.pop("", 0)  # each file counts once under the empty term
    spark = files.sparkSession
    # The weights are made by the same function on all sides.
    weigh = F.round(F.log((1 + F.lit(n)) / (1 + F.col("df"))) * 1000).cast("long")
    rows = spark.createDataFrame([(t, counts.get(t, 0)) for t in vocabulary] + [("", 1)], "term string, df long").select("term", F.greatest(weigh, F.lit(0)).alias("w")).collect()
    made = {r["term"]: r["w"] for r in rows}
    return made, made.pop("")


def weighty_terms(templates: list, weights: dict[str, int], least: float) -> list[str]:
    """Terms one of which any sentence with a cosine of ``least`` holds: the light rest can't reach it. None if no term has weight."""
    norm: dict[int, int] = {}
    inside: dict[int, dict[str, int]] = {}
    for r in templates:
        v = (r["tf"] * weights[r["term"]]) ** 2
        norm[r["template"]] = norm.get(r["template"], 0) + v
        inside.setdefault(r["template"], {})[r["term"]] = v
    light: dict[int, int] = dict.fromkeys(norm, 0)
    order = sorted(weights, key=lambda t: (weights[t], t))
    if not any(norm.values()):
        return []
    for k, term in enumerate(order):
        grown = {t: light[t] + inside[t].get(term, 0) for t in light}
        if any(grown[t] >= least * least * norm[t] for t in grown):
            return order[k:]
        light = grown
    return []


def own_licenses(files: DataFrame, templates: tuple = TEMPLATES, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(__row, license, cosine) of files (__row, __text) with a license sentence."""
    spark = files.sparkSession
    terms = template_terms(spark, templates)
    listed = terms.collect()  # the templates' terms
    weights, single = term_weights(files, sorted({r["term"] for r in listed}))
    strong = weighty_terms(listed, weights, min_cosine)
    if not strong:
        return files.select("__row", F.lit("").alias("license"), F.lit(0.0).alias("cosine")).where("false")
    any_strong = r"(?<![a-z0-9])(?:" + "|".join(strong) + r")(?![a-z0-9])"
    lines = files.select("__row", F.explode(F.array_distinct(F.filter(sentences_of(lowered(F.col("__text"))), lambda s: s.rlike(any_strong)))).alias("sentence"))
    counted = lines.select("__row", "sentence", F.explode(terms_of(F.col("sentence"))).alias("term")).groupBy("__row", "sentence", "term").agg(F.count(F.lit(1)).alias("n"))
    weighed = spark.createDataFrame([(t, w) for t, w in weights.items()], "term string, w long")
    counted = counted.join(F.broadcast(weighed), "term", "left").withColumn("w", F.coalesce("w", F.lit(single)))
    norms = F.sum((F.col("n") * F.col("w")) * (F.col("n") * F.col("w")))
    lengths = {}
    for r in listed:
        lengths[r["template"]] = lengths.get(r["template"], 0) + (r["tf"] * weights[r["term"]]) ** 2
    vectors = spark.createDataFrame([(r["term"], r["template"], r["tf"] * weights[r["term"]]) for r in listed], "term string, template int, v long")
    # One pass: each sentence's norm, and its product with every template as a map of one row per template.
    per_template = [F.coalesce(F.sum(F.when(F.col("template") == t, F.col("n") * F.col("w") * F.col("v"))), F.lit(0)).alias(f"p{t}") for t in sorted(lengths)]
    dots = counted.join(F.broadcast(vectors), "term").groupBy("__row", "sentence").agg(*per_template)
    sizes = counted.groupBy("__row", "sentence").agg(norms.alias("norm"))
    both = dots.join(sizes, ["__row", "sentence"])
    names = {r["template"]: r["license"] for r in listed}
    best = F.array_max(F.array(*[F.struct((F.col(f"p{t}") / F.sqrt(F.col("norm").cast("double") * float(lengths[t]))).alias("cosine"), F.lit(-rank).alias("rank"), F.lit(names[t]).alias("license")) for rank, t in enumerate(sorted(lengths, key=lambda t: names[t])) if lengths[t]]))
    found = both.where("norm > 0").groupBy("__row").agg(F.max(best).alias("b")).select("__row", "b.license", F.round("b.cosine", 6).alias("cosine"), F.col("b.cosine").alias("__raw"))
    return found.where(F.col("__raw") >= min_cosine).drop("__raw")


def scan_licenses(files: DataFrame, path: str = "path", text: str = "text", *, templates: tuple = TEMPLATES, min_cosine: float = MIN_COSINE) -> DataFrame:
    """The files' columns without the text, and license, cosine, origin (own, inherited, none), licence_path."""
    keep = [c for c in files.columns if c not in (text, "license", "cosine", "origin", "licence_path")]
    rows = files.select(*keep, F.coalesce(F.col(path), F.lit("")).alias("__path"), F.xxhash64(F.coalesce(F.col(path), F.lit("")), F.coalesce(F.col(text), F.lit(""))).alias("__row"))
    rows = rows.withColumn("__dir", F.regexp_extract("__path", r"(?s)^(.*)/[^/]*$", 1))
    rows = materialize(rows, "license-rows")
    bodies = files.select(F.xxhash64(F.coalesce(F.col(path), F.lit("")), F.coalesce(F.col(text), F.lit(""))).alias("__row"), F.col(text).alias("__text"))
    own = materialize(own_licenses(bodies, templates, min_cosine), "license-own")
    marked = rows.join(own.withColumnRenamed("__row", "__of"), F.col("__row") == F.col("__of"), "left").drop("__of")
    marked = materialize(marked, "license-marked")
    # Ancestors of every directory, joined to the directories that have a licence file.
    speaks = marked.where(F.col("license").isNotNull() & F.col("__path").rlike(LICENCE_FILE))
    first = F.min(F.struct((-F.col("cosine")).alias("cosine"), "license", F.col("__path").alias("at")))
    speakers = speaks.groupBy(F.col("__dir").alias("above")).agg(first.alias("s"))
    parts = F.split("__dir", "/")
    ancestors = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
    climbing = marked.select("__dir").distinct().select("__dir", F.explode(F.array_distinct(ancestors)).alias("above"))
    nearest = climbing.join(speakers, "above").groupBy(F.col("__dir").alias("__in")).agg(F.max_by("s", F.length("above")).alias("s"))
    out = marked.join(nearest, F.col("__dir") == F.col("__in"), "left")
    has = F.col("license").isNotNull()
    return out.select(
        *keep,
        F.coalesce("license", "s.license").alias("license"),
        F.coalesce("cosine", -F.col("s.cosine")).alias("cosine"),
        F.when(has, "own").when(F.col("s").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~has, F.col("s.at")).alias("licence_path"),
    )


def document_path() -> Column:
    """Where a document would lie: source / language / thousand; every eighth id is a licence file, some of them higher up."""
    parts = [F.col("source"), F.when(F.col("doc_id") % 512 != 0, F.col("lang")), F.when(F.col("doc_id") % 64 != 0, F.floor(F.col("doc_id") / 1000).cast("string"))]
    name = F.when(F.col("doc_id") % 8 == 0, F.concat(F.lit("LICENSE."), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return F.concat_ws("/", *parts, name)


def oracle_sql(templates: tuple = TEMPLATES, min_cosine: float = MIN_COSINE) -> str:
    """The query over ``documents`` in DuckDB SQL, every sentence compared."""
    values = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(templates))
    terms = lambda x: f"regexp_extract_all(translate({x}, '{UPPER}', '{LOWER}'), '{TERM}')"
    return f"""
WITH templates(template, license, sentence) AS (VALUES {values}),
t AS (SELECT template, license, term, count(*) AS tf FROM (SELECT template, license, unnest({terms("sentence")}) AS term FROM templates) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents),
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({terms("coalesce(text, '')")}) AS term FROM documents) WHERE term IN (SELECT term FROM t) GROUP BY term),
w AS (SELECT DISTINCT t.term, greatest(CAST(round(ln((1 + n) / (1 + coalesce(df, 0))) * 1000) AS BIGINT), 0) AS w FROM t LEFT JOIN df USING (term), n),
single AS (SELECT greatest(CAST(round(ln((1 + n) / 2) * 1000) AS BIGINT), 0) AS w1 FROM n),
tv AS (SELECT template, license, term, tf * w AS v FROM t JOIN w USING (term)),
tn AS (SELECT template, sum(v * v) AS norm FROM tv GROUP BY template),
lines AS (SELECT DISTINCT doc_id, unnest(string_split(replace(translate(text, '{UPPER}', '{LOWER}'), '. ', '.' || chr(10)), chr(10))) AS sentence FROM documents),
counted AS (SELECT doc_id, sentence, term, count(*) AS c FROM (SELECT doc_id, sentence, unnest({terms("sentence")}) AS term FROM lines) GROUP BY ALL),
weighed AS (SELECT doc_id, sentence, term, c * coalesce(w, w1) AS v FROM counted LEFT JOIN w USING (term), single),
sizes AS (SELECT doc_id, sentence, sum(v * v) AS norm FROM weighed GROUP BY ALL),
dots AS (SELECT doc_id, sentence, template, license, sum(a.v * tv.v) AS p FROM weighed a JOIN tv USING (term) GROUP BY ALL),
cosines AS (SELECT doc_id, license, p / sqrt(CAST(sizes.norm AS DOUBLE) * CAST(tn.norm AS DOUBLE)) AS cosine FROM dots JOIN sizes USING (doc_id, sentence) JOIN tn USING (template) WHERE sizes.norm > 0 AND tn.norm > 0),
own AS (SELECT doc_id, license, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, license) AS k FROM cosines WHERE cosine >= {min_cosine}) WHERE k = 1),
files AS (SELECT doc_id, concat_ws('/', source, CASE WHEN doc_id % 512 <> 0 THEN lang END, CASE WHEN doc_id % 64 <> 0 THEN CAST(doc_id // 1000 AS VARCHAR) END, CASE WHEN doc_id % 8 = 0 THEN 'LICENSE.' || doc_id ELSE doc_id || '.txt' END) AS path FROM documents),
placed AS (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM files LEFT JOIN own USING (doc_id)),
speakers AS (SELECT dir AS above, license, cosine, path AS src FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, license, path) AS k FROM placed WHERE license IS NOT NULL AND regexp_matches(path, '(^|/)LICENSE[.][^/]*$')) WHERE k = 1),
nearest AS (SELECT dir, license, cosine, src FROM (SELECT d.dir, s.*, row_number() OVER (PARTITION BY d.dir ORDER BY length(s.above) DESC) AS k FROM (SELECT DISTINCT dir FROM placed) d JOIN speakers s ON s.above = '' OR d.dir = s.above OR starts_with(d.dir, s.above || '/')) WHERE k = 1)
SELECT p.doc_id, p.path, coalesce(p.license, s.license) AS license, coalesce(p.cosine, s.cosine) AS cosine,
  CASE WHEN p.license IS NOT NULL THEN 'own' WHEN s.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN p.license IS NULL THEN s.src END AS licence_path
FROM placed p LEFT JOIN nearest s USING (dir)
"""
