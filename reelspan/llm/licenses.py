"""License scan: TF-IDF cosine of sentences and licence files to templates, and inheritance from ancestor directories.

DataFrame functions only. Vectors are sparse rows (unit, word, weight): weight = count * idf, idf = ln((1 + files) /
(1 + files with the word)) + 1 with counts over all files; words in no template weigh as if no file had them. A unit
is a sentence of a file, within its line or over line ends, or the whole text of a file with a licence file's name. A unit's cosine can only
reach the threshold if it has one of a template's heaviest words, those without which what is left is too short a
vector; only such units are compared.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F

from reelspan.llm.common import row_keys, stage

_NOTICE = ("This {} is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, "
           "either version {} of the License, or (at your option) any later version")
#: Sentences, source notices, titles and tags of well-known public licenses; a license may have several.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Released into the public domain under CC0 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    # the published notice for source files
    ("GPL-2.0", _NOTICE.format("program", "GNU General Public License", "2")),
    ("GPL-3.0", _NOTICE.format("program", "GNU General Public License", "3")),
    ("LGPL-2.1", _NOTICE.format("library", "GNU Lesser General Public License", "2.1")),
    ("LGPL-3.0", _NOTICE.format("library", "GNU Lesser General Public License", "3")),
    ("AGPL-3.0", _NOTICE.format("program", "GNU Affero General Public License", "3")),
    ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    # the title of the published text
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    # the tag of source files
    *((name, f"SPDX-License-Identifier: {tag}") for name, tag in (
        ("MIT", "MIT"), ("Apache-2.0", "Apache-2.0"), ("MPL-2.0", "MPL-2.0"), ("ISC", "ISC"), ("BSD-2-Clause", "BSD-2-Clause"), ("BSD-3-Clause", "BSD-3-Clause"),
        *((f"{k}GPL-{v}", f"{k}GPL-{v}{end}") for k, v in (("", "2.0"), ("", "3.0"), ("L", "2.1"), ("L", "3.0"), ("A", "3.0")) for end in ("", "-only", "-or-later")))),
)
THRESHOLD = 0.75
LICENSE_FILE = r"(?i)(^|/)(licen[sc]e|copying)([.-][^/]*)?$"
_WORD = "[a-z0-9]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def sentences(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"([.!?])[ \t]+", "$1\n"), "\n")


def wrapped_sentences(text: Column) -> Column:
    """Sentences that may run over line ends; a line without a letter or digit ends one."""
    blocks = F.regexp_replace(text, "\n([^A-Za-z0-9\n]*\n)+", "\x01")
    return F.split(F.translate(F.regexp_replace(F.translate(blocks, "\n", " "), r"([.!?])[ \t]+", "$1\n"), "\x01", "\n"), "\n")


def directory(path: Column) -> Column:
    """What stands before the last slash; empty at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def ancestors(path_of_dir: Column) -> Column:
    """The directory, its parents, and the top (empty)."""
    parts = F.filter(F.split(path_of_dir, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def template_counts(templates=TEMPLATES) -> list[Counter]:
    return [Counter(re.findall(_WORD, t.lower())) for _, t in templates]


def _key_words(counts: list[Counter], idf: dict[str, float], threshold: float) -> set[str]:
    """Words of which every unit at the threshold has one: without them a template keeps too little of its length."""
    keys = set()
    for c in counts:
        weight = sorted(((n * idf[w]) ** 2, w) for w, n in c.items())
        left = sum(x for x, _ in weight)
        need = threshold ** 2 * left
        while weight and left >= need * (1 - 1e-9):
            x, w = weight.pop()
            keys.add(w)
            left -= x
    return keys


def own_licenses(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(files without their text but with ``row_keys``, own licenses per key: _k1, _k2, license, score).

    files: doc_id, path, text, all of which may be null. Of several licenses the one with the largest cosine counts,
    ties by name.
    """
    spark = files.sparkSession
    counts = template_counts(templates)
    vocabulary = sorted(set().union(*counts))
    k1, k2 = row_keys()
    d = files.withColumns({"_k1": k1, "_k2": k2, "text": F.coalesce("text", F.lit(""))})
    known = F.array(*[F.lit(w) for w in vocabulary])
    narrow = stage(d.select("_k1", "_k2", "doc_id", "path", F.array_intersect(words(F.col("text")), known).alias("_hits")))
    # as many rows as the templates have words
    df = {r.w: r["count"] for r in narrow.select(F.explode("_hits").alias("w")).groupBy("w").count().collect()}
    n = narrow.count()
    idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in vocabulary}
    unknown = math.log(1 + n) + 1
    keys = F.array(*[F.lit(w) for w in sorted(_key_words(counts, idf, threshold))])

    pattern = "(^|[^a-z0-9])(" + "|".join(sorted(_key_words(counts, idf, threshold))) + ")($|[^a-z0-9])"
    some = d.where(F.lower("text").rlike(pattern))
    whole = F.when(F.coalesce(F.col("path"), F.lit("")).rlike(LICENSE_FILE), F.array("text")).otherwise(F.array().cast("array<string>"))
    units = some.select("_k1", "_k2", F.posexplode(F.array_union(F.concat(whole, sentences(F.col("text"))), wrapped_sentences(F.col("text")))).alias("unit", "u"))
    units = units.select("_k1", "_k2", "unit", words(F.col("u")).alias("ws")).where(F.arrays_overlap("ws", keys))
    tf = units.select("_k1", "_k2", "unit", F.explode("ws").alias("w")).groupBy("_k1", "_k2", "unit", "w").count()
    table = spark.createDataFrame([(w, float(i)) for w, i in idf.items()], "w string, idf double")
    v = tf.join(F.broadcast(table), "w", "left")  # the templates' words
    v = stage(v.select("_k1", "_k2", "unit", "w", (F.col("count") * F.coalesce("idf", F.lit(unknown))).alias("x")))
    unit = ["_k1", "_k2", "unit"]
    length = v.groupBy(unit).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))
    weights = []
    for i, ((name, _), c) in enumerate(zip(templates, counts)):
        size = math.sqrt(sum((k * idf[w]) ** 2 for w, k in c.items()))
        weights += [(i, name, w, k * idf[w] / size) for w, k in c.items()]
    weights = spark.createDataFrame(weights, "t int, license string, w string, y double")
    dots = v.join(F.broadcast(weights), "w").groupBy(*unit, "t", "license").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    found = dots.join(length, unit).withColumn("score", F.round(F.col("dot") / F.col("length"), 6)).where(F.col("score") >= threshold)
    best = found.groupBy("_k1", "_k2").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    return narrow.drop("_hits"), best.select("_k1", "_k2", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def scan(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, license, score, found_in of every row of ``files`` (doc_id, path, text; other columns are ignored).

    A file with a license of its own has it, its cosine, and its own path in found_in. Others inherit from the nearest
    directory above (their own first) with a licence file that has one (of several the largest cosine, then the name);
    found_in is that directory, score null. Null in all three: no license. Directories are resolved once each, not per
    file. Null texts count as empty, files without a path inherit nothing, repeated rows are repeated. An empty table
    gives none.
    """
    narrow, own = own_licenses(files, templates, threshold)
    d = stage(narrow.join(own, ["_k1", "_k2"], "left").withColumn("dir", directory(F.col("path"))))
    stated = d.where(F.col("license").isNotNull() & F.col("path").rlike(LICENSE_FILE))
    stated = stated.groupBy(F.col("dir").alias("above")).agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    dirs = d.where(F.col("license").isNull() & F.col("dir").isNotNull()).select("dir").distinct()
    dirs = dirs.select("dir", F.explode(ancestors(F.col("dir"))).alias("above"))
    near = dirs.join(stated, "above").groupBy("dir").agg(F.max(F.struct(F.length("above").alias("n"), "above", "b.license")).alias("x"))
    near = near.select("dir", F.col("x.license").alias("_license"), F.col("x.above").alias("_above"))
    out = d.join(near, "dir", "left")
    mine = F.col("license").isNotNull()
    return out.select("doc_id", "path", F.coalesce("license", "_license").alias("license"), "score",
                      F.when(mine, F.col("path")).otherwise(F.col("_above")).alias("found_in"))


def oracle(files: str, templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for ``scan``; files: SQL of doc_id, path, text (no nulls)."""
    rows = ", ".join(f"({i}, '{name}', '{t}')" for i, (name, t) in enumerate(templates))
    take = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
    return f"""WITH f AS ({files}), t(t, license, body) AS (VALUES {rows}),
 tw AS (SELECT t, license, w, count(*) AS k FROM (SELECT t, license, unnest({take.format('body')}) AS w FROM t) GROUP BY ALL),
 df AS (SELECT w, count(*) AS n FROM (SELECT unnest(list_distinct({take.format('text')})) AS w FROM f) WHERE w IN (SELECT w FROM tw) GROUP BY w),
 idf AS (SELECT DISTINCT tw.w, ln((1 + (SELECT count(*) FROM f)) / (1 + coalesce(n, 0))::DOUBLE) + 1 AS idf FROM tw LEFT JOIN df USING (w)),
 tv AS (SELECT t, license, w, k * idf / sqrt(sum((k * idf) ** 2) OVER (PARTITION BY t)) AS y FROM tw JOIN idf USING (w)),
 s AS (SELECT doc_id, path, list_concat(CASE WHEN regexp_matches(path, '{LICENSE_FILE}') THEN [text] ELSE [] END,
   list_concat(string_split(regexp_replace(text, '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(10)),
   string_split(translate(regexp_replace(translate(regexp_replace(text, '\\n([^A-Za-z0-9\\n]*\\n)+', chr(1), 'g'), chr(10), ' '),
    '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(1), chr(10)), chr(10)))) AS us FROM f),
 u AS (SELECT doc_id, unnest(us) AS u, generate_subscripts(us, 1) AS unit FROM s),
 tf AS (SELECT doc_id, unit, w, count(*) AS k FROM (SELECT doc_id, unit, unnest({take.format('u')}) AS w FROM u) GROUP BY ALL),
 v AS (SELECT doc_id, unit, tf.w, k * coalesce(idf, ln(1.0 + (SELECT count(*) FROM f)) + 1) AS x FROM tf LEFT JOIN idf USING (w)),
 l AS (SELECT doc_id, unit, sqrt(sum(x * x)) AS len FROM v GROUP BY ALL),
 c AS (SELECT doc_id, unit, license, sum(x * y) AS dot FROM v JOIN tv USING (w) GROUP BY doc_id, unit, t, license),
 own AS (SELECT doc_id, license, round(dot / len, 6) AS score FROM c JOIN l USING (doc_id, unit) WHERE round(dot / len, 6) >= {threshold}
   QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) = 1),
 d AS (SELECT f.doc_id, path, license, score, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM f LEFT JOIN own USING (doc_id)),
 st AS (SELECT dir AS above, license AS inherited FROM d WHERE license IS NOT NULL AND regexp_matches(path, '{LICENSE_FILE}')
   QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, license) = 1),
 near AS (SELECT dir, inherited, above FROM (SELECT DISTINCT dir FROM d) d JOIN st ON above = '' OR dir = above OR starts_with(dir, above || '/')
   QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(above) DESC) = 1)
 SELECT doc_id, path, coalesce(license, inherited) AS license, score, CASE WHEN license IS NOT NULL THEN path ELSE above END AS found_in
 FROM d LEFT JOIN near USING (dir)"""
