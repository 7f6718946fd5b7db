"""Licence scans in DataFrame operations only: sparse TF-IDF cosine, then inheritance along paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsengine.llm.frames import cut

# How licences are commonly stated, in headers and at the top of licence files.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it under the terms of the GNU General Public License."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("EPL-2.0", "This program is made available under the terms of the Eclipse Public License 2.0."),
]
# Words that say little about a licence, and names of licence files.
COMMON = {"a", "an", "and", "any", "are", "as", "be", "by", "for", "in", "into", "is", "it", "may", "not", "of", "or", "that", "the", "this", "to", "with", "you"}
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)([._-][^/]*)?$"
TOKEN = "[a-z0-9]+([.-][a-z0-9]+)*"
#: A sentence states the licence of the template that it is at least so similar to.
SIMILARITY = 0.6


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def sentences(text: Column) -> Column:
    """Distinct trimmed sentences and lines."""
    parts = F.split(F.regexp_replace(text, r"([.!?])[ \t]+", "$1\n"), "[\r\n]+")
    return F.array_distinct(F.transform(parts, lambda s: F.trim(s)))


def default_templates(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(i).alias("template_id"), F.lit(n).alias("license"), F.lit(t).alias("text")) for i, (n, t) in enumerate(TEMPLATES)])
    return spark.range(1).select(F.inline(rows))


def template_index(templates: DataFrame) -> DataFrame:
    """Inverted index (token, template_id, license, idf, part) with unit-length TF-IDF parts.

    idf = ln((1 + N) / (1 + templates with the token)) + 1.
    """
    tf = templates.select("template_id", "license", F.explode(tokens(F.col("text"))).alias("token")).groupBy("template_id", "license", "token").agg(F.count("*").alias("tf"))
    n = templates.agg(F.count("*").alias("n"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    weighed = tf.join(df, "token").join(F.broadcast(n)).withColumn("idf", F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    norm = weighed.groupBy("template_id").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), 2))).alias("norm"), F.max("n").alias("n"))
    return weighed.drop("n").join(norm, "template_id").select("token", "template_id", "license", "idf", (F.col("tf") * F.col("idf") / F.col("norm")).alias("part"), "n")


def candidates(said: Column, index: DataFrame, least: float = SIMILARITY) -> tuple[Column, Callable[[Column], Column]]:
    """Those of an array of sentences that can be ``least`` similar to a template, and a test of whole texts for holding one.

    No match is lost: a sentence's cosine to a template is at most the root of
    the squared parts of the template's tokens that it holds, and the second
    step asks for ``least`` of that bound. The first step asks for one of the
    template's anchors: tokens, common words last, without which the rest has
    less than ``least``. The index is that of a stated list, so it is small.
    """
    bound = max(least - 1e-6, 0.0) ** 2
    masses: dict[int, dict[str, float]] = {}
    for r in index.select("template_id", "token", "part").collect():
        masses.setdefault(r["template_id"], {})[r["token"]] = r["part"] ** 2
    if not masses:
        return F.filter(said, lambda s: F.lit(False)), lambda text: F.lit(False)
    anchors = set()
    for mass in masses.values():
        rest = sum(mass.values())
        for token in sorted(mass, key=lambda w: (w in COMMON, -mass[w], w)):
            if rest < bound:
                break
            anchors.add(token)
            rest -= mass[token]
    pattern = f"(?<![a-z0-9])(?:{'|'.join(w.replace('.', '[.]') for w in sorted(anchors, reverse=True))})(?![a-z0-9])"
    stated = F.array(*[F.array(*[F.struct(F.lit(w).alias("token"), F.lit(m).alias("mass")) for w, m in sorted(mass.items())]) for _, mass in sorted(masses.items())])
    held = lambda words, template: F.aggregate(F.filter(template, lambda t: F.array_contains(words, t["token"])), F.lit(0.0), lambda total, t: total + t["mass"])
    worded = F.transform(F.filter(said, lambda s: F.lower(s).rlike(pattern)), lambda s: F.struct(s.alias("sentence"), tokens(s).alias("words")))
    close = F.filter(worded, lambda x: F.exists(stated, lambda template: held(x["words"], template) >= bound))
    return F.transform(close, lambda x: x["sentence"]), lambda text: F.lower(text).rlike(pattern)


def match_sentences(stated: DataFrame, index: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(sentence, license, similarity) for distinct sentences at least ``least`` similar to a template of ``template_index``."""
    n = index.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]
    idf = index.groupBy("token").agg(F.max("idf").alias("idf"))
    tf = stated.select("sentence", F.explode(tokens(F.col("sentence"))).alias("token")).groupBy("sentence", "token").agg(F.count("*").alias("tf"))
    weighed = tf.join(F.broadcast(idf), "token", "left").withColumn("weight", F.col("tf") * F.coalesce("idf", F.log(F.lit(1.0 + n)) + 1))
    norm = weighed.groupBy("sentence").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    dots = weighed.select("sentence", "token", "weight").join(F.broadcast(index.select("token", "template_id", "license", "part")), "token").groupBy("sentence", "template_id", "license").agg(F.sum(F.col("weight") * F.col("part")).alias("dot"))
    scored = dots.join(norm, "sentence").withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 6))
    best = scored.groupBy("sentence").agg(F.max_by(F.struct("license", "similarity"), F.struct("similarity", -F.col("template_id"))).alias("best"))
    return best.select("sentence", "best.license", "best.similarity").where(F.col("similarity") >= least)


def stated_sentences(files: DataFrame, index: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(id, sentence) for every sentence that can be ``least`` similar to a template; null texts have none."""
    near, may_hold = candidates(sentences(F.col(text_col)), index, least)
    return files.where(may_hold(F.col(text_col))).select(F.col(id_col).alias("id"), F.explode(near).alias("sentence"))


def scan_licenses(files: DataFrame, templates: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", licence_file: Column | None = None, least: float = SIMILARITY) -> DataFrame:
    """One row per file: id, path, own_license, similarity, license, basis, from_dir.

    A file's own licence is that of its sentence most similar to a template.
    A file without one inherits from the nearest directory above it that holds
    a licence file: a file with a licence of its own for which ``licence_file``
    (by default, its name) holds; of several the most similar one counts, then
    the first path. ``basis`` is ``header``, ``directory`` or null.

    Null and empty texts state nothing; a null path has no directory. Ids may
    repeat: rows of one id are one file, with the least path and all texts
    counted. Other columns are not read.
    """
    named = F.col(path_col).rlike(LICENCE_FILE) if licence_file is None else licence_file
    index = cut(template_index(templates))
    base = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.coalesce(named, F.lit(False)).alias("named"))
    place = base.groupBy("id").agg(F.min("path").alias("path"), F.max("named").alias("named"))
    # Written once: it is compared, then joined with what is found; few sentences are left of a text.
    spoken = cut(stated_sentences(files, index, id_col, text_col, least))
    found = match_sentences(spoken.select("sentence").distinct(), index, least)
    own = spoken.join(found, "sentence").groupBy("id").agg(F.max_by(F.struct("license", "similarity"), F.struct("similarity", "license")).alias("own"))
    directory = F.regexp_extract(F.coalesce("path", F.lit("")), "^(.*)/[^/]*$", 1)
    placed = cut(place.join(own, "id", "left").withColumn("dir", directory))
    holders = placed.where(F.col("named") & F.col("own").isNotNull() & F.col("path").isNotNull()).groupBy("dir").agg(F.min_by("own.license", F.struct(-F.col("own.similarity"), F.col("path"))).alias("dir_license"))
    parts = F.split("dir", "/")
    above = placed.where(F.col("path").isNotNull()).select("dir").distinct().select(F.col("dir").alias("low"), F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("dir"))
    nearest = above.join(holders, "dir").groupBy("low").agg(F.max_by(F.struct("dir_license", "dir"), F.struct(F.length("dir"), F.col("dir"))).alias("from")).select(F.col("low").alias("dir"), "from")
    return placed.join(nearest, "dir", "left").select(
        F.col("id").alias(id_col),
        F.col("path").alias(path_col),
        F.col("own.license").alias("own_license"),
        F.col("own.similarity").alias("similarity"),
        F.coalesce("own.license", F.when(F.col("path").isNotNull(), F.col("from.dir_license"))).alias("license"),
        F.when(F.col("own").isNotNull(), "header").when(F.col("path").isNotNull() & F.col("from").isNotNull(), "directory").alias("basis"),
        F.when(F.col("own").isNull() & F.col("path").isNotNull(), F.col("from.dir")).alias("from_dir"),
    )
