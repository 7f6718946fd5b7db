import math
import random
import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from newsengine.llm import queries
from newsengine.llm.licenses import SIMILARITY, TEMPLATES, default_templates, match_sentences, scan_licenses, stated_sentences, template_index

TOKEN = re.compile("[a-z0-9]+(?:[.-][a-z0-9]+)*")


def best(sentence):
    n = len(TEMPLATES)
    bags = [Counter(TOKEN.findall(t.lower())) for _, t in TEMPLATES]
    df = Counter(w for b in bags for w in b)
    idf = lambda w: math.log((1 + n) / (1 + df[w])) + 1
    vec = lambda b: {w: c * idf(w) for w, c in b.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    s = vec(Counter(TOKEN.findall(sentence.lower())))
    scores = []
    for i, b in enumerate(bags):
        t = vec(b)
        scores.append((round(sum(s[w] * t.get(w, 0) for w in s) / (norm(s) * norm(t)), 6), -i))
    top = max(scores)
    return TEMPLATES[-top[1]][0], top[0]


def test_similarity_equals_brute_force(spark):
    said = ["Licensed under the Apache License, Version 2.0.", "licensed under cc by-nc 4.0 today", "MIT license text", "copyright someone", "This file: SPDX-License-Identifier: MIT", "a licence"]
    df = spark.createDataFrame([(s,) for s in said], "sentence string")
    got = {r.sentence: (r.license, r.similarity) for r in match_sentences(df, template_index(default_templates(spark)), 0.0).collect()}
    for s, found in got.items():
        want = best(s)
        assert found[0] == want[0] and abs(found[1] - want[1]) < 2e-6


def test_inheritance_and_edges(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/c/x.py", "code"),
        (3, "a/b/LICENSE.txt", "Licensed under CC BY-NC 4.0."),
        (4, "a/y.py", "Some text. Licensed under the Apache License, Version 2.0. More text."),
        (5, "z/q.py", "text"),
        (6, None, None),
        (7, "a/b/e.py", ""),
        (8, "ab/x.py", "not below a"),
        (2, "a/b/c/x.py", "code"),
        (9, "LICENSE", "nothing stated"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").selectExpr("*", "'q' as license", "0 as dir")
    got = {r.doc_id: (r.license, r.basis, r.from_dir) for r in scan_licenses(df, default_templates(spark)).collect()}
    assert got == {
        1: ("MIT", "header", None),
        2: ("CC-BY-NC-4.0", "directory", "a/b"),
        3: ("CC-BY-NC-4.0", "header", None),
        4: ("Apache-2.0", "header", None),
        5: (None, None, None),
        6: (None, None, None),
        7: ("CC-BY-NC-4.0", "directory", "a/b"),
        8: (None, None, None),
        9: (None, None, None),
    }
    assert scan_licenses(df.limit(0), default_templates(spark)).count() == 0


def test_no_sentence_is_lost_before_the_cosine(spark):
    """Templates with words taken out and others put in, common words included, against brute force over all of them."""
    rng = random.Random(7)
    filler = ["the", "of", "under", "software", "tion", "by", "mit", "und", "work"]
    said = {"Permission is granted, free of charge, to any person obtaining a copy of software", "under CC BY", "terms of the Mozilla Public v. 2.0", "Ünder the MIT."}
    for _, text in TEMPLATES:
        for _ in range(25):
            words = [w for w in text.split() if rng.random() < 0.7]
            said.add(" ".join(words + rng.sample(filler, rng.randint(0, 3))))
    said = sorted(x for x in said if x.strip())
    df = spark.createDataFrame([(k, x) for k, x in enumerate(said)], "doc_id long, text string")
    index = template_index(default_templates(spark))
    whole = re.compile(r"(?<=[.!?])[ \t]+")
    want = {(k, p) for k, x in enumerate(said) for p in whole.split(x) if TOKEN.search(p.lower()) and best(p)[1] >= SIMILARITY}
    held = stated_sentences(df, index)
    found = {r.sentence for r in match_sentences(held.select("sentence").distinct(), index).collect()}
    assert {(r.id, r.sentence) for r in held.collect() if r.sentence in found} == want
    assert len(want) > 100 and any(not re.search("licen[cs]e|copyright|redistribut", p.lower()) for _, p in want)


def test_long_texts_and_no_templates(spark):
    long = "word and other words. " * 100_000 + "Released under the MIT License."
    df = spark.createDataFrame([(1, "a/x", long), (2, "a/y", "Released under the MIT License.\n" * 1000)], "doc_id long, path string, text string")
    assert {r.doc_id: (r.license, r.similarity) for r in scan_licenses(df, default_templates(spark)).collect()} == {1: ("MIT", 1.0), 2: ("MIT", 1.0)}
    assert {r.license for r in scan_licenses(df, default_templates(spark).limit(0)).collect()} == {None}


def test_no_python_on_the_main_path(spark):
    df = spark.createDataFrame([(1, "a", "b")], "doc_id long, path string, text string")
    index = template_index(default_templates(spark))
    held = stated_sentences(df, index)
    for made in (index, held, match_sentences(held, index), scan_licenses(df, default_templates(spark))):
        assert not re.search("Python|Pandas|Arrow", made._jdf.queryExecution().executedPlan().toString())


def test_query_equals_its_sql_over_every_sentence(spark):
    """The SQL meets every sentence with every template."""
    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{folder}/documents.parquet'")
    want = con.sql(queries.licence_sql()).fetchall()
    got = queries.op2_license_scans(spark, folder).select("doc_id", "path", "own_license", "similarity", "license", "basis", "from_dir").collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
