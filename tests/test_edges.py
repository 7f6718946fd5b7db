"""Queries against their SQL on small tables of odd rows."""

import random
from datetime import datetime

import duckdb
import pytest

from newsengine.operators.pairing import near_pairs
from newsengine.plans import linkage, parts, queries, single  # noqa: F401  register the queries


def plain(v):
    return "null" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)


def both(spark, folder, name, table, rows, schema):
    """Rows of a query and of its SQL over one table of ``rows``."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, str(folder))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.SQL[name]})").fetchall()
    return sorted(tuple(map(plain, r)) for r in got.collect()), sorted(tuple(map(plain, r)) for r in want)


def test_sliding_counts_near_an_edge_without_a_time_and_before_1970(spark, tmp_path):
    times = [None, datetime(1969, 12, 31, 23, 59, 59, 999_900), datetime(1969, 12, 31, 21, 15), datetime(1970, 1, 1), datetime(2024, 1, 1, 0, 30), datetime(2024, 1, 1, 0, 29, 59, 999_999), datetime(2024, 1, 1, 0, 29, 59, 999_500), datetime(2024, 1, 1, 0, 29, 59, 999_499), datetime(1969, 12, 31, 23, 29, 59, 999_500), None]
    rows = [(k, t, 1, kind, 1.0, "{}") for k, t in enumerate(times) for kind in ("view", None)]
    got, want = both(spark, tmp_path, "sliding_counts", "events", rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    assert got == want and ("view", "null", "24") in got


def counted(rng, size):
    """Random counts of eight words whose squares add up to ``size``."""
    while True:
        counts = [rng.choice([0, 0, 1, 2, 3, 5, 8, 12]) for _ in range(8)]
        if sum(c * c for c in counts) == size:
            return counts


def test_pairs_at_exactly_the_mark(spark, tmp_path):
    """The join of merge_check_limit, over counts whose cosine is 11 / 20, against its SQL."""
    rng = random.Random(1)
    docs = [counted(rng, 100) for _ in range(300)]
    items = [counted(rng, 400 if k % 2 else 100) for k in range(40)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    assert sum(20 * dot(a, b) == 11 * round((dot(a, a) * dot(b, b)) ** 0.5) for a in docs for b in items) > 20
    vec = lambda c: [0.0, *(x / dot(c, c) ** 0.5 for x in c), *[0.0] * 23]
    frame = lambda rows, name: spark.createDataFrame([(k, vec(c)) for k, c in enumerate(rows)], f"{name} long, vec array<double>")
    left, right = frame(docs, "left_id"), frame(items, "right_id")
    for name, df in (("dv", left), ("bv", right)):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    score = linkage.COSINE_SQL.format(a="d.vec", b="b.vec")
    want = duckdb.sql(f"SELECT left_id, right_id, round({score}, 6) FROM '{tmp_path}/dv.parquet/*.parquet' d, '{tmp_path}/bv.parquet/*.parquet' b WHERE {score} >= 0.55").fetchall()
    got = [tuple(r) for r in near_pairs(left, right, 0.55).select("left_id", "right_id", *queries.r6("score")).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("name", ["build_claims", "detect_contradictions", "top_tokens", "overview_sections", "overview_bullets", "quality_flags", "claim_status", "claim_divergence"])
def test_texts_of_claims_are_shuffled_once_and_nothing_is_written(spark, tmp_path, name):
    rows = [(k, f"Title {k}\nThe council of the city said that it has {k % 3} new plans for schools. It has no plans for the harbour of the city.", "en", f"src{k % 3}") for k in range(40)]
    got, want = both(spark, tmp_path, name, "documents", rows, "doc_id long, text string, lang string, source string")
    assert got == want and got
    plan = queries.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    # One to deal a small file to all cores, one by event; claim_status also adds up a few rows.
    assert plan.count("Exchange") <= (3 if name == "claim_status" else 2) and "ExistingRDD" not in plan
