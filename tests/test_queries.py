"""Queries against their SQL on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from newsengine.plans import linkage, more, parts, queries, single  # noqa: F401  register the queries

FOLDER = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: All of them with ALL_QUERIES=1; else a few of each kind.
SOME = "rank_events ranking_stats sticky_rank junk_score chronological_feed feed_neighbors viewed_history policy_gate parse_article discover_urls frontier_dedup scrape_summary hash_embedding decide_link merge_check version_diff build_packet build_claims overview_sections derive_teaser score_topics topic_drift emergent_topics bias_labels media_profile_update validate_payload validate_envelope histogram_summary user_sessions packet_merge event_detail apply_external_pair_score near_pairs merge_check_limit link_incremental link_v1_threshold claim_divergence".split()
NAMES = sorted(queries.SQL) if os.environ.get("ALL_QUERIES") else SOME

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return "null"
    return f"{v:.6f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, sql, name):
    df = queries.QUERIES[name](spark, str(FOLDER))
    want = sql.sql(queries.SQL[name])
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got == rows(want.columns, want.fetchall())
    assert got[1]


def test_every_query_has_a_row():
    assert set(queries.QUERIES) == set(queries.SQL)
