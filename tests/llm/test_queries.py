"""The registered queries keep their contracts on the smallest tables."""

import hashlib
import zlib
from pathlib import Path

import pytest

from newsengine.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
CONTRACT = {
    "op1_url_filters": ("pages", {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"}),
    "op3_quality_rules": ("documents", {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"}),
    "op5_html": ("pages", {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}),
    "op8_tiff": ("documents", {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"}),
    "op9_repeats": ("documents", {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}),
    "op12_lm_scoring": ("documents", {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"}),
    "op10_bpe": ("documents", {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}),
}


@pytest.mark.parametrize("name", CONTRACT)
def test_contract(spark, name):
    source, columns = CONTRACT[name]
    df = queries.queries()[name](spark, FOLDER)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in columns} == columns
    found = df.collect()
    given = spark.read.parquet(f"{FOLDER}/{source}.parquet").collect()
    key = "page_id" if source == "pages" else "doc_id"
    assert sorted(r[key] for r in found) == sorted(r[key] for r in given)
    by = {r[key]: r for r in given}
    for r in found:
        if name == "op8_tiff":
            raw = by[r.doc_id].text.encode()
            raw += b"\0" * (-len(raw) % 64 or (0 if raw else 64))
            assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
        if name == "op10_bpe":
            assert r.decoded_sha256 == hashlib.sha256(by[r.doc_id].text.encode()).hexdigest()
        if name == "op12_lm_scoring":
            assert r.n_tokens == len(by[r.doc_id].text.encode().split()) + 1 and r.n_known <= r.n_tokens and r.score < 0
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        if name == "op5_html":
            assert r.n_chars == len(r.text)
        if name == "op3_quality_rules":
            assert not (r.base_failed and r.kept)


def test_trie_equals_its_sql(spark):
    import duckdb

    df = queries.op11_prefix_trie(spark, FOLDER)
    assert dict(df.dtypes) == {c: "string" if c == "ends_sha256" else "bigint" for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{FOLDER}/conversations.parquet'")
    want = con.execute(queries.oracle_sql()["op11_prefix_trie"])
    names = [c[0] for c in want.description]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, df.select(*names).collect())) == sorted(map(key, want.fetchall()))


def test_whitening_contract(spark):
    df = queries.op13_whitening(spark, FOLDER)
    assert dict(df.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    found = df.collect()
    ids = [r.vec_id for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id").collect()]
    assert sorted((r.vec_id, r.component) for r in found) == sorted((i, k) for i in ids for k in range(1, 5))
    assert max(r.identity_error for r in found) < 1e-4
    shares = [next(r.explained for r in found if r.component == k) for k in range(1, 5)]
    assert shares == sorted(shares, reverse=True)
