import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    clean = [(i, words(rng, 90)) for i in range(60)]
    junk = [(100 + i, " ".join(f"{w}###" for w in words(rng, 90).split())) for i in range(12)]
    near = [(200 + i, " ".join([*clean[i][1].split()[:-2], "changed", "end"])) for i in range(6)]
    passage = words(rng, 90)
    share = [(300 + i, words(rng, 60) + "\n" + passage) for i in range(3)]
    rude = [(400 + i, words(rng, 60) + " idiot moron " + words(rng, 20)) for i in range(12)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in clean + junk + near + share + rude + [(999, "short")]], "doc_id long, text string, lang string, source string, n_chars long")
    labels = [(i, 1, 0) for i, _ in clean] + [(i, 0, 0) for i, _ in junk] + [(i, 1, 1) for i, _ in rude]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = now.collect()
        if k < 4:
            assert now.columns == docs.columns
    ids = {n: sorted(r.doc_id for r in rows) for n, rows in kept.items()}
    assert set(ids["quality_rules"]) == {i for i, _ in clean + near + share + rude}
    assert set(ids["minhash_near_dedup"]) == {i for i, _ in clean + share + rude}
    texts = {r.doc_id: r.text for r in kept["suffix_array_dedup"]}
    assert all(passage not in texts[i] and texts[i].strip() for i, _ in share) and all(texts[i] == t for i, t in clean)
    assert set(i for i, _ in clean) <= set(ids["mixing"]) and len(set(ids["mixing"]) & {i for i, _ in rude}) < 6
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in kept["bpe"]:
        assert r.ids == lib.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == ids["bpe"]


def test_near_dedup_keeps_one_row_of_each_class_of_texts(spark):
    rng = random.Random(12)
    a, b, c, d = (words(rng, 60) for _ in range(4))
    rows = [(1, a), (1, b), (2, a), (None, c), (None, c), (None, d), (3, d + " end"), (4, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text or "") for r in corpus_pipeline.minhash_near_dedup(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(1, a), (1, b), (None, c), (3, d + " end"), (4, "")], key=str)
