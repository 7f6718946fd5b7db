"""Corpus pipeline: five stages from ``documents`` to tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; all but the last return the columns that they were given.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsengine.llm.bpe import bpe_round_trip
from newsengine.llm.frames import cut, drop_folder, shared_dir
from newsengine.llm.mixing import domain_posteriors, fit_domains, fit_rates, rate_column, realise
from newsengine.llm.neardup import near_duplicates
from newsengine.llm.quality import fit_forests, judge_quality
from newsengine.llm.queries import MIX, label_domains, vocabulary
from newsengine.llm.repeats import remove_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the forests reject."""
    forests = fit_forests(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge_quality(docs, forests).where("kept").select(*docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicate texts: that of least id, null ids last; a null text counts as empty.

    Texts stand for themselves by their digest, so rows without an id take part
    and different texts of one id stay apart.
    """
    key = F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_id")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *others)
    classes = near_duplicates(docs.select(key, "text"), id_col="text_id").select("text_id", "class_id")
    ranked = docs.groupBy(key).agg(F.min(rank).alias("rank")).join(classes, "text_id")
    chosen = ranked.groupBy("class_id").agg(F.min(F.struct("rank", "text_id")).alias("least")).select("least.text_id")
    # One row of each text: copies meet in the task that reads them, so each text is moved once.
    firsts = docs.groupBy(key).agg(F.min_by(F.struct(*docs.columns), rank).alias("row"))
    return firsts.join(chosen, "text_id", "left_semi").select("row.*")


#: Bytes from which on a repeated string counts as a passage here: 51 words of four letters with a space each.
PASSAGE = 255


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of ``PASSAGE`` bytes that occur twice or more; a cut inside a character leaves U+FFFD.

    No document goes: one that is all repeated keeps its row with an empty text.
    """
    left = remove_repeats(docs, window=PASSAGE, keep=[c for c in docs.columns if c not in ("text", "n_chars")])
    text = F.expr("make_valid_utf8(cast(kept as string))")
    return left.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says, so that the label domains have their target shares of tokens."""
    model = fit_domains(docs, label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    posteriors = cut(domain_posteriors(docs, model, keep=[]))
    steps, _, _ = fit_rates(posteriors, model.domains, MIX, anchor="clean")
    rated = domain_posteriors(docs, model).withColumn("rate", rate_column(steps))
    return realise(rated).select(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each whole text, with the digests of the ids and of the text that they decode to."""
    return bpe_round_trip(docs, vocabulary, ids_col="ids", keep=["doc_id"]).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("mixing", mixing),
    ("bpe", bpe),
]

#: Forests, signatures and a trained classifier have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next.

    A stage's folder goes once the next one is written; that of the last but
    one is what the result is computed from, so it stays with the caller.
    """
    shared_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_folder(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
