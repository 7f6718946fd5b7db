"""The given tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The instant that the queries over orders and line items call now.
NOW = "2001-08-01 00:00:00"
#: Six hours and twelve hours would underflow on orders of several years.
WINDOW_HOURS = 90 * 24.0
#: The outlet of the document source that is not allowlisted.
BLOCKED_SOURCE = "src0"


#: Tables of texts, whose rows cost much more to process than to read.
TEXTS = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else df


def spread(df: DataFrame) -> DataFrame:
    """A scan dealt out to all cores if its files give fewer tasks than there are cores; a large table stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def now():
    return F.lit(NOW).cast("timestamp")


def ts(c: str):
    return F.col(c).cast("timestamp")


def order_events(spark: SparkSession, d: str) -> DataFrame:
    """Orders as published events."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.lit("PUBLISHED").alias("state"), ts("o_orderdate").alias("published_at"), ts("o_orderdate").alias("t0"), ts("o_orderdate").alias("t_last"))


def item_articles(spark: SparkSession, d: str) -> DataFrame:
    """Line items as articles: supplier as outlet, ship date as time, ten times the tax as junk score."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("media_id"), ts("l_shipdate").alias("published_at"), ts("l_shipdate").alias("created_at"), F.round(F.col("l_tax") * 10, 6).alias("junk"))


def item_claims(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.when(F.col("l_linestatus") == "O", "SUPPORTED").otherwise("INSUFFICIENT").alias("status"))


def item_topics(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as events that begin with their first shipment, return flags as topics of weight quantity."""
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("event_id"), ts("l_shipdate").alias("published_at"), F.col("l_returnflag").alias("topic_key"), F.col("l_quantity").alias("weight"))
    start = rows.groupBy("event_id").agg(F.min("published_at").alias("t0"))
    return rows.join(start, "event_id")


def document_articles(spark: SparkSession, d: str) -> DataFrame:
    """Documents as articles: source as outlet, first line as title, whole text as snippet, eight ids an event."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("article_id"),
        F.floor(F.col("doc_id") / 8).cast("long").alias("event_id"),
        F.lit(0).alias("version_id"),
        F.col("source").alias("media_id"),
        F.col("source").alias("media_key"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example/"), F.col("doc_id").cast("string")).alias("url"),
        F.substring_index(text, "\n", 1).alias("title"),
        text.alias("snippet"),
    )


def source_media(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("source").alias("media_id"), F.col("source").alias("media_key"), (F.col("source") != BLOCKED_SOURCE).alias("allowlisted")).distinct()


def turn_versions(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as events whose turns are versions."""
    return table(spark, d, "conversations").select(F.col("conv_id").alias("event_id"), F.col("turn").cast("int").alias("version_index"), F.concat_ws("-", "conv_id", "turn").alias("version_id"), F.col("role"), F.col("text").alias("headline"))


def log_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as log messages: type as name, props as payload."""
    return table(spark, d, "events").select(F.col("event_type").alias("event_name"), F.col("event_id").cast("string").alias("event_id"), ts("ts").alias("ts"), "user_id", "value", F.col("props").alias("payload"))


def vector_events(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(vectors with label as event, all vectors as articles)."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("article_id"), F.col("label").alias("event_id"), F.col("embedding").alias("embedding_vec")), e
