"""Hashed word vectors, dense arrays at the edges and sparse rows in joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsengine.functions import text as X

SLOTS = 256


def text_for_embedding(title: Column, snippet: Column) -> Column:
    return F.concat(X.text_or_empty(title), F.lit(" "), X.text_or_empty(snippet))


def embedding_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def hash_vector(text: Column, slots: int = SLOTS) -> Column:
    """Counts of hashed words, of unit length; zeros without words.

    The words are hashed once each; the counts fold into one array.
    """
    places = F.transform(X.tokenize_letters(text), lambda t: X.hash_token(t, slots).cast("int"))
    sorted_ = F.array_sort(places)
    # Runs of the sorted places give counts without a pass per slot.
    counts = F.map_from_entries(F.transform(F.array_distinct(sorted_), lambda p: F.struct(p, F.size(F.filter(sorted_, lambda q: q == p)).cast("double"))))
    norm = F.sqrt(F.aggregate(F.map_values(counts), F.lit(0.0), lambda a, v: a + v * v))
    return F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda k: F.coalesce(F.try_element_at(counts, k) / norm, F.lit(0.0)))


def hash_embedding(articles: DataFrame, model: str = "hash-bow-256") -> DataFrame:
    """``articles`` with embedding_model, embedding_hash and embedding_vec."""
    t = text_for_embedding(F.col("title"), F.col("snippet"))
    return articles.withColumns({"embedding_model": F.lit(model), "embedding_hash": embedding_hash(t), "embedding_vec": hash_vector(t)})


def hash_embedding_rows(articles: DataFrame, id_col: str = "article_id", slots: int = SLOTS) -> DataFrame:
    """The same vectors as sparse rows (id, slot, value): exploded words and two-step sums."""
    t = text_for_embedding(F.col("title"), F.col("snippet"))
    tf = articles.select(id_col, F.explode(X.tokenize_letters(t)).alias("token")).groupBy(id_col, "token").count()
    slot = tf.groupBy(id_col, X.hash_token(F.col("token"), slots).cast("int").alias("slot")).agg(F.sum("count").cast("double").alias("n"))
    norm = slot.groupBy(id_col).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return slot.join(norm, id_col).select(id_col, "slot", (F.col("n") / F.col("norm")).alias("value"))


def embed_incremental(articles: DataFrame, stored: DataFrame) -> DataFrame:
    """Vectors of the articles whose text hash is not the stored one."""
    now = articles.withColumn("__hash", embedding_hash(text_for_embedding(F.col("title"), F.col("snippet"))))
    old = stored.select("article_id", F.col("embedding_hash").alias("__old"))
    return hash_embedding(now.join(old, "article_id", "left").where(~F.col("__hash").eqNullSafe(F.col("__old"))).drop("__hash", "__old"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 for null, empty or zero vectors and unequal lengths."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(usable & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def centroid(vectors: DataFrame, key: str = "event_id", vec: str = "embedding_vec") -> DataFrame:
    """(key, centroid, n): the mean of each component over the key's non-null vectors."""
    cells = vectors.where(F.col(vec).isNotNull()).select(key, F.posexplode(vec).alias("pos", "v")).groupBy(key, "pos").agg(F.avg("v").alias("v"), F.count("*").alias("n"))
    return cells.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("c"), F.max("n").alias("n")).select(key, F.transform("c", lambda x: x["v"]).alias("centroid"), "n")
