"""Reads, idempotent writes and table maintenance as DataFrame to DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsengine.functions import lexicons as L


def pages_source(spark: SparkSession, path: str, stream: bool = False, schema: str = "media_key string, page_kind string, url string, html string") -> DataFrame:
    """List and article pages from Parquet, as a batch or a stream."""
    return spark.readStream.schema(schema).parquet(path) if stream else spark.read.parquet(path)


def media_seeds(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, (("media_key", "string"), ("name", "string"), ("allowlisted", "boolean"), ("license", "string"), ("attribution_required", "boolean"), ("non_commercial", "boolean")), strict=True)]) for r in L.MEDIA_SEEDS])
    return spark.range(1).select(F.inline(rows))


def seed_media(media: DataFrame, seeds: DataFrame) -> DataFrame:
    """``media`` with the seeds whose media_key it lacks; an existing row stays as it is."""
    cols = ["media_key", "name", "allowlisted"]
    new = seeds.select(*cols).dropDuplicates(["media_key"]).join(media.select("media_key"), "media_key", "left_anti")
    return media.unionByName(new, allowMissingColumns=True)


def seed_profiles(profiles: DataFrame, seeds: DataFrame) -> DataFrame:
    """(media_key, profile MAP) with the seeds' licence entries over the stored ones."""
    entries = F.map_filter(F.create_map(*[x for k in ("license", "attribution_required", "non_commercial") for x in (F.lit(k), F.col(k).cast("string"))]), lambda k, v: v.isNotNull())
    new = seeds.where(F.col("license").isNotNull()).select("media_key", entries.alias("seed"))
    both = profiles.join(new, "media_key", "full")
    empty = F.create_map().cast("map<string,string>")
    old, seed = F.coalesce("profile", empty), F.coalesce("seed", empty)
    return both.select("media_key", F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(seed, k)), seed).alias("profile"))


def media_allowlisted(media: DataFrame) -> DataFrame:
    return media.where("allowlisted")


def media_by_key(media: DataFrame, key: str) -> DataFrame:
    return media.where(F.col("media_key") == key)


def articles_by_event(links: DataFrame, articles: DataFrame) -> DataFrame:
    return links.join(articles, "article_id")


def count_articles_for_event(links: DataFrame) -> DataFrame:
    return links.groupBy("event_id").agg(F.count("*").alias("article_count"))


def link_article_upsert(links: DataFrame, new: DataFrame) -> DataFrame:
    """``links`` with the (event_id, article_id) pairs that it lacks."""
    return links.unionByName(new.dropDuplicates(["event_id", "article_id"]).join(links, ["event_id", "article_id"], "left_anti"), allowMissingColumns=True)


def candidate_events(events: DataFrame, since: Column) -> DataFrame:
    return events.where((F.col("state") != "CLOSED") & (F.col("t_last") >= since))


def stale_events(events: DataFrame, before: Column) -> DataFrame:
    return events.where((F.col("state") != "CLOSED") & (F.col("t_last") <= before))


def active_events(events: DataFrame) -> DataFrame:
    return events.where(F.col("state").isin(L.ACTIVE_STATES))


def pending_publish(events: DataFrame) -> DataFrame:
    return events.where(F.col("state") == "PENDING_PUBLISH")


def latest_version(versions: DataFrame, key: str = "event_id", index: str = "version_index") -> DataFrame:
    """The row of the highest index per event; the window keeps one row of each before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.col(index).desc())
    return versions.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def claims_with_quotes(claims: DataFrame, quotes: DataFrame, articles: DataFrame, media: DataFrame) -> DataFrame:
    """Claims with their quotes ARRAY<STRUCT> in order of quote_id; a claim without quotes has an empty array."""
    cited = quotes.join(articles.select("article_id", "url", "media_id"), "article_id", "left").join(media.select("media_id", "media_key"), "media_id", "left")
    fields = F.struct("quote_id", "article_id", F.coalesce("media_key", F.lit("unknown")).alias("media_key"), F.coalesce("url", F.lit("")).alias("url"), "quote_text", "strength", "role")
    nested = cited.groupBy("claim_id").agg(F.array_sort(F.collect_list(fields)).alias("quotes"))
    out = claims.join(nested, "claim_id", "left")
    return out.withColumn("quotes", F.coalesce("quotes", F.array().cast(out.schema["quotes"].dataType)))


def count_by_version(rows: DataFrame, name: str) -> DataFrame:
    """Rows per (event_id, version_id), as guard against a second run."""
    return rows.groupBy("event_id", "version_id").agg(F.count("*").alias(name))


def count_claims_by_version(claims: DataFrame) -> DataFrame:
    return count_by_version(claims, "claims")


def count_bias_by_version(labels: DataFrame) -> DataFrame:
    return count_by_version(labels, "labels")


def count_topics_by_version(assignments: DataFrame) -> DataFrame:
    return count_by_version(assignments, "topics")


def pending_versions(versions: DataFrame, done: DataFrame) -> DataFrame:
    """Versions for which a stage has left nothing yet."""
    return versions.join(done.select("event_id", "version_id").distinct(), ["event_id", "version_id"], "left_anti")


def delete_claims_by_version(claims: DataFrame, quotes: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims and quotes without those of the (event_id, version_id) rows of ``gone``."""
    dead = claims.join(gone, ["event_id", "version_id"], "left_semi").select("claim_id")
    return claims.join(gone, ["event_id", "version_id"], "left_anti"), quotes.join(dead, "claim_id", "left_anti")


def packet_merge(packets: DataFrame, stage: DataFrame, key: str = "version_id") -> DataFrame:
    """Packets with the stage's columns over their own of the same name, others kept."""
    new = [c for c in stage.columns if c != key]
    flagged = stage.select(key, F.struct(*new).alias("__stage"))
    joined = packets.join(flagged, key, "left")
    kept = [c for c in packets.columns if c not in new]
    old = lambda c: F.when(F.col("__stage").isNull(), F.col(c)).otherwise(F.col(f"__stage.{c}")) if c in packets.columns else F.col(f"__stage.{c}")
    return joined.select(*kept, *[old(c).alias(c) for c in new])


def apply_changes(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``rows`` with the non-null values of ``changes`` (one row per key) over their own."""
    new = [c for c in changes.columns if c != key]
    joined = rows.join(changes.select(key, *[F.col(c).alias(f"__new_{c}") for c in new]), key, "left")
    return joined.select(*[F.coalesce(f"__new_{c}", c).alias(c) if c in new else F.col(c) for c in rows.columns])


def article_status_update(articles: DataFrame, changes: DataFrame) -> DataFrame:
    return apply_changes(articles, changes, "article_id")


def event_update(events: DataFrame, changes: DataFrame) -> DataFrame:
    return apply_changes(events, changes, "event_id")


PACKET_AI_FIELDS = ["overview", "quality_flags", "ai_overview", "ai_teaser", "ai_run_version_id"]


def reset_enrichment(packets: DataFrame, claims: DataFrame, quotes: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chosen (event_id, version_id) lose their claims and the five enriched packet columns."""
    left, cited = delete_claims_by_version(claims, quotes, chosen)
    flag = chosen.select("event_id", "version_id").distinct().withColumn("__reset", F.lit(True))
    joined = packets.join(flag, ["event_id", "version_id"], "left")
    cleared = joined.select(*[F.when(F.col("__reset").isNull(), F.col(c)).alias(c) if c in PACKET_AI_FIELDS else F.col(c) for c in packets.columns])
    return cleared, left, cited


def bias_labels_by_scope(labels: DataFrame, event_id, version_id, scope: str) -> DataFrame:
    return labels.where((F.col("event_id") == event_id) & (F.col("version_id") == version_id) & (F.col("scope") == scope))


def bias_labels_by_media(labels: DataFrame, media_id, event_id) -> DataFrame:
    return labels.where((F.col("media_id") == media_id) & (F.col("event_id") == event_id))


def topic_assignments_by_event(rows: DataFrame, event_id) -> DataFrame:
    return rows.where(F.col("event_id") == event_id)


def topic_assignments_by_article(rows: DataFrame, article_id) -> DataFrame:
    return rows.where(F.col("article_id") == article_id)


def media_profile_upsert(profiles: DataFrame, new: DataFrame) -> DataFrame:
    """One profile per media_id, the new row where there is one."""
    cols = [c for c in profiles.columns if c != "media_id"]
    fresh = new.select("media_id", F.struct(*cols).alias("__new"))
    joined = profiles.join(fresh, "media_id", "full")
    return joined.select("media_id", *[F.when(F.col("__new").isNull(), F.col(c)).otherwise(F.col(f"__new.{c}")).alias(c) for c in cols])


def audit_append(rows: DataFrame, path: str) -> None:
    """Append to the audit log at ``path``, partitioned by day."""
    rows.withColumn("day", F.to_date("occurred_at")).write.mode("append").partitionBy("day").parquet(path)


def audit_by_entity(log: DataFrame, entity_type: str, entity_id: str) -> DataFrame:
    return log.where((F.col("entity_type") == entity_type) & (F.col("entity_id") == entity_id)).orderBy(F.col("occurred_at").desc())
