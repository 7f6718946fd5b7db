"""The ten stages from list pages to sub-events, to be run by ``stages.chain``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsengine.functions import lexicons as L
from newsengine.operators import bias, claims, ingest, lifecycle, linking, overview, topics, vectors
from newsengine.sources.shared import checkpointed
from newsengine.streaming.stages import written

Step = tuple[str, Callable[[DataFrame], DataFrame], list[str]]
VERSION = ["event_id", "version_id"]


def sink(batch: DataFrame, folder: str, name: str, where: Column | None = None) -> DataFrame | None:
    """What a stage has left so far, where it is asked for; null if nothing."""
    path = f"{folder}/{name}"
    if not written(batch.sparkSession, path):
        return None
    rows = batch.sparkSession.read.parquet(path)
    return (rows if where is None else rows.where(where)).drop("sink_part", "sink_day")


def gathered(rows: DataFrame, name: str) -> DataFrame:
    """(VERSION, name): the rows of each version in one array; a version holds a few dozen articles and their claims."""
    rest = [c for c in rows.columns if c not in VERSION]
    return rows.groupBy(*VERSION).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name))


def cited(versions: DataFrame) -> DataFrame:
    """One row for each article of each version's packet."""
    rows = versions.select(*VERSION, F.explode("packet.articles").alias("a"))
    return rows.select(*VERSION, "a.article_id", F.col("a.media_key").alias("media_id"), F.to_timestamp("a.published_at").alias("published_at"), "a.title", "a.snippet", "a.url")


def news_steps(folder: str, media: DataFrame, pages: DataFrame, rules: DataFrame, now: Column) -> list[Step]:
    """Discover, normalize, policy, embed, link, version, claims, overview, topics and bias, sub-events.

    The chain starts from list pages (media_key, url, html); ``pages`` holds
    the fetched article pages (media_key, url, html), ``media`` (media_id,
    media_key, allowlisted). Each stage's rows are keyed, so pages or messages
    that come again leave every sink as it is: articles by URL, links by
    article, versions by the set of articles they cite. From versions on a row
    is one version and holds what belongs to it, so no stage waits for rows of
    another batch. Articles without a title, outlets that are unknown and
    articles that the policy blocks end at their stage; a version without
    claims keeps its row. What a page or an article has left before is found by
    the sink itself, in the parts of a batch's keys; linking reads the links of
    the last days alone, beyond which no event takes articles.
    """
    recent = F.date_sub(F.to_date(now), L.CANDIDATE_DAYS + 1)

    def discover(batch: DataFrame) -> DataFrame:
        found = ingest.discover_urls(batch, rules)
        return ingest.frontier_dedup(found, found.where("1 = 0")).select("media_key", "url")

    def normalize(batch: DataFrame) -> DataFrame:
        parsed = ingest.parse_article(batch.join(pages.select("media_key", "url", "html"), ["media_key", "url"]), rules).drop("html")
        out = ingest.normalize_article(parsed, media, parsed.where("1 = 0"))
        return out.where("outcome = 'NORMALIZED'").withColumn("article_id", F.substring(F.sha2("url", 256), 1, 24)).drop("outcome")

    def policy(batch: DataFrame) -> DataFrame:
        return ingest.policy_gate(batch, media)

    def embed(batch: DataFrame) -> DataFrame:
        none = batch.where("1 = 0").select("article_id", F.lit("").alias("embedding_hash"))
        return vectors.embed_incremental(batch.where("status = 'POLICY_OK'"), none)

    def link(batch: DataFrame) -> DataFrame:
        known = sink(batch, folder, "linked", F.col("sink_day") >= recent)
        old = batch.where("1 = 0").select("*", F.lit("").alias("event_id"), now.alias("linked_at")) if known is None else known
        events = old.groupBy("event_id").agg(F.lit("DETECTED").alias("state"), F.min("linked_at").alias("t0"), F.max("linked_at").alias("t_last"))
        fresh = batch.join(old.select("article_id"), "article_id", "left_anti")
        links, _, merges = linking.link_incremental(fresh, events, old.select("event_id", "article_id"), old.select(*batch.columns), now)
        # A new event that merges stays the article's own; its canonical event is told beside it.
        told = merges.select(F.col("merged_id").alias("event_id"), "canonical_id")
        return fresh.join(links.drop("score").join(told, "event_id", "left"), "article_id").withColumn("linked_at", now).withColumn("sink_day", F.to_date(now))

    def version(batch: DataFrame) -> DataFrame:
        linked = sink(batch, folder, "linked").join(batch.select("event_id").distinct(), "event_id", "left_semi")
        events = linked.groupBy("event_id").agg(F.lit("DETECTED").alias("state"), F.min("linked_at").alias("t0"), F.max("linked_at").alias("t_last"), F.lit(None).cast("timestamp").alias("published_at"))
        known = sink(batch, folder, "versioned")
        old = events.where("1 = 0").select("event_id", F.lit(0).alias("version_index")) if known is None else known
        made = lifecycle.build_packet(events, linked.select("event_id", "article_id", "linked_at"), linked.drop("event_id", "linked_at", "media_key"), media, old)
        ids = F.concat_ws(",", F.array_sort(F.transform("packet.articles", lambda a: a["article_id"])))
        made = made.withColumn("cited", F.sha2(ids, 256)).withColumn("version_id", F.concat("event_id", F.lit("_v"), F.col("version_index").cast("string")))
        return made.join(events.select("event_id", "t0"), "event_id")

    def claim(batch: DataFrame) -> DataFrame:
        return batch.join(gathered(claims.build_claims(cited(batch)), "claims"), VERSION, "left")

    def stated(batch: DataFrame) -> DataFrame:
        return batch.select(*VERSION, F.inline("claims"))

    def overviews(batch: DataFrame) -> DataFrame:
        made = overview.overview_sections(stated(batch)).select(*VERSION, F.struct("gate_status", "sections", "claims_count", "quotes_count", "evidence_rate").alias("overview"))
        return batch.join(made, VERSION, "left")

    def themes(batch: DataFrame) -> DataFrame:
        lexicon = topics.topic_lexicon(batch.sparkSession)
        # A version's times count from its first article on.
        articles = cited(batch)
        first = articles.groupBy(*VERSION).agg(F.min("published_at").alias("t0"))
        assigned, emergent, _, _ = topics.assign_topics(first, articles.drop("version_id"), stated(batch), first.where("1 = 0"), lexicon)
        marks = bias.bias_article_level(articles).select(*VERSION, "article_id", "label_primary", "label_secondary", "intensity", "confidence", "rationale")
        out = batch.join(gathered(assigned, "topics"), VERSION, "left")
        return out.join(gathered(emergent, "emergent"), VERSION, "left").join(gathered(marks, "bias"), VERSION, "left")

    def subevents(batch: DataFrame) -> DataFrame:
        assigned = batch.select(*VERSION, F.inline("topics"))
        timed = cited(batch).join(assigned, [*VERSION, "article_id"])
        start = timed.groupBy(*VERSION).agg(F.min("published_at").alias("t0"))
        # Bins are those of one version: the version stands for its event here.
        weights = timed.join(start, VERSION).drop("event_id").withColumnRenamed("version_id", "event_id")
        drift = topics.topic_drift(topics.heatmap_rows(weights))
        by_version = lambda df: df.drop("event_id").withColumn("event_id", F.col("version_id"))
        own, branch = batch.select(*VERSION), checkpointed(topics.claim_divergence(stated(batch)))
        made = topics.build_subevents(by_version(own), drift, by_version(assigned), by_version(branch))
        return made.drop("event_id").join(own, "version_id").select(*VERSION, "subevents")

    return [
        ("discovered", discover, ["url"]),
        ("normalized", normalize, ["url"]),
        ("gated", policy, ["article_id"]),
        ("embedded", embed, ["article_id"]),
        ("linked", link, ["article_id"]),
        ("versioned", version, ["event_id", "cited"]),
        ("claimed", claim, VERSION),
        ("overviewed", overviews, VERSION),
        ("themed", themes, VERSION),
        ("subevents", subevents, VERSION),
    ]
