"""States of events, versions and their packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsengine.functions import text as X
from newsengine.sources.tables import latest_version

SLOT = 30 * 60 * 1000


def schedule_publish(events: DataFrame, now: Column) -> DataFrame:
    """DETECTED events wait five minutes for their publication."""
    new = F.col("state") == "DETECTED"
    due = now + F.expr("INTERVAL 5 MINUTES")
    return events.withColumns({"publish_at": F.when(new, due).otherwise(F.col("publish_at")), "state": F.when(new, "PENDING_PUBLISH").otherwise(F.col("state"))})


def touch_on_link(events: DataFrame, linked: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(events, update triggers): links to existing events move t_last, every link triggers an update."""
    sums = linked.groupBy("event_id").agg(F.max(F.col("link_action") == "LINKED_EXISTING").alias("__old"))
    moved = events.join(sums, "event_id", "left").withColumn("t_last", F.when(F.col("__old"), now).otherwise(F.col("t_last"))).drop("__old")
    return moved.select(*events.columns), linked.select("event_id", F.lit("NEW_ARTICLE").alias("trigger"), now.alias("occurred_at"))


def publish_due(events: DataFrame, now: Column) -> DataFrame:
    due = (F.col("state") != "CLOSED") & (F.col("publish_at").isNull() | (F.col("publish_at") <= now))
    return events.withColumns({"published_at": F.when(due, F.coalesce("published_at", now)).otherwise(F.col("published_at")), "state": F.when(due, "PUBLISHED").otherwise(F.col("state"))})


def rehydrate_pending(events: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(publish now, still scheduled) of the pending events."""
    pending = events.where("state = 'PENDING_PUBLISH'")
    due = F.col("publish_at").isNull() | (F.col("publish_at") <= now)
    return pending.where(due), pending.where(~due)


def close_stale(events: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Events without an article for ``days`` days close."""
    old = (F.col("state") != "CLOSED") & (F.unix_millis("t_last") <= F.unix_millis(now) - days * 86_400_000)
    return events.withColumns({"closed_at": F.when(old, now).otherwise(F.col("closed_at")), "close_reason": F.when(old, "INACTIVITY_7D"), "state": F.when(old, "CLOSED").otherwise(F.col("state"))})


def refresh_slots(events: DataFrame, now: Column) -> DataFrame:
    """(job_key, run_at, event_id) at the next half hour, each key once."""
    slot = F.timestamp_millis((F.ceil(F.unix_millis(now) / SLOT) * SLOT).cast("long"))
    return events.select(F.concat(F.lit("refresh:"), F.col("event_id").cast("string"), F.lit(":"), X.iso(slot)).alias("job_key"), slot.alias("run_at"), "event_id").dropDuplicates(["job_key"])


def due_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.where(F.col("run_at") <= now)


def next_version(events: DataFrame, versions: DataFrame) -> DataFrame:
    """(event_id, version_index): one past the highest, or 0."""
    top = versions.groupBy("event_id").agg(F.max("version_index").alias("top"))
    return events.select("event_id").join(top, "event_id", "left").select("event_id", F.coalesce(F.col("top") + 1, F.lit(0)).alias("version_index"))


def build_packet(events: DataFrame, links: DataFrame, articles: DataFrame, media: DataFrame, versions: DataFrame) -> DataFrame:
    """One new version row per event: index, headline, packet STRUCT with its articles in link order.

    The headline is the last linked article's title, else the start time,
    else a fixed text.
    """
    cited = links.join(articles, "article_id").join(media.select("media_id", "media_key"), "media_id", "left")
    row = F.struct(F.col("linked_at"), F.col("article_id"), F.coalesce("media_key", F.lit("unknown")).alias("media_key"), X.iso(F.col("published_at")).alias("published_at"), "title", "snippet", "url")
    per = cited.groupBy("event_id").agg(F.array_sort(F.collect_list(row)).alias("a"))
    at = lambda c: X.iso(F.col(c))
    joined = events.join(per, "event_id", "left").join(next_version(events, versions), "event_id")
    refs = F.transform(F.coalesce("a", F.array().cast(joined.schema["a"].dataType)), lambda x: x.dropFields("linked_at"))
    headline = F.coalesce(F.try_element_at("a", F.lit(-1))["title"], at("t0"), F.lit("No headline"))
    return joined.select("event_id", "version_index", headline.alias("headline"), F.struct("event_id", "version_index", "state", at("t0").alias("t0"), at("t_last").alias("t_last"), at("published_at").alias("published_at"), headline.alias("headline"), refs.alias("articles")).alias("packet"))


def version_diff(new: DataFrame, versions: DataFrame, reason: Column) -> DataFrame:
    """``new`` packets with diff STRUCT(added_articles, reason) against the latest version."""
    old = latest_version(versions).select("event_id", F.col("packet.articles.article_id").alias("__before"))
    ids = F.col("packet.articles.article_id")
    joined = new.join(old, "event_id", "left")
    return joined.withColumn("diff", F.struct(F.when(F.col("__before").isNull(), ids).otherwise(F.array_except(ids, F.col("__before"))).alias("added_articles"), reason.alias("reason"))).drop("__before")


def version_history(rows: DataFrame, key: str = "event_id", order: str = "created_at") -> DataFrame:
    """Rows numbered from 0 in order, for a batch that rebuilds all versions."""
    return rows.withColumn("version_index", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)
