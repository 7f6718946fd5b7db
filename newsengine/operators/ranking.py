"""Event scores from articles and claims, and the ranked feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsengine.functions import lexicons as L
from newsengine.functions import text as X

HOUR = 3_600_000


def article_junk(articles: DataFrame) -> DataFrame:
    """``articles`` with junk DOUBLE, from url, title and snippet."""
    return articles.withColumn("junk", X.junk_score(F.col("url"), F.col("title"), F.col("snippet"))["score"])


def importance(capped: Column, media: Column) -> Column:
    return X.sigmoid(F.log(1 + capped) * F.log(1 + media))


def recency(published: Column, t0: Column, now: Column, half_life_hours: float = L.HALF_LIFE_HOURS) -> Column:
    age = F.greatest(F.lit(0), F.unix_millis(now) - F.unix_millis(F.coalesce(published, t0, now)))
    return F.exp(-0.693 * age / (half_life_hours * HOUR))


def claim_quality(supported: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(1.0), supported / total)).otherwise(0.0)


def topic_boost(keys: Column, hot: list[str]) -> Column:
    """Half a point per hot topic of the event, one at most."""
    if not hot:
        return F.lit(0.0)
    n = F.size(F.filter(F.coalesce(keys, F.array().cast("array<string>")), lambda k: k.isin(hot)))
    return F.least(n / 2, F.lit(1.0))


def media_counts(scored: DataFrame, now: Column, momentum_hours: float = L.MOMENTUM_HOURS) -> DataFrame:
    """One row per event and outlet: the first of two aggregations, so no event's articles meet in one task unsummed."""
    fresh = (F.col("junk") < L.JUNK_PENALTY) & (F.unix_millis(F.coalesce("published_at", "created_at")) >= F.unix_millis(now) - int(momentum_hours * HOUR))
    return scored.groupBy("event_id", "media_id").agg(F.count("*").alias("n"), F.count_if(F.col("junk") < L.JUNK_EXCLUDE).alias("kept"), F.count_if(fresh).alias("fresh"), F.sum("junk").alias("junk"))


def event_aggregates(scored: DataFrame, now: Column, momentum_hours: float = L.MOMENTUM_HOURS) -> DataFrame:
    per = media_counts(scored, now, momentum_hours)
    return per.groupBy("event_id").agg(
        F.sum("n").alias("articles"),
        F.sum("kept").alias("kept"),
        F.sum(F.least("kept", F.lit(L.PER_MEDIA_CAP))).alias("capped"),
        F.count_if(F.col("kept") > 0).alias("unique_media"),
        F.max("n").alias("largest"),
        F.sum("fresh").alias("updates_6h"),
        F.count_if(F.col("fresh") > 0).alias("fresh_media"),
        F.sum("junk").alias("junk_sum"),
    )


def event_score(events: DataFrame, articles: DataFrame, claims: DataFrame, now: Column, hot_topics: list[str] | None = None, momentum_hours: float = L.MOMENTUM_HOURS, half_life_hours: float = L.HALF_LIFE_HOURS) -> DataFrame:
    """One row per event with its score, components and tie-breakers.

    ``articles`` has junk (see ``article_junk``). Events whose articles are all
    junk score -1 and are excluded; events without articles are scored.
    ``claims`` has (event_id, status). Two-level sums and left joins: one
    shuffle by event for each of articles and claims.
    """
    sums = event_aggregates(articles, now, momentum_hours)
    said = claims.groupBy("event_id").agg(F.count("*").alias("claims"), F.count_if(F.col("status") == "SUPPORTED").alias("supported"))
    joined = events.join(sums, "event_id", "left").join(said, "event_id", "left").na.fill(0, ["articles", "kept", "capped", "unique_media", "largest", "updates_6h", "fresh_media", "claims", "supported"])
    out = (F.col("articles") > 0) & (F.col("kept") == 0)
    avg = F.when(F.col("articles") > 0, F.col("junk_sum") / F.col("articles")).otherwise(0.0)
    dominant = (F.col("articles") > 0) & (F.col("largest") / F.greatest("articles", F.lit(1)) > L.DOMINANCE_SHARE)
    w = L.RANK_WEIGHTS
    zero = lambda c: F.when(out, 0.0).otherwise(c)
    keys = F.col("topic_keys") if "topic_keys" in events.columns else F.lit(None).cast("array<string>")
    parts = joined.select(
        *events.columns,
        out.alias("junk_excluded"),
        avg.alias("junk_penalty"),
        (dominant & ~out).alias("dominance_penalty"),
        zero(importance(F.col("capped"), F.col("unique_media"))).alias("importance"),
        zero(X.sigmoid(F.col("updates_6h") + 2 * F.col("fresh_media"))).alias("momentum"),
        zero(recency(F.col("published_at"), F.col("t0"), now, half_life_hours)).alias("recency"),
        zero(claim_quality(F.col("supported"), F.col("claims"))).alias("quality"),
        zero(topic_boost(keys, hot_topics or [])).alias("topic_boost"),
        F.when(out, 0).otherwise(F.col("unique_media")).alias("unique_media"),
        F.when(out, 0).otherwise(F.col("updates_6h")).alias("updates_6h"),
    )
    total = w["importance"] * F.col("importance") + w["momentum"] * F.col("momentum") + w["recency"] * F.col("recency") + w["quality"] * F.col("quality") + w["topic"] * F.col("topic_boost") - w["junk"] * F.col("junk_penalty") - F.when(F.col("dominance_penalty"), L.DOMINANCE_PENALTY).otherwise(0.0)
    return parts.withColumn("score", F.when(F.col("junk_excluded"), -1.0).otherwise(total))


def rank_order() -> list[Column]:
    """Score to nine digits, then outlets, updates, time and id."""
    return [F.round("score", 9).desc(), F.col("unique_media").desc(), F.col("updates_6h").desc(), F.col("published_at").desc_nulls_last(), F.col("event_id")]


def rank_events(scored: DataFrame) -> DataFrame:
    """Events that are not excluded, in order; the caller limits or writes them range-partitioned."""
    return scored.where(~F.col("junk_excluded")).orderBy(*rank_order())


def top_ranked(scored: DataFrame, k: int) -> DataFrame:
    """The first ``k`` with their position from 1: a top-k per task, then one of ``k`` rows each."""
    top = scored.where(~F.col("junk_excluded")).orderBy(*rank_order()).limit(k)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*rank_order())))


def newest_published(events: DataFrame, k: int = L.RANK_WINDOW) -> DataFrame:
    return events.where(F.col("state") == "PUBLISHED").orderBy(F.col("published_at").desc_nulls_last(), F.col("event_id").desc()).limit(k)


def ranked_feed(events: DataFrame, articles: DataFrame, claims: DataFrame, now: Column, window: int = L.RANK_WINDOW, page: int = L.PAGE_SIZE, **options) -> DataFrame:
    """The newest published events, ranked, first page, with the cursor of the page's last row if more follow.

    The window of events is joined first, so only their articles and claims
    are scored.
    """
    newest = newest_published(events, window)
    ids = newest.select("event_id")
    mine = articles.join(F.broadcast(ids), "event_id", "left_semi")  # ``ids`` has ``window`` rows at most
    scored = event_score(newest, article_junk(mine), claims.join(F.broadcast(ids), "event_id", "left_semi"), now, **options)
    ranked = top_ranked(scored, window)
    more = F.max("position").over(Window.partitionBy()) > page
    return ranked.withColumn("next_cursor", F.when(more & (F.col("position") == page), X.encode_cursor(F.col("published_at"), F.col("event_id")))).where(F.col("position") <= page)


def ranking_stats(scored: DataFrame) -> DataFrame:
    """avg_score_top10, multi_source_ratio, junk_blocked and penalized in one row."""
    top = top_ranked(scored, 10).agg(F.avg("score").alias("avg_score_top10"), F.avg((F.col("unique_media") > 1).cast("double")).alias("multi_source_ratio"))
    rest = scored.agg(F.count_if("junk_excluded").alias("junk_blocked"), F.count_if(~F.col("junk_excluded") & (F.col("junk_penalty") > 0)).alias("penalized"))
    return top.join(F.broadcast(rest))


def freshness_diversity_score(t_last: Column, media: Column, now: Column, life_hours: float = L.HALF_LIFE_HOURS) -> Column:
    fresh = F.when(t_last.isNull(), 0.0).otherwise(F.exp(-(F.unix_millis(now) - F.unix_millis(t_last)) / (life_hours * HOUR)))
    return 0.6 * fresh + 0.4 * F.least(F.lit(1.0), media / 5)


def sticky_rank(items: DataFrame, now: Column, most: int = 3, life_hours: float = L.HALF_LIFE_HOURS, feed: str | None = None) -> DataFrame:
    """Items in order of score, except that an untriggered one moves at most ``most`` places.

    One feed is one page of items; with ``feed`` each value of that column is
    a feed of its own and feeds are ranked side by side.
    """
    group = [feed] if feed else []
    triggered = F.col("headline_changed") | F.col("has_new_supported_claim") | F.col("has_new_media")
    scored = items.withColumn("score", freshness_diversity_score(F.col("t_last"), F.col("unique_media"), now, life_hours))
    by_score = scored.withColumn("__i", F.row_number().over(Window.partitionBy(*group).orderBy(F.round("score", 9).desc(), "event_id")) - 1)
    before = F.col("previous_position")
    held = before.isNotNull() & ~triggered & (F.abs(F.col("__i") - before) > most)
    place = F.when(held & (F.col("__i") < before), before - most).when(held, before + most).otherwise(F.col("__i"))
    return by_score.withColumn("__p", place).withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy("__p", "__i")) - 1).drop("__i", "__p")
