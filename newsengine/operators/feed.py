"""Read queries: feeds by time, event documents, viewing history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsengine.functions import lexicons as L
from newsengine.functions import text as X
from newsengine.sources.tables import latest_version

STRENGTH = {"STRONG": 3, "MEDIUM": 2, "WEAK": 1}


def chronological_feed(events: DataFrame, cursor: str | None = None, page: int = L.PAGE_SIZE) -> DataFrame:
    """One page of published events, newest first, with has_more; a bad cursor reads as none.

    Order and cursor both go by (published_at, event_id), so pages neither
    repeat nor skip rows. One row more than the page is read.
    """
    live = events.where(F.col("state") == "PUBLISHED")
    if cursor is not None:
        c = X.decode_cursor(F.lit(cursor))
        at, last = c["published_at"], c["event_id"].cast(events.schema["event_id"].dataType)
        live = live.where(last.isNull() | F.col("published_at").isNull() | (F.col("published_at") < at) | ((F.col("published_at") == at) & (F.col("event_id") < last)))
    order = [F.col("published_at").desc_nulls_last(), F.col("event_id").desc()]
    top = live.orderBy(*order).limit(page + 1).withColumn("position", F.row_number().over(Window.orderBy(*order)))
    more = F.max("position").over(Window.partitionBy()) > page
    return top.withColumn("has_more", more).where(F.col("position") <= page)


def feed_page(events: DataFrame, group: Column | None = None, page: int = L.PAGE_SIZE) -> DataFrame:
    """The first page of every feed at once, feeds told apart by ``group``."""
    key = F.lit(0) if group is None else group
    w = Window.partitionBy("feed").orderBy(F.col("published_at").desc_nulls_last(), F.col("event_id").desc())
    return events.where(F.col("state") == "PUBLISHED").withColumn("feed", key).withColumn("position", F.row_number().over(w)).where(F.col("position") <= page)


def feed_items(events: DataFrame, versions: DataFrame) -> DataFrame:
    """(event_id, state, headline, t_last, published_at, cover_image_url, teaser, ai_overview).

    The cover column carries the teaser. An overview whose two lists are
    empty reads as none.
    """
    last = latest_version(versions).select("event_id", "headline", "ai_teaser", "ai_overview")
    joined = events.join(last, "event_id", "left")
    o = F.col("ai_overview")
    full = (F.coalesce(F.size(o["what_happened"]), F.lit(0)) > 0) | (F.coalesce(F.size(o["context"]), F.lit(0)) > 0)
    teaser = F.nullif("ai_teaser", F.lit(""))
    return joined.select("event_id", "state", "headline", "t_last", "published_at", teaser.alias("cover_image_url"), teaser.alias("teaser"), F.when(full, o).alias("ai_overview"))


def quote_highlights(quotes: DataFrame, k: int = 3, keys: tuple[str, ...] = ("event_id", "media_key")) -> DataFrame:
    """The ``k`` strongest quotes per event and outlet, ties in order of ``ord``."""
    rank = F.coalesce(*[F.when(F.col("strength") == s, n) for s, n in STRENGTH.items()], F.lit(0))
    w = Window.partitionBy(*keys).orderBy(rank.desc(), "ord")
    return quotes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def media_tabs(links: DataFrame, articles: DataFrame, media: DataFrame, quotes: DataFrame | None = None) -> DataFrame:
    """(event_id, media_key, articles ARRAY, highlights ARRAY)."""
    cited = links.join(articles, "article_id").join(media.select("media_id", "media_key"), "media_id", "left").withColumn("media_key", F.coalesce("media_key", F.lit("unknown")))
    tabs = cited.groupBy("event_id", "media_key").agg(F.array_sort(F.collect_list(F.struct("article_id", "title", "snippet", "url", "published_at"))).alias("articles"))
    if quotes is None:
        return tabs.withColumn("highlights", F.array().cast("array<string>"))
    said = quotes.join(cited.select("event_id", "article_id", "media_key"), ["event_id", "article_id"])
    top = quote_highlights(said).groupBy("event_id", "media_key").agg(F.array_sort(F.collect_list(F.struct("rank", "quote_id", "quote_text", "strength", "claim_id"))).alias("highlights"))
    return tabs.join(top, ["event_id", "media_key"], "left")


def nested(rows: DataFrame, name: str, *cols: str) -> DataFrame:
    return rows.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))


def event_detail(events: DataFrame, versions: DataFrame, tabs: DataFrame, overviews: DataFrame, media_labels: DataFrame, article_labels: DataFrame, topics: DataFrame, heatmap: DataFrame, subevents: DataFrame) -> DataFrame:
    """One document per event, for all events in one job; filter events first for one of them.

    Each part is grouped by event before the join, so no join multiplies rows.
    ``overviews`` and ``subevents`` belong to versions; the latest one counts.
    """
    last = latest_version(versions).select("event_id", F.col("version_id").alias("__v"), F.struct("version_id", "version_index", "headline").alias("latest_version"))
    head = events.join(last, "event_id", "left")
    own = overviews.select("event_id", F.col("version_id").alias("__v"), F.struct("gate_status", "sections").alias("overview"))
    subs = subevents.select("event_id", F.col("version_id").alias("__v"), "subevents")
    label = ["media_id", "label_primary", "label_secondary", "intensity", "confidence", "degraded"]
    out = head.join(own, ["event_id", "__v"], "left").join(subs, ["event_id", "__v"], "left")
    for part in (
        nested(tabs, "media_tabs", "media_key", "articles", "highlights"),
        nested(media_labels, "bias_media_level", *label),
        nested(article_labels, "bias_article_level", "article_id", *label),
        nested(topics, "top_topics", "rank", "topic_key", "weight"),
        nested(heatmap.where("size(topics) > 0").withColumn("topics", F.map_entries("topics")), "topics_heatmap", "bin_index", "bin_start", "bin_end", "topics"),
    ):
        out = out.join(part, "event_id", "left")
    return out.drop("__v")


def feed_neighbors(feed: DataFrame, group: str | None = None) -> DataFrame:
    """``feed`` rows with the ids before and after them; null at the ends."""
    w = Window.partitionBy(*([group] if group else [])).orderBy("position")
    return feed.withColumns({"prev_id": F.lag("event_id").over(w), "next_id": F.lead("event_id").over(w)})


def viewed_history(views: DataFrame, most: int = 200) -> DataFrame:
    """The newest view of each event, newest first, at most ``most`` per user."""
    once = views.groupBy("user_id", "event_id").agg(F.max_by(F.struct(*[c for c in views.columns if c not in ("user_id", "event_id")]), "viewed_at").alias("v"))
    flat = once.select("user_id", "event_id", "v.*")
    w = Window.partitionBy("user_id").orderBy(F.col("viewed_at").desc(), "event_id")
    return flat.withColumn("position", F.row_number().over(w)).where(F.col("position") <= most)
