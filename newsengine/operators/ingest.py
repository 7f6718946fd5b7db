"""From pages to gated articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsengine.functions import lexicons as L
from newsengine.functions import text as X

RULES = "media_key string, capture_regex string, accept_regex string, reject_regex string, list_url string, has_date_published boolean"


def site_rules(spark: SparkSession) -> DataFrame:
    fields = [f.split(" ") for f in RULES.split(", ")]
    rows = F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, fields, strict=True)]) for r in L.SITE_RULES])
    return spark.range(1).select(F.inline(rows))


def discover_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(media_key, page_url, pos, url): hrefs of list pages that a site's rules take, distinct in page order.

    A page of a site without rules has none. The rule table is a stated list
    of sites, so it is small enough to go to every task.
    """
    both = pages.join(F.broadcast(rules.select("media_key", "capture_regex", "accept_regex", "reject_regex")), "media_key")
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.concat(F.lit("(?i)href=[\"']("), F.col("capture_regex"), F.lit(")[\"']")), F.lit(1))
    taken = F.filter(found, lambda u: F.rlike(u, F.col("accept_regex")) & ~F.coalesce(F.rlike(u, F.col("reject_regex")), F.lit(False)))
    return both.select("media_key", F.col("url").alias("page_url"), F.posexplode(F.array_distinct(taken)).alias("pos", "url"))


def frontier_dedup(found: DataFrame, articles: DataFrame) -> DataFrame:
    """The first find of each URL, by outlet, page and position, that is no article yet."""
    w = Window.partitionBy("url").orderBy("media_key", "page_url", "pos")
    first = found.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
    return first.join(articles.select("url"), "url", "left_anti")


def scrape_summary(attempts: DataFrame) -> DataFrame:
    """discovered, skipped and fetch_fail per outlet and in all (media_key null), from (media_key, outcome)."""
    n = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return attempts.rollup("media_key").agg(n("discovered"), n("skipped"), n("fetch_fail"))


def parse_article(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """``pages`` with title, snippet and published_at; sites without rules give empty texts.

    Without ``rules`` every page is parsed and ``datePublished`` is looked at.
    """
    page = F.coalesce("html", F.lit(""))
    own = [c for c in pages.columns if c not in ("title", "snippet", "published_at")]
    if rules is None:
        known, late = F.lit(True), F.lit(True)
        base = pages
    else:
        base = pages.join(F.broadcast(rules.select("media_key", "has_date_published")), "media_key", "left")
        known, late = F.col("has_date_published").isNotNull(), F.coalesce("has_date_published", F.lit(False))
    title = F.coalesce(X.extract_meta(page, "og:title"), X.extract_h1(page), F.lit(""))
    snippet = F.coalesce(X.extract_meta(page, "og:description"), X.extract_lead_paragraph(page), F.lit(""))
    when = F.coalesce(X.extract_meta(page, "article:published_time"), F.when(late, X.extract_meta(page, "datePublished")))
    return base.select(*own, F.when(known, title).otherwise("").alias("title"), F.when(known, snippet).otherwise("").alias("snippet"), F.when(known, F.try_to_timestamp(when)).alias("published_at"))


def normalize_article(parsed: DataFrame, media: DataFrame, articles: DataFrame) -> DataFrame:
    """``parsed`` with media_id, snippet cut to its limit, and outcome.

    Outcome: FETCH_FAIL for unknown outlets, DUPLICATE_URL for stored or
    repeated URLs, PARSE_FAIL for blank titles, else NORMALIZED.
    """
    stored = articles.select("url").distinct().withColumn("__stored", F.lit(True))
    joined = parsed.join(media.select("media_key", "media_id"), "media_key", "left").join(stored, "url", "left")
    again = F.row_number().over(Window.partitionBy("url").orderBy("media_key", "title", "snippet")) > 1
    outcome = F.when(F.col("media_id").isNull(), "FETCH_FAIL").when(F.col("__stored") | again, "DUPLICATE_URL").when(X.trim_ws(X.text_or_empty(F.col("title"))) == "", "PARSE_FAIL").otherwise("NORMALIZED")
    return joined.withColumn("outcome", outcome).withColumn("snippet", F.substring("snippet", 1, L.MAX_SNIPPET)).drop("__stored")


def gate_reason(allowlisted: Column, snippet: Column) -> Column:
    """First failing check, null if none."""
    return F.when(~F.coalesce(allowlisted, F.lit(False)), "NOT_ALLOWLISTED").when(F.length(X.trim_ws(X.text_or_empty(snippet))) < L.MIN_SNIPPET, "NO_EXTRACT").when(~X.is_spanish(snippet), "NOT_SPANISH")


def policy_gate(articles: DataFrame, media: DataFrame) -> DataFrame:
    """``articles`` with status POLICY_OK, or BLOCKED and blocked_reason."""
    joined = articles.drop("status", "blocked_reason").join(media.select("media_id", "allowlisted"), "media_id", "left")
    reason = gate_reason(F.col("allowlisted"), F.col("snippet"))
    return joined.withColumn("blocked_reason", reason).withColumn("status", F.when(F.col("blocked_reason").isNull(), "POLICY_OK").otherwise("BLOCKED")).drop("allowlisted")


def blocked_events(gated: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(blocked messages, audit rows), one of each per blocked article."""
    bad = gated.where("blocked_reason is not null")
    messages = bad.select(F.lit("ArticlePolicyBlocked").alias("event_name"), now.alias("occurred_at"), F.col("url"), F.col("blocked_reason").alias("reason_code"))
    audit = bad.select(now.alias("occurred_at"), F.lit("ARTICLE").alias("entity_type"), F.col("article_id").cast("string").alias("entity_id"), F.lit("BLOCKED").alias("action"), F.col("blocked_reason").alias("data"))
    return messages, audit
