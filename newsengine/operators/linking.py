"""Articles to events: candidates, scores, decisions, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsengine.functions import lexicons as L
from newsengine.functions import text as X
from newsengine.operators.folding import fold_batch
from newsengine.operators.pairing import COMPOSITE, best_pairs, near_pairs, scored_pairs
from newsengine.operators.vectors import centroid, cosine_similarity, text_for_embedding
from newsengine.sources.shared import checkpointed

DAY = 86_400_000
CONTEXT = ["action", "city", "city_conf"]


def mega_event_guard(article_count: Column, sub_event_count: Column) -> Column:
    """STRUCT(blocked, reason): over the article limit first, then over the sub-event limit."""
    reason = F.when(article_count > L.MAX_ARTICLES, "MAX_ARTICLES").when(F.coalesce(sub_event_count, F.lit(0)) > L.MAX_SUB_EVENTS, "MAX_SUB_EVENTS")
    return F.struct(reason.isNotNull().alias("blocked"), reason.alias("reason"))


def entity_overlap(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)))


def temporal_proximity(at: Column, t0: Column, t_last: Column, half_life_days: float = L.TEMPORAL_HALF_LIFE_DAYS) -> Column:
    low = F.unix_millis(F.coalesce(t0, at))
    high = F.unix_millis(F.coalesce(t_last, t0, at))
    ts = F.unix_millis(at)
    gap = F.when((ts >= low) & (ts <= high), 0).when(ts < low, low - ts).otherwise(ts - high)
    return F.when(at.isNull(), 0.5).otherwise(F.exp(-0.693 * gap / (half_life_days * DAY)))


def hard_block(a: dict[str, Column], e: dict[str, Column]) -> Column:
    """Reasons ARRAY<STRING> against linking; a null on either side is no reason.

    ``a`` has action, city, city_conf, fact_date; ``e`` has action, city,
    city_conf, fact_earliest, fact_latest.
    """
    action = (a["action"] != "") & (e["action"] != "") & (a["action"] != e["action"])
    sure = (F.coalesce(a["city_conf"], F.lit(0.0)) >= L.CITY_CONFIDENCE) & (F.coalesce(e["city_conf"], F.lit(0.0)) >= L.CITY_CONFIDENCE)
    city = (a["city"] != "") & (e["city"] != "") & (F.lower(a["city"]) != F.lower(e["city"])) & sure
    at = F.unix_millis(a["fact_date"])
    first = F.coalesce(F.unix_millis(e["fact_earliest"]), at)
    last = F.coalesce(F.unix_millis(e["fact_latest"]), first)
    known = e["fact_earliest"].isNotNull() | e["fact_latest"].isNotNull()
    gap = known & (F.when(at < first, first - at).when(at > last, at - last).otherwise(0) > L.DATE_GAP_DAYS * DAY)
    return F.array_compact(F.array(F.when(action, "action_incompatible"), F.when(city, "city_mismatch"), F.when(gap, "date_gap")))


def event_features(events: DataFrame, links: DataFrame, articles: DataFrame, since: Column | None = None) -> DataFrame:
    """Per open event: centroid, entities, article_count, unique_media; each computed once, not per pair.

    Events without a vector are left out, and those over the size limit.
    """
    live = events.where(F.col("state") != "CLOSED")
    if since is not None:
        live = live.where(F.col("t_last") >= since)
    mine = links.join(articles, "article_id").join(live.select("event_id"), "event_id")
    sizes = mine.groupBy("event_id").agg(F.count("*").alias("article_count"), F.countDistinct("media_id").alias("unique_media"))
    said = mine.select("event_id", F.explode(X.extract_entities(text_for_embedding(F.col("title"), F.col("snippet")))).alias("entity")).distinct().groupBy("event_id").agg(F.array_sort(F.collect_list("entity")).alias("entities"))
    joined = live.join(centroid(mine).select("event_id", "centroid"), "event_id").join(sizes, "event_id").join(said, "event_id", "left")
    fits = ~mega_event_guard(F.col("article_count"), F.lit(0))["blocked"]
    return joined.where(fits).withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))


def link_candidates(articles: DataFrame, features: DataFrame, now: Column, days: int = L.CANDIDATE_DAYS) -> DataFrame:
    """Pairs of an article and an open event of the last ``days`` days.

    Pairs meet on shared non-zero vector slots or shared entities only: any
    other pair scores at most the temporal weight, far under every threshold,
    so it can neither link nor block.
    """
    recent = features.where(F.unix_millis("t_last") >= F.unix_millis(now) - days * DAY)
    entities = X.extract_entities(text_for_embedding(F.col("title"), F.col("snippet")))
    rows = articles.withColumn("article_entities", entities)
    tags = lambda vec, ents: F.array_union(F.transform(F.filter(F.transform(vec, lambda v, k: F.when(v != 0, k)), lambda k: k.isNotNull()), lambda k: F.concat(F.lit("v"), k.cast("string"))), F.transform(ents, lambda e: F.concat(F.lit("e"), e)))
    left = rows.select("article_id", F.explode(tags(F.col("embedding_vec"), F.col("article_entities"))).alias("tag"))
    right = recent.select("event_id", F.explode(tags(F.col("centroid"), F.col("entities"))).alias("tag"))
    pairs = left.join(right, "tag").select("article_id", "event_id").distinct()
    return pairs.join(rows, "article_id").join(event_side(recent), "event_id")


def event_side(features: DataFrame) -> DataFrame:
    """The columns of events that a pair has; those that articles have too get the prefix event_."""
    cols = [c for c in ("state", "t0", "t_last", "centroid", "entities", "article_count", "unique_media", "fact_earliest", "fact_latest") if c in features.columns]
    return features.select("event_id", *cols, *[F.col(c).alias(f"event_{c}") for c in CONTEXT if c in features.columns])


def score_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs`` with embedding_sim, entity_overlap, temporal, score and block_reasons."""
    get = lambda name, kind: F.col(name) if name in pairs.columns else F.lit(None).cast(kind)
    a = {"action": get("action", "string"), "city": get("city", "string"), "city_conf": get("city_conf", "double"), "fact_date": get("fact_date", "timestamp")}
    e = {"action": get("event_action", "string"), "city": get("event_city", "string"), "city_conf": get("event_city_conf", "double"), "fact_earliest": get("fact_earliest", "timestamp"), "fact_latest": get("fact_latest", "timestamp")}
    scored = pairs.withColumns({
        "embedding_sim": cosine_similarity(F.col("embedding_vec"), F.col("centroid")),
        "entity_overlap": entity_overlap(F.col("article_entities"), F.col("entities")),
        "temporal": temporal_proximity(F.col("published_at"), F.col("t0"), F.col("t_last")),
        "block_reasons": hard_block(a, e),
    })
    return scored.withColumn("score", L.W_EMBEDDING * F.col("embedding_sim") + L.W_ENTITY * F.col("entity_overlap") + L.W_TEMPORAL * F.col("temporal"))


def score_candidates(articles: DataFrame, features: DataFrame, now: Column, days: int = L.CANDIDATE_DAYS, least: float | None = None) -> DataFrame:
    """Scores of all candidate pairs, or of those that reach ``least``: such pairs alone become rows then."""
    if least is None:
        return score_pairs(link_candidates(articles, features, now, days))
    recent = features.where(F.unix_millis("t_last") >= F.unix_millis(now) - days * DAY)
    rows = articles.withColumn("article_entities", X.extract_entities(text_for_embedding(F.col("title"), F.col("snippet"))))
    left = rows.select(F.col("article_id").alias("left_id"), F.col("embedding_vec").alias("vec"), F.col("article_entities").alias("entities"), F.unix_millis("published_at").alias("at"))
    right = recent.select(F.col("event_id").alias("right_id"), F.col("centroid").alias("vec"), "entities", F.unix_millis("t0").alias("t0"), F.unix_millis("t_last").alias("t_last"))
    pairs = scored_pairs(left, right, least, COMPOSITE).select(F.col("left_id").alias("article_id"), F.col("right_id").alias("event_id"))
    return score_pairs(pairs.join(rows, "article_id").join(event_side(recent), "event_id")).where(F.col("score") >= least)


def best_first() -> list[Column]:
    return [F.round("score", 9).desc(), F.col("event_id")]


def decide_link(articles: DataFrame, scored: DataFrame, verdicts: DataFrame | None = None, link: float = L.THETA_LINK, maybe_link: float = L.THETA_MAYBE) -> DataFrame:
    """(article_id, action, event_id, score, basis) for every article.

    The best pair without a block links from 0.62 on, and from 0.50 on if its
    event has two outlets; else the article creates an event. ``verdicts``
    (article_id, same_event, hard_block, best_event_id) decide the rows
    between the two thresholds first.
    """
    free = scored.where(F.size("block_reasons") == 0)
    best = free.groupBy("article_id").agg(F.min_by(F.struct("event_id", "score", "unique_media"), F.struct(-F.round("score", 9), F.col("event_id"))).alias("top"))
    joined = articles.select("article_id").join(best, "article_id", "left")
    score, maybe = F.col("top.score"), (F.col("top.score") >= maybe_link) & (F.col("top.score") < link)
    basis = F.when(score >= link, "auto").when(maybe & (F.col("top.unique_media") >= 2), "two_media")
    event = F.col("top.event_id")
    if verdicts is not None:
        seen = verdicts.select("article_id", F.struct("same_event", "hard_block", "best_event_id").alias("__v"))
        joined = joined.join(seen, "article_id", "left")
        asked = maybe & F.col("__v").isNotNull()
        told = F.col("__v.best_event_id").isNotNull() & (F.col("__v.same_event") >= L.VERDICT_LINK)
        basis = F.when(asked & F.coalesce("__v.hard_block", F.lit(False)), None).when(asked & told, "verdict").otherwise(basis)
        event = F.when(basis == "verdict", F.col("__v.best_event_id")).otherwise(event)
        score = F.when(basis == "verdict", F.col("__v.same_event")).otherwise(score)
    return joined.select("article_id", F.when(basis.isNotNull(), "LINK").otherwise("CREATE").alias("action"), F.when(basis.isNotNull(), event).alias("event_id"), F.when(basis.isNotNull(), score).alias("score"), basis.alias("basis"))


def top_scores_audit(scored: DataFrame, decisions: DataFrame) -> DataFrame:
    """(article_id, top ARRAY<STRUCT>): the five best candidates of links, three of creations."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("article_id").orderBy(*best_first()))).where("rank <= 5")
    joined = ranked.join(decisions.select("article_id", "action"), "article_id").where((F.col("action") == "LINK") | (F.col("rank") <= 3))
    return joined.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("rank", "event_id", "score"))).alias("top"))


def link_v1(articles: DataFrame, features: DataFrame, least: float = L.THETA_V1) -> DataFrame:
    """The event of the nearest centroid, linked from a cosine of 0.45 on; times play no part.

    The best event of each article is found block by block, so that an article
    makes one row for each block of events and none for each event.
    """
    left = articles.select(F.col("article_id").alias("left_id"), F.col("embedding_vec").alias("vec"))
    best = best_pairs(left, features.select(F.col("event_id").alias("right_id"), F.col("centroid").alias("vec")))
    joined = articles.select("article_id").join(best.withColumnRenamed("left_id", "article_id"), "article_id", "left")
    linked = F.coalesce(F.col("score") >= least, F.lit(False))
    return joined.select("article_id", F.when(linked, "LINK").otherwise("CREATE").alias("action"), F.when(linked, F.col("right_id")).alias("event_id"), "score")


def merge_check(new: DataFrame, candidates: DataFrame, capped: bool = True, least: float = L.THETA_MERGE) -> DataFrame:
    """(event_id, candidate_id, canonical_id, merged_id, score): the first candidate that a new event merges with.

    Both sides have event_id, centroid, article_count and t0. Candidates are
    taken by (t0, event_id); the larger event stays, at a tie the candidate
    if it is not younger. Only pairs that reach ``least`` become rows; a
    candidate that is at the size limit meets nobody.
    """
    if capped:
        candidates = candidates.where(F.col("article_count") <= L.MAX_ARTICLES)
    vec = lambda df, name: df.select(F.col("event_id").alias(name), F.col("centroid").alias("vec"))
    pairs = near_pairs(vec(new, "left_id"), vec(candidates, "right_id"), least).select(F.col("left_id").alias("event_id"), F.col("right_id").alias("candidate_id"), "score").where("event_id <> candidate_id")
    side = lambda df, p: df.select(F.col("event_id").alias("event_id" if p == "n" else "candidate_id"), F.col("article_count").alias(f"{p}_count"), F.col("t0").alias(f"{p}_t0"))
    both = pairs.join(side(new, "n"), "event_id").join(side(candidates, "c"), "candidate_id")
    if capped:
        both = both.where(F.col("n_count") + F.col("c_count") <= L.MAX_ARTICLES)
    first = both.withColumn("__rn", F.row_number().over(Window.partitionBy("event_id").orderBy(F.col("c_t0").asc_nulls_last(), "candidate_id"))).where("__rn = 1")
    older = F.col("n_t0").isNull() | (F.col("c_t0") <= F.col("n_t0"))
    stays = F.when(F.col("c_count") > F.col("n_count"), F.col("candidate_id")).when(F.col("n_count") > F.col("c_count"), F.col("event_id")).when(older, F.col("candidate_id")).otherwise(F.col("event_id"))
    return first.select("event_id", "candidate_id", stays.alias("canonical_id"), F.when(stays == F.col("event_id"), F.col("candidate_id")).otherwise(F.col("event_id")).alias("merged_id"), "score")


def resolve_canonical(events: DataFrame) -> DataFrame:
    """(event_id, canonical_id) at the end of the chain of canonical_event_id, however long.

    Every round doubles how far each pointer reaches and keeps the least id
    that it has passed, so the rounds are the logarithm of the longest chain.
    A pointer to an event that is not in the table ends there. Events that
    point to each other in a ring, of any length, and those that lead into one
    resolve to the least id of the ring: a pointer of 2^k steps that is still
    on its way when 2^k is over the number of events is on a ring, and has by
    then passed all of it.
    """
    given = events.select("event_id", F.coalesce("canonical_event_id", "event_id").alias("to"))
    out = checkpointed(given.select("event_id", F.col("to").alias("canonical_id"), F.col("to").alias("__least"), (F.col("to") == F.col("event_id")).alias("__end")))
    most, reached = out.count(), 1
    while out.where("not __end").limit(1).count():
        ahead = out.select(F.col("event_id").alias("canonical_id"), F.col("canonical_id").alias("__next"), F.col("__least").alias("__low"), F.col("__end").alias("__done"))
        stepped = out.join(ahead, "canonical_id", "left")
        out = checkpointed(stepped.select("event_id", F.coalesce("__next", "canonical_id").alias("canonical_id"), F.least("__least", F.coalesce("__low", "__least")).alias("__least"), F.coalesce("__done", F.lit(True)).alias("__end")))
        reached *= 2
        if reached > most:
            break
    # What has not ended walks a ring, on which it is by now: from there every pointer has passed the whole ring.
    ring = out.where("not __end")
    on = ring.select("canonical_id").distinct().join(ring.select(F.col("event_id").alias("canonical_id"), F.col("__least").alias("__ring")), "canonical_id")
    joined = out.join(on, "canonical_id", "left")
    return joined.select("event_id", F.when(F.col("__end"), F.col("canonical_id")).otherwise(F.col("__ring")).alias("canonical_id"))


def open_states(events: DataFrame, links: DataFrame, articles: DataFrame, since: Column) -> DataFrame:
    """The open events that moved since ``since``, as the fold takes them; those over the size limit or without a vector are left out."""
    live = events.where((F.col("state") != "CLOSED") & (F.unix_millis("t_last") >= F.unix_millis(since)))
    rows = links.select("event_id", "article_id").join(live.select("event_id"), "event_id")
    sizes = rows.groupBy("event_id").agg(F.count("*").alias("n_articles")).where(f"n_articles <= {L.MAX_ARTICLES}")
    # From here on an event has at most as many rows as the limit says.
    mine = rows.join(sizes.select("event_id"), "event_id").join(articles.select("article_id", "media_id", "title", "snippet", "embedding_vec"), "article_id")
    names = F.array_distinct(F.flatten(F.collect_list(X.extract_entities(text_for_embedding(F.col("title"), F.col("snippet"))))))
    said = mine.groupBy("event_id").agg(names.alias("entities"), F.collect_set(F.col("media_id").cast("string")).alias("media"))
    ms = lambda c: F.unix_millis(c) if c in events.columns else F.lit(None).cast("long")
    plain = lambda c, kind: (F.col(c) if c in events.columns else F.lit(None)).cast(kind)
    facts = live.select("event_id", ms("t0").alias("t0"), ms("t_last").alias("t_last"), plain("action", "string").alias("action"), plain("city", "string").alias("city"), plain("city_conf", "double").alias("city_conf"), ms("fact_earliest").alias("fact_earliest"), ms("fact_latest").alias("fact_latest"))
    out = facts.join(centroid(mine).select("event_id", F.col("centroid").alias("vec"), F.col("n").alias("n_vec")), "event_id").join(sizes, "event_id").join(said, "event_id")
    return out.withColumn("event_id", F.col("event_id").cast("string"))


def link_incremental(batch: DataFrame, events: DataFrame, links: DataFrame, articles: DataFrame, now: Column, order: str = "article_id", days: int = L.CANDIDATE_DAYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, new events, merges) of one batch, as if its articles came one at a time in ``order``.

    links has event_id, article_id, score (null for an article that opens its
    event); new events event_id, state, t0, t_last, canonical_event_id; merges
    event_id, candidate_id, canonical_id, merged_id, score. Each new event is
    held against the open events at once. Articles without a vector are left
    out, and of rows with one id one stays. See ``folding``.
    """
    one = batch.where(F.size("embedding_vec") > 0).dropDuplicates(["article_id"])
    has = lambda c, kind: (F.col(c) if c in batch.columns else F.lit(None)).cast(kind)
    ms = lambda c: F.unix_millis(c) if c in batch.columns else F.lit(None).cast("long")
    given = one.select(F.col(order).alias("seq"), F.col("article_id").cast("string").alias("article_id"), F.col("embedding_vec").cast("array<double>").alias("vec"), X.extract_entities(text_for_embedding(F.col("title"), F.col("snippet"))).alias("entities"), F.col("media_id").cast("string").alias("media_id"), ms("published_at").alias("at"), has("action", "string").alias("action"), has("city", "string").alias("city"), has("city_conf", "double").alias("city_conf"), ms("fact_date").alias("fact_date"))
    instant = batch.sparkSession.range(1).select(F.unix_millis(now)).first()[0]
    since = F.timestamp_millis(F.lit(instant - days * DAY))
    made = fold_batch(given, open_states(events, links, articles, since), instant)
    kinds = batch.schema["article_id"].dataType
    at = F.timestamp_millis(F.lit(instant))
    made_links = made.select("event_id", F.col("article_id").cast(kinds).alias("article_id"), "score")
    new = made.where("not linked")
    canonical = F.when(F.col("merged_into").isNotNull() & F.col("stays"), F.col("merged_into"))
    merges = new.where("merged_into is not null").select("event_id", F.col("merged_into").alias("candidate_id"), F.coalesce(canonical, "event_id").alias("canonical_id"), F.when(F.col("stays"), F.col("event_id")).otherwise(F.col("merged_into")).alias("merged_id"), F.col("merge_score").alias("score"))
    new_events = new.select("event_id", F.lit("DETECTED").alias("state"), at.alias("t0"), at.alias("t_last"), canonical.alias("canonical_event_id"))
    return made_links, new_events, merges
