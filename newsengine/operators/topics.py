"""Topics, heatmaps, drift and sub-events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsengine.functions import lexicons as L
from newsengine.functions import text as X

HOUR = 3_600_000


def topic_lexicon(spark: SparkSession) -> DataFrame:
    """(topic_key, ord, keyword)."""
    rows = F.array(*[F.struct(F.lit(t).alias("topic_key"), F.lit(i).alias("ord"), F.lit(k).alias("keyword")) for i, (t, ks) in enumerate(L.TOPIC_KEYWORDS.items()) for k in ks])
    return spark.range(1).select(F.inline(rows))


def score_topics(articles: DataFrame, lexicon: DataFrame, id_cols: tuple[str, ...] = ("article_id",), text_col: str = "text") -> DataFrame:
    """(ids, topic_key, ord, weight): tokens that contain a keyword, once per keyword, over all tokens.

    The lexicon is a stated word list; each distinct token of the table meets
    it once.
    """
    words = articles.select(*id_cols, F.explode(X.whitespace_tokens(F.col(text_col))).alias("token")).groupBy(*id_cols, "token").agg(F.count("*").alias("n"))
    total = words.groupBy(*id_cols).agg(F.sum("n").alias("total"))
    hits = words.join(F.broadcast(lexicon), F.col("token").contains(F.col("keyword"))).groupBy(*id_cols, "topic_key", "ord").agg(F.sum("n").alias("hits"))
    return hits.join(total, list(id_cols)).select(*id_cols, "topic_key", "ord", (F.col("hits") / F.col("total")).alias("weight"))


def top_topics_per_article(articles: DataFrame, scores: DataFrame, id_cols: tuple[str, ...] = ("article_id",), least: float = L.TOPIC_MIN_WEIGHT) -> DataFrame:
    """(ids, topic_key, weight): the two best of at least ``least``, else OTROS with weight 1."""
    w = Window.partitionBy(*id_cols).orderBy(F.col("weight").desc(), "ord")
    top = scores.where(F.col("weight") >= least).withColumn("rank", F.row_number().over(w)).where("rank <= 2").select(*id_cols, "topic_key", "weight")
    joined = articles.select(*id_cols).distinct().join(top, list(id_cols), "left")
    return joined.select(*id_cols, F.coalesce("topic_key", F.lit(L.OTHER_TOPIC)).alias("topic_key"), F.coalesce("weight", F.lit(1.0)).alias("weight"))


def emergent_topics(claims: DataFrame, article_counts: DataFrame, lexicon: DataFrame, least: int = L.EMERGENT_MIN, most: int = L.EMERGENT_MAX, keys: tuple[str, ...] = ("event_id", "version_id")) -> DataFrame:
    """(keys, rank, topic_key): frequent pairs of neighbouring words of an event's claims that no topic owns.

    ``article_counts`` has ``keys`` and article_count. Ties go by first
    appearance, in the order of the claims' ord and position.
    """
    tokens = F.filter(X.whitespace_tokens(F.col("claim_text")), lambda t: F.length(t) > 3)
    rows = claims.select(*keys, "ord", tokens.alias("t")).where(F.size("t") > 1)
    pairs = rows.select(*keys, "ord", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.concat(F.element_at("t", i), F.lit(" "), F.element_at("t", i + 1)))).alias("pos", "gram"))
    counts = pairs.groupBy(*keys, "gram").agg(F.count("*").alias("n"), F.min(F.struct("ord", "pos")).alias("first")).where(F.col("n") >= least)
    big = article_counts.where(F.col("article_count") >= least).select(*keys)
    closed = lexicon.select(F.col("keyword").alias("w")).distinct()
    split = counts.join(big, list(keys)).withColumn("a", F.substring_index("gram", " ", 1)).withColumn("b", F.substring_index("gram", " ", -1))
    free = split.join(F.broadcast(closed), F.col("a") == F.col("w"), "left_anti").join(F.broadcast(closed), F.col("b") == F.col("w"), "left_anti")
    w = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "first")
    slug = F.concat(F.lit("EMERG_"), F.substring(F.upper(F.regexp_replace("gram", f"{X.WS}+", "_")), 1, 30))
    return free.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select(*keys, "rank", slug.alias("topic_key"))


def heatmap_rows(weights: DataFrame, bin_hours: float = L.BIN_HOURS, bins: int = L.BINS) -> DataFrame:
    """(event_id, bin_index, topic_key, share) from (event_id, t0, published_at, topic_key, weight).

    Shares of each bin add up to 1 before rounding to three digits; rows
    without a time, before t0 or past the last bin do not count.
    """
    size = int(bin_hours * HOUR)
    at = F.unix_millis("published_at") - F.unix_millis("t0")
    inside = weights.withColumn("bin_index", F.floor(at / size).cast("int")).where((at >= 0) & (F.col("bin_index") < bins))
    cells = inside.groupBy("event_id", "bin_index", "topic_key").agg(F.sum("weight").alias("w"))
    total = F.sum("w").over(Window.partitionBy("event_id", "bin_index"))
    return cells.select("event_id", "bin_index", "topic_key", F.round(F.col("w") / total, 3).alias("share"))


def topic_heatmap(events: DataFrame, weights: DataFrame, bin_hours: float = L.BIN_HOURS, bins: int = L.BINS) -> DataFrame:
    """All bins of each event: (event_id, bin_index, bin_start, bin_end, topics MAP)."""
    size = int(bin_hours * HOUR)
    cells = heatmap_rows(weights, bin_hours, bins).groupBy("event_id", "bin_index").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("topic_key", "share")))).alias("topics"))
    grid = events.where("t0 is not null").select("event_id", "t0", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin_index"))
    start = lambda k: F.timestamp_millis(F.unix_millis("t0") + (F.col("bin_index") + k) * size)
    return grid.join(cells, ["event_id", "bin_index"], "left").select("event_id", "bin_index", start(0).alias("bin_start"), start(1).alias("bin_end"), F.coalesce("topics", F.create_map().cast("map<string,double>")).alias("topics"))


def event_top_topics(weights: DataFrame, k: int = 5) -> DataFrame:
    sums = weights.groupBy("event_id", "topic_key").agg(F.round(F.sum("weight"), 3).alias("weight"))
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy("event_id").orderBy(F.col("weight").desc(), "topic_key"))).where(F.col("rank") <= k)


def dominant_topic(topics: Column) -> Column:
    """Topic of the largest share, OTROS for none."""
    top = F.array_max(F.transform(F.map_entries(topics), lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k"))))
    return F.when(F.size(topics) > 0, F.when(top["v"] > 0, top["k"]).otherwise(L.OTHER_TOPIC)).otherwise(L.OTHER_TOPIC)


def dominant_rows(shares: DataFrame) -> DataFrame:
    """(event_id, bin_index, topic_key): the topic of the largest share of each filled bin, the last name at a tie."""
    return shares.groupBy("event_id", "bin_index").agg(F.max(F.struct("share", "topic_key")).alias("m")).select("event_id", "bin_index", "m.topic_key")


def topic_drift(shares: DataFrame, run: int = L.DRIFT_BINS) -> DataFrame:
    """(event_id, drift_topic, start_bin): the first other topic that leads ``run`` bins in a row.

    Bins in a row have consecutive indexes, so an empty bin ends a run. Of
    several runs the one that is long enough first counts.
    """
    top = dominant_rows(shares)
    first = top.groupBy("event_id").agg(F.min_by("topic_key", "bin_index").alias("initial"))
    other = top.join(first, "event_id").where("topic_key <> initial")
    island = F.col("bin_index") - F.row_number().over(Window.partitionBy("event_id", "topic_key").orderBy("bin_index"))
    runs = other.withColumn("island", island).groupBy("event_id", "topic_key", "island").agg(F.min("bin_index").alias("start_bin"), F.count("*").alias("n")).where(F.col("n") >= run)
    return runs.groupBy("event_id").agg(F.min(F.struct("start_bin", "topic_key")).alias("r")).select("event_id", F.col("r.topic_key").alias("drift_topic"), F.col("r.start_bin").alias("start_bin"))


def claim_divergence(claims: DataFrame, used: DataFrame | None = None, keys: tuple[str, str] = ("event_id", "version_id"), least: int = L.DIVERGENCE_MIN) -> DataFrame:
    """(keys, label, claim_ids): the first cluster of at least ``least`` claims of a version.

    Claims join the first cluster with which they share two words; the
    cluster then keeps the shared ones only. The fold depends on order, so a
    version's claims meet in one task; a version holds the claims of at most
    a few dozen articles. Claims of ``used`` (claim_id) are left out.
    """
    live = claims.where(F.col("status").isin("SUPPORTED", "DISPUTED"))
    if used is not None:
        live = live.join(used.select("claim_id"), "claim_id", "left_anti")
    rows = live.select(*keys, "ord", "claim_id", F.filter(X.whitespace_tokens(F.col("claim_text")), lambda t: F.length(t) > 3).alias("tokens"))
    enough = rows.withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).where(F.col("__n") >= least).drop("__n")
    kinds = [f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys] + ["label string", f"claim_ids array<{rows.schema['claim_id'].dataType.simpleString()}>"]

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        clusters: list[tuple[list, list]] = []
        for r in group.sort_values("__pos").itertuples():
            for members, shared in clusters:
                common = [t for t in r.tokens if t in shared]
                if len(common) >= 2:
                    members.append(r.claim_id)
                    shared[:] = common
                    break
            else:
                clusters.append(([r.claim_id], list(r.tokens)))
        for members, shared in clusters:
            if len(members) >= least:
                return pd.DataFrame([[*(group[k].iloc[0] for k in keys), "RAMA: " + " ".join(shared[:3]), members]], columns=[*keys, "label", "claim_ids"])
        return pd.DataFrame(columns=[*keys, "label", "claim_ids"])

    placed = enough.withColumn("__pos", F.row_number().over(Window.partitionBy(*keys).orderBy("ord", "claim_id"))).drop("ord")
    return placed.groupBy(*keys).applyInPandas(fold, ", ".join(kinds))


def build_subevents(versions: DataFrame, drift: DataFrame, assignments: DataFrame, divergence: DataFrame) -> DataFrame:
    """(event_id, version_id, subevents ARRAY<STRUCT>): the version's own, then a phase and a branch where they are new."""
    kind = "array<struct<label:string,predicate_summary:string,article_ids:array<string>,key_claim_ids:array<string>>>"
    none = F.array().cast("array<string>")
    old = F.coalesce("subevents", F.array().cast(kind)) if "subevents" in versions.columns else F.array().cast(kind)
    per = assignments.groupBy("event_id", "topic_key").agg(F.array_sort(F.collect_set(F.col("article_id").cast("string"))).alias("__ids"))
    phase = drift.join(per, (drift["event_id"] == per["event_id"]) & (F.col("drift_topic") == F.col("topic_key")), "left").select(drift["event_id"], "drift_topic", "start_bin", F.coalesce("__ids", none).alias("__ids"))
    branch = divergence.select("event_id", "version_id", F.col("label").alias("__label"), F.col("claim_ids").cast("array<string>").alias("__claims"))
    joined = versions.join(phase, "event_id", "left").join(branch, ["event_id", "version_id"], "left")
    new_phase = F.col("drift_topic").isNotNull() & ~F.exists(old, lambda s: s["label"].contains("FASE"))
    new_branch = F.col("__label").isNotNull() & ~F.exists(old, lambda s: s["label"] == F.col("__label"))
    a = F.struct(F.concat(F.lit("FASE 2: "), "drift_topic").alias("label"), F.concat(F.lit("Cambio temático sostenido hacia "), "drift_topic", F.lit(" a partir del bin "), F.col("start_bin").cast("string")).alias("predicate_summary"), F.col("__ids").alias("article_ids"), none.alias("key_claim_ids"))
    b = F.struct(F.col("__label").alias("label"), F.concat(F.lit("Grupo de "), F.size("__claims").cast("string"), F.lit(" claims divergentes")).alias("predicate_summary"), none.alias("article_ids"), F.col("__claims").alias("key_claim_ids"))
    return joined.select("event_id", "version_id", F.concat(old, F.array_compact(F.array(F.when(new_phase, a), F.when(new_branch, b)))).alias("subevents"))


def assign_topics(versions: DataFrame, articles: DataFrame, claims: DataFrame, done: DataFrame, lexicon: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(assignments, emergent, top topics, heatmap) of versions that have no assignment yet.

    ``versions`` has event_id, version_id, t0; ``articles`` event_id,
    article_id, title, snippet, published_at.
    """
    todo = versions.join(done.select("event_id", "version_id").distinct(), ["event_id", "version_id"], "left_anti")
    mine = articles.join(todo, "event_id").withColumn("text", F.concat(X.text_or_empty(F.col("title")), F.lit(". "), X.text_or_empty(F.col("snippet"))))
    keys = ("event_id", "version_id", "article_id")
    assigned = top_topics_per_article(mine, score_topics(mine, lexicon, keys), keys)
    counts = mine.groupBy("event_id", "version_id").agg(F.count("*").alias("article_count"))
    emergent = emergent_topics(claims.join(todo.select("event_id", "version_id"), ["event_id", "version_id"], "left_semi"), counts, lexicon)
    timed = assigned.join(mine.select(*keys, "t0", "published_at"), list(keys))
    return assigned, emergent, event_top_topics(timed), topic_heatmap(todo, timed)
