"""Queries over single column functions and the remaining table operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsengine.functions import lexicons as L
from newsengine.functions import text as X
from newsengine.operators import bias as B
from newsengine.operators import claims as C
from newsengine.operators import lifecycle as Y
from newsengine.operators import linking as K
from newsengine.operators import overview as O
from newsengine.operators import ranking as R
from newsengine.operators import topics as P
from newsengine.operators import vectors as V
from newsengine.plans import adapters as A
from newsengine.plans.more import STATE, states
from newsengine.plans.queries import BIAS_SQL, CLAIM_SQL, HASH_SQL, LETTERS_SQL, NORM_SQL, NOW_MS, SENTENCE_SQL, STRIP_SQL, TOPIC_SQL, TYPE_SQL, query, r6
from newsengine.sources import tables as S


@query("SELECT page_id, url, sha256(html) AS html FROM pages")
def pages_source(spark, d):
    """Pages as they are read."""
    return S.pages_source(spark, f"{d}/pages.parquet").select("page_id", "url", F.sha2("html", 256).alias("html"))


@query("""SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', '''')) AS plain FROM pages""")
def decode_entities(spark, d):
    return A.table(spark, d, "pages").select("page_id", F.sha2(X.decode_entities(F.col("html")), 256).alias("plain"))


@query(f"SELECT page_id, sha256({STRIP_SQL.format('html')}) AS plain FROM pages")
def strip_html(spark, d):
    return A.table(spark, d, "pages").select("page_id", F.sha2(X.strip_html(F.col("html")), 256).alias("plain"))


H1_SQL = "regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)"


@query(f"SELECT page_id, {STRIP_SQL.format(H1_SQL)} AS h1 FROM pages")
def extract_h1(spark, d):
    return A.table(spark, d, "pages").select("page_id", X.extract_h1(F.col("html")).alias("h1"))


@query("SELECT page_id, 'utf-8 & more' AS title FROM pages")
def extract_meta(spark, d):
    """A meta element added to every page in reversed order of attributes, read back and decoded."""
    page = F.concat(F.lit('<meta content="utf-8 &amp; more" name="og:title">'), "html")
    return A.table(spark, d, "pages").select("page_id", X.extract_meta(page, "og:title").alias("title"))


@query(f"SELECT doc_id, len({LETTERS_SQL})::INT AS n_tokens, sha256(array_to_string({LETTERS_SQL}, ' ')) AS tokens FROM documents")
def tokenize_letters(spark, d):
    t = X.tokenize_letters(F.col("text"))
    return A.table(spark, d, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.sha2(F.array_join(t, " "), 256).alias("tokens"))


@query(f"WITH w AS (SELECT DISTINCT unnest({LETTERS_SQL}) AS token FROM documents), hw AS (SELECT token, list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(token, ''), lambda c: unicode(c)::HUGEINT)), lambda a, b: (a * 31 + b) % 4294967296) AS h FROM w) SELECT token, {HASH_SQL} AS slot FROM hw")
def hash_token(spark, d):
    """Slot of every distinct word."""
    words = A.table(spark, d, "documents").select(F.explode(X.tokenize_letters(F.col("text"))).alias("token")).distinct()
    return words.select("token", X.hash_token(F.col("token")).cast("int").alias("slot"))


@query("SELECT doc_id AS article_id, length(string_split(text, chr(10))[1] || ' ' || text) AS n FROM documents")
def text_for_embedding(spark, d):
    a = A.document_articles(spark, d)
    return a.select("article_id", F.length(V.text_for_embedding(F.col("title"), F.col("snippet"))).cast("long").alias("n"))


@query(f"WITH {SENTENCE_SQL} SELECT article_id, count(*) AS sentences, sum(length(sentence))::BIGINT AS chars FROM se WHERE sentence <> '' GROUP BY 1")
def split_sentences(spark, d):
    """Number and length of the sentences of every document with its title."""
    a = A.document_articles(spark, d)
    s = a.select("article_id", F.explode(X.split_sentences(C.source_text(F.col("title"), F.col("snippet")))).alias("s"))
    return s.groupBy("article_id").agg(F.count("*").alias("sentences"), F.sum(F.length("s")).alias("chars"))


@query(f"WITH t AS (SELECT doc_id, {NORM_SQL.format('text')} AS norm, text AS sentence FROM documents) SELECT doc_id, sha256(norm) AS norm, {TYPE_SQL} AS kind, len(regexp_extract_all(sentence, '[0-9]+(?:[.,][0-9]+)?'))::INT AS numbers FROM t")
def normalize_claim(spark, d):
    """Whole documents normalized, classed and searched for numbers."""
    t = F.col("text")
    return A.table(spark, d, "documents").select("doc_id", F.sha2(X.normalize_claim(t), 256).alias("norm"), X.classify_claim(t).alias("kind"), F.size(X.extract_numbers(t)).alias("numbers"))


@query(f"WITH {CLAIM_SQL} SELECT claim_type, status, count(*) AS claims, sum(quotes)::BIGINT AS quotes FROM fin GROUP BY 1, 2")
def claim_status(spark, d):
    """Claims and quotes by type and status."""
    c = C.build_claims(A.document_articles(spark, d))
    return c.groupBy("claim_type", "status").agg(F.count("*").alias("claims"), F.sum(F.size("quotes")).alias("quotes"))


@query(f"WITH {CLAIM_SQL} SELECT event_id, norm AS claim_text, CASE WHEN status = 'INSUFFICIENT' THEN 'que_falta' WHEN status = 'DISPUTED' THEN 'en_disputa' WHEN claim_type IN ('FACT', 'QUANT') THEN 'que_paso' ELSE 'contexto' END AS section FROM fin")
def overview_bullets(spark, d):
    return O.overview_bullets(C.build_claims(A.document_articles(spark, d))).select("event_id", "claim_text", "section")


@query("SELECT doc_id AS version_id, substring(sha256('overview:v2.0:' || doc_id || ':' || lang), 1, 16) AS overview_hash FROM documents")
def overview_hash(spark, d):
    return A.table(spark, d, "documents").select(F.col("doc_id").alias("version_id"), X.overview_hash(F.col("doc_id"), F.col("lang")).alias("overview_hash"))


@query("SELECT doc_id, 'Bloqueado por gates: ' || CASE WHEN n_chars < 500 THEN 'SINGLE_SOURCE, MISSING_QUOTES' ELSE 'SINGLE_SOURCE' END AS why FROM documents")
def insufficient_overview(spark, d):
    reasons = O.evidence_gate(F.lit(1), F.when(F.col("n_chars") < 500, 1).otherwise(2))
    return A.table(spark, d, "documents").select("doc_id", O.insufficient_overview(reasons)["why"].alias("why"))


@query(f"SELECT o_orderkey AS event_id, CASE WHEN {STATE} = 'CLOSED' THEN 'PENDING_PUBLISH' ELSE {STATE} END AS state, CASE WHEN {STATE} = 'CLOSED' THEN {NOW_MS} + 300000 ELSE epoch_ms(o_orderdate) + 432000000 END AS publish_ms FROM orders")
def schedule_publish(spark, d):
    """Fulfilled orders as newly detected events; the others keep their time."""
    e = states(spark, d).withColumn("state", F.when(F.col("state") == "CLOSED", "DETECTED").otherwise(F.col("state")))
    return Y.schedule_publish(e, A.now()).select("event_id", "state", F.unix_millis("publish_at").alias("publish_ms"))


@query("SELECT l_orderkey AS a, o.o_orderkey AS b, round(CASE WHEN len(list_distinct(list(l_suppkey))) = 0 THEN 0 ELSE len(list_intersect(list_distinct(list(l_suppkey)), any_value(s))) / (len(list_distinct(list(l_suppkey))) + len(any_value(s)) - len(list_intersect(list_distinct(list(l_suppkey)), any_value(s)))) END, 6) AS overlap FROM lineitem JOIN (SELECT l_orderkey - 1 AS k, l_orderkey AS o_orderkey, list_distinct(list(l_suppkey)) AS s FROM lineitem GROUP BY 1, 2) o ON k = l_orderkey GROUP BY 1, 2")
def entity_overlap(spark, d):
    """Shared suppliers of neighbouring orders."""
    s = A.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("s"))
    n = s.select((F.col("l_orderkey") - 1).alias("a"), F.col("l_orderkey").alias("b"), F.col("s").alias("t"))
    return s.withColumnRenamed("l_orderkey", "a").join(n, "a").select("a", "b", F.round(K.entity_overlap(F.col("s"), F.col("t")), 6).alias("overlap"))


@query("SELECT o_orderkey AS article_id, CASE WHEN o_orderstatus = 'O' THEN 'LINK' WHEN o_orderstatus = 'P' AND o_totalprice >= 300000 THEN 'LINK' ELSE 'CREATE' END AS action, CASE WHEN o_orderstatus = 'O' THEN o_custkey WHEN o_orderstatus = 'P' AND o_totalprice >= 300000 THEN -o_custkey END AS event_id FROM orders")
def apply_external_pair_score(spark, d):
    """Open orders score 0.7 and link at once; of the others, at 0.55, priced ones have a verdict for another event, fulfilled ones a block."""
    o = A.table(spark, d, "orders")
    open_ = F.col("o_orderstatus") == "O"
    scored = o.select(F.col("o_orderkey").alias("article_id"), F.col("o_custkey").alias("event_id"), F.when(open_, 0.7).otherwise(0.55).alias("score"), F.lit(1).alias("unique_media"), F.array().cast("array<string>").alias("block_reasons"))
    verdicts = o.select(F.col("o_orderkey").alias("article_id"), F.when(F.col("o_totalprice") >= 300000, 0.9).otherwise(0.2).alias("same_event"), (F.col("o_orderstatus") == "F").alias("hard_block"), (-F.col("o_custkey")).alias("best_event_id"))
    return K.decide_link(o.select(F.col("o_orderkey").alias("article_id")), scored, verdicts).select("article_id", "action", "event_id")


@query("SELECT l_suppkey AS media_id, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O' GROUP BY 1")
def bias_labels_by_scope(spark, d):
    """Labels of one scope and version, counted per outlet."""
    li = A.table(spark, d, "lineitem").select(F.lit("e").alias("event_id"), F.col("l_returnflag").alias("version_id"), F.col("l_linestatus").alias("scope"), F.col("l_suppkey").alias("media_id"))
    return S.bias_labels_by_scope(li, "e", "R", "O").groupBy("media_id").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS event_id, l_linenumber AS line FROM lineitem WHERE l_suppkey = 7 AND l_returnflag = 'A'")
def bias_labels_by_media(spark, d):
    li = A.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("media_id"), F.col("l_returnflag").alias("event_id"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"))
    return S.bias_labels_by_media(li, 7, "A").select(F.col("k").alias("event_id"), "line")


@query("SELECT l_orderkey AS article_id, l_returnflag AS topic_key FROM lineitem WHERE l_suppkey = 3")
def topic_assignments_by_event(spark, d):
    li = A.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("event_id"), F.col("l_orderkey").alias("article_id"), F.col("l_returnflag").alias("topic_key"))
    return S.topic_assignments_by_event(li, 3).select("article_id", "topic_key")


@query("SELECT l_suppkey AS event_id, l_returnflag AS topic_key FROM lineitem WHERE l_orderkey = 1")
def topic_assignments_by_article(spark, d):
    li = A.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("event_id"), F.col("l_orderkey").alias("article_id"), F.col("l_returnflag").alias("topic_key"))
    return S.topic_assignments_by_article(li, 1).select("event_id", "topic_key")


@query("SELECT s_suppkey AS media_id, coalesce(n, s_nationkey)::BIGINT AS score FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity > 49 GROUP BY 1) ON l_suppkey = s_suppkey")
def media_profile_upsert(spark, d):
    """Supplier profiles replaced where new ones are there."""
    old = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("media_id"), F.col("s_nationkey").cast("long").alias("score"))
    new = A.table(spark, d, "lineitem").where("l_quantity > 49").groupBy(F.col("l_suppkey").alias("media_id")).agg(F.count("*").alias("score"))
    return S.media_profile_upsert(old, new)


@query("SELECT doc_id AS article_id, CASE WHEN quality = 0 THEN 'BLOCKED' ELSE 'NORMALIZED' END AS status FROM documents LEFT JOIN (SELECT doc_id AS k, min(quality) AS quality FROM labels GROUP BY 1) ON k = doc_id")
def article_status_update(spark, d):
    """Documents of low quality are blocked."""
    arts = A.table(spark, d, "documents").select(F.col("doc_id").alias("article_id"), F.lit("NORMALIZED").alias("status"))
    bad = A.table(spark, d, "labels").groupBy(F.col("doc_id").alias("article_id")).agg(F.min("quality").alias("q")).where("q = 0").select("article_id", F.lit("BLOCKED").alias("status"))
    return S.article_status_update(arts, bad)


@query("SELECT o_orderkey AS event_id, CASE WHEN o_orderstatus <> 'P' THEN 'o' END AS overview, CASE WHEN o_orderstatus <> 'P' THEN (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) ELSE 0 END AS claims FROM orders")
def reset_enrichment(spark, d):
    """Pending orders lose their overview and claims."""
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.lit(0).alias("version_id"), F.lit("o").alias("overview"), "o_orderstatus")
    claims = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.lit(0).alias("version_id"), F.monotonically_increasing_id().alias("claim_id"))
    quotes = claims.select("claim_id")
    packets, left, _ = S.reset_enrichment(o, claims, quotes, o.where("o_orderstatus = 'P'").select("event_id", "version_id"))
    n = left.groupBy("event_id").agg(F.count("*").alias("claims"))
    return packets.join(n, "event_id", "left").select("event_id", "overview", F.coalesce("claims", F.lit(0)).alias("claims"))


@query("SELECT l_orderkey AS event_id, count(*) AS labels FROM lineitem GROUP BY 1")
def count_bias_by_version(spark, d):
    return S.count_bias_by_version(A.item_articles(spark, d).withColumn("version_id", F.lit(0))).select("event_id", "labels")


@query("SELECT l_suppkey AS event_id, count(*) AS topics FROM lineitem GROUP BY 1")
def count_topics_by_version(spark, d):
    return S.count_topics_by_version(A.item_topics(spark, d).withColumn("version_id", F.lit(0))).select("event_id", "topics")


@query(f"WITH {TOPIC_SQL}, tp AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY weight DESC, ord) AS rank FROM sc WHERE weight >= 0.2 QUALIFY rank <= 2), a AS (SELECT doc_id // 8 AS event_id, coalesce(topic_key, 'OTROS') AS topic_key, coalesce(weight, 1.0) AS weight FROM documents LEFT JOIN tp ON article_id = doc_id WHERE (doc_id // 8) % 2 = 0) SELECT event_id, topic_key, round(sum(weight), 3) AS weight FROM a GROUP BY 1, 2")
def assign_topics(spark, d):
    """Top topics of the event versions that have no assignment; odd events have one."""
    a = A.document_articles(spark, d).drop("version_id").withColumn("published_at", A.now())
    versions = a.select("event_id", F.lit(0).alias("version_id"), A.now().alias("t0")).distinct()
    claims = a.where("1 = 0").select("event_id", F.lit(0).alias("version_id"), F.lit(0).alias("ord"), F.lit("").alias("claim_text"))
    _, _, top, _ = P.assign_topics(versions, a, claims, versions.where("event_id % 2 = 1"), P.topic_lexicon(spark))
    return top.select("event_id", "topic_key", "weight")


@query(f"WITH {BIAS_SQL} SELECT article_id, CASE WHEN emotional + critical + negation + institutional + technical + attribution + pro_gov + anti_gov = 0 THEN '{L.WHY_NEUTRAL}' END AS why FROM f WHERE emotional + critical + negation + institutional + technical + attribution + pro_gov + anti_gov = 0")
def bias_rationale(spark, d):
    """Why texts of the documents without any hit."""
    rows = B.bias_article_level(A.document_articles(spark, d))
    return rows.where(sum((F.col(k) for k in B.FEATURES), F.lit(0.0)) == 0).select("article_id", F.col("rationale.why_short").alias("why"))


@query(f"SELECT o_orderkey AS event_id, round(exp(-0.693 * greatest(0, {NOW_MS} - epoch_ms(o_orderdate)) / 43200000.0 / 100), 6) AS recency, round(CASE WHEN n > 0 THEN least(1.0, s / n) ELSE 0 END, 6) AS quality FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_linestatus = 'O') AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def recency(spark, d):
    """Recency with a half-life of 1 200 hours, and claim quality."""
    n = A.item_claims(spark, d).groupBy("event_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "SUPPORTED").alias("s"))
    j = A.order_events(spark, d).join(n, "event_id", "left").na.fill(0, ["n", "s"])
    return j.select("event_id", F.round(R.recency(F.col("published_at"), F.col("t0"), A.now(), 1200), 6).alias("recency"), F.round(R.claim_quality(F.col("s"), F.col("n")), 6).alias("quality"))


@query("SELECT l_orderkey AS event_id, round(1 / (1 + exp(-ln(1 + sum(least(n, 3))) * ln(1 + count(*)))), 6) AS importance, max(n) / sum(n) > 0.7 AS dominated FROM (SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def importance(spark, d):
    """Importance and dominance of every order's suppliers, no article being junk."""
    a = R.event_aggregates(A.item_articles(spark, d).withColumn("junk", F.lit(0.0)), A.now())
    return a.select("event_id", F.round(R.importance(F.col("capped"), F.col("unique_media")), 6).alias("importance"), (F.col("largest") / F.col("articles") > L.DOMINANCE_SHARE).alias("dominated"))
