"""One query per operator over whole given tables, each beside the SQL that it equals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsengine.functions import lexicons as L
from newsengine.functions import text as X
from newsengine.operators import bias as B
from newsengine.operators import claims as C
from newsengine.operators import eventlog as E
from newsengine.operators import feed as D
from newsengine.operators import ingest as I
from newsengine.operators import lifecycle as Y
from newsengine.operators import linking as K
from newsengine.operators import overview as O
from newsengine.operators import ranking as R
from newsengine.operators import topics as P
from newsengine.operators import vectors as V
from newsengine.plans import adapters as A
from newsengine.sources import tables as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
Query = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


WINDOW_MS = int(A.WINDOW_HOURS * 3_600_000)
NOW_MS = f"epoch_ms(TIMESTAMP '{A.NOW}')"

# ---------------------------------------------------------------- ranking

SCORED_SQL = f"""
a AS (SELECT l_orderkey AS event_id, l_suppkey AS media_id, l_shipdate AS ts, round(l_tax * 10, 6) AS junk FROM lineitem),
per AS (SELECT event_id, media_id, count(*) AS n, count(*) FILTER (WHERE junk < 0.75) AS kept,
  count(*) FILTER (WHERE junk < 0.45 AND epoch_ms(ts) >= {NOW_MS} - {WINDOW_MS}) AS fresh, sum(junk) AS junk FROM a GROUP BY 1, 2),
ev AS (SELECT event_id, sum(n) AS articles, sum(kept) AS kept, sum(least(kept, 3)) AS capped, count(*) FILTER (WHERE kept > 0) AS um,
  max(n) AS largest, sum(fresh) AS u6, count(*) FILTER (WHERE fresh > 0) AS fm, sum(junk) AS junk FROM per GROUP BY 1),
cl AS (SELECT l_orderkey AS event_id, count(*) AS claims, count(*) FILTER (WHERE l_linestatus = 'O') AS supported FROM lineitem GROUP BY 1),
j AS (SELECT o_orderkey AS event_id, o_orderdate AS published_at, coalesce(articles, 0) AS articles, coalesce(kept, 0) AS kept, coalesce(capped, 0) AS capped,
  coalesce(um, 0) AS um, coalesce(largest, 0) AS largest, coalesce(u6, 0) AS u6, coalesce(fm, 0) AS fm, coalesce(junk, 0) AS junk,
  coalesce(claims, 0) AS claims, coalesce(supported, 0) AS supported
  FROM orders LEFT JOIN ev ON o_orderkey = ev.event_id LEFT JOIN cl ON o_orderkey = cl.event_id),
s AS (SELECT event_id, published_at, (articles > 0 AND kept = 0) AS junk_excluded,
  CASE WHEN articles > 0 THEN junk / articles ELSE 0 END AS junk_penalty,
  (articles > 0 AND largest / greatest(articles, 1) > 0.7) AS dominance_penalty,
  1 / (1 + exp(-ln(1 + capped) * ln(1 + um))) AS importance, 1 / (1 + exp(-(u6 + 2 * fm))) AS momentum,
  exp(-0.693 * greatest(0, {NOW_MS} - epoch_ms(published_at)) / {WINDOW_MS}.0) AS recency,
  CASE WHEN claims > 0 THEN supported / claims ELSE 0 END AS quality, um AS unique_media, u6 AS updates_6h FROM j),
scored AS (SELECT *, CASE WHEN junk_excluded THEN -1 ELSE 0.40 * importance + 0.22 * momentum + 0.18 * recency + 0.08 * quality - 0.06 * junk_penalty
  - CASE WHEN dominance_penalty THEN 0.05 ELSE 0 END END AS score FROM s),
ranked AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, unique_media DESC, updates_6h DESC, published_at DESC, event_id) AS position FROM scored WHERE NOT junk_excluded)
"""


def scored_orders(spark: SparkSession, d: str) -> DataFrame:
    return R.event_score(A.order_events(spark, d), A.item_articles(spark, d), A.item_claims(spark, d), A.now(), momentum_hours=A.WINDOW_HOURS, half_life_hours=A.WINDOW_HOURS)


@query(f"WITH {SCORED_SQL} SELECT event_id, round(score, 6) AS score, round(importance, 6) AS importance, round(momentum, 6) AS momentum, round(recency, 6) AS recency, round(quality, 6) AS quality, round(junk_penalty, 6) AS junk_penalty, unique_media::BIGINT AS unique_media, updates_6h::BIGINT AS updates_6h, dominance_penalty FROM ranked")
def rank_events(spark, d):
    """Every event that is not all junk, with its score and components, in order."""
    return R.rank_events(scored_orders(spark, d)).select("event_id", *r6("score", "importance", "momentum", "recency", "quality", "junk_penalty"), F.col("unique_media").cast("long").alias("unique_media"), F.col("updates_6h").cast("long").alias("updates_6h"), "dominance_penalty")


@query(f"WITH {SCORED_SQL} SELECT round((SELECT avg(score) FROM ranked WHERE position <= 10), 6) AS avg_score_top10, (SELECT avg((unique_media > 1)::INT) FROM ranked WHERE position <= 10) AS multi_source_ratio, count(*) FILTER (WHERE junk_excluded) AS junk_blocked, count(*) FILTER (WHERE NOT junk_excluded AND junk_penalty > 0) AS penalized FROM scored")
def ranking_stats(spark, d):
    """Averages of the ten best and junk counts."""
    return R.ranking_stats(scored_orders(spark, d)).withColumn("avg_score_top10", F.round("avg_score_top10", 6))


@query(f"WITH {SCORED_SQL}, first AS (SELECT * FROM ranked WHERE position <= 61) SELECT event_id, position, round(score, 6) AS score FROM first")
def top_ranked(spark, d):
    """The 61 best events with their positions (a top-k report)."""
    return R.top_ranked(scored_orders(spark, d), L.RANK_WINDOW).select("event_id", F.col("position").cast("long").alias("position"), *r6("score"))


@query("""SELECT * FROM (SELECT o_orderkey AS event_id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS position, count(*) OVER () > 20 AS has_more FROM orders) WHERE position <= 20""")
def chronological_feed(spark, d):
    """First page by time."""
    return D.chronological_feed(A.order_events(spark, d)).select("event_id", F.col("position").cast("long").alias("position"), "has_more")


STICKY_SQL = """
WITH s AS (SELECT o_orderkey AS event_id, o_custkey AS feed, o_orderstatus = 'F' AS trig, (o_orderkey % 9)::INT AS prev,
  0.6 * exp(-(epoch_ms(TIMESTAMP '2001-08-01') - epoch_ms(o_orderdate)) / 7776000000.0) + 0.4 * least(1.0, (o_orderkey % 7) / 5.0) AS score FROM orders),
i AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY round(score, 9) DESC, event_id) - 1 AS i FROM s),
p AS (SELECT *, CASE WHEN NOT trig AND abs(i - prev) > 3 THEN CASE WHEN i < prev THEN prev - 3 ELSE prev + 3 END ELSE i END AS p FROM i)
SELECT feed, event_id, round(score, 6) AS score, row_number() OVER (PARTITION BY feed ORDER BY p, i) - 1 AS position FROM p"""


@query(STICKY_SQL)
def sticky_rank(spark, d):
    """Each customer's orders as a feed whose items keep near their old place."""
    o = A.table(spark, d, "orders")
    items = o.select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("feed"), A.ts("o_orderdate").alias("t_last"), (F.col("o_orderkey") % 7).cast("int").alias("unique_media"), (F.col("o_orderkey") % 9).cast("int").alias("previous_position"), (F.col("o_orderstatus") == "F").alias("headline_changed"), F.lit(False).alias("has_new_supported_claim"), F.lit(False).alias("has_new_media"))
    return R.sticky_rank(items, A.now(), life_hours=A.WINDOW_HOURS, feed="feed").select("feed", "event_id", *r6("score"), F.col("position").cast("long").alias("position"))


def junk_sql(c: str, patterns: list[str]) -> str:
    return " + ".join(f"regexp_matches({c}, '(?i){p.replace('W', chr(92) + 'b').replace('(?<=[A-Za-z0-9_])¡no', chr(92) + 'b¡no')}')::INT" for p in patterns)


@query(f"""WITH a AS (SELECT doc_id AS article_id, 'https://' || source || '.example/' || doc_id AS url, string_split(text, chr(10))[1] AS title, text AS snippet FROM documents),
h AS (SELECT *, {junk_sql('url', L.JUNK_URL)} AS nu, {junk_sql('title', L.JUNK_TITLE)} AS nt, {junk_sql("title || ' ' || snippet", L.JUNK_SEO)} AS ns FROM a),
s AS (SELECT *, least(1.0, CASE WHEN nu > 0 THEN 0.35 ELSE 0 END + CASE WHEN nt >= 2 THEN 0.3 WHEN nt = 1 THEN 0.15 ELSE 0 END + CASE WHEN ns > 0 THEN 0.2 ELSE 0 END + CASE WHEN length(snippet) < 100 THEN 0.1 ELSE 0 END) AS score FROM h)
SELECT article_id, round(score, 6)::DOUBLE AS score, CASE WHEN score >= 0.75 THEN 'excluded' WHEN score >= 0.45 THEN 'penalized' ELSE 'normal' END AS class FROM s""")
def junk_score(spark, d):
    """Junk score and class of every document."""
    j = R.article_junk(A.document_articles(spark, d))
    return j.select("article_id", F.round("junk", 6).alias("score"), X.junk_classify(F.col("junk")).alias("class"))


# ---------------------------------------------------------------- read queries


@query("SELECT conv_id AS event_id, turn::INT AS version_index, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def latest_version(spark, d):
    return S.latest_version(A.turn_versions(spark, d)).select("event_id", "version_index", "role")


@query("SELECT o_custkey AS feed, o_orderkey AS event_id, position, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY position) AS prev_id, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY position) AS next_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS position FROM orders) WHERE position <= 20")
def feed_neighbors(spark, d):
    """First page of every customer's feed with the neighbours of each item."""
    events = A.order_events(spark, d).join(A.table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("cust")), "event_id")
    page = D.feed_page(events, F.col("cust"))
    return D.feed_neighbors(page, "feed").select("feed", "event_id", F.col("position").cast("long").alias("position"), "prev_id", "next_id")


@query("WITH v AS (SELECT user_id, event_type AS event_id, max(ts) AS t FROM events GROUP BY 1, 2) SELECT user_id, event_id, epoch_us(t) AS viewed_us, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id) AS position FROM v")
def viewed_history(spark, d):
    """Newest view of each kind per user."""
    views = A.log_events(spark, d).select("user_id", F.col("event_name").alias("event_id"), F.col("ts").alias("viewed_at"))
    return D.viewed_history(views).select("user_id", "event_id", F.unix_micros("viewed_at").alias("viewed_us"), F.col("position").cast("long").alias("position"))


@query(f"""SELECT o_orderkey AS event_id, CASE o_orderstatus WHEN 'F' THEN 'cerrados' WHEN 'O' THEN 'en_desarrollo' ELSE CASE WHEN {NOW_MS} - epoch_ms(o_orderdate) > 604800000 THEN 'cerrados' ELSE 'vistos' END END AS segment,
CASE WHEN sec < 60 THEN 'hace un momento' WHEN sec < 3600 THEN 'hace ' || (sec // 60) || ' min' WHEN sec < 86400 THEN 'hace ' || (sec // 3600) || 'h' ELSE 'hace ' || (sec // 86400) || 'd' END AS ago FROM (SELECT *, ({NOW_MS} - epoch_ms(o_orderdate)) // 1000 AS sec FROM orders)""")
def history_segment(spark, d):
    """Segment and relative time of every order."""
    o = A.table(spark, d, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "CLOSED").when(F.col("o_orderstatus") == "O", "PUBLISHED").otherwise("DETECTED")
    at = A.ts("o_orderdate")
    return o.select(F.col("o_orderkey").alias("event_id"), X.history_segment(state, at, A.now()).alias("segment"), X.relative_time(F.floor((F.unix_millis(A.now()) - F.unix_millis(at)) / 1000)).alias("ago"))


@query("""WITH q AS (SELECT l_orderkey AS event_id, l_suppkey AS media_key, l_linenumber AS ord, l_partkey AS quote_id, CASE l_returnflag WHEN 'A' THEN 3 WHEN 'N' THEN 2 ELSE 1 END AS s FROM lineitem)
SELECT event_id, media_key, quote_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_id, media_key ORDER BY s DESC, ord, quote_id) AS rank FROM q) WHERE rank <= 3""")
def quote_highlights(spark, d):
    """The three strongest line items per order and supplier."""
    li = A.table(spark, d, "lineitem")
    q = li.select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("media_key"), F.struct("l_linenumber", "l_partkey").alias("ord"), F.col("l_partkey").alias("quote_id"), F.when(F.col("l_returnflag") == "A", "STRONG").when(F.col("l_returnflag") == "N", "MEDIUM").otherwise("WEAK").alias("strength"))
    return D.quote_highlights(q).select("event_id", "media_key", "quote_id", F.col("rank").cast("long").alias("rank"))


# ---------------------------------------------------------------- ingestion


def array_sql(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


LETTERS_SQL = r"list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{L}\s]', '', 'g'), '\s+'), lambda x: x <> '')"
SPANISH_SQL = f"""t AS (SELECT doc_id, source, text, {LETTERS_SQL} AS tok FROM documents),
n AS (SELECT *, len(list_filter(tok, lambda x: list_contains({array_sql(L.SPANISH_STOP_WORDS)}, x))) AS es, len(list_filter(tok, lambda x: list_contains({array_sql(L.ENGLISH_STOP_WORDS)}, x))) AS en FROM t),
g AS (SELECT *, CASE WHEN len(tok) = 0 THEN false WHEN es + en = 0 THEN true ELSE es / (es + en) >= 0.6 END AS spanish FROM n)"""


@query(f"WITH {SPANISH_SQL} SELECT doc_id, spanish FROM g")
def is_spanish(spark, d):
    return A.table(spark, d, "documents").select("doc_id", X.is_spanish(F.col("text")).alias("spanish"))


@query(rf"WITH {SPANISH_SQL} SELECT doc_id AS article_id, CASE WHEN source = 'src0' THEN 'NOT_ALLOWLISTED' WHEN length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 80 THEN 'NO_EXTRACT' WHEN NOT spanish THEN 'NOT_SPANISH' END AS blocked_reason, CASE WHEN source = 'src0' OR length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 80 OR NOT spanish THEN 'BLOCKED' ELSE 'POLICY_OK' END AS status FROM g")
def policy_gate(spark, d):
    """First failing check of every document."""
    return I.policy_gate(A.document_articles(spark, d), A.source_media(spark, d)).select("article_id", "blocked_reason", "status")


STRIP_SQL = r"trim(regexp_replace(regexp_replace({0}, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))"


@query(rf"""WITH p AS (SELECT page_id, html, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS h1, list_filter(list_transform(regexp_extract_all(html, '(?is)<p[^>]*>(.*?)</p>', 1), lambda x: {STRIP_SQL.format('x')}), lambda x: length(x) > 40) AS ps FROM pages)
SELECT page_id, coalesce({STRIP_SQL.format('h1')}, '') AS title, coalesce(ps[1], '') AS snippet FROM p""")
def parse_article(spark, d):
    """Title and lead of every page."""
    return I.parse_article(A.table(spark, d, "pages")).select("page_id", "title", "snippet")


@query(r"""WITH h AS (SELECT page_id, url, list_filter(regexp_extract_all(html, '(?i)href=["''](/[^"'']+)["'']', 1), lambda x: regexp_matches(x, '^/[^/?]+$') AND NOT regexp_matches(x, '[.,]$')) AS u FROM pages),
e AS (SELECT page_id, url AS page_url, unnest(u) AS href, generate_subscripts(u, 1) AS i FROM h),
f AS (SELECT page_id, page_url, href, min(i) AS i FROM e GROUP BY ALL)
SELECT page_url, href AS url, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos FROM f""")
def discover_urls(spark, d):
    """Distinct relative links of every page that a site rule takes."""
    rules = spark.range(1).select(F.lit("any").alias("media_key"), F.lit(r"/[^\"']+").alias("capture_regex"), F.lit(r"^/[^/?]+$").alias("accept_regex"), F.lit(r"[.,]$").alias("reject_regex"))
    pages = A.table(spark, d, "pages").withColumn("media_key", F.lit("any"))
    return I.discover_urls(pages, rules).select("page_url", "url", F.col("pos").cast("long").alias("pos"))


@query("SELECT url, min(page_id) AS page_id FROM pages WHERE url NOT IN (SELECT p.url FROM pages p JOIN documents x ON x.doc_id = p.page_id AND x.lang = 'fr') GROUP BY 1")
def frontier_dedup(spark, d):
    """The first page of each URL that is no article yet; the URLs of pages whose id is a French document are."""
    p = A.table(spark, d, "pages")
    found = p.select("url", F.lit("any").alias("media_key"), F.lit("").alias("page_url"), F.col("page_id").alias("pos"))
    stored = p.join(A.table(spark, d, "documents").where("lang = 'fr'").select(F.col("doc_id").alias("page_id")), "page_id", "left_semi")
    return I.frontier_dedup(found, stored).select("url", F.col("pos").alias("page_id"))


@query("SELECT source AS media_key, count(*) FILTER (WHERE lang = 'en') AS discovered, count(*) FILTER (WHERE lang = 'fr') AS skipped, count(*) FILTER (WHERE lang NOT IN ('en', 'fr')) AS fetch_fail FROM documents GROUP BY ROLLUP (source)")
def scrape_summary(spark, d):
    """Outcomes per outlet and in all."""
    outcome = F.when(F.col("lang") == "en", "discovered").when(F.col("lang") == "fr", "skipped").otherwise("fetch_fail")
    return I.scrape_summary(A.table(spark, d, "documents").select(F.col("source").alias("media_key"), outcome.alias("outcome")))


# ---------------------------------------------------------------- vectors and linking

HASH_SQL = "(CASE WHEN h >= 2147483648 THEN abs(h - 4294967296) ELSE h END % 256)::INT"
BAG_SQL = rf"""t AS (SELECT doc_id AS article_id, unnest({LETTERS_SQL}) AS token FROM (SELECT doc_id, string_split(text, chr(10))[1] || ' ' || text AS text FROM documents)),
w AS (SELECT DISTINCT token FROM t),
hw AS (SELECT token, list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(token, ''), lambda c: unicode(c)::HUGEINT)), lambda a, b: (a * 31 + b) % 4294967296) AS h FROM w),
v AS (SELECT article_id, {HASH_SQL} AS slot, count(*)::DOUBLE AS n FROM t JOIN hw USING (token) GROUP BY 1, 2)"""


@query(f"WITH {BAG_SQL} SELECT article_id, slot, round(n / sqrt(sum(n * n) OVER (PARTITION BY article_id)), 6) AS value FROM v")
def hash_embedding(spark, d):
    """Hashed word vectors of every document as sparse rows."""
    return V.hash_embedding_rows(A.document_articles(spark, d)).select("article_id", "slot", *r6("value"))


@query("SELECT doc_id AS article_id, sha256(string_split(text, chr(10))[1] || ' ' || text) AS embedding_hash FROM documents")
def embedding_hash(spark, d):
    a = A.document_articles(spark, d)
    return a.select("article_id", V.embedding_hash(V.text_for_embedding(F.col("title"), F.col("snippet"))).alias("embedding_hash"))


CENTROID_SQL = "c AS (SELECT label AS event_id, pos, avg(v::DOUBLE) AS v FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2)"


@query(f"WITH {CENTROID_SQL} SELECT event_id, pos::INT AS pos, round(v, 6) AS v FROM c")
def centroid(spark, d):
    """Mean vector of every label, one row per component."""
    vectors, _ = A.vector_events(spark, d)
    return V.centroid(vectors).select("event_id", F.posexplode("centroid").alias("pos", "v")).select("event_id", (F.col("pos") + 1).alias("pos"), F.round("v", 6).alias("v"))


@query(f"""WITH {CENTROID_SQL}, cn AS (SELECT event_id, list(v ORDER BY pos) AS cv FROM c GROUP BY 1),
s AS (SELECT vec_id AS article_id, event_id, list_cosine_similarity(embedding::DOUBLE[], cv) AS score FROM embeddings, cn),
b AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY round(score, 9) DESC, event_id) AS rn FROM s)
SELECT article_id, CASE WHEN score >= 0.2 THEN 'LINK' ELSE 'CREATE' END AS action, CASE WHEN score >= 0.2 THEN event_id END AS event_id, round(score, 6) AS score FROM b WHERE rn = 1""")
def link_v1(spark, d):
    """Nearest centroid of every vector; the events are the ten labels, a stated query set."""
    vectors, _ = A.vector_events(spark, d)
    features = V.centroid(vectors).select("event_id", "centroid", F.array().cast("array<string>").alias("entities"))
    articles = vectors.select("article_id", "embedding_vec", F.lit("").alias("title"), F.lit("").alias("snippet"))
    return K.link_v1(articles, features, least=0.2).select("article_id", "action", "event_id", *r6("score"))


@query(f"""WITH {CENTROID_SQL}, cn AS (SELECT event_id, list(v ORDER BY pos) AS cv FROM c GROUP BY 1),
m AS (SELECT label AS event_id, count(*) AS n, CASE WHEN label % 2 = 0 THEN 2 ELSE 1 END AS um, TIMESTAMP '2024-01-01' + INTERVAL (label) DAY AS t0 FROM embeddings GROUP BY label),
s AS (SELECT vec_id AS article_id, cn.event_id, um, 0.55 * list_cosine_similarity(embedding::DOUBLE[], cv) + 0.20 * exp(-0.693 * abs(epoch_ms(TIMESTAMP '2024-01-01' + INTERVAL (vec_id % 20) DAY) - epoch_ms(t0)) / 259200000.0) AS score FROM embeddings, cn JOIN m ON m.event_id = cn.event_id),
b AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY round(score, 9) DESC, event_id) AS rn FROM s),
k AS (SELECT article_id, event_id, score, CASE WHEN score >= 0.3 THEN 'auto' WHEN score >= 0.25 AND um >= 2 THEN 'two_media' END AS basis FROM b WHERE rn = 1)
SELECT article_id, CASE WHEN basis IS NULL THEN 'CREATE' ELSE 'LINK' END AS action, CASE WHEN basis IS NOT NULL THEN event_id END AS event_id, CASE WHEN basis IS NOT NULL THEN round(score, 6) END AS score, basis FROM k""")
def decide_link(spark, d):
    """Scores and decisions of every vector against the label events."""
    vectors, _ = A.vector_events(spark, d)
    day = F.lit("2024-01-01").cast("timestamp")
    at = lambda n: F.timestamp_millis(F.unix_millis(day) + n * 86_400_000)
    features = V.centroid(vectors).select("event_id", "centroid", F.array().cast("array<string>").alias("entities"), F.when(F.col("event_id") % 2 == 0, 2).otherwise(1).alias("unique_media"), at(F.col("event_id")).alias("t0"), at(F.col("event_id")).alias("t_last"))
    articles = vectors.select("article_id", "embedding_vec", F.lit("").alias("title"), F.lit("").alias("snippet"), at(F.col("article_id") % 20).alias("published_at"))
    scored = K.score_candidates(articles, features, at(F.lit(7)), days=30, least=0.25)
    return K.decide_link(articles, scored, link=0.3, maybe_link=0.25).select("article_id", "action", "event_id", *r6("score"), "basis")


@query("""WITH e AS (SELECT label AS event_id, count(*) AS n, TIMESTAMP '2024-01-01' + INTERVAL (label) DAY AS t0 FROM embeddings GROUP BY label),
c AS (SELECT label AS event_id, pos, avg(v::DOUBLE) AS v FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2),
cn AS (SELECT event_id, list(v ORDER BY pos) AS cv FROM c GROUP BY 1),
s AS (SELECT vec_id, label, cn.event_id AS candidate_id, n, t0, list_cosine_similarity(embedding::DOUBLE[], cv) AS score FROM embeddings, cn JOIN e ON e.event_id = cn.event_id),
f AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY t0, candidate_id) AS rn FROM s WHERE score >= 0.2)
SELECT vec_id AS event_id, candidate_id, round(score, 6) AS score, candidate_id AS canonical_id, vec_id AS merged_id FROM f WHERE rn = 1""")
def merge_check(spark, d):
    """Every vector as a new event of one article against the label events, without the size limit."""
    vectors, _ = A.vector_events(spark, d)
    day = F.lit("2024-01-01").cast("timestamp")
    at = lambda n: F.timestamp_millis(F.unix_millis(day) + n * 86_400_000)
    new = vectors.select((-F.col("article_id") - 1).alias("event_id"), F.col("embedding_vec").alias("centroid"), F.lit(1).alias("article_count"), at(F.lit(100)).alias("t0"))
    old = V.centroid(vectors).select(F.col("event_id").cast("long").alias("event_id"), "centroid", (F.col("n") + 1).alias("article_count"), at(F.col("event_id")).alias("t0"))
    back = lambda c: F.when(F.col(c) < 0, -F.col(c) - 1).otherwise(F.col(c)).alias(c)
    return K.merge_check(new, old, capped=False, least=0.2).select(back("event_id"), F.col("candidate_id").cast("int").alias("candidate_id"), *r6("score"), F.col("canonical_id").cast("int").alias("canonical_id"), back("merged_id"))


ENTITY_SQL = r"'[A-ZÁÉÍÓÚÑÜ][a-záéíóúñü]+(?:\s+(?:(?:de|del|la|el|los|las|y|en)\s+)*[A-ZÁÉÍÓÚÑÜ][a-záéíóúñü]+)*'"


@query(rf"""WITH x AS (SELECT doc_id AS article_id, list_distinct(list_concat(list_transform(regexp_extract_all(text, {ENTITY_SQL}), lambda e: trim(lower(e))), list_transform(regexp_extract_all(text, '"([^"]{{3,50}})"', 1), lambda e: trim(lower(e))))) AS e FROM documents)
SELECT article_id, len(e)::INT AS n_entities, sha256(array_to_string(list_sort(e), '|')) AS entities FROM x""")
def extract_entities(spark, d):
    """Number and digest of the entities of every document."""
    a = A.document_articles(spark, d).select("article_id", X.extract_entities(F.col("snippet")).alias("e"))
    return a.select("article_id", F.size("e").alias("n_entities"), F.sha2(F.array_join(F.array_sort("e"), "|"), 256).alias("entities"))


@query("SELECT o_orderkey AS event_id, round(exp(-0.693 * CASE WHEN l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY THEN 0 WHEN l_shipdate < o_orderdate THEN epoch_ms(o_orderdate) - epoch_ms(l_shipdate) ELSE epoch_ms(l_shipdate) - epoch_ms(o_orderdate) - 2592000000 END / 7776000000.0), 6) AS temporal, l_linenumber AS line FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def temporal_proximity(spark, d):
    """Nearness of every line item to its order's first thirty days."""
    o, li = A.table(spark, d, "orders"), A.table(spark, d, "lineitem")
    at = A.ts("o_orderdate")
    p = K.temporal_proximity(A.ts("l_shipdate"), at, F.timestamp_millis(F.unix_millis(at) + 30 * 86_400_000), 90)
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("event_id"), F.round(p, 6).alias("temporal"), F.col("l_linenumber").alias("line"))


# ---------------------------------------------------------------- lifecycle and versions


@query(f"""SELECT o_orderkey AS event_id, CASE WHEN {NOW_MS} - epoch_ms(o_orderdate) >= 604800000 AND o_orderstatus <> 'F' THEN 'CLOSED' WHEN o_orderstatus = 'F' THEN 'CLOSED' WHEN o_orderstatus = 'P' THEN 'PENDING_PUBLISH' ELSE 'PUBLISHED' END AS state,
CASE WHEN {NOW_MS} - epoch_ms(o_orderdate) >= 604800000 AND o_orderstatus <> 'F' THEN 'INACTIVITY_7D' END AS close_reason FROM orders""")
def close_stale(spark, d):
    """Orders without news for a week close; fulfilled ones are closed already."""
    o = A.table(spark, d, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "CLOSED").when(F.col("o_orderstatus") == "P", "PENDING_PUBLISH").otherwise("PUBLISHED")
    events = o.select(F.col("o_orderkey").alias("event_id"), state.alias("state"), A.ts("o_orderdate").alias("t_last"), F.lit(None).cast("timestamp").alias("closed_at"))
    return Y.close_stale(events, A.now()).select("event_id", "state", "close_reason")


@query(f"""SELECT o_orderkey AS event_id, CASE WHEN o_orderstatus = 'F' THEN 'CLOSED' WHEN epoch_ms(o_orderdate) + 300000 <= {NOW_MS} THEN 'PUBLISHED' ELSE 'PENDING_PUBLISH' END AS state, CASE WHEN o_orderstatus <> 'F' AND epoch_ms(o_orderdate) + 300000 <= {NOW_MS} THEN {NOW_MS} END AS published_ms FROM orders""")
def publish_due(spark, d):
    """Scheduled at the order date and five minutes, then published where due."""
    o = A.table(spark, d, "orders")
    events = o.select(F.col("o_orderkey").alias("event_id"), F.when(F.col("o_orderstatus") == "F", "CLOSED").otherwise("DETECTED").alias("state"), F.lit(None).cast("timestamp").alias("publish_at"), F.lit(None).cast("timestamp").alias("published_at"), A.ts("o_orderdate").alias("at"))
    out = Y.publish_due(Y.schedule_publish(events, F.col("at")), A.now())
    return out.select("event_id", "state", F.unix_millis("published_at").alias("published_ms"))


@query("SELECT DISTINCT 'refresh:' || o_custkey || ':2001-08-01T00:30:00.000Z' AS job_key, o_custkey AS event_id FROM orders WHERE o_orderstatus = 'O'")
def refresh_slots(spark, d):
    """One refresh job per active customer at the next half hour."""
    events = S.active_events(A.table(spark, d, "orders").select(F.col("o_custkey").alias("event_id"), F.when(F.col("o_orderstatus") == "O", "PUBLISHED").otherwise("CLOSED").alias("state")))
    slots = Y.refresh_slots(events, F.lit("2001-08-01 00:00:01").cast("timestamp"))
    return slots.select(F.concat(F.substring_index("job_key", ":", 2), F.lit(":2001-08-01T00:30:00.000Z")).alias("job_key"), "event_id")


@query("SELECT o_orderkey AS event_id, coalesce(max(turn) + 1, 0)::INT AS version_index FROM orders LEFT JOIN conversations ON conv_id = o_orderkey GROUP BY 1")
def next_version(spark, d):
    events = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"))
    return Y.next_version(events, A.turn_versions(spark, d))


@query("""WITH v AS (SELECT conv_id AS event_id, turn, list(DISTINCT role) OVER (PARTITION BY conv_id ORDER BY turn) AS cur, list(DISTINCT role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM conversations)
SELECT event_id, turn::INT AS version_index, coalesce(array_to_string(list_sort(list_filter(cur, lambda x: NOT coalesce(list_contains(prev, x), false))), ','), '') AS added FROM v""")
def version_diff(spark, d):
    """Roles that are new in each turn's version of a conversation."""
    v = A.turn_versions(spark, d)
    w = Window.partitionBy("event_id").orderBy("version_index")
    cur = F.collect_set("role").over(w)
    prev = F.coalesce(F.collect_set("role").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.array().cast("array<string>"))
    return v.select("event_id", "version_index", F.array_join(F.array_sort(F.array_except(cur, prev)), ",").alias("added"))


@query("SELECT l_orderkey AS event_id, count(*) AS article_count FROM lineitem GROUP BY 1")
def count_articles_for_event(spark, d):
    return S.count_articles_for_event(A.item_articles(spark, d))


@query("SELECT DISTINCT o_orderkey AS event_id FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate >= TIMESTAMP '2001-07-25'")
def candidate_events(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.when(F.col("o_orderstatus") == "F", "CLOSED").otherwise("PUBLISHED").alias("state"), A.ts("o_orderdate").alias("t_last"))
    return S.candidate_events(o, F.lit("2001-07-25").cast("timestamp")).select("event_id").distinct()


# ---------------------------------------------------------------- claims and overview

NORM_SQL = r"regexp_replace(regexp_replace(regexp_replace(lower({0}), '^\s+|\s+$', '', 'g'), '[^\p{{L}}\p{{N}}\s]', '', 'g'), '\s+', ' ', 'g')"
SENTENCE_SQL = rf"""src AS (SELECT doc_id AS article_id, doc_id // 8 AS event_id, source AS media_id, string_split(text, chr(10))[1] || '. ' || text AS source FROM documents),
sp AS (SELECT *, string_split_regex(regexp_replace(regexp_replace(source, '(?i)({L.ABBREVIATIONS})\.', '\1' || chr(57344), 'g'), '([.;:])\s+', '\1' || chr(57345), 'g'), chr(57345)) AS parts FROM src),
ex AS (SELECT article_id, event_id, media_id, source, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM sp),
se AS (SELECT * EXCLUDE (p), regexp_replace(replace(p, chr(57344), '.'), '^\s+|\s+$', '', 'g') AS sentence FROM ex),
nm AS (SELECT *, {NORM_SQL.format('sentence')} AS norm FROM se WHERE length(sentence) >= 40),
cs AS (SELECT *, row_number() OVER (PARTITION BY event_id, article_id, norm ORDER BY i) AS rn FROM nm QUALIFY rn = 1)"""
TYPE_SQL = f"CASE WHEN regexp_matches(sentence, '[0-9]') THEN 'QUANT' WHEN regexp_matches(lower(sentence), '{L.ALLEGATION}') THEN 'ALLEGATION' WHEN regexp_matches(lower(sentence), '{L.FORECAST}') THEN 'FORECAST' WHEN regexp_matches(lower(sentence), '{L.OPINION}') THEN 'OPINION' ELSE 'FACT' END"
STRENGTH_SQL = f"CASE WHEN media >= 2 OR regexp_matches(q, '[0-9]') OR regexp_matches(lower(q), '{L.ATTRIBUTED}') THEN 'STRONG' WHEN regexp_matches(lower(q), '{L.HEDGED}') THEN 'WEAK' WHEN length(q) >= 80 THEN 'MEDIUM' ELSE 'WEAK' END"
CLAIM_SQL = rf"""{SENTENCE_SQL},
k AS (SELECT *, {TYPE_SQL} AS kind, substring(sentence, 1, 240) AS q FROM cs),
cm AS (SELECT event_id, norm, arg_min(kind, (article_id, i)) AS claim_type, min((article_id, i)) AS ord, count(DISTINCT media_id) AS media, count(*) AS quotes FROM k GROUP BY 1, 2),
qs AS (SELECT k.event_id, k.norm, k.article_id, k.media_id, k.i, k.source, k.sentence, cm.media, q, {STRENGTH_SQL} AS strength FROM k JOIN cm USING (event_id, norm)),
st AS (SELECT event_id, norm, count(*) FILTER (WHERE strength = 'STRONG') AS strong, count(*) FILTER (WHERE strength = 'MEDIUM') AS medium, count(DISTINCT media_id) FILTER (WHERE strength = 'MEDIUM') AS mm FROM qs GROUP BY 1, 2),
tk AS (SELECT event_id, norm, unnest(list_filter(string_split(norm, ' '), lambda x: length(x) > 3)) AS token, generate_subscripts(list_filter(string_split(norm, ' '), lambda x: length(x) > 3), 1) AS pos FROM cm),
tf AS (SELECT event_id, norm, token, count(*) AS freq, min(pos) AS pos, regexp_matches(token, '^(0|[1-9][0-9]{{0,8}}|[1-3][0-9]{{9}})$') AS num FROM tk GROUP BY 1, 2, 3),
tt AS (SELECT *, row_number() OVER (PARTITION BY event_id, norm ORDER BY freq DESC, num DESC, CASE WHEN num THEN token::BIGINT END NULLS FIRST, pos) AS rank FROM tf QUALIFY rank <= 5),
ft AS (SELECT event_id, norm, list_sort(list_distinct(regexp_extract_all(norm, '[0-9]+(?:[.,][0-9]+)?'))) AS nums, regexp_matches(norm, '\bno\b') AS neg FROM cm),
tr AS (SELECT tt.event_id, tt.norm, token, nums, neg FROM tt JOIN ft USING (event_id, norm)),
pr AS (SELECT a.event_id, a.norm AS x, b.norm AS y, (len(a.nums) > 0 AND len(b.nums) > 0 AND a.nums <> b.nums) AS numbers, a.neg <> b.neg AS negation, count(*) AS n FROM tr a JOIN tr b ON a.event_id = b.event_id AND a.token = b.token AND a.norm < b.norm GROUP BY 1, 2, 3, 4, 5),
bad AS (SELECT DISTINCT event_id, unnest([x, y]) AS norm FROM pr WHERE (numbers AND n >= 2) OR (negation AND n >= 3)),
fin AS (SELECT cm.*, CASE WHEN bad.norm IS NOT NULL THEN 'DISPUTED' WHEN strong > 0 OR (medium >= 2 AND mm >= 2) THEN 'SUPPORTED' ELSE 'INSUFFICIENT' END AS status FROM cm JOIN st USING (event_id, norm) LEFT JOIN bad USING (event_id, norm))"""


@query(f"WITH {CLAIM_SQL} SELECT event_id, norm AS claim_text, claim_type, media::BIGINT AS media_count, quotes::INT AS n_quotes, status FROM fin")
def build_claims(spark, d):
    """Claims of every event of eight documents, with type, support and status."""
    c = C.build_claims(A.document_articles(spark, d))
    return c.select("event_id", "claim_text", "claim_type", "media_count", F.size("quotes").alias("n_quotes"), "status")


@query(f"WITH {CLAIM_SQL} SELECT event_id, norm AS claim_text FROM bad")
def detect_contradictions(spark, d):
    return C.with_contradictions(C.extract_claims(A.document_articles(spark, d))).where("contradicted").select("event_id", "claim_text")


@query(f"WITH {CLAIM_SQL} SELECT event_id, article_id, norm AS claim_text, strength, (nullif(position(sentence IN source), 0) - 1)::INT AS span_start, (nullif(position(sentence IN source), 0) - 1 + least(length(sentence), 240))::INT AS span_end FROM qs")
def claim_quotes(spark, d):
    """Every quote with its strength and span."""
    c = C.extract_claims(A.document_articles(spark, d)).select("event_id", "claim_text", F.explode("quotes").alias("q"))
    return c.select("event_id", "q.article_id", "claim_text", "q.strength", F.col("q.span_start").cast("int").alias("span_start"), F.col("q.span_end").cast("int").alias("span_end"))


@query(f"WITH {CLAIM_SQL} SELECT event_id, norm AS claim_text, token, freq, rank FROM tt")
def top_tokens(spark, d):
    claims = C.extract_claims(A.document_articles(spark, d))
    return C.top_tokens(claims.withColumn("text", F.col("claim_text")), keys=("event_id", "text")).select("event_id", F.col("text").alias("claim_text"), "token", "freq", F.col("rank").cast("long").alias("rank"))


OVERVIEW_SQL = f"""{CLAIM_SQL},
fl AS (SELECT event_id, count(*) AS claims_count, sum(quotes) AS quotes_count, count(*) FILTER (WHERE status = 'SUPPORTED') AS supported_count, count(*) FILTER (WHERE status = 'DISPUTED') AS disputed_count,
 count(*) FILTER (WHERE status = 'SUPPORTED' AND claim_type IN ('FACT', 'QUANT')) AS a, count(*) FILTER (WHERE status = 'SUPPORTED' AND claim_type NOT IN ('FACT', 'QUANT')) AS b, count(*) FILTER (WHERE status = 'INSUFFICIENT') AS c FROM fin GROUP BY 1)"""


@query(f"WITH {OVERVIEW_SQL} SELECT event_id, CASE WHEN supported_count >= 2 THEN 'PASS' ELSE 'FAIL' END AS gate_status, claims_count, quotes_count::BIGINT AS quotes_count, round(supported_count / claims_count, 6) AS evidence_rate, supported_count, disputed_count, CASE WHEN supported_count >= 2 THEN a ELSE 0 END::INT AS que_paso, CASE WHEN supported_count >= 2 THEN b ELSE 0 END::INT AS contexto, disputed_count::INT AS en_disputa, c::INT AS que_falta FROM fl")
def overview_sections(spark, d):
    """Gate, quality flags and bullets per section of every event."""
    o = O.overview_sections(C.build_claims(A.document_articles(spark, d)))
    size = lambda k: F.size(F.get("sections", F.lit([x for x, _ in L.SECTIONS].index(k)))["bullets"]).alias(k)
    return o.select("event_id", "gate_status", "claims_count", "quotes_count", *r6("evidence_rate"), "supported_count", "disputed_count", *[size(k) for k, _ in L.SECTIONS])


@query(f"WITH {CLAIM_SQL} SELECT event_id, count(DISTINCT media_id) AS sources, count(*) AS quotes, array_to_string(list_filter([CASE WHEN count(DISTINCT media_id) < 2 THEN 'SINGLE_SOURCE' END, CASE WHEN count(*) < 2 THEN 'MISSING_QUOTES' END], lambda x: x IS NOT NULL), ',') AS reasons FROM qs GROUP BY 1")
def evidence_gate(spark, d):
    e = O.evidence_counts(C.extract_claims(A.document_articles(spark, d)))
    return e.select("event_id", "sources", "quotes", F.array_join("reasons", ",").alias("reasons"))


@query(r"""WITH j AS (SELECT conv_id, trim(regexp_replace(string_agg(trim(text), ' ' ORDER BY turn, text), '\s+', ' ', 'g')) AS s FROM conversations WHERE trim(text) <> '' GROUP BY 1),
c AS (SELECT *, substring(s, 1, 139) AS cut FROM j), l AS (SELECT *, CASE WHEN contains(cut, ' ') THEN length(cut) - position(' ' IN reverse(cut)) ELSE 0 END AS last FROM c)
SELECT conv_id AS event_id, CASE WHEN length(s) <= 140 THEN s ELSE rtrim(substring(s, 1, CASE WHEN last > 70 THEN last ELSE 139 END)) || '…' END AS teaser FROM l""")
def derive_teaser(spark, d):
    """Teaser of every conversation's turns."""
    c = A.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return c.select(F.col("conv_id").alias("event_id"), X.derive_teaser(F.transform("t", lambda x: x["text"])).alias("teaser"))


@query("SELECT doc_id // 8 AS event_id, substring(sha256('claims:v2.0:' || string_agg(doc_id || ':', '|' ORDER BY doc_id || ':')), 1, 16) AS claims_hash FROM documents GROUP BY 1")
def claims_hash(spark, d):
    a = A.document_articles(spark, d).withColumn("created_at", F.lit(None).cast("timestamp"))
    return C.version_claims_hash(a).select("event_id", "claims_hash")


# ---------------------------------------------------------------- topics

KEYWORD_SQL = "lex(topic_key, ord, keyword) AS (VALUES " + ", ".join(f"('{t}', {i}, '{k}')" for i, (t, ks) in enumerate(L.TOPIC_KEYWORDS.items()) for k in ks) + ")"
TOPIC_SQL = rf"""{KEYWORD_SQL},
tw AS (SELECT doc_id AS article_id, token, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '\s+')) AS token FROM documents) GROUP BY 1, 2),
tot AS (SELECT article_id, sum(n) AS total FROM tw GROUP BY 1),
sc AS (SELECT tw.article_id, topic_key, ord, sum(n) / any_value(total) AS weight FROM tw JOIN lex ON contains(token, keyword) JOIN tot ON tot.article_id = tw.article_id GROUP BY 1, 2, 3)"""


@query(f"WITH {TOPIC_SQL} SELECT article_id, topic_key, round(weight, 6) AS weight FROM sc")
def score_topics(spark, d):
    """Topic weights of every document."""
    docs = A.document_articles(spark, d).select("article_id", F.col("snippet").alias("text"))
    return P.score_topics(docs, P.topic_lexicon(spark)).select("article_id", "topic_key", *r6("weight"))


@query(f"WITH {TOPIC_SQL}, tp AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY weight DESC, ord) AS rank FROM sc WHERE weight >= 0.005 QUALIFY rank <= 2) SELECT doc_id AS article_id, coalesce(topic_key, 'OTROS') AS topic_key, round(coalesce(weight, 1.0), 6) AS weight FROM documents LEFT JOIN tp ON article_id = doc_id")
def top_topics_per_article(spark, d):
    """The two best topics of every document, from a weight of 0.005 on."""
    docs = A.document_articles(spark, d).select("article_id", F.col("snippet").alias("text"))
    return P.top_topics_per_article(docs, P.score_topics(docs, P.topic_lexicon(spark)), least=0.005).select("article_id", "topic_key", *r6("weight"))


HEAT_SQL = f"""t0 AS (SELECT l_suppkey AS event_id, min(l_shipdate) AS t0 FROM lineitem GROUP BY 1),
cells AS (SELECT l_suppkey AS event_id, (epoch_ms(l_shipdate) - epoch_ms(t0)) // {WINDOW_MS} AS bin_index, l_returnflag AS topic_key, sum(l_quantity) AS w FROM lineitem JOIN t0 ON event_id = l_suppkey GROUP BY 1, 2, 3),
heat AS (SELECT event_id, bin_index::INT AS bin_index, topic_key, round(w / sum(w) OVER (PARTITION BY event_id, bin_index), 3) AS share FROM cells WHERE bin_index < 28)"""


@query(f"WITH {HEAT_SQL} SELECT * FROM heat")
def topic_heatmap(spark, d):
    """Topic shares of every supplier's 90-day bins."""
    return P.heatmap_rows(A.item_topics(spark, d), A.WINDOW_HOURS)


@query(f"""WITH {HEAT_SQL}, dom AS (SELECT event_id, bin_index, max((share, topic_key)) AS m FROM heat GROUP BY 1, 2), dm AS (SELECT event_id, bin_index, m[2] AS topic FROM dom),
i AS (SELECT event_id, arg_min(topic, bin_index) AS initial FROM dm GROUP BY 1),
g AS (SELECT dm.event_id, topic, bin_index, bin_index - row_number() OVER (PARTITION BY dm.event_id, topic ORDER BY bin_index) AS island FROM dm JOIN i ON i.event_id = dm.event_id WHERE topic <> initial),
r AS (SELECT event_id, topic, island, min(bin_index) AS start_bin FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 3)
SELECT event_id, arg_min(topic, (start_bin, topic)) AS drift_topic, min(start_bin) AS start_bin FROM r GROUP BY 1""")
def topic_drift(spark, d):
    """Suppliers whose leading topic changes for three bins in a row."""
    return P.topic_drift(P.heatmap_rows(A.item_topics(spark, d), A.WINDOW_HOURS))


@query("SELECT event_id, topic_key, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY weight DESC, topic_key) AS rank FROM (SELECT l_suppkey AS event_id, l_returnflag AS topic_key, round(sum(l_quantity), 3) AS weight FROM lineitem GROUP BY 1, 2)) WHERE rank <= 5")
def event_top_topics(spark, d):
    return P.event_top_topics(A.item_topics(spark, d)).select("event_id", "topic_key", "weight", F.col("rank").cast("long").alias("rank"))


@query(rf"""WITH {KEYWORD_SQL}, tk AS (SELECT conv_id AS event_id, turn AS ord, list_filter(string_split_regex(lower(text), '\s+'), lambda x: length(x) > 3) AS t FROM conversations),
gr AS (SELECT event_id, ord, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS gram, unnest(range(1, len(t))) AS pos FROM tk WHERE len(t) > 1),
ct AS (SELECT event_id, gram, count(*) AS n, min((ord, pos)) AS first FROM gr GROUP BY 1, 2 HAVING count(*) >= 2),
fr AS (SELECT * FROM ct WHERE split_part(gram, ' ', 1) NOT IN (SELECT keyword FROM lex) AND split_part(gram, ' ', 2) NOT IN (SELECT keyword FROM lex)),
rk AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, first) AS rank FROM fr)
SELECT event_id, rank, 'EMERG_' || substring(upper(replace(gram, ' ', '_')), 1, 30) AS topic_key FROM rk WHERE rank <= 3 AND event_id IN (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) >= 2)""")
def emergent_topics(spark, d):
    """Repeated word pairs of every conversation, twice at least."""
    c = A.table(spark, d, "conversations").select(F.col("conv_id").alias("event_id"), F.lit(0).alias("version_id"), F.col("turn").alias("ord"), F.col("text").alias("claim_text"))
    counts = c.groupBy("event_id", "version_id").agg(F.count("*").alias("article_count"))
    return P.emergent_topics(c, counts, P.topic_lexicon(spark), least=2).select("event_id", F.col("rank").cast("long").alias("rank"), "topic_key")


DIVERGENCE_SQL = f"""WITH RECURSIVE {CLAIM_SQL},
dc AS (SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY ord, norm) AS i, list_filter(string_split(norm, ' '), lambda x: length(x) > 3) AS tokens FROM cm),
r(event_id, i, clusters) AS (
SELECT DISTINCT event_id, 0::BIGINT, []::STRUCT(n INT, s VARCHAR[])[] FROM dc
UNION ALL
SELECT event_id, i, CASE WHEN pos IS NULL OR pos = 0 THEN list_append(clusters, {{'n': 1, 's': tokens}}) ELSE list_transform(clusters, lambda c, k: CASE WHEN k = pos THEN {{'n': c.n + 1, 's': list_filter(tokens, lambda t: list_contains(c.s, t))}} ELSE c END) END
FROM (SELECT r.event_id, dc.i, clusters, tokens, list_position(list_transform(clusters, lambda c: len(list_filter(tokens, lambda t: list_contains(c.s, t))) >= 2), true) AS pos FROM r JOIN dc ON dc.event_id = r.event_id AND dc.i = r.i + 1)),
w AS (SELECT event_id, list_filter(clusters, lambda c: c.n >= {L.DIVERGENCE_MIN})[1] AS c FROM r QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY i DESC) = 1)
SELECT event_id, 'RAMA: ' || array_to_string(c.s[1:3], ' ') AS label, c.n AS n_claims FROM w WHERE c IS NOT NULL"""


@query(DIVERGENCE_SQL)
def claim_divergence(spark, d):
    """First cluster of alike claims of every event, by a fold in order; the SQL takes one claim of every event a step."""
    claims = C.extract_claims(A.document_articles(spark, d)).withColumn("status", F.lit("SUPPORTED"))
    return P.claim_divergence(claims).select("event_id", "label", F.size("claim_ids").alias("n_claims"))


# ---------------------------------------------------------------- bias


def feature_sql(c: str) -> str:
    return ", ".join(rf"len(regexp_extract_all({c}, '\b(?:{'|'.join(ws)})\b')) / total AS {k}" for k, ws in L.BIAS_WORDS.items())


BIAS_SQL = rf"""lo AS (SELECT doc_id AS article_id, doc_id // 8 AS event_id, source AS media_id, strip_accents(lower(string_split(text, chr(10))[1] || '. ' || text)) AS low FROM documents),
tl AS (SELECT *, len(string_split_regex(low, '\s+')) AS total FROM lo), f AS (SELECT article_id, event_id, media_id, {feature_sql('low')} FROM tl)"""


def softmax_sql(source: str, weights: dict[str, list[float]], features: list[str], keys: str) -> str:
    terms = {"bias": "(pro_gov - anti_gov)"}
    rows = " UNION ALL ".join(f"SELECT {keys}, '{n}' AS label, {i} AS ord, " + " + ".join(f"({w} * {terms.get(k, k)})" for w, k in zip(ws, features, strict=True)) + f" AS s FROM {source}" for i, (n, ws) in enumerate(weights.items()))
    return f"SELECT {keys}, label, conf FROM (SELECT *, round(exp(s - max(s) OVER (PARTITION BY {keys})) / sum(exp(s)) OVER (PARTITION BY {keys}) * exp(max(s) OVER (PARTITION BY {keys})), 12) AS conf FROM ({rows})) QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY conf DESC, ord) = 1"


PRIMARY_SQL = softmax_sql("f", L.PRIMARY_WEIGHTS, L.PRIMARY_FEATURES, "article_id")
SECONDARY_SQL = softmax_sql("f", L.SECONDARY_WEIGHTS, L.SECONDARY_FEATURES, "article_id")


@query(f"WITH {BIAS_SQL} SELECT article_id, " + ", ".join(f"round({k}, 6) AS {k}" for k in L.BIAS_WORDS) + " FROM f")
def bias_features(spark, d):
    """Lexicon rates of every document."""
    return B.bias_article_level(A.document_articles(spark, d)).select("article_id", *r6(*B.FEATURES))


@query(f"WITH {BIAS_SQL}, p AS ({PRIMARY_SQL}), q AS ({SECONDARY_SQL}) SELECT article_id, CASE WHEN p.conf < 0.1 THEN 'NO_CONCLUYENTE' ELSE p.label END AS label_primary, q.label AS label_secondary, round(p.conf, 6) AS confidence, round(least(1.0, greatest(0.0, (emotional + critical + negation + institutional + technical + attribution) * 5)), 6) AS intensity FROM f JOIN p USING (article_id) JOIN q USING (article_id)")
def bias_labels(spark, d):
    """Primary and secondary label of every document, with low thresholds so that labels show."""
    rows = B.bias_article_level(A.document_articles(spark, d))
    f = {k: F.col(k) for k in B.FEATURES}
    out = rows.select("article_id", B.bias_primary(f, 0.1).alias("p"), B.bias_secondary(f, 0.0).alias("s"), F.round("intensity", 6).alias("intensity"))
    return out.select("article_id", F.col("p.label").alias("label_primary"), F.col("s.label").alias("label_secondary"), F.round("p.confidence", 6).alias("confidence"), "intensity")


@query(f"WITH {BIAS_SQL} SELECT event_id, media_id, count(*) AS articles, " + ", ".join(f"round(0.7 * {0.01 * (i + 1)} + 0.3 * avg({k}), 6) AS {k}" for i, k in enumerate(L.BIAS_WORDS)) + " FROM f GROUP BY 1, 2")
def bias_media_level(spark, d):
    """Blended features of every event and outlet, with one history for all."""
    rows = B.bias_article_level(A.document_articles(spark, d))
    history = F.create_map(*[x for i, k in enumerate(B.FEATURES) for x in (F.lit(k), F.lit(0.01 * (i + 1)))])
    profiles = A.source_media(spark, d).select("media_id", history.alias("avg_features"))
    return B.bias_media_level(rows, profiles).select("event_id", "media_id", "articles", *r6(*B.FEATURES))


@query(f"WITH {BIAS_SQL}, m AS (SELECT event_id, media_id, count(*) AS n, avg(negation) AS negation FROM f GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY event_id DESC) - 1 AS back, count(*) OVER (PARTITION BY media_id) AS c FROM m) SELECT media_id, sum(n)::BIGINT AS articles_processed, round(sum(pow(0.7, back) * CASE WHEN back = c - 1 THEN 1 ELSE 0.3 END * negation), 6) AS negation FROM b GROUP BY 1")
def media_profile_update(spark, d):
    """Running profile of every outlet after all events."""
    rows = B.bias_article_level(A.document_articles(spark, d))
    means = rows.groupBy("event_id", "media_id").agg(*[F.avg(k).alias(k) for k in B.FEATURES], F.count("*").alias("articles"))
    none = A.source_media(spark, d).where("1 = 0").select("media_id", F.lit(None).cast("map<string,double>").alias("avg_features"), F.lit(0).cast("long").alias("articles_processed"))
    return B.media_profile_update(means, none).select("media_id", "articles_processed", F.round(F.col("avg_features")["negation"], 6).alias("negation"))


# ---------------------------------------------------------------- event log


@query("SELECT 'log.' || event_type || '.total' AS metric, count(*) AS value FROM events GROUP BY 1")
def pipeline_counters(spark, d):
    """Messages per type."""
    log = A.log_events(spark, d)
    names = {n: f"log.{n}.total" for n in ("click", "view", "purchase", "error", "signup", "login", "logout", "scroll", "search")}
    return E.pipeline_counters(log, names)


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, value DESC) AS rn FROM events WHERE value IS NOT NULL), v AS (SELECT event_type, list_sort(list(value)) AS v FROM r WHERE rn <= 1000 GROUP BY 1) SELECT event_type AS metric, len(v)::INT AS count, v[floor(len(v) * 0.5)::INT + 1] AS p50, v[floor(len(v) * 0.95)::INT + 1] AS p95, v[floor(len(v) * 0.99)::INT + 1] AS p99 FROM v")
def histogram_summary(spark, d):
    """Percentiles of the last thousand values of each type (a sliding window of that length)."""
    log = A.log_events(spark, d).select(F.col("event_name").alias("metric"), "value", "ts")
    return E.histogram_summary(log)


@query("SELECT event_id::VARCHAR AS event_id, CASE WHEN event_type NOT IN ('click', 'view') THEN 'unknown event' WHEN event_type = 'click' AND json_extract_string(props, '$.k') IS NULL THEN 'k missing' WHEN event_type = 'view' THEN 'page missing,extra keys' ELSE '' END AS errors FROM events")
def validate_payload(spark, d):
    """Payloads of every message against two contracts."""
    terms = E.contract_table(spark, {"click": {"k": "integer"}, "view": {"page": "string"}})
    out = E.validate_payload(A.log_events(spark, d), terms)
    return out.select("event_id", F.array_join("payload_errors", ",").alias("errors"))


@query("WITH w AS (SELECT event_type, value, epoch_ms(ts) // 1800000 AS slot, unnest(range(0, 12)) AS k FROM events) SELECT event_type, (slot - k) * 1800 AS window_start, count(*) AS n FROM w GROUP BY 1, 2")
def sliding_counts(spark, d):
    """Messages per type in six-hour windows that slide by half an hour."""
    w = E.sliding_counts(A.log_events(spark, d))
    return w.select(F.col("event_name").alias("event_type"), "window_start", "n")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS last_us, count(*) AS n FROM s GROUP BY user_id, sid")
def user_sessions(spark, d):
    """Sessions of each user that end after six quiet hours."""
    s = A.log_events(spark, d).groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return s.select("user_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("last").alias("last_us"), "n")
