"""A query of its own for operators that the other queries apply only on the way, and for the inventory's own thresholds."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsengine.functions import lexicons as L
from newsengine.functions import text as X
from newsengine.operators import bias as B
from newsengine.operators import claims as C
from newsengine.operators import feed as D
from newsengine.operators import linking as K
from newsengine.operators import overview as O
from newsengine.operators import ranking as R
from newsengine.operators import topics as P
from newsengine.operators import vectors as V
from newsengine.plans import adapters as A
from newsengine.plans.queries import BIAS_SQL, CENTROID_SQL, CLAIM_SQL, OVERVIEW_SQL, PRIMARY_SQL, SCORED_SQL, SECONDARY_SQL, SENTENCE_SQL, STRENGTH_SQL, STRIP_SQL, TYPE_SQL, junk_sql, query, r6, scored_orders
from newsengine.sources import tables as S
from newsengine.sources.shared import shared_dir

# ---------------------------------------------------------------- ingestion


@query(rf"""WITH p AS (SELECT page_id, {STRIP_SQL.format("regexp_extract(html, '(?is)<p[^>]*class=\"[^\"]*lead[^\"]*\"[^>]*>(.*?)</p>', 1)")} AS lead, list_filter(list_transform(regexp_extract_all(html, '(?is)<p[^>]*>(.*?)</p>', 1), lambda x: {STRIP_SQL.format('x')}), lambda x: length(x) > 40) AS ps FROM pages)
SELECT page_id, CASE WHEN lead <> '' THEN lead ELSE coalesce(ps[1], '') END AS lead FROM p""")
def extract_lead_paragraph(spark, d):
    """Lead of every page, empty if there is none."""
    return A.table(spark, d, "pages").select("page_id", F.coalesce(X.extract_lead_paragraph(F.col("html")), F.lit("")).alias("lead"))


# ---------------------------------------------------------------- claims


def sentence_rows(spark, d):
    return C.claim_sentences(A.document_articles(spark, d))


@query(f"WITH {SENTENCE_SQL} SELECT article_id, {TYPE_SQL} AS kind, count(*) AS n FROM cs GROUP BY 1, 2")
def classify_claim(spark, d):
    """Kinds of the sentences of every document."""
    return sentence_rows(spark, d).groupBy("article_id", X.classify_claim(F.col("sentence")).alias("kind")).agg(F.count("*").alias("n"))


@query(f"WITH {SENTENCE_SQL}, k AS (SELECT *, {TYPE_SQL} AS kind FROM cs) SELECT article_id, CASE WHEN kind IN ('ALLEGATION', 'OPINION') THEN 'ATTRIBUTION' ELSE 'EVIDENCE' END AS role, count(*) AS n FROM k GROUP BY 1, 2")
def quote_role(spark, d):
    """Roles of the quotes of every document."""
    role = X.quote_role(X.classify_claim(F.col("sentence")))
    return sentence_rows(spark, d).groupBy("article_id", role.alias("role")).agg(F.count("*").alias("n"))


@query(f"WITH {SENTENCE_SQL}, qs AS (SELECT article_id, substring(sentence, 1, 240) AS q, 1 AS media FROM cs) SELECT article_id, {STRENGTH_SQL} AS strength, count(*) AS n FROM qs GROUP BY 1, 2")
def quote_strength(spark, d):
    """Strengths of the quotes of every document, as of a single outlet."""
    strength = X.quote_strength(F.substring("sentence", 1, L.MAX_QUOTE), F.lit(1))
    return sentence_rows(spark, d).groupBy("article_id", strength.alias("strength")).agg(F.count("*").alias("n"))


@query(f"WITH {SENTENCE_SQL} SELECT article_id, count(*) AS n, sum(position(sentence IN source) - 1)::BIGINT AS starts, sum(position(sentence IN source) - 1 + least(length(sentence), 240))::BIGINT AS ends FROM cs WHERE contains(source, sentence) GROUP BY 1")
def quote_span(spark, d):
    """Sums of where the sentences of every document begin and end."""
    s = sentence_rows(spark, d).select("article_id", F.col("span").alias("s")).where("s.span_start is not null")
    return s.groupBy("article_id").agg(F.count("*").alias("n"), F.sum(F.col("s.span_start").cast("long")).alias("starts"), F.sum(F.col("s.span_end").cast("long")).alias("ends"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)?'), ' ') AS numbers FROM documents")
def extract_numbers(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.array_join(X.extract_numbers(F.col("text")), " ").alias("numbers"))


@query(f"WITH {CLAIM_SQL} SELECT event_id, norm AS claim_text, claim_type, media::BIGINT AS media_count, quotes::INT AS n_quotes FROM cm")
def extract_claims(spark, d):
    """Claims of every event before they are compared."""
    return C.extract_claims(A.document_articles(spark, d)).select("event_id", "claim_text", "claim_type", "media_count", F.size("quotes").alias("n_quotes"))


@query(f"WITH {OVERVIEW_SQL} SELECT event_id, claims_count, quotes_count::BIGINT AS quotes_count, supported_count, disputed_count, claims_count AS bullets, round(supported_count / claims_count, 6) AS evidence_rate FROM fl")
def quality_flags(spark, d):
    q = O.quality_flags(C.build_claims(A.document_articles(spark, d)))
    return q.select("event_id", "claims_count", "quotes_count", "supported_count", "disputed_count", "bullets", *r6("evidence_rate"))


@query("SELECT l_orderkey AS event_id, CASE WHEN count(*) FILTER (WHERE l_linestatus = 'O') >= 2 AND count(*) FILTER (WHERE l_quantity > 10) > 0 THEN 'PASS' ELSE 'FAIL' END AS gate FROM lineitem GROUP BY 1")
def overview_gate(spark, d):
    """Open line items as supported claims, larger ones as bullets."""
    per = A.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("event_id")).agg(F.count_if(F.col("l_linestatus") == "O").alias("supported"), F.count_if(F.col("l_quantity") > 10).alias("bullets"))
    return per.select("event_id", O.overview_gate(F.col("supported"), F.col("bullets")).alias("gate"))


@query("""WITH q AS (SELECT l_orderkey AS claim_id, count(*)::INT AS n_quotes, sum(length(coalesce(s_name, 'unknown')))::BIGINT AS name_chars, sum(length(coalesce(p_name, '')))::BIGINT AS url_chars, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) AS quote_ids
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = p_partkey % 10 GROUP BY 1)
SELECT o_orderkey AS claim_id, coalesce(n_quotes, 0) AS n_quotes, coalesce(name_chars, 0) AS name_chars, coalesce(url_chars, 0) AS url_chars, coalesce(quote_ids, '') AS quote_ids FROM orders LEFT JOIN q ON claim_id = o_orderkey""")
def claims_with_quotes(spark, d):
    """Orders as claims, line items as quotes, parts as articles of the suppliers 0 to 9, of which 0 is not known."""
    t = lambda n: A.table(spark, d, n)
    claims = t("orders").select(F.col("o_orderkey").alias("claim_id"))
    quotes = t("lineitem").select(F.col("l_linenumber").alias("quote_id"), F.col("l_orderkey").alias("claim_id"), F.col("l_partkey").alias("article_id"), F.col("l_returnflag").alias("quote_text"), F.lit("WEAK").alias("strength"), F.lit("EVIDENCE").alias("role"))
    articles = t("part").select(F.col("p_partkey").alias("article_id"), F.col("p_name").alias("url"), (F.col("p_partkey") % 10).alias("media_id"))
    media = t("supplier").select(F.col("s_suppkey").alias("media_id"), F.col("s_name").alias("media_key"))
    out = S.claims_with_quotes(claims, quotes, articles, media)
    total = lambda field: F.aggregate(F.transform("quotes", lambda q: F.length(q[field]).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    return out.select("claim_id", F.size("quotes").alias("n_quotes"), total("media_key").alias("name_chars"), total("url").alias("url_chars"), F.array_join(F.transform("quotes", lambda q: q["quote_id"].cast("string")), ",").alias("quote_ids"))


# ---------------------------------------------------------------- audit log


@query("SELECT event_type AS action, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2")
def audit_append(spark, d):
    """All messages appended to an audit log in two turns, which is read again by day."""
    path = f"{shared_dir(spark)}/audit-{uuid.uuid4()}"
    log = A.log_events(spark, d).select(F.col("event_name").alias("action"), F.col("event_id").alias("entity_id"), F.lit("EVENT").alias("entity_type"), F.col("ts").alias("occurred_at"))
    early = F.hash("entity_id") < 0
    S.audit_append(log.where(early), path)
    S.audit_append(log.where(~early), path)
    return spark.read.parquet(path).groupBy("action", F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- bias


def document_features(spark, d):
    return B.bias_article_level(A.document_articles(spark, d))


def features():
    return {k: F.col(k) for k in B.FEATURES}


INTENSITY_SQL = "round(least(1.0, greatest(0.0, (emotional + critical + negation + institutional + technical + attribution) * 5)), 6)"
PRIMARY_LABEL = f"CASE WHEN conf < {L.PRIMARY_MIN} THEN 'NO_CONCLUYENTE' ELSE label END"


@query(f"WITH {BIAS_SQL}, p AS ({PRIMARY_SQL}) SELECT article_id, {PRIMARY_LABEL} AS label, round(conf, 6) AS confidence FROM p")
def bias_primary(spark, d):
    """Primary label of every document from the inventory's threshold on."""
    return document_features(spark, d).select("article_id", B.bias_primary(features()).alias("p")).select("article_id", "p.label", F.round("p.confidence", 6).alias("confidence"))


@query(f"WITH {BIAS_SQL}, p AS ({SECONDARY_SQL}) SELECT article_id, CASE WHEN conf >= {L.SECONDARY_MIN} THEN label END AS label, round(conf, 6) AS confidence FROM p")
def bias_secondary(spark, d):
    """Secondary label of every document from the inventory's threshold on."""
    return document_features(spark, d).select("article_id", B.bias_secondary(features()).alias("p")).select("article_id", "p.label", F.round("p.confidence", 6).alias("confidence"))


@query(f"WITH {BIAS_SQL} SELECT article_id, {INTENSITY_SQL} AS intensity FROM f")
def bias_intensity(spark, d):
    return document_features(spark, d).select("article_id", F.round(B.bias_intensity(features()), 6).alias("intensity"))


@query(f"WITH {BIAS_SQL}, p AS ({PRIMARY_SQL}) SELECT article_id, event_id, media_id, {PRIMARY_LABEL} AS label_primary, round(conf, 6) AS confidence, {INTENSITY_SQL} AS intensity, 'ARTICLE_LEVEL' AS scope, 1 AS refs FROM f JOIN p USING (article_id)")
def bias_article_level(spark, d):
    """Label rows of every document with their evidence."""
    rows = document_features(spark, d)
    return rows.select("article_id", "event_id", "media_id", "label_primary", *r6("confidence", "intensity"), "scope", F.size("rationale.evidence_refs").alias("refs"))


SIGNAL_SQL = "list_filter([" + ", ".join(f"CASE WHEN {k} > {least} THEN '{name}' END" for k, least, name in L.BIAS_SIGNALS) + "], lambda x: x IS NOT NULL)"


@query(f"WITH {BIAS_SQL}, p AS ({PRIMARY_SQL}), s AS (SELECT f.article_id, {PRIMARY_LABEL} AS label, {SIGNAL_SQL} AS found FROM f JOIN p USING (article_id)), g AS (SELECT *, CASE WHEN len(found) = 0 THEN ['{L.NO_SIGNAL}'] ELSE found END AS signals FROM s) SELECT article_id, array_to_string(signals, '|') AS signals, CASE WHEN label IN ('NEUTRO', 'NO_CONCLUYENTE') THEN '{L.WHY_NEUTRAL}' ELSE 'Clasificado como ' || label || ' por señales de ' || array_to_string(signals[1:2], ' y ') || '.' END AS why FROM g")
def bias_rationales(spark, d):
    """Why texts and signals of all documents."""
    r = F.col("rationale")
    return document_features(spark, d).select("article_id", F.array_join(r["signals"], "|").alias("signals"), r["why_short"].alias("why"))


# ---------------------------------------------------------------- ranking


@query(f"""WITH a AS (SELECT doc_id AS article_id, source, 'https://' || source || '.example/' || doc_id AS url, string_split(text, chr(10))[1] AS title, text AS snippet FROM documents),
h AS (SELECT *, {junk_sql('url', L.JUNK_URL)} AS nu, {junk_sql('title', L.JUNK_TITLE)} AS nt, {junk_sql("title || ' ' || snippet", L.JUNK_SEO)} AS ns FROM a),
s AS (SELECT *, least(1.0, CASE WHEN nu > 0 THEN 0.35 ELSE 0 END + CASE WHEN nt >= 2 THEN 0.3 WHEN nt = 1 THEN 0.15 ELSE 0 END + CASE WHEN ns > 0 THEN 0.2 ELSE 0 END + CASE WHEN length(snippet) < 100 THEN 0.1 ELSE 0 END) AS score FROM h)
SELECT source AS media_id, CASE WHEN round(score, 10) >= 0.75 THEN 'excluded' WHEN round(score, 10) >= 0.45 THEN 'penalized' ELSE 'normal' END AS class, count(*) AS n FROM s GROUP BY 1, 2""")
def junk_classify(spark, d):
    """Junk classes of every outlet's documents."""
    j = R.article_junk(A.document_articles(spark, d))
    return j.groupBy("media_id", X.junk_classify(F.col("junk")).alias("class")).agg(F.count("*").alias("n"))


@query(f"WITH {SCORED_SQL} SELECT event_id, round(score, 6) AS score, round(importance, 6) AS importance, junk_excluded FROM scored WHERE NOT junk_excluded UNION ALL SELECT event_id, -1.0, 0.0, true FROM scored WHERE junk_excluded")
def event_score(spark, d):
    """Score of every event, excluded ones included."""
    return scored_orders(spark, d).select("event_id", *r6("score", "importance"), "junk_excluded")


@query(f"WITH {SCORED_SQL} SELECT event_id, dominance_penalty AND NOT junk_excluded AS dominated FROM scored")
def dominance(spark, d):
    return scored_orders(spark, d).select("event_id", F.col("dominance_penalty").alias("dominated"))


@query(f"WITH {SCORED_SQL} SELECT event_id, CASE WHEN junk_excluded THEN 0 ELSE round(momentum, 6) END AS momentum FROM scored")
def momentum(spark, d):
    return scored_orders(spark, d).select("event_id", *r6("momentum"))


@query(f"WITH {SCORED_SQL} SELECT event_id, CASE WHEN junk_excluded THEN 0 ELSE round(quality, 6) END AS quality FROM scored")
def claim_quality(spark, d):
    return scored_orders(spark, d).select("event_id", *r6("quality"))


@query(f"WITH {SCORED_SQL.replace(str(int(A.WINDOW_HOURS * 3_600_000)) + '.0', '43200000.0').replace(' - ' + str(int(A.WINDOW_HOURS * 3_600_000)) + ')', ' - 21600000)')} SELECT event_id, CASE WHEN junk_excluded THEN -1 ELSE round(score, 6) END AS score, CASE WHEN junk_excluded THEN 0 ELSE updates_6h END::BIGINT AS updates_6h FROM scored")
def event_score_hours(spark, d):
    """Scores with the inventory's own six hours of momentum and twelve of half-life."""
    scored = R.event_score(A.order_events(spark, d), A.item_articles(spark, d), A.item_claims(spark, d), A.now())
    return scored.select("event_id", *r6("score"), F.col("updates_6h").cast("long").alias("updates_6h"))


# ---------------------------------------------------------------- read queries


@query("SELECT o_orderkey AS event_id, epoch_ms(o_orderdate) AS published_ms, o_orderkey::VARCHAR AS decoded_id FROM orders")
def decode_cursor(spark, d):
    """Cursors of all orders, encoded and decoded again."""
    o = A.order_events(spark, d)
    back = X.decode_cursor(X.encode_cursor(F.col("published_at"), F.col("event_id")))
    return o.select("event_id", F.unix_millis(back["published_at"]).alias("published_ms"), back["event_id"].alias("decoded_id"))


@query("SELECT event_id::VARCHAR AS event_id, CASE WHEN sec < 60 THEN 'hace un momento' WHEN sec < 3600 THEN 'hace ' || (sec // 60) || ' min' WHEN sec < 86400 THEN 'hace ' || (sec // 3600) || 'h' ELSE 'hace ' || (sec // 86400) || 'd' END AS ago FROM (SELECT event_id, (epoch_ms(last) - epoch_ms(ts)) // 1000 AS sec FROM events, (SELECT max(ts) AS last FROM events))")
def relative_time(spark, d):
    """Age of every message at the time of the last one."""
    log = A.log_events(spark, d)
    last = log.agg(F.max("ts").alias("last"))
    # One row with one value.
    aged = log.join(F.broadcast(last))
    return aged.select("event_id", X.relative_time(F.floor((F.unix_millis("last") - F.unix_millis("ts")) / 1000)).alias("ago"))


@query("SELECT l_suppkey AS event_id, s_name AS media_key, n_name AS country, count(DISTINCT l_partkey)::INT AS n_articles FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2, 3")
def include_joins(spark, d):
    """Parts of every supplier as articles below its outlet, with the outlet's country from a third table."""
    li = A.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("event_id"), F.struct(F.col("l_suppkey").alias("m"), F.col("l_partkey").alias("p")).alias("article_id"), F.col("l_suppkey").alias("media_id")).distinct()
    media = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("media_id"), F.col("s_name").alias("media_key"), "s_nationkey")
    arts = li.select("article_id", "media_id", F.lit("").alias("title"), F.lit("").alias("snippet"), F.lit("").alias("url"), A.now().alias("published_at"))
    tabs = D.media_tabs(li.select("event_id", "article_id"), arts, media.select("media_id", "media_key"))
    country = media.join(A.table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("country")), "s_nationkey").select("media_key", "country")
    return tabs.join(country, "media_key").select("event_id", "media_key", "country", F.size("articles").alias("n_articles"))


# ---------------------------------------------------------------- late rows


@query("""WITH t0 AS (SELECT l_suppkey AS event_id, min(l_shipdate) + INTERVAL 90 DAY AS t0 FROM lineitem GROUP BY 1),
r AS (SELECT l_suppkey AS event_id, (epoch_ms(l_shipdate) - epoch_ms(t0)) AS ms FROM lineitem JOIN t0 ON event_id = l_suppkey)
SELECT DISTINCT event_id, (ms // 604800000)::INT AS bin_index FROM r WHERE ms >= 0 AND ms // 604800000 < 28""")
def late_rows(spark, d):
    """Weekly bins of every supplier that hold rows; those of its first 90 days and after week 28 are out of range."""
    w = A.item_topics(spark, d).withColumn("t0", F.timestamp_millis(F.unix_millis("t0") + 90 * 86_400_000))
    return P.heatmap_rows(w, 7 * 24).select("event_id", "bin_index").distinct()


# ---------------------------------------------------------------- linking


DAY_SQL = "TIMESTAMP '2024-01-01' + INTERVAL ({0}) DAY"


def label_features(spark, d):
    vectors, _ = A.vector_events(spark, d)
    at = lambda n: F.timestamp_millis(F.unix_millis(F.lit("2024-01-01").cast("timestamp")) + n * 86_400_000)
    made = V.centroid(vectors).select("event_id", "centroid", F.array().cast("array<string>").alias("entities"), F.when(F.col("event_id") % 2 == 0, 2).otherwise(1).alias("unique_media"), at(F.col("event_id")).alias("t0"), at(F.col("event_id")).alias("t_last"))
    arts = vectors.select("article_id", "embedding_vec", F.lit("").alias("title"), F.lit("").alias("snippet"), at(F.col("article_id") % 20).alias("published_at"))
    return arts, made, at


LABEL_SQL = f"""{CENTROID_SQL}, cn AS (SELECT event_id, list(v ORDER BY pos) AS cv FROM c GROUP BY 1),
s AS (SELECT vec_id AS article_id, event_id, list_cosine_similarity(embedding::DOUBLE[], cv) AS sim, exp(-0.693 * abs(epoch_ms({DAY_SQL.format('vec_id % 20')}) - epoch_ms({DAY_SQL.format('event_id')})) / 259200000.0) AS near FROM embeddings, cn)"""


@query(f"WITH {LABEL_SQL} SELECT event_id, count(*) AS n FROM s WHERE event_id >= 3 GROUP BY 1")
def link_candidates(spark, d):
    """Candidate articles of the label events of the last seven days, which are a stated list."""
    arts, made, at = label_features(spark, d)
    return K.link_candidates(arts, made, at(F.lit(10))).groupBy("event_id").agg(F.count("*").alias("n"))


@query(f"WITH {LABEL_SQL} SELECT article_id, event_id, round(sim, 6) AS embedding_sim, round(near, 6) AS temporal, round(0.55 * sim + 0.20 * near, 6) AS score FROM s WHERE event_id >= 3")
def score_candidates(spark, d):
    """Scores of every vector against the label events of the last seven days."""
    arts, made, at = label_features(spark, d)
    return K.score_candidates(arts, made, at(F.lit(10))).select("article_id", "event_id", *r6("embedding_sim", "temporal", "score"))


@query(f"""WITH {LABEL_SQL}, b AS (SELECT *, 0.55 * sim + 0.20 * near AS score, row_number() OVER (PARTITION BY article_id ORDER BY round(0.55 * sim + 0.20 * near, 9) DESC, event_id) AS rn FROM s),
k AS (SELECT article_id, event_id, score, CASE WHEN score >= {L.THETA_LINK} THEN 'auto' WHEN score >= {L.THETA_MAYBE} AND event_id % 2 = 0 THEN 'two_media' END AS basis FROM b WHERE rn = 1)
SELECT article_id, CASE WHEN basis IS NULL THEN 'CREATE' ELSE 'LINK' END AS action, CASE WHEN basis IS NOT NULL THEN event_id END AS event_id, CASE WHEN basis IS NOT NULL THEN round(score, 6) END AS score FROM k""")
def decide_link_thresholds(spark, d):
    """Decisions of every vector at the inventory's thresholds."""
    arts, made, at = label_features(spark, d)
    return K.decide_link(arts, K.score_candidates(arts, made, at(F.lit(7)), days=30, least=L.THETA_MAYBE)).select("article_id", "action", "event_id", *r6("score"))


@query(f"WITH {LABEL_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY round(sim, 9) DESC, event_id) AS rn FROM s) SELECT article_id, CASE WHEN sim >= {L.THETA_V1} THEN 'LINK' ELSE 'CREATE' END AS action, CASE WHEN sim >= {L.THETA_V1} THEN event_id END AS event_id FROM b WHERE rn = 1")
def link_v1_threshold(spark, d):
    """Nearest centroid of every vector at the inventory's threshold."""
    arts, made, _ = label_features(spark, d)
    return K.link_v1(arts, made).select("article_id", "action", "event_id")
