"""Further queries: table maintenance, guards, packets, nested documents, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

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
from newsengine.plans.queries import BIAS_SQL, CLAIM_SQL, HEAT_SQL, NOW_MS, SCORED_SQL, SPANISH_SQL, WINDOW_MS, query, r6
from newsengine.sources import tables as S

STATE = "CASE o_orderstatus WHEN 'F' THEN 'CLOSED' WHEN 'P' THEN 'PENDING_PUBLISH' ELSE 'PUBLISHED' END"


def states(spark, d):
    """Orders with a state by their status and publish_at five days after the order date."""
    o = A.table(spark, d, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "CLOSED").when(F.col("o_orderstatus") == "P", "PENDING_PUBLISH").otherwise("PUBLISHED")
    at = A.ts("o_orderdate")
    return o.select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("cust"), state.alias("state"), at.alias("t0"), at.alias("t_last"), at.alias("published_at"), F.timestamp_millis(F.unix_millis(at) + 432_000_000).alias("publish_at"))


def links(spark, d):
    return A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("article_id"), F.col("l_suppkey").alias("media_id"), A.ts("l_shipdate").alias("linked_at"))


ARTICLE = "(l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey)"


@query("SELECT source AS media_key, bool_or(lang = 'es') AS allowlisted FROM documents GROUP BY 1 HAVING bool_or(lang = 'es')")
def media_allowlisted(spark, d):
    m = A.table(spark, d, "documents").groupBy(F.col("source").alias("media_key")).agg(F.max(F.col("lang") == "es").alias("allowlisted"))
    return S.media_allowlisted(m)


@query("SELECT DISTINCT source AS media_key, true AS allowlisted FROM documents WHERE source = 'src3'")
def media_by_key(spark, d):
    return S.media_by_key(A.source_media(spark, d), "src3").select("media_key", "allowlisted")


@query("SELECT source AS media_key FROM documents GROUP BY 1 UNION SELECT unnest(['eltiempo','elespectador','razon_publica','flip','consonante','oec','ascolbi','aciur'])")
def seed_media(spark, d):
    """Sources with the seeded outlets added."""
    return S.seed_media(A.source_media(spark, d), S.media_seeds(spark)).select("media_key")


@query(f"SELECT l_orderkey AS event_id, {ARTICLE} AS article_id, o_orderstatus AS status FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def articles_by_event(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"))
    li = links(spark, d)
    arts = li.select("article_id", F.col("event_id").alias("k")).distinct().join(o, "k").select("article_id", "status")
    return S.articles_by_event(li.select("event_id", "article_id"), arts).select("event_id", "article_id", "status")


@query(f"SELECT DISTINCT l_orderkey AS event_id, {ARTICLE} AS article_id FROM lineitem")
def link_article_upsert(spark, d):
    """Returned items are linked already, all items come again: each pair once."""
    li = A.table(spark, d, "lineitem")
    pair = lambda df: df.select(F.col("l_orderkey").alias("event_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("article_id"))
    return S.link_article_upsert(pair(li.where("l_returnflag = 'R'")).distinct(), pair(li))


@query(f"SELECT o_orderkey AS event_id FROM orders WHERE {STATE} <> 'CLOSED' AND o_orderdate <= TIMESTAMP '1999-01-01'")
def stale_events(spark, d):
    return S.stale_events(states(spark, d), F.lit("1999-01-01").cast("timestamp")).select("event_id")


@query(f"SELECT o_orderkey AS event_id FROM orders WHERE {STATE} = 'PUBLISHED'")
def active_events(spark, d):
    return S.active_events(states(spark, d)).select("event_id")


@query(f"SELECT o_orderkey AS event_id FROM orders WHERE {STATE} = 'PENDING_PUBLISH'")
def pending_publish(spark, d):
    return S.pending_publish(states(spark, d)).select("event_id")


@query(f"SELECT o_orderkey AS event_id, epoch_ms(o_orderdate) + 432000000 <= {NOW_MS} AS due FROM orders WHERE {STATE} = 'PENDING_PUBLISH'")
def rehydrate_pending(spark, d):
    """Pending events, due now or later."""
    due, later = Y.rehydrate_pending(states(spark, d), A.now())
    return due.select("event_id", F.lit(True).alias("due")).unionByName(later.select("event_id", F.lit(False).alias("due")))


@query(f"SELECT o_orderkey AS event_id FROM orders WHERE epoch_ms(o_orderdate) + 432000000 <= {NOW_MS}")
def due_jobs(spark, d):
    return Y.due_jobs(states(spark, d).select("event_id", F.col("publish_at").alias("run_at")), A.now()).select("event_id")


@query(f"SELECT o_orderkey AS event_id, CASE WHEN bool_or(l_returnflag = 'A') THEN {NOW_MS} ELSE epoch_ms(any_value(o_orderdate)) END AS t_last_ms FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def touch_on_link(spark, d):
    """Orders with an accepted line are touched now."""
    linked = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.when(F.col("l_returnflag") == "A", "LINKED_EXISTING").otherwise("TRIGGER_CREATE").alias("link_action"))
    moved, _ = Y.touch_on_link(states(spark, d), linked, A.now())
    return moved.select("event_id", F.unix_millis("t_last").alias("t_last_ms"))


@query("SELECT conv_id AS event_id, count(*) AS claims FROM conversations GROUP BY 1")
def count_claims_by_version(spark, d):
    rows = A.turn_versions(spark, d).select("event_id", F.lit(0).alias("version_id"))
    return S.count_claims_by_version(rows).select("event_id", "claims")


@query("SELECT conv_id AS event_id, turn::INT AS version_index FROM conversations WHERE (conv_id, turn) NOT IN (SELECT conv_id, turn FROM conversations WHERE role = 'assistant')")
def pending_versions(spark, d):
    """Turns that no assistant has answered in the same row: work left for a stage."""
    v = A.turn_versions(spark, d)
    return S.pending_versions(v, v.where("role = 'assistant'")).select("event_id", "version_index")


@query("SELECT l_orderkey AS event_id, count(*) AS quotes FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def delete_claims_by_version(spark, d):
    """Claims and quotes of fulfilled orders go; what is left is counted."""
    claims = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.lit(0).alias("version_id"), F.col("o_orderkey").alias("claim_id"), "o_orderstatus")
    quotes = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("claim_id"))
    _, left = S.delete_claims_by_version(claims, quotes, claims.where("o_orderstatus = 'F'").select("event_id", "version_id"))
    return left.groupBy(F.col("claim_id").alias("event_id")).agg(F.count("*").alias("quotes"))


@query("SELECT o_orderkey AS version_id, o_orderstatus AS state, CASE WHEN n IS NULL THEN 'none' ELSE 'some' END AS overview, n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def packet_merge(spark, d):
    """Packets of orders with the fields of a later stage over their own."""
    packets = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("version_id"), F.col("o_orderstatus").alias("state"), F.lit("none").alias("overview"), F.lit(None).cast("long").alias("n"))
    stage = A.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("version_id")).agg(F.lit("some").alias("overview"), F.count("*").alias("n"))
    return S.packet_merge(packets, stage)


@query(f"SELECT o_orderkey AS event_id, CASE WHEN f THEN 'CLOSED' ELSE {STATE} END AS state FROM orders LEFT JOIN (SELECT l_orderkey, true AS f FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 200) ON l_orderkey = o_orderkey")
def event_update(spark, d):
    """States changed by a change set."""
    changes = A.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("event_id")).agg(F.sum("l_quantity").alias("q")).where("q > 200").select("event_id", F.lit("CLOSED").alias("state"))
    return S.event_update(states(spark, d), changes).select("event_id", "state")


@query("SELECT event_id::VARCHAR AS entity_id, epoch_us(ts) AS at FROM events WHERE event_type = 'error' AND user_id = 8")
def audit_by_entity(spark, d):
    log = A.log_events(spark, d).select(F.upper("event_name").alias("entity_type"), F.col("user_id").cast("string").alias("entity_id"), F.col("ts").alias("occurred_at"), F.col("event_id").alias("id"))
    return S.audit_by_entity(log, "ERROR", "8").select(F.col("id").alias("entity_id"), F.unix_micros("occurred_at").alias("at"))


@query(r"""WITH a AS (SELECT doc_id, source, lang, string_split(text, chr(10))[1] AS title, text FROM documents)
SELECT doc_id AS article_id, length(substring(text, 1, 600))::INT AS snippet_chars, CASE WHEN source = 'src1' THEN 'FETCH_FAIL' WHEN lang = 'de' THEN 'DUPLICATE_URL' WHEN length(regexp_replace(title, '^\s+|\s+$', '', 'g')) = 0 THEN 'PARSE_FAIL' ELSE 'NORMALIZED' END AS outcome FROM a""")
def normalize_article(spark, d):
    """Outcome of every document as a parsed page; one source is no known outlet, the German ones are stored already."""
    a = A.document_articles(spark, d)
    media = A.source_media(spark, d).where("media_key <> 'src1'").select("media_key", "media_id")
    german = A.table(spark, d, "documents").where("lang = 'de'").select(F.col("doc_id").alias("article_id"))
    out = I.normalize_article(a.drop("media_id"), media, a.join(german, "article_id", "left_semi").select("url"))
    return out.select("article_id", F.length("snippet").alias("snippet_chars"), "outcome")


@query(rf"WITH {SPANISH_SQL} SELECT 'https://' || source || '.example/' || doc_id AS url, CASE WHEN source = 'src0' THEN 'NOT_ALLOWLISTED' WHEN length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 80 THEN 'NO_EXTRACT' ELSE 'NOT_SPANISH' END AS reason_code FROM g WHERE source = 'src0' OR length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 80 OR NOT spanish")
def blocked_events(spark, d):
    gated = I.policy_gate(A.document_articles(spark, d), A.source_media(spark, d))
    messages, _ = I.blocked_events(gated, A.now())
    return messages.select("url", "reason_code")


@query("SELECT doc_id AS article_id, sha256(string_split(text, chr(10))[1] || ' ' || text) AS embedding_hash FROM documents WHERE lang <> 'en'")
def embed_incremental(spark, d):
    """English documents are stored under their present hash, French ones under another: all but English are due."""
    a = A.document_articles(spark, d)
    h = V.embedding_hash(V.text_for_embedding(F.col("title"), F.col("snippet")))
    langs = A.table(spark, d, "documents").select(F.col("doc_id").alias("article_id"), "lang")
    stored = a.join(langs, "article_id").where("lang in ('en', 'fr')").select("article_id", F.when(F.col("lang") == "en", h).otherwise("old").alias("embedding_hash"))
    return V.embed_incremental(a, stored).select("article_id", "embedding_hash")


@query("SELECT a.vec_id, b.vec_id AS other, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_similarity(spark, d):
    """Every vector with the next one."""
    e = A.table(spark, d, "embeddings")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other"), F.col("embedding").alias("b"))
    return e.join(n, "vec_id").select("vec_id", "other", F.round(V.cosine_similarity(F.col("embedding"), F.col("b")), 6).alias("cosine"))


@query("SELECT l_suppkey AS event_id, CASE WHEN count(*) > 25 THEN 'MAX_ARTICLES' WHEN count(DISTINCT l_partkey) > 7 THEN 'MAX_SUB_EVENTS' END AS reason FROM lineitem GROUP BY 1 UNION ALL SELECT l_orderkey + 1000000000 AS event_id, CASE WHEN count(*) > 25 THEN 'MAX_ARTICLES' WHEN count(DISTINCT l_partkey) > 7 THEN 'MAX_SUB_EVENTS' END AS reason FROM lineitem GROUP BY 1")
def mega_event_guard(spark, d):
    """Suppliers and orders as events, parts as their sub-events."""
    li = A.table(spark, d, "lineitem")
    n = lambda k: li.groupBy(k.cast("long").alias("event_id")).agg(F.count("*").alias("n"), F.countDistinct("l_partkey").alias("s"))
    return n(F.col("l_suppkey")).unionByName(n(F.col("l_orderkey") + 1_000_000_000)).select("event_id", K.mega_event_guard(F.col("n"), F.col("s"))["reason"].alias("reason"))


@query("""SELECT l_orderkey AS event_id, l_linenumber AS line, l_partkey AS part, array_to_string(list_filter([CASE WHEN l_returnflag <> o_orderstatus THEN 'action_incompatible' END, CASE WHEN lower(l_linestatus) <> lower(o_orderstatus) AND l_discount >= 0.05 THEN 'city_mismatch' END,
CASE WHEN CASE WHEN l_shipdate < o_orderdate THEN epoch_ms(o_orderdate) - epoch_ms(l_shipdate) WHEN l_shipdate > o_orderdate + INTERVAL 30 DAY THEN epoch_ms(l_shipdate) - epoch_ms(o_orderdate) - 2592000000 ELSE 0 END > 604800000 THEN 'date_gap' END], lambda x: x IS NOT NULL), ',') AS reasons FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def hard_block(spark, d):
    """Reasons why a line would not fit its order."""
    j = A.table(spark, d, "lineitem").join(A.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    sure = F.when(F.col("l_discount") >= 0.05, 0.7).otherwise(0.69)
    at = A.ts("o_orderdate")
    a = {"action": F.col("l_returnflag"), "city": F.col("l_linestatus"), "city_conf": sure, "fact_date": A.ts("l_shipdate")}
    e = {"action": F.col("o_orderstatus"), "city": F.lower("o_orderstatus"), "city_conf": F.lit(0.9), "fact_earliest": at, "fact_latest": F.timestamp_millis(F.unix_millis(at) + 2_592_000_000)}
    return j.select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.array_join(K.hard_block(a, e), ",").alias("reasons"))


@query("WITH s AS (SELECT l_orderkey AS article_id, l_suppkey AS event_id, max(l_quantity) AS score FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY score DESC, event_id) AS rank FROM s) SELECT article_id, array_to_string(list(event_id ORDER BY rank), ',') AS top FROM r JOIN orders ON o_orderkey = article_id WHERE rank <= CASE WHEN o_orderstatus = 'O' THEN 5 ELSE 3 END GROUP BY 1")
def top_scores_audit(spark, d):
    """Best suppliers of every order: five of open ones, three of others."""
    scored = A.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("article_id"), F.col("l_suppkey").alias("event_id")).agg(F.max("l_quantity").alias("score"))
    decisions = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("article_id"), F.when(F.col("o_orderstatus") == "O", "LINK").otherwise("CREATE").alias("action"))
    return K.top_scores_audit(scored, decisions).select("article_id", F.array_join(F.transform("top", lambda t: t["event_id"].cast("string")), ",").alias("top"))


@query("WITH RECURSIVE e AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 16 > 0 THEN o_orderkey - 1 END AS c FROM orders), r AS (SELECT id, coalesce(c, id) AS place, 0 AS n FROM e UNION ALL SELECT r.id, e.c, n + 1 FROM r JOIN e ON e.id = r.place WHERE e.c IS NOT NULL) SELECT id AS event_id, arg_max(place, n) AS canonical_id FROM r GROUP BY 1")
def resolve_canonical(spark, d):
    """Chains of up to fifteen hops over order keys."""
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.when(F.col("o_orderkey") % 16 > 0, F.col("o_orderkey") - 1).alias("canonical_event_id"))
    return K.resolve_canonical(o)


@query(f"SELECT o_orderkey AS event_id, coalesce(max(turn) + 1, 0)::INT AS version_index, count(DISTINCT {ARTICLE})::INT AS n_articles, coalesce(arg_max({ARTICLE}, (l_shipdate, {ARTICLE})), strftime(any_value(o_orderdate), '%Y-%m-%dT%H:%M:%S.000Z')) AS headline FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN conversations ON conv_id = o_orderkey GROUP BY 1")
def build_packet(spark, d):
    """Packets of all orders: index, number of articles and headline."""
    li = links(spark, d).dropDuplicates(["event_id", "article_id", "linked_at"])
    arts = li.select("article_id", F.col("media_id").cast("string").alias("media_id"), F.col("article_id").alias("title"), F.lit("").alias("snippet"), F.lit("").alias("url"), F.lit(None).cast("timestamp").alias("published_at")).dropDuplicates(["article_id"])
    media = A.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("media_id"), F.col("s_name").alias("media_key"))
    p = Y.build_packet(states(spark, d), li.select("event_id", "article_id", "linked_at"), arts, media, A.turn_versions(spark, d))
    return p.select("event_id", "version_index", F.size(F.array_distinct("packet.articles.article_id")).alias("n_articles"), "headline")


@query("SELECT doc_id AS event_id, CASE WHEN lang = 'en' THEN 'x' ELSE upper(left(source, 1)) END AS claim_text, CASE WHEN lang = 'fr' THEN 'FACT' ELSE 'OPINION' END AS claim_type, CASE WHEN n_chars > 1000 THEN 'SUPPORTED' WHEN lang = 'de' THEN 'DISPUTED' ELSE 'INSUFFICIENT' END AS status, (text <> '')::INT AS n_quotes FROM documents WHERE lang <> 'es'")
def claims_from_extraction(spark, d):
    """One extracted claim per document, cited from itself; Spanish ones have a confidence out of range."""
    docs = A.table(spark, d, "documents")
    lang = F.col("lang")
    ev = F.array(F.struct(F.concat(F.lit("u/"), F.col("doc_id").cast("string")).alias("source_url"), F.coalesce("text", F.lit("")).alias("quote")))
    claim = F.struct(F.when(lang == "en", "x").otherwise(F.upper(F.substring("source", 1, 1))).alias("claim_text"), F.when(lang == "fr", "FACT").otherwise("OPINION").alias("claim_type"), F.when(lang == "de", "deny").otherwise("affirm").alias("polarity"), F.when(lang == "es", 1.5).when(F.col("n_chars") > 1000, 0.8).otherwise(0.2).alias("confidence"), ev.alias("evidence"))
    given = docs.select(F.col("doc_id").alias("event_id"), F.lit(0).alias("version_id"), F.to_json(F.struct(F.array(claim).alias("claims"))).alias("json"))
    arts = docs.select(F.col("doc_id").alias("event_id"), F.concat(F.lit("u/"), F.col("doc_id").cast("string")).alias("url"), F.col("doc_id").alias("article_id"), F.col("source").alias("media_id"), F.lit("").alias("title"), F.col("text").alias("snippet"))
    return C.claims_from_extraction(given, arts).select("event_id", "claim_text", "claim_type", "status", F.size("quotes").alias("n_quotes"))


@query("SELECT doc_id AS version_id, substring(sha256('overview:v2.0:' || doc_id || ':' || source), 1, 16) AS overview_hash FROM documents WHERE lang <> 'en'")
def overview_dedup(spark, d):
    """Versions whose overview is not stored under the present hash; English ones are."""
    docs = A.table(spark, d, "documents").select(F.col("doc_id").alias("version_id"), F.col("source").alias("claims_hash"), "lang")
    stored = docs.where("lang = 'en'").select("version_id", X.overview_hash(F.col("version_id"), F.col("claims_hash")).alias("overview_hash"), F.lit("o").alias("ai_overview"))
    return O.overview_dedup(docs.drop("lang"), stored).select("version_id", "overview_hash")


@query(r"""WITH t AS (SELECT conv_id AS event_id, list(CASE WHEN role = 'user' THEN text END) AS u, list(CASE WHEN role = 'assistant' THEN text END) AS a, list(CASE WHEN role = 'system' THEN text END) AS s FROM conversations GROUP BY 1),
f AS (SELECT event_id, len(list_filter(u, lambda x: trim(x) <> '')) AS u, len(list_filter(a, lambda x: trim(x) <> '')) AS a, len(list_filter(s, lambda x: trim(x) <> '')) AS s FROM t)
SELECT event_id, array_to_string(list_filter([CASE WHEN coalesce(u, 0) = 0 THEN 'EMPTY_WHAT_HAPPENED' END, CASE WHEN coalesce(a, 0) = 0 THEN 'EMPTY_CONTEXT' END, CASE WHEN coalesce(s, 0) = 0 THEN 'EMPTY_IN_DISPUTE' END], lambda x: x IS NOT NULL), ',') AS reasons FROM f""")
def content_gate(spark, d):
    """User, assistant and system texts of conversations as an overview's three lists."""
    c = A.table(spark, d, "conversations")
    of = lambda r: F.collect_list(F.when(F.col("role") == r, F.col("text")))
    g = c.groupBy(F.col("conv_id").alias("event_id")).agg(of("user").alias("u"), of("assistant").alias("a"), of("system").alias("s"))
    return g.select("event_id", F.array_join(O.content_gate(F.col("u"), F.col("a"), F.col("s")), ",").alias("reasons"))


@query("SELECT vec_id AS event_id, CASE WHEN label IN (0, 1, 2) THEN ['Alta', 'Media', 'Baja'][label + 1] ELSE 'No concluyente' END AS label, least(1.0, greatest(0.0, label / 5.0 - 0.5))::DOUBLE AS confidence FROM embeddings")
def normalize_ai_overview(spark, d):
    """External overviews, one per vector, with labels and confidences partly out of range."""
    e = A.table(spark, d, "embeddings")
    names = F.array(*[F.lit(x) for x in ("Alta", "Media", "Baja")])
    raw = F.to_json(F.struct(F.coalesce(F.get(names, F.col("label")), F.lit("?")).alias("confidence_label"), F.array(F.struct(F.lit("t").alias("topic"), (F.col("label") / 5.0 - 0.5).alias("confidence"))).alias("disputes")))
    o = O.normalize_ai_overview(raw)
    return e.select(F.col("vec_id").alias("event_id"), o["confidence_label"].alias("label"), F.round(F.get(o["disputes"], F.lit(0))["confidence"], 6).alias("confidence"))


@query(f"WITH {CLAIM_SQL} SELECT event_id, count(*) AS claims FROM fin WHERE event_id % 2 = 0 GROUP BY 1")
def enrich_published(spark, d):
    """Claims of published events that are not marked; odd events are marked as done."""
    arts = A.document_articles(spark, d).withColumn("version_id", F.col("event_id"))
    ids = arts.select("event_id", "version_id").distinct()
    claims, _, _ = O.enrich_published(ids.withColumn("state", F.lit("PUBLISHED")), ids, arts.drop("version_id"), ids.where("event_id % 2 = 1"))
    return claims.groupBy("event_id").agg(F.count("*").alias("claims"))


@query(f"WITH {HEAT_SQL} SELECT event_id, bin_index, (max((share, topic_key)))[2] AS dominant FROM heat GROUP BY 1, 2 UNION ALL SELECT s_suppkey, b::INT, 'OTROS' FROM (SELECT DISTINCT l_suppkey AS s_suppkey FROM lineitem), range(0, 28) r(b) WHERE (s_suppkey, b) NOT IN (SELECT event_id, bin_index FROM heat)")
def dominant_topic(spark, d):
    """Leading topic of all 28 bins of every supplier."""
    w = A.item_topics(spark, d)
    heat = P.topic_heatmap(w.select("event_id", "t0").distinct(), w, A.WINDOW_HOURS)
    return heat.select("event_id", "bin_index", P.dominant_topic(F.col("topics")).alias("dominant"))


@query(f"WITH {HEAT_SQL}, dm AS (SELECT event_id, bin_index, (max((share, topic_key)))[2] AS topic FROM heat GROUP BY 1, 2), i AS (SELECT event_id, arg_min(topic, bin_index) AS initial FROM dm GROUP BY 1), g AS (SELECT dm.event_id, topic, bin_index, bin_index - row_number() OVER (PARTITION BY dm.event_id, topic ORDER BY bin_index) AS island FROM dm JOIN i ON i.event_id = dm.event_id WHERE topic <> initial), r AS (SELECT event_id, topic, island, min(bin_index) AS sb FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 3), dr AS (SELECT event_id, arg_min(topic, (sb, topic)) AS t, min(sb) AS sb FROM r GROUP BY 1) SELECT dr.event_id, 'FASE 2: ' || t AS label, count(DISTINCT l_orderkey)::INT AS n_articles, 0 AS n_claims FROM dr JOIN lineitem ON l_suppkey = dr.event_id AND l_returnflag = t GROUP BY 1, 2 UNION ALL SELECT s_suppkey, 'RAMA: ' || s_name, 0, 2 FROM supplier WHERE s_acctbal > 5000 AND s_suppkey IN (SELECT l_suppkey FROM lineitem)")
def build_subevents(spark, d):
    """Sub-events from topic drift of suppliers, and a branch for those with a high balance."""
    w = A.item_topics(spark, d)
    drift = P.topic_drift(P.heatmap_rows(w, A.WINDOW_HOURS))
    assigned = A.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("event_id"), F.col("l_returnflag").alias("topic_key"), F.col("l_orderkey").alias("article_id"))
    versions = w.select("event_id").distinct().withColumn("version_id", F.lit(0))
    branch = A.table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("event_id"), F.lit(0).alias("version_id"), F.concat(F.lit("RAMA: "), "s_name").alias("label"), F.array("s_name", F.col("s_nationkey").cast("string")).alias("claim_ids"))
    out = P.build_subevents(versions, drift, assigned, branch)
    return out.select("event_id", F.explode("subevents").alias("s")).select("event_id", "s.label", F.size("s.article_ids").alias("n_articles"), F.size("s.key_claim_ids").alias("n_claims"))


@query(f"WITH {BIAS_SQL} SELECT article_id, coalesce(nullif(array_to_string(list_filter([" + ", ".join(f"CASE WHEN {k} > {v} THEN '{n}' END" for k, v, n in L.BIAS_SIGNALS) + f"], lambda x: x IS NOT NULL), ','), ''), '{L.NO_SIGNAL}') AS signals FROM f")
def bias_signals(spark, d):
    rows = B.bias_article_level(A.document_articles(spark, d))
    return rows.select("article_id", F.array_join("rationale.signals", ",").alias("signals"))


@query(f"WITH {BIAS_SQL}, v AS (" + " UNION ALL ".join(f"SELECT article_id, {i} AS i, '{k}' AS k, {k} AS v FROM f" for i, k in enumerate(L.BIAS_WORDS)) + "), r AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY v DESC, i) AS rn FROM v WHERE v > 0 QUALIFY rn <= 5) SELECT article_id, array_to_string(list(k ORDER BY rn), ',') AS top FROM r GROUP BY 1")
def bias_top_features(spark, d):
    """Names of the largest features of every document that has any."""
    rows = B.bias_article_level(A.document_articles(spark, d))
    top = F.transform("rationale.top_features", lambda x: F.substring_index(x, ":", 1))
    return rows.select("article_id", F.array_join(top, ",").alias("top")).where("top <> ''")


@query("SELECT vec_id AS label_id, CASE WHEN label < 4 THEN 'low_confidence' WHEN vec_id % 2 = 0 THEN 'insufficient_evidence' END AS degraded_reason, CASE WHEN label < 4 OR vec_id % 2 = 0 THEN 'INCONCLUSO' ELSE 'CRITICO' END AS label_primary FROM embeddings")
def bias_safeguard(spark, d):
    """Labels, one per vector, by confidence and evidence."""
    e = A.table(spark, d, "embeddings")
    refs = F.when(F.col("vec_id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("r")))
    labels = e.select(F.col("vec_id").alias("label_id"), F.lit("CRITICO").alias("label_primary"), F.lit("X").alias("label_secondary"), (F.col("label") / 10).alias("confidence"), F.struct(refs.alias("evidence_refs")).alias("rationale"))
    return B.bias_safeguard(labels).select("label_id", "degraded_reason", "label_primary")


@query("SELECT o_orderkey AS event_id, s_name AS media_key, arg_min(l_returnflag, (l_shipdate, l_linenumber, l_partkey)) FILTER (WHERE l_linestatus = 'O') AS media_level, count(*) FILTER (WHERE l_linestatus <> 'O')::INT AS n_articles FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2")
def bias_for_media(spark, d):
    """Labels of every order and supplier: open lines are outlet rows, others article rows."""
    li = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("media_id"), F.when(F.col("l_linestatus") == "O", "MEDIA_LEVEL").otherwise("ARTICLE_LEVEL").alias("scope"), F.col("l_returnflag").alias("label_primary"), F.lit(None).cast("string").alias("label_secondary"), F.lit(0.0).alias("intensity"), F.lit(0.5).alias("confidence"), A.ts("l_shipdate").alias("created_at"), F.struct("l_linenumber", "l_partkey").alias("label_id"), F.concat_ws("-", "l_linenumber", "l_partkey").alias("article_id"))
    media = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("media_id"), F.col("s_name").alias("media_key"))
    orders = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"))
    return B.bias_for_media(li.join(orders, "event_id", "left_semi"), media).select("event_id", "media_key", F.col("media_level.label_primary").alias("media_level"), F.size("article_level").alias("n_articles"))


@query("SELECT o_orderkey AS event_id, least(((o_orderpriority IN ('1-URGENT', '2-HIGH'))::INT + (o_orderstatus = 'O')::INT) / 2.0, 1.0)::DOUBLE AS boost FROM orders")
def topic_boost(spark, d):
    o = A.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("event_id"), R.topic_boost(F.array("o_orderpriority", "o_orderstatus"), ["1-URGENT", "2-HIGH", "O"]).alias("boost"))


@query(f"WITH {SCORED_SQL.replace('FROM orders LEFT JOIN ev', 'FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 61) o LEFT JOIN ev').replace('round(l_tax * 10, 6) AS junk', '0.1 AS junk')} SELECT event_id, round(score, 6) AS score, position FROM ranked WHERE position <= 20")
def ranked_feed(spark, d):
    """First page of the newest 61 events (the feed's window), ranked."""
    arts = A.item_articles(spark, d).drop("junk").withColumns({"url": F.lit(""), "title": F.lit(""), "snippet": F.lit("")})
    feed = R.ranked_feed(A.order_events(spark, d), arts, A.item_claims(spark, d), A.now(), momentum_hours=A.WINDOW_HOURS, half_life_hours=A.WINDOW_HOURS)
    return feed.select("event_id", *r6("score"), F.col("position").cast("long").alias("position"))


@query("SELECT o_orderkey AS event_id, to_base64(encode(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') || '|' || o_orderkey)) AS cursor, true AS valid, o_orderkey::VARCHAR AS back FROM orders")
def encode_cursor(spark, d):
    """Cursor of every order, checked and read back."""
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), X.encode_cursor(A.ts("o_orderdate"), F.col("o_orderkey")).alias("cursor"))
    return o.select("event_id", "cursor", X.valid_cursor(F.col("cursor")).alias("valid"), X.decode_cursor(F.col("cursor"))["event_id"].alias("back"))


@query("SELECT doc_id, false AS valid FROM documents")
def valid_cursor(spark, d):
    """No document's text is a cursor."""
    return A.table(spark, d, "documents").select("doc_id", X.valid_cursor(F.coalesce("text", F.lit(""))).alias("valid"))


@query("WITH l AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1) SELECT o_orderkey AS event_id, text AS headline, CASE WHEN role = 'user' THEN 'u' END AS teaser, coalesce(role = 'user', false) AS has_overview FROM orders LEFT JOIN l ON conv_id = o_orderkey")
def feed_items(spark, d):
    """Feed rows of all orders; conversations are their versions."""
    user = F.col("role") == "user"
    texts = F.when(user, F.array(F.lit("w"))).otherwise(F.array().cast("array<string>"))
    v = A.turn_versions(spark, d).withColumns({"ai_teaser": F.when(user, "u").otherwise(""), "ai_overview": F.struct(texts.alias("what_happened"), texts.alias("context"))})
    return D.feed_items(states(spark, d), v).select("event_id", "headline", "teaser", F.col("ai_overview").isNotNull().alias("has_overview"))


@query(f"SELECT l_orderkey AS event_id, s_name AS media_key, count(DISTINCT {ARTICLE})::INT AS n_articles FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2")
def media_tabs(spark, d):
    """Articles of every order by supplier."""
    li = links(spark, d)
    arts = li.select("article_id", "media_id", F.lit("").alias("title"), F.lit("").alias("snippet"), F.lit("").alias("url"), F.col("linked_at").alias("published_at")).dropDuplicates(["article_id"])
    media = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("media_id"), F.col("s_name").alias("media_key"))
    tabs = D.media_tabs(li.select("event_id", "article_id").distinct(), arts, media)
    return tabs.select("event_id", "media_key", F.size("articles").alias("n_articles"))


@query("WITH l AS (SELECT conv_id, max(turn) AS v FROM conversations GROUP BY 1), m AS (SELECT l_orderkey, count(DISTINCT l_suppkey)::INT AS n FROM lineitem GROUP BY 1), t AS (SELECT l_suppkey, count(DISTINCT l_returnflag)::INT AS n FROM lineitem GROUP BY 1) SELECT o_orderkey AS event_id, v::INT AS version_index, m.n AS tabs, t.n AS topics FROM orders LEFT JOIN l ON conv_id = o_orderkey LEFT JOIN m ON m.l_orderkey = o_orderkey LEFT JOIN t ON t.l_suppkey = o_orderkey")
def event_detail(spark, d):
    """Nested documents of all orders, summed up by the sizes of their parts."""
    li = links(spark, d)
    tabs = li.groupBy("event_id", F.col("media_id").cast("string").alias("media_key")).agg(F.array_sort(F.collect_set("article_id")).alias("articles")).withColumn("highlights", F.array().cast("array<string>"))
    w = A.item_topics(spark, d)
    topics = P.event_top_topics(w)
    heat = P.topic_heatmap(w.select("event_id", "t0").distinct(), w, A.WINDOW_HOURS)
    none = states(spark, d).where("1 = 0")
    over = none.select("event_id", F.lit("").alias("version_id"), F.lit("").alias("gate_status"), F.array().cast("array<string>").alias("sections"))
    subs = none.select("event_id", F.lit("").alias("version_id"), F.array().cast("array<string>").alias("subevents"))
    labels = none.select("event_id", *[F.lit(None).cast("string").alias(c) for c in ("article_id", "media_id", "label_primary", "label_secondary", "intensity", "confidence", "degraded")])
    doc = D.event_detail(states(spark, d), A.turn_versions(spark, d), tabs, over, labels, labels, topics, heat, subs)
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return doc.select("event_id", F.col("latest_version.version_index").alias("version_index"), size("media_tabs").alias("tabs"), size("top_topics").alias("topics"))


@query("SELECT event_id, array_to_string(list_filter([CASE WHEN event_type = 'error' THEN 'event_name missing' END, CASE WHEN event_type = 'click' THEN 'occurred_at no date-time' END, CASE WHEN event_type = 'view' THEN 'extra keys' END], lambda x: x IS NOT NULL), ',') AS errors FROM events")
def validate_envelope(spark, d):
    """Envelopes made from every event; three types carry one fault each."""
    e = A.table(spark, d, "events")
    kind = F.col("event_type")
    j = F.to_json(F.struct(F.when(kind == "error", "").otherwise(kind).alias("event_name"), F.col("event_id").cast("string").alias("event_id"), F.when(kind == "click", "yesterday").otherwise("2024-01-02T03:04:05Z").alias("occurred_at"), F.struct(F.lit("t").alias("trace_id"), F.lit("s").alias("span_id"), F.lit("m").alias("source_module")).alias("trace"), F.struct(F.col("value").alias("v")).alias("payload"), F.when(kind == "view", 1).alias("more")))
    return E.validate_envelope(e.select("event_id", j.alias("json"))).select("event_id", F.array_join("errors", ",").alias("errors"))


@query("SELECT event_id::VARCHAR AS event_id, 'OVERVIEW' AS entity_type, event_id::VARCHAR AS entity_id FROM events")
def entity_of_event(spark, d):
    """Entity of every message; these payloads name none."""
    e = A.log_events(spark, d)
    return e.select("event_id", E.entity_of_event(F.col("payload"), F.col("event_id")).alias("x")).select("event_id", "x.*")


@query("SELECT 'log_' || event_type || '_total' AS name, 'counter' AS type, '' AS label, count(*)::DOUBLE AS value FROM events GROUP BY 1 UNION ALL SELECT 'users_gauge', 'gauge', '', count(DISTINCT user_id)::DOUBLE FROM events")
def metrics_exposition(spark, d):
    """Counters per type and a gauge in the exposition's rows."""
    log = A.log_events(spark, d)
    counters = log.groupBy(F.concat(F.lit("log."), "event_name", F.lit(".total")).alias("metric")).agg(F.count("*").alias("value"))
    gauges = log.agg(F.countDistinct("user_id").alias("value")).select(F.lit("users.gauge").alias("metric"), "value")
    none = counters.where("1 = 0").select("metric", *[F.lit(None).cast("double").alias(c) for c in ("p50", "p95", "p99", "count")])
    return E.metrics_exposition(counters, gauges, none)


@query("SELECT o_orderkey AS event_id, round(0.6 * exp(-(epoch_ms(TIMESTAMP '2001-08-01') - epoch_ms(o_orderdate)) / 7776000000.0) + 0.4 * least(1.0, (o_orderkey % 7) / 5.0), 6) AS score FROM orders")
def freshness_diversity_score(spark, d):
    o = A.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("event_id"), F.round(R.freshness_diversity_score(A.ts("o_orderdate"), F.col("o_orderkey") % 7, A.now(), A.WINDOW_HOURS), 6).alias("score"))


@query(f"SELECT l_suppkey AS event_id, (epoch_ms(l_shipdate) // {WINDOW_MS}) AS slot, count(*) AS n FROM lineitem GROUP BY 1, 2")
def tumbling_counts(spark, d):
    """Line items per supplier and 90-day slot."""
    li = A.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("event_id"), F.floor(F.unix_millis(A.ts("l_shipdate")) / WINDOW_MS).cast("long").alias("slot"))
    return li.groupBy("event_id", "slot").agg(F.count("*").alias("n"))
