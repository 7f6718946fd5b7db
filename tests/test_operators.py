from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsengine.operators import bias, claims, eventlog, feed, ingest, lifecycle, linking, overview, ranking, topics, vectors
from newsengine.sources import tables

T0 = datetime(2024, 1, 10)
def now():
    return F.lit("2024-01-10 00:00:00").cast("timestamp")


def h(n):
    return T0 + timedelta(hours=n)


# ---- ingestion


def test_discover_urls(spark):
    page = '<a href="https://flip.org.co/pronunciamientos/uno">x</a><a href=\'https://flip.org.co/pronunciamientos/dos\'></a><a href="https://flip.org.co/pronunciamientos/uno"></a><a href="https://flip.org.co/pronunciamientos/x?page=2"></a><a href="https://flip.org.co/otros/y"></a>'
    pages = spark.createDataFrame([("flip", "l", page), ("nadie", "l", page), ("flip", "m", None)], "media_key string, url string, html string")
    got = [(r.pos, r.url) for r in ingest.discover_urls(pages, ingest.site_rules(spark)).orderBy("pos").collect()]
    assert got == [(0, "https://flip.org.co/pronunciamientos/uno"), (1, "https://flip.org.co/pronunciamientos/dos")]


def test_parse_and_normalize(spark):
    page = '<meta property="og:title" content="T"><meta property="article:published_time" content="2024-01-02T03:04:05Z"><p>' + "x" * 700 + "</p>"
    pages = spark.createDataFrame([("flip", "u1", page), ("flip", "u2", page), ("flip", "u3", "<p>none"), ("none", "u4", page), ("flip", "u1", page)], "media_key string, url string, html string")
    parsed = ingest.parse_article(pages, ingest.site_rules(spark))
    media = spark.createDataFrame([("flip", "m1")], "media_key string, media_id string")
    old = spark.createDataFrame([("u2",)], "url string")
    got = sorted((r.url, r.outcome, len(r.snippet)) for r in ingest.normalize_article(parsed, media, old).collect())
    assert got == [("u1", "DUPLICATE_URL", 600), ("u1", "NORMALIZED", 600), ("u2", "DUPLICATE_URL", 600), ("u3", "PARSE_FAIL", 0), ("u4", "FETCH_FAIL", 0)]
    assert parsed.where("url = 'u2'").first().published_at == datetime(2024, 1, 2, 3, 4, 5)
    assert ingest.parse_article(spark.createDataFrame([("flip", "u", '<meta name="datePublished" content="mañana">')], "media_key string, url string, html string"), ingest.site_rules(spark)).first().published_at is None


def test_policy_gate(spark):
    es = "la casa de los niños en el parque con una fuente y " * 2
    rows = [(1, "m1", es), (2, "m2", es), (3, "m9", es), (4, "m1", es[:79].ljust(79, "x")), (5, "m1", "the house of the people in the city and the river " * 2), (6, "m1", None)]
    arts = spark.createDataFrame(rows, "article_id int, media_id string, snippet string")
    media = spark.createDataFrame([("m1", True), ("m2", False)], "media_id string, allowlisted boolean")
    got = {r.article_id: r.blocked_reason for r in ingest.policy_gate(arts, media).collect()}
    assert got == {1: None, 2: "NOT_ALLOWLISTED", 3: "NOT_ALLOWLISTED", 4: "NO_EXTRACT", 5: "NOT_SPANISH", 6: "NO_EXTRACT"}


# ---- vectors and linking


def test_hash_embedding(spark):
    arts = spark.createDataFrame([(1, "Reforma", "reforma tributaria"), (2, "", None), (3, "Reforma", "reforma tributaria")], "article_id int, title string, snippet string")
    got = {r.article_id: r for r in vectors.hash_embedding(arts).collect()}
    assert got[1].embedding_vec == got[3].embedding_vec and got[1].embedding_hash == got[3].embedding_hash
    assert abs(sum(x * x for x in got[1].embedding_vec) - 1) < 1e-9 and got[2].embedding_vec == [0.0] * 256
    sparse = {(r.slot, round(r.value, 9)) for r in vectors.hash_embedding_rows(arts).where("article_id = 1").collect()}
    assert sparse == {(i, round(x, 9)) for i, x in enumerate(got[1].embedding_vec) if x}
    assert vectors.embed_incremental(arts, vectors.hash_embedding(arts).where("article_id <> 3")).count() == 1


def test_cosine_and_centroid(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], [1.0, 0.0]), (2, [1.0, 0.0], [0.0, 1.0]), (3, [0.0, 0.0], [1.0, 0.0]), (4, [1.0], [1.0, 0.0]), (5, None, [1.0])], "id int, a array<double>, b array<double>")
    assert [r.c for r in df.orderBy("id").select(vectors.cosine_similarity(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0]
    c = vectors.centroid(spark.createDataFrame([(1, [1.0, 3.0]), (1, [3.0, 5.0]), (2, None)], "event_id int, embedding_vec array<double>")).collect()
    assert [(r.event_id, r.centroid, r.n) for r in c] == [(1, [2.0, 4.0], 2)]


def scored(spark, rows):
    return spark.createDataFrame(rows, "article_id int, event_id string, score double, unique_media int, block_reasons array<string>")


def test_decide_link(spark):
    arts = spark.createDataFrame([(i,) for i in range(1, 8)], "article_id int")
    rows = [(1, "e1", 0.62, 1, []), (2, "e1", 0.55, 2, []), (3, "e1", 0.55, 1, []), (4, "e1", 0.49, 5, []), (5, "e1", 0.99, 5, ["city_mismatch"]), (6, "e1", 0.7, 1, []), (6, "e0", 0.7, 1, []), (5, "e2", 0.3, 3, [])]
    got = {r.article_id: (r.action, r.event_id) for r in linking.decide_link(arts, scored(spark, rows)).collect()}
    assert got == {1: ("LINK", "e1"), 2: ("LINK", "e1"), 3: ("CREATE", None), 4: ("CREATE", None), 5: ("CREATE", None), 6: ("LINK", "e0"), 7: ("CREATE", None)}
    verdicts = spark.createDataFrame([(2, 0.9, True, "e1"), (3, 0.6, False, "e9"), (1, 0.0, True, None)], "article_id int, same_event double, hard_block boolean, best_event_id string")
    got = {r.article_id: (r.action, r.event_id) for r in linking.decide_link(arts, scored(spark, rows), verdicts).collect()}
    assert got[1] == ("LINK", "e1") and got[2] == ("CREATE", None) and got[3] == ("LINK", "e9")


def test_hard_block_and_time(spark):
    cases = [
        ("a", "b", None, None, 0.9, 0.9, None, "action_incompatible"),
        ("", "b", "Cali", "cali", 0.9, 0.9, None, ""),
        (None, "b", "Cali", "Bogotá", 0.7, 0.7, None, "city_mismatch"),
        (None, None, "Cali", "Bogotá", 0.69, 0.9, None, ""),
        (None, None, None, None, None, None, h(7 * 24), ""),
        (None, None, None, None, None, None, h(7 * 24 + 1), "date_gap"),
    ]
    df = spark.createDataFrame([(i, *c, T0) for i, c in enumerate(cases)], "i int, aa string, ea string, ac string, ec string, ap double, ep double, d timestamp, want string, t timestamp")
    a = {"action": F.col("aa"), "city": F.col("ac"), "city_conf": F.col("ap"), "fact_date": F.col("d")}
    e = {"action": F.col("ea"), "city": F.col("ec"), "city_conf": F.col("ep"), "fact_earliest": F.col("t"), "fact_latest": F.lit(None).cast("timestamp")}
    for r in df.withColumn("got", F.array_join(linking.hard_block(a, e), ",")).collect():
        assert r.got == r.want, r
    near = df.limit(1).select(linking.temporal_proximity(F.lit(None).cast("timestamp"), F.col("t"), F.col("t")).alias("a"), linking.temporal_proximity(F.col("t") + F.expr("INTERVAL 3 DAYS"), F.col("t"), F.lit(None).cast("timestamp")).alias("b")).first()
    assert near.a == 0.5 and abs(near.b - 0.5) < 1e-3


def test_link_incremental_and_merge(spark):
    arts = spark.createDataFrame([(1, "m1", "Juan Pérez", "habla en Cali", T0), (2, "m2", "Juan Pérez", "habla en Cali", T0), (3, "m1", "Otra Cosa", "distinta del todo", T0)], "article_id int, media_id string, title string, snippet string, published_at timestamp")
    batch = vectors.hash_embedding(arts)
    events = batch.where("1=0").selectExpr("'' as event_id", "'' as state", "published_at as t0", "published_at as t_last")
    made, new, merges = linking.link_incremental(batch, events, events.selectExpr("event_id", "cast(null as int) as article_id"), batch.where("1=0"), now())
    by = {r.article_id: r.event_id for r in made.collect()}
    assert len(by) == 3 and by[1] == by[2] != by[3] and new.count() == 2
    ev = "event_id string, centroid array<double>, article_count int, t0 timestamp"
    fresh = spark.createDataFrame([("n", [1.0, 0.0], 1, h(5))], ev)
    old = spark.createDataFrame([("c1", [0.0, 1.0], 1, h(0)), ("c2", [1.0, 0.1], 1, h(1)), ("c3", [1.0, 0.0], 1, h(2)), ("c0", [1.0, 0.0], 25, h(0))], ev)
    r = linking.merge_check(fresh, old).first()
    assert (r.candidate_id, r.canonical_id, r.merged_id) == ("c2", "c2", "n")
    assert linking.merge_check(fresh, old, capped=False).first().candidate_id == "c0"


# ---- lifecycle


def test_lifecycle(spark):
    rows = [("a", "DETECTED", T0, None, None), ("b", "CLOSED", h(-500), None, None), ("c", "PUBLISHED", h(-168), h(-100), h(-200)), ("d", "PUBLISHED", h(-167), None, h(-200))]
    ev = spark.createDataFrame(rows, "event_id string, state string, t_last timestamp, publish_at timestamp, published_at timestamp").withColumn("closed_at", F.lit(None).cast("timestamp"))
    s = {r.event_id: r for r in lifecycle.schedule_publish(ev, now()).collect()}
    assert s["a"].state == "PENDING_PUBLISH" and s["a"].publish_at == T0 + timedelta(minutes=5) and s["b"].state == "CLOSED"
    early = lifecycle.publish_due(lifecycle.schedule_publish(ev, now()), now() + F.expr("INTERVAL 299 SECONDS"))
    late = lifecycle.publish_due(lifecycle.schedule_publish(ev, now()), now() + F.expr("INTERVAL 300 SECONDS"))
    assert early.where("event_id='a'").first().state == "PENDING_PUBLISH" and late.where("event_id='a'").first().state == "PUBLISHED"
    assert late.where("event_id='b'").first().state == "CLOSED" and late.where("event_id='c'").first().published_at == h(-200)
    c = {r.event_id: (r.state, r.close_reason) for r in lifecycle.close_stale(ev, now()).collect()}
    assert c == {"a": ("DETECTED", None), "b": ("CLOSED", None), "c": ("CLOSED", "INACTIVITY_7D"), "d": ("PUBLISHED", None)}
    jobs = lifecycle.refresh_slots(ev.union(ev).where("event_id='a'"), now() + F.expr("INTERVAL 1 SECOND")).collect()
    assert [(j.job_key, j.run_at) for j in jobs] == [("refresh:a:2024-01-10T00:30:00.000Z", T0 + timedelta(minutes=30))]


def test_versions(spark):
    ev = spark.createDataFrame([("e", "PUBLISHED", T0, T0, None), ("f", "DETECTED", None, None, None)], "event_id string, state string, t0 timestamp, t_last timestamp, published_at timestamp")
    links = spark.createDataFrame([("e", "a1", h(1)), ("e", "a2", h(2))], "event_id string, article_id string, linked_at timestamp")
    arts = spark.createDataFrame([("a1", "m", "uno", "s", "u1", None), ("a2", "x", "dos", "s", "u2", T0)], "article_id string, media_id string, title string, snippet string, url string, published_at timestamp")
    media = spark.createDataFrame([("m", "flip")], "media_id string, media_key string")
    none = spark.createDataFrame([], "event_id string, version_index int, packet struct<articles:array<struct<article_id:string>>>")
    p = {r.event_id: r for r in lifecycle.build_packet(ev, links, arts, media, none).collect()}
    assert p["e"].version_index == 0 and p["e"].headline == "dos" and [a.media_key for a in p["e"].packet.articles] == ["flip", "unknown"]
    assert p["f"].headline == "No headline" and p["f"].packet.articles == []
    old = spark.createDataFrame([("e", 3, ([("a1",)],))], none.schema)
    new = lifecycle.build_packet(ev, links, arts, media, old)
    d = {r.event_id: r for r in lifecycle.version_diff(new, old, F.lit("NEW_ARTICLE")).collect()}
    assert d["e"].version_index == 4 and d["e"].diff.added_articles == ["a2"] and d["f"].diff.added_articles == []


# ---- claims and overview

LONG = "El gobierno anunció una reforma tributaria integral"


def article(spark, *rows):
    return spark.createDataFrame([("e", "v", *r) for r in rows], "event_id string, version_id string, article_id string, media_id string, title string, snippet string")


def test_claims(spark):
    a = article(spark, ("a1", "m1", "T", f"{LONG} hoy. {LONG} hoy."), ("a2", "m2", "T", f"{LONG} hoy."), ("a3", "m1", "T", "x" * 39 + ". " + "corta."))
    got = claims.build_claims(a).collect()
    assert len(got) == 2
    c = next(r for r in got if "gobierno" in r.claim_text)
    assert (c.media_count, len(c.quotes), c.status, c.claim_type) == (2, 2, "SUPPORTED", "FACT")
    assert {q.strength for q in c.quotes} == {"STRONG"} and c.quotes[0].span_start == 3


def test_contradictions(spark):
    a = article(spark, ("a1", "m1", "T", f"{LONG} con 3 puntos nuevos."), ("a2", "m1", "T", f"{LONG} con 5 puntos nuevos."), ("a3", "m1", "T", "La ciudad celebra un festival musical con 8 bandas locales."))
    status = {r.claim_text: r.status for r in claims.build_claims(a).collect()}
    assert sorted(status.values()) == ["DISPUTED", "DISPUTED", "SUPPORTED"]
    b = article(spark, ("a1", "m1", "T", f"{LONG} con puntos nuevos."), ("a2", "m1", "T", f"{LONG} con puntos nuevos no."))
    assert claims.detect_contradictions(claims.extract_claims(b)).count() == 2


def test_top_tokens_order(spark):
    df = spark.createDataFrame([("e", "v", "c", "zeta alfa 2025 beta 1999 zeta gama delta omega")], "event_id string, version_id string, claim_id string, claim_text string")
    assert [r.token for r in claims.top_tokens(df).orderBy("rank").collect()] == ["zeta", "1999", "2025", "alfa", "beta"]


def test_extraction(spark):
    j = '{"claims":[{"claim_text":"Uno","claim_type":"X","polarity":"deny","confidence":0.4,"evidence":[{"source_url":"u","quote":"T. s"}]},{"claim_text":"uno!","confidence":0.9,"evidence":[{"source_url":"u","quote":"q"}]},{"claim_text":"Dos","confidence":1.2,"evidence":[{"source_url":"u","quote":"q"}]},{"claim_text":"Tres","claim_type":"OPINION","confidence":0.5,"evidence":[{"source_url":"zz","quote":"q"}]}]}'
    ex = spark.createDataFrame([("e", "v", j), ("e", "w", "no json"), ("e", "x", None)], "event_id string, version_id string, json string")
    arts = spark.createDataFrame([("e", "u", "a1", "m1", "T", "s")], "event_id string, url string, article_id string, media_id string, title string, snippet string")
    got = {r.claim_text: r for r in claims.claims_from_extraction(ex, arts).collect()}
    assert set(got) == {"Uno", "Tres"} and (got["Uno"].status, got["Uno"].claim_type, got["Uno"].quotes[0].span_start) == ("DISPUTED", "FACT", 0)
    assert (got["Tres"].status, got["Tres"].claim_type, got["Tres"].quotes) == ("SUPPORTED", "OPINION", [])


def test_overview(spark):
    q = "quotes array<struct<quote_id:string,article_id:string,media_id:string>>"
    rows = [("e", "v", 1, "c1", "uno", "FACT", "SUPPORTED", [("q", "a", "m")]), ("e", "v", 2, "c2", "dos", "OPINION", "SUPPORTED", [("q", "a", "m")]), ("e", "v", 3, "c3", "tres", "FACT", "DISPUTED", [("q", "a", "n")]), ("e", "v", 4, "c4", "x", "FACT", "INSUFFICIENT", []), ("f", "v", 1, "c5", "y", "FACT", "SUPPORTED", [("q", "a", "m")])]
    df = spark.createDataFrame(rows, f"event_id string, version_id string, ord int, claim_id string, claim_text string, claim_type string, status string, {q}")
    got = {r.event_id: r for r in overview.overview_sections(df).collect()}
    assert got["e"].gate_status == "PASS" and [len(s.bullets) for s in got["e"].sections] == [1, 1, 1, 0] and got["e"].evidence_rate == 0.5
    assert got["f"].gate_status == "FAIL" and [len(s.bullets) for s in got["f"].sections] == [0, 0, 0, 0]
    assert {r.event_id: r.reasons for r in overview.evidence_counts(df).collect()} == {"e": [], "f": ["SINGLE_SOURCE", "MISSING_QUOTES"]}
    o = spark.range(1).select(overview.normalize_ai_overview(F.lit('{"confidence_label":"Altísima","what_happened":["a"],"disputes":[{"topic":"t","confidence":7}]}')).alias("o"), overview.normalize_ai_overview(F.lit("broken")).alias("b"), overview.insufficient_overview(F.array(F.lit("SINGLE_SOURCE"))).alias("i")).first()
    assert (o.o.confidence_label, o.o.what_happened, o.o.context, o.o.disputes[0].confidence) == ("No concluyente", ["a"], [], 1.0)
    assert o.b.what_happened == [] and o.i.why == "Bloqueado por gates: SINGLE_SOURCE"


# ---- topics, bias


def test_topics(spark):
    arts = spark.createDataFrame([(1, "Policía policia seguridad"), (2, "nada de nada que ver"), (3, "hospital banco fiscal")], "article_id int, text string")
    got = sorted((r.article_id, r.topic_key, round(r.weight, 3)) for r in topics.top_topics_per_article(arts, topics.score_topics(arts, topics.topic_lexicon(spark))).collect())
    assert got == [(1, "SEGURIDAD", 0.667), (2, "OTROS", 1.0), (3, "ECONOMIA", 0.667), (3, "JUSTICIA", 0.333)]


def test_heatmap_and_drift(spark):
    seq = [(2, "A"), (8, "A"), (14, "B"), (20, "B"), (26, "B"), (-1, "C"), (8 * 24, "C")]
    w = spark.createDataFrame([("e", T0, h(n), t, 1.0) for n, t in seq] + [("e", T0, None, "C", 1.0)], "event_id string, t0 timestamp, published_at timestamp, topic_key string, weight double")
    heat = topics.topic_heatmap(w.select("event_id", "t0").distinct(), w).orderBy("bin_index").collect()
    assert len(heat) == 28 and [heat[k].topics for k in (0, 2, 5)] == [{"A": 1.0}, {"B": 1.0}, {}]
    assert [(r.event_id, r.drift_topic, r.start_bin) for r in topics.topic_drift(topics.heatmap_rows(w)).collect()] == [("e", "B", 2)]
    alternating = spark.createDataFrame([("e", T0, h(6 * k + 1), t, 1.0) for k, t in enumerate("ABABAB")], w.schema)
    assert topics.topic_drift(topics.heatmap_rows(alternating)).count() == 0
    gap = spark.createDataFrame([("e", T0, h(6 * k + 1), t, 1.0) for k, t in ((0, "A"), (1, "B"), (2, "B"), (4, "B"))], w.schema)
    assert topics.topic_drift(topics.heatmap_rows(gap)).count() == 0


def test_emergent_divergence_subevents(spark):
    c = spark.createDataFrame([("e", "v", k, f"c{k}", t, "SUPPORTED") for k, t in enumerate(["marea roja llega hoy", "otra marea roja crece", "la marea roja sigue", "gobierno presidente dice", "x"])], "event_id string, version_id string, ord int, claim_id string, claim_text string, status string")
    counts = lambda n: spark.createDataFrame([("e", "v", n)], "event_id string, version_id string, article_count int")
    lex = topics.topic_lexicon(spark)
    assert [r.topic_key for r in topics.emergent_topics(c, counts(3), lex).collect()] == ["EMERG_MAREA_ROJA"]
    assert topics.emergent_topics(c, counts(2), lex).count() == 0
    d = topics.claim_divergence(c)
    r = d.first()
    assert r.label == "RAMA: marea roja" and r.claim_ids == ["c0", "c1", "c2"]
    assert topics.claim_divergence(c, spark.createDataFrame([("c0",)], "claim_id string")).count() == 0
    drift = spark.createDataFrame([("e", "B", 2)], "event_id string, drift_topic string, start_bin int")
    asg = spark.createDataFrame([("e", "B", "a1"), ("e", "B", "a1"), ("e", "A", "a2")], "event_id string, topic_key string, article_id string")
    s = topics.build_subevents(counts(1).select("event_id", "version_id"), drift, asg, d).first().subevents
    assert [(x.label, x.article_ids, x.key_claim_ids) for x in s] == [("FASE 2: B", ["a1"], []), ("RAMA: marea roja", [], ["c0", "c1", "c2"])]


def test_bias(spark):
    a = spark.createDataFrame([("e", "v", "a1", "m1", "Terrible", "tragico y devastador"), ("e", "v", "a2", "m1", "No", "según la entidad no hay cifra")], "event_id string, version_id string, article_id string, media_id string, title string, snippet string")
    rows = bias.bias_article_level(a)
    got = {r.article_id: r for r in rows.collect()}
    assert got["a1"].emotional == 0.75 and got["a1"].intensity == 1.0 and got["a1"].rationale.signals == ["lenguaje emocional"]
    assert abs(got["a2"].negation - 2 / 7) < 1e-9 and abs(got["a2"].attribution - 1 / 7) < 1e-9
    assert got["a1"].rationale.evidence_refs[0].id == "a1" and got["a1"].label_primary == "EMOCIONAL"
    prof = spark.createDataFrame([("m1", {"emotional": 1.0}, 4)], "media_id string, avg_features map<string,double>, articles_processed long")
    m = bias.bias_media_level(rows, prof).first()
    assert abs(m.emotional - (0.7 + 0.3 * 0.375)) < 1e-9 and abs(m.negation - 0.3 / 7) < 1e-9
    means = spark.createDataFrame([(k, "m1", *([float(k)] + [0.0] * 7), 2) for k in (1, 2, 3)], "event_id int, media_id string, " + ", ".join(f"{f} double" for f in bias.FEATURES) + ", articles int")
    x = 1.0
    for k in (1, 2, 3):
        x = 0.7 * x + 0.3 * k
    p = bias.media_profile_update(means, prof).first()
    assert abs(p.avg_features["emotional"] - x) < 1e-9 and p.articles_processed == 10
    y = 1.0
    for k in (2, 3):
        y = 0.7 * y + 0.3 * k
    assert abs(bias.media_profile_update(means, prof.limit(0)).first().avg_features["emotional"] - y) < 1e-9
    low = bias.bias_safeguard(rows).where("article_id = 'a1'").first()
    assert (low.label_primary, low.degraded_reason) == ("INCONCLUSO", "low_confidence")


# ---- ranking and feed


def rank(spark, arts, claims_=(), published=T0):
    ids = sorted({a[0] for a in arts}) or ["e"]
    ev = spark.createDataFrame([(i, published, None) for i in ids], "event_id string, published_at timestamp, t0 timestamp")
    a = spark.createDataFrame(list(arts), "event_id string, media_id string, junk double, published_at timestamp").withColumn("created_at", F.col("published_at"))
    c = spark.createDataFrame(list(claims_), "event_id string, status string")
    return {r.event_id: r for r in ranking.event_score(ev, a, c, now()).collect()}


def test_event_scores(spark):
    old = h(-100)
    r = rank(spark, [("one", "m1", 0.0, old)] * 4 + [("two", m, 0.0, old) for m in ("m1", "m1", "m2", "m2")] + [("junk", "m1", 0.8, old)] + [("mix", "m1", 0.8, old), ("mix", "m2", 0.0, old)])
    assert r["two"].score > r["one"].score and r["one"].dominance_penalty and not r["two"].dominance_penalty
    assert r["junk"].junk_excluded and r["junk"].score == -1 and not r["mix"].junk_excluded
    many = rank(spark, [("ten", "m1", 0.0, old)] * 10 + [("six", m, 0.0, old) for m in ("m1", "m2") for _ in range(3)])
    assert many["six"].score > many["ten"].score
    fresh = rank(spark, [("e", "m1", 0.44, T0), ("e", "m2", 0.45, T0)], [("e", "SUPPORTED"), ("e", "DISPUTED")])["e"]
    assert fresh.updates_6h == 1 and fresh.quality == 0.5 and abs(fresh.recency - 1) < 1e-12
    assert abs(rank(spark, [("e", "m", 0.0, old)], published=h(-12))["e"].recency - 0.5) < 1e-3
    assert rank(spark, [])["e"].quality == 0


def test_sticky_rank(spark):
    rows = [(f"e{k}", h(-k), 1, None, False) for k in range(8)] + [("moved", h(-100), 1, 0, False), ("free", h(-101), 1, 0, True)]
    df = spark.createDataFrame(rows, "event_id string, t_last timestamp, unique_media int, previous_position int, headline_changed boolean").withColumns({"has_new_supported_claim": F.lit(False), "has_new_media": F.lit(False)})
    got = {r.event_id: r.position for r in ranking.sticky_rank(df, now()).collect()}
    assert got["moved"] in (3, 4) and got["free"] == 9 and sorted(got.values()) == list(range(10))
    assert ranking.sticky_rank(df.limit(0), now()).count() == 0


def test_pages_do_not_skip(spark):
    ev = spark.createDataFrame([(k, "PUBLISHED", h(k // 3)) for k in range(47)] + [(99, "CLOSED", T0)], "event_id int, state string, published_at timestamp")
    seen, cursor = [], None
    from newsengine.functions.text import encode_cursor

    while True:
        page = feed.chronological_feed(ev, cursor).orderBy("position").withColumn("c", encode_cursor(F.col("published_at"), F.col("event_id"))).collect()
        seen += [r.event_id for r in page]
        if not page or not page[0].has_more:
            break
        cursor = page[-1].c
    assert seen == sorted(range(47), key=lambda k: (-(k // 3), -k))
    assert len(feed.chronological_feed(ev, "garbage").collect()) == 20


def test_history(spark):
    v = spark.createDataFrame([("u", f"e{k % 250}", h(k)) for k in range(400)], "user_id string, event_id string, viewed_at timestamp")
    got = feed.viewed_history(v).orderBy("position").collect()
    assert len(got) == 200 and got[0].event_id == "e149" and got[0].viewed_at == h(399)


# ---- tables and log


def test_table_maintenance(spark):
    seeds = tables.media_seeds(spark)
    media = spark.createDataFrame([("flip", "old name", False)], "media_key string, name string, allowlisted boolean")
    once = tables.seed_media(media, seeds)
    assert once.count() == 8 and tables.seed_media(once, seeds).count() == 8 and once.where("name = 'old name'").count() == 1
    p = {r.media_key: r.profile for r in tables.seed_profiles(spark.createDataFrame([("flip", {"license": "x", "k": "v"})], "media_key string, profile map<string,string>"), seeds).collect()}
    assert p["flip"]["license"] == "CC-BY-NC 4.0" and p["flip"]["k"] == "v" and len(p) == 6
    links = spark.createDataFrame([("e", "a")], "event_id string, article_id string")
    assert tables.link_article_upsert(links, links.union(spark.createDataFrame([("e", "b"), ("e", "b")], links.schema))).count() == 2
    packets = spark.createDataFrame([("v", "e", "o", 1), ("w", "e", "p", 2)], "version_id string, event_id string, overview string, n int")
    stage = spark.createDataFrame([("v", None, "t")], "version_id string, overview string, topics string")
    got = {r.version_id: (r.overview, r.topics, r.n) for r in tables.packet_merge(packets, stage).collect()}
    assert got == {"v": (None, "t", 1), "w": ("p", None, 2)}


def test_audit_log(spark, tmp_path):
    rows = spark.createDataFrame([(h(k), "EVENT", "e1", "X") for k in range(3)], "occurred_at timestamp, entity_type string, entity_id string, action string")
    tables.audit_append(rows, str(tmp_path / "log"))
    tables.audit_append(rows, str(tmp_path / "log"))
    got = tables.audit_by_entity(spark.read.parquet(str(tmp_path / "log")), "EVENT", "e1").collect()
    assert len(got) == 6 and got[0].occurred_at == h(2)


@pytest.mark.parametrize(
    "name, payload, want",
    [
        ("EventClosed", '{"event_id":"e","closed_at":"2024-01-01T00:00:00Z","close_reason":"INACTIVITY_7D"}', []),
        ("EventClosed", '{"event_id":"e","closed_at":"2024-13-01T00:00:00Z","close_reason":"OTHER"}', ["closed_at invalid", "close_reason invalid"]),
        ("ArticlePolicyOk", '{"article_id":"a","x":1}', ["extra keys"]),
        ("ArticlePolicyOk", "{}", ["article_id missing"]),
        ("Nothing", "{}", ["unknown event"]),
        ("EventPacketBuilt", '{"event_id":"e","version_index":1.5}', ["version_index invalid"]),
        ("ArticlePolicyOk", None, ["article_id missing"]),
    ],
)
def test_payload_contracts(spark, name, payload, want):
    df = spark.createDataFrame([(name, payload)], "event_name string, payload string")
    assert eventlog.validate_payload(df, eventlog.contract_table(spark)).first().payload_errors == want


def test_envelopes_and_metrics(spark):
    ok = '{"event_name":"A","event_id":"1","occurred_at":"2024-01-01T00:00:00.000Z","trace":{"trace_id":"t","span_id":"s","source_module":"m"},"payload":{}}'
    bad = [ok.replace('"A"', '""'), ok.replace("2024-01-01T", "x"), ok.replace('"span_id":"s",', ""), ok.replace('"payload":{}', '"payload":{},"z":1'), "nope"]
    df = spark.createDataFrame([(ok,)] + [(b,) for b in bad], "json string")
    good, rest = eventlog.quarantine(eventlog.validate_envelope(df))
    assert good.count() == 1 and rest.count() == 5
    log = spark.createDataFrame([("OverviewGenerated", '{"gate_status":"FAIL"}'), ("OverviewGenerated", '{"gate_status":"PASS"}'), ("SubEventsBuilt", '{"subevent_count":3}'), ("Other", "{}")], "event_name string, payload string")
    assert {r.metric: r.value for r in eventlog.pipeline_counters(log).collect()} == {"overview.generated.total": 2, "overview.gate_fail.total": 1, "subevent.built.total": 1, "subevent.detected.total": 3}
    v = spark.createDataFrame([("m", float(k), h(k)) for k in range(4)], "metric string, value double, ts timestamp")
    r = eventlog.histogram_summary(v).first()
    assert (r["count"], r.p50, r.p95, r.p99) == (4, 2.0, 3.0, 3.0)


def test_canonical_chains_of_any_length(spark):
    rows = [(k, k - 1 if k % 40 else None) for k in range(120)] + [(500, 499)]
    got = {r.event_id: r.canonical_id for r in linking.resolve_canonical(spark.createDataFrame(rows, "event_id long, canonical_event_id long")).collect()}
    assert got == {k: k // 40 * 40 for k in range(120)} | {500: 499}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 8, 1000])
def test_rings_of_any_length_resolve_to_their_least_id(spark, n):
    ring = [(5000 + k, 5000 + (k * 7 + 3) % n) for k in range(n)] if n in (1, 2, 4, 8) else [(5000 + k, 5000 + (k + 1) % n) for k in range(n)]
    order = {a: b for a, b in ring}
    into = [(k, 5000 + k % n) for k in range(10)]  # leads into the ring
    plain = [(100, None), (101, 100), (102, 101)]
    got = {r.event_id: r.canonical_id for r in linking.resolve_canonical(spark.createDataFrame(ring + into + plain, "event_id long, canonical_event_id long")).collect()}

    def end(k):
        seen = []
        while k not in seen:
            seen.append(k)
            k = order.get(k, k)
        return min(seen[seen.index(k) :])

    assert got == {a: end(a) for a, _ in ring} | {a: end(b) for a, b in into} | {100: 100, 101: 100, 102: 100}


def test_alike_articles_of_one_batch_link_to_each_other(spark):
    at = F.lit("2024-01-01").cast("timestamp")
    vec = lambda k: [float(i == k) for i in range(4)]
    rows = [(1, vec(0)), (2, vec(0)), (3, vec(1)), (4, vec(0)), (5, vec(1)), (6, vec(2))]
    batch = spark.createDataFrame(rows, "article_id long, embedding_vec array<double>").select("*", F.lit("Ana Diaz").alias("title"), F.lit("").alias("snippet"), F.lit("m").alias("media_id"), at.alias("published_at"))
    events = batch.where("1 = 0").select(F.lit("").alias("event_id"), F.lit("").alias("state"), at.alias("t0"), at.alias("t_last"))
    made, new, merges = linking.link_incremental(batch, events, events.select("event_id", F.lit(None).cast("long").alias("article_id")), batch.where("1 = 0"), at)
    groups = {}
    for r in made.collect():
        groups.setdefault(r.event_id, set()).add(r.article_id)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 4], [3, 5], [6]] and new.count() == 3
