import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from newsengine.operators import ingest
from newsengine.operators.bias import FEATURES
from newsengine.streaming import news, stages

T0 = datetime(2024, 1, 1)


def envelope(k, name="ArticlePolicyOk", at=None, payload=None):
    return json.dumps({"event_name": name, "event_id": f"m{k}", "occurred_at": (at or T0 + timedelta(minutes=k)).isoformat() + "Z", "trace": {"trace_id": "t", "span_id": "s", "source_module": "m"}, "payload": payload or {"article_id": f"a{k}"}})


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def source(spark, path, texts):
    spark.createDataFrame([(t,) for t in texts], "json string").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("json string").parquet(path)


def test_deduplicated_counters(spark, tmp_path):
    texts = [envelope(k) for k in range(40)] + [envelope(3), envelope(5), "broken"]
    stream = stages.deduplicated(stages.envelopes(source(spark, str(tmp_path / "in"), texts)))
    assert run(stream, "dedup_test", "append").count() == 40
    counted = run(stages.counters_per_slot(stages.envelopes(spark.readStream.schema("json string").parquet(str(tmp_path / "in")))), "slot_test", "update")
    rows = counted.groupBy("slot.start").agg(F.max("value").alias("v")).orderBy("start").collect()
    assert [r.v for r in rows] == [32, 10]


def test_sessions_close_once(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = [("e1", T0), ("e1", T0 + timedelta(days=3)), ("e2", T0), ("late", T0 + timedelta(days=30))]
    spark.createDataFrame(rows, "event_key string, ts timestamp").coalesce(1).write.parquet(path)
    closed = run(stages.closing_sessions(spark.readStream.schema("event_key string, ts timestamp").parquet(path)), "close_test", "append")
    assert sorted((r.event_key, r.closed_at, r.articles) for r in closed.collect()) == [("e1", T0 + timedelta(days=10), 2), ("e2", T0 + timedelta(days=7), 1)]


def test_running_profiles(spark, tmp_path):
    path = str(tmp_path / "p")
    schema = "media_id string, ord int, " + ", ".join(f"{f} double" for f in FEATURES) + ", articles int"
    spark.createDataFrame([("m", k, *([float(k)] + [0.0] * 7), 1) for k in (2, 1, 3)], schema).coalesce(1).write.parquet(path)
    got = run(stages.running_profiles(spark.readStream.schema(schema).parquet(path)), "profile_test", "update").collect()
    assert len(got) == 1 and abs(got[0].emotional - (0.7 * (0.7 * 1 + 0.3 * 2) + 0.3 * 3)) < 1e-9 and got[0].articles_processed == 3


def test_stage_chain_is_idempotent(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    steps = [
        ("parsed", lambda b: stages.envelopes(b), ["event_id"]),
        ("gated", lambda b: b.select("event_id", F.get_json_object("payload", "$.article_id").alias("article_id")), ["event_id"]),
    ]
    stages.chain(source(spark, path, [envelope(k) for k in range(5)]), steps, out)
    assert spark.read.parquet(f"{out}/gated").count() == 5
    stages.chain(source(spark, path, [envelope(k) for k in range(3, 8)]), steps, out)
    assert sorted(r.article_id for r in spark.read.parquet(f"{out}/gated").collect()) == [f"a{k}" for k in range(8)]
    again = stages.stage_sink(lambda b: b, f"{out}/gated", ["event_id"])
    again(spark.createDataFrame([("m1", "a1")], "event_id string, article_id string"), 9)
    assert spark.read.parquet(f"{out}/gated").count() == 8


def test_sink_reads_only_the_parts_of_a_batch(spark, tmp_path):
    path = str(tmp_path / "sink")
    put = stages.stage_sink(lambda b: b, path, ["k"])
    frame = lambda ks: spark.createDataFrame([(k, k * 2) for k in ks], "k long, v long")
    put(frame(range(50)), 0)
    put(frame(range(40, 60)), 1)
    put(frame(range(40, 60)), 1)
    put(frame([]), 2)
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == list(range(60))


NEWS = {
    "uno": ("Gobierno anuncia reforma de salud en Bogotá", "El gobierno de Gustavo Petro anunció la reforma de la salud en Bogotá. El ministro dijo que la reforma llega al congreso con 30 artículos para los hospitales."),
    "dos": ("Gobierno anuncia reforma de salud en Bogotá hoy", "El gobierno de Gustavo Petro anunció la reforma de la salud en Bogotá. El ministro dijo que la reforma llega al congreso con 30 artículos para los hospitales del país."),
    "tres": ("Lluvias dejan inundaciones en Chocó", "Las fuertes lluvias de la noche dejaron varias familias sin casa en el Chocó, según la oficina de riesgo de la región y los bomberos."),
    "corto": ("Sin texto", "Muy corto."),
}


def news_pages(spark, names):
    url = lambda n: f"https://flip.org.co/pronunciamientos/{n}"
    article = lambda n: f'<meta property="og:title" content="{NEWS[n][0]}"><meta property="og:description" content="{NEWS[n][1]}"><meta property="article:published_time" content="2024-01-02T03:04:05Z">'
    links = "".join(f'<a href="{url(n)}">x</a>' for n in names) + '<a href="https://flip.org.co/otros/y">y</a>'
    return ("flip", "list", links), [("flip", url(n), article(n)) for n in NEWS]


def test_ten_stages_run_as_one_and_again(spark, tmp_path):
    schema, path, out = "media_key string, url string, html string", str(tmp_path / "in"), str(tmp_path / "out")
    pages = spark.createDataFrame(news_pages(spark, NEWS)[1], schema)
    media = spark.createDataFrame([("m1", "flip", True)], "media_id string, media_key string, allowlisted boolean")
    steps = news.news_steps(out, media, pages, ingest.site_rules(spark), F.lit("2024-01-03").cast("timestamp"))

    def feed(names):
        spark.createDataFrame([news_pages(spark, names)[0], ("nadie", "l", None)], schema).coalesce(1).write.mode("append").parquet(path)
        stages.chain(spark.readStream.schema(schema).parquet(path), steps, out)
        sinks = {name: spark.read.parquet(f"{out}/{name}") for name, _, _ in steps}
        return {name: sorted(map(repr, df.select(*sorted(df.columns)).collect())) for name, df in sinks.items()}

    first = feed(["uno", "tres", "corto"])
    assert {k: len(v) for k, v in first.items()} == {"discovered": 3, "normalized": 3, "gated": 3, "embedded": 2, "linked": 2, "versioned": 2, "claimed": 2, "overviewed": 2, "themed": 2, "subevents": 2}
    assert feed(["uno", "tres", "corto"]) == first
    second = feed(["uno", "dos"])
    assert {k: len(v) for k, v in second.items()} == {"discovered": 4, "normalized": 4, "gated": 4, "embedded": 3, "linked": 3, "versioned": 3, "claimed": 3, "overviewed": 3, "themed": 3, "subevents": 3}
    assert [k for k in first if not set(first[k]) <= set(second[k])] == []
    grown = spark.read.parquet(f"{out}/themed").where("version_index = 1").first()
    assert sorted(a.title for a in grown.packet.articles) == [NEWS["uno"][0], NEWS["dos"][0]]
    assert grown.claims and len(grown.bias) == 2 and {t.topic_key for t in grown.topics} and grown.overview.claims_count == len(grown.claims)
    links = {r.title: r.event_id for r in spark.read.parquet(f"{out}/linked").collect()}
    assert links[NEWS["uno"][0]] == links[NEWS["dos"][0]] != links[NEWS["tres"][0]]
