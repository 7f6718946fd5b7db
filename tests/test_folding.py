"""Linking a batch against a plain loop that takes one article at a time."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsengine.operators import folding, linking

NOW = datetime(2024, 1, 10)
ARTICLE = "article_id long, media_id string, title string, snippet string, embedding_vec array<double>, published_at timestamp, action string, city string, city_conf double, fact_date timestamp"
EVENT = "event_id string, state string, t0 timestamp, t_last timestamp, action string, city string, city_conf double, fact_earliest timestamp, fact_latest timestamp"
NAMES = ["Ana Diaz", "Cali", "Bogotá", "Juan Pérez", "Medellín", "Luisa Rey"]


def cosine(a, b):
    norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / norm if norm else 0.0


def names_of(a):
    return {n.lower() for n in NAMES if n in a["title"]}


def blocks(a, e):
    if a["action"] and e["action"] and a["action"] != e["action"]:
        return True
    if a["city"] and e["city"] and a["city"].lower() != e["city"].lower() and min(a["city_conf"] or 0, e["city_conf"] or 0) >= 0.7:
        return True
    if a["fact_date"] and (e["first"] or e["last"]):
        low = e["first"] or a["fact_date"]
        high = e["last"] or low
        return max(low - a["fact_date"], a["fact_date"] - high) > timedelta(days=7)
    return False


def one_at_a_time(articles, events, now=NOW):
    """The plain loop: (event of each article, merges)."""
    home, merges = {}, {}
    for a in articles:
        best = None
        for e in events:
            if len(e["articles"]) > 25:
                continue
            vecs = [x["vec"] for x in e["articles"]]
            centroid = [sum(v) / len(vecs) for v in zip(*vecs, strict=True)]
            ents = set().union(*(names_of(x) for x in e["articles"]))
            mine = names_of(a)
            overlap = len(mine & ents) / len(mine | ents) if mine and ents else 0.0
            near = 0.5
            if a["at"] is not None:
                gap = max(e["t0"] - a["at"], a["at"] - e["t_last"], timedelta(0))
                near = math.exp(-0.693 * gap.total_seconds() / (3 * 86400))
            score = 0.55 * cosine(a["vec"], centroid) + 0.25 * overlap + 0.2 * near
            if not blocks(a, e) and (best is None or (-round(score, 9), e["id"]) < best[0]):
                best = ((-round(score, 9), e["id"]), score, e)
        if best and (best[1] >= 0.62 or (best[1] >= 0.5 and len({x["media"] for x in best[2]["articles"]}) >= 2)):
            best[2]["articles"].append(a)
            home[a["id"]] = best[2]["id"]
            continue
        new = {"id": folding.new_id(str(a["id"])), "t0": now, "t_last": now, "articles": [a], "action": None, "city": None, "city_conf": None, "first": None, "last": None}
        home[a["id"]] = new["id"]
        for e in sorted(events, key=lambda e: (e["t0"], e["id"])):
            vecs = [x["vec"] for x in e["articles"]]
            if len(e["articles"]) + 1 <= 25 and cosine(a["vec"], [sum(v) / len(vecs) for v in zip(*vecs, strict=True)]) >= 0.55:
                merges[new["id"]] = (e["id"], e["id"] if len(e["articles"]) > 1 or e["t0"] <= now else new["id"])
                break
        events.append(new)
    return home, merges


def article(rng, k, centres, spread, media=3):
    names = rng.sample(NAMES, rng.choice([0, 1, 1, 2]))
    vec = [c + rng.gauss(0, spread) for c in rng.choice(centres)]
    at = NOW - timedelta(hours=rng.randint(0, 200)) if rng.random() < 0.9 else None
    fact = NOW - timedelta(days=rng.randint(0, 20)) if rng.random() < 0.3 else None
    return {"id": k, "vec": vec, "title": " y también ".join(names), "media": f"m{rng.randint(0, media)}", "at": at, "action": rng.choice([None, None, "", "a", "b"]), "city": rng.choice([None, "Cali", "CALI", "Bogotá"]), "city_conf": rng.choice([None, 0.6, 0.9]), "fact_date": fact}


def frames(spark, articles, events):
    row = lambda a: (a["id"], a["media"], a["title"], "", a["vec"], a["at"], a["action"], a["city"], a["city_conf"], a["fact_date"])
    batch = spark.createDataFrame([row(a) for a in articles], ARTICLE)
    old = spark.createDataFrame([row(a) for e in events for a in e["articles"]], ARTICLE)
    evs = spark.createDataFrame([(e["id"], "DETECTED", e["t0"], e["t_last"], e["action"], e["city"], e["city_conf"], e["first"], e["last"]) for e in events], EVENT)
    links = spark.createDataFrame([(e["id"], a["id"]) for e in events for a in e["articles"]], "event_id string, article_id long")
    return batch, evs, links, old


def both_ways(spark, articles, events):
    at = F.lit(str(NOW)).cast("timestamp")
    made, new, merges = linking.link_incremental(*frames(spark, articles, events), at)
    got = {r.article_id: r.event_id for r in made.collect()}
    merged = {r.event_id: (r.candidate_id, r.canonical_id) for r in merges.collect()}
    opened = {r.event_id for r in new.collect()}
    known = {e["id"] for e in events}
    want, want_merges = one_at_a_time(articles, events)
    assert got == want
    assert merged == want_merges
    assert opened == set(want.values()) - known
    return want, want_merges


def made_events(rng, n, centres, spread):
    out = []
    for k in range(n):
        t0 = NOW - timedelta(hours=rng.randint(20, 160))
        one = rng.choice(centres)
        size = rng.choice([1, 2, 24, 25])
        arts = [article(rng, 10_000 + 100 * k + j, [one], spread) for j in range(size)]
        out.append({"id": f"old{k:02d}", "t0": t0, "t_last": t0 + timedelta(hours=rng.randint(0, 20)), "articles": arts, "action": rng.choice([None, "a"]), "city": rng.choice([None, "cali"]), "city_conf": 0.8, "first": rng.choice([None, NOW - timedelta(days=9)]), "last": rng.choice([None, NOW - timedelta(days=5)])})
    return out


@pytest.mark.parametrize(("seed", "spread", "n"), [(1, 0.35, 500), (2, 0.8, 300)])
def test_batch_equals_one_article_at_a_time(spark, seed, spread, n):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(10)] for _ in range(14)]
    articles = [article(rng, k, centres, spread) for k in range(n)]
    want, merges = both_ways(spark, articles, made_events(rng, 12, centres, spread))
    assert len(set(want.values())) < n and merges


def test_rounds_do_not_follow_a_chain_of_alike_articles(spark, monkeypatch):
    rng = random.Random(5)
    one = [[rng.gauss(0, 1) for _ in range(6)]]
    articles = [article(rng, k, one, 0.02) | {"action": None, "city": None, "fact_date": None} for k in range(120)]
    rounds = []
    crossings = folding.crossings
    monkeypatch.setattr(folding, "crossings", lambda *a: rounds.append(1) or crossings(*a))
    want, _ = both_ways(spark, articles, [])
    assert len(set(want.values())) >= 120 // 26  # the size limit opens an event after every 26
    assert len(rounds) <= 3


def test_empty_batch_and_articles_without_vectors(spark):
    at = F.lit(str(NOW)).cast("timestamp")
    rng = random.Random(6)
    one = article(rng, 1, [[1.0, 0.0]], 0.1)
    none = frames(spark, [one | {"vec": None}], [])
    assert [df.count() for df in linking.link_incremental(*none, at)] == [0, 0, 0]
    batch, *rest = frames(spark, [one], [])
    made, new, merges = linking.link_incremental(batch.union(batch), *rest, at)
    assert (made.count(), new.count(), merges.count()) == (1, 1, 0)
