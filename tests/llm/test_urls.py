import random
from itertools import combinations

from newsengine.llm.urls import MiningLimits, UrlRule, judge_urls, mine_rules, url_tokens
from pyspark.sql import functions as F

RULES = [UrlRule("block", "com", "en/"), UrlRule("allow", "example.com", "en/7"), UrlRule("allow", "net", "de/"), UrlRule("block", "example.net", "de/8"), UrlRule("block", "org", "es/")]


def test_hosts_paths_and_stated_rules(spark):
    cases = [
        ("http://A.Example.COM/en/7?x#y", "a.example.com", "/en/7", "example.com/en/7", "allow"),
        ("https://b.com/en/1", "b.com", "/en/1", "com/en/", "block"),
        ("https://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
        ("x://example.net/de/88", "example.net", "/de/88", "example.net/de/8", "block"),
        ("x://a.net/de/8", "a.net", "/de/8", "net/de/", "allow"),
        ("http://host", "host", "", None, "allow"),
        ("http://org/es/", "org", "/es/", "org/es/", "block"),
        ("http://h?q=/en/", "h", "", None, "allow"),
        ("a://b://c/d", "b:", "//c/d", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http://ÉÀ.com/\nx", "ÉÀ.com", "/\nx", None, "allow"),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)] * 2, "page_id long, url string").selectExpr("*", "'z' as host", "1 as verdict")
    mined = mine_rules(df.where("1=0").selectExpr("url", "true as blocked"))
    rows = judge_urls(df, RULES, mined).collect()
    assert len(rows) == 2 * len(cases)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == cases[r.page_id][1:], cases[r.page_id]
    assert judge_urls(df.limit(0), RULES, mined).count() == 0


def test_mined_rules_equal_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(400):
        host, lang, n = rng.choice(["casino", "farm", "news"]), rng.choice(["en", "de"]), rng.randint(1, 99)
        rows.append((f"http://{host}.com/{lang}/{n}", rng.random() < (0.9 if host == "casino" and lang == "en" else 0.2 if host == "casino" else 0.1)))
    rows += [(None, True), ("http://x.com", None)]
    df = spark.createDataFrame(rows, "url string, blocked boolean")
    limits = MiningLimits(0.05, 5, 0.6)
    got = {tuple(r["items"]): (r["support"], r["rows"]) for r in mine_rules(df, limits).collect()}
    tokens = [(frozenset(r.t), r.blocked) for r in df.where("url is not null and blocked is not null").select(url_tokens(F.col("url")).alias("t"), "blocked").collect()]
    least = max(5, 0.05 * sum(b for _, b in tokens))
    every = {}
    for items in {frozenset(c) for t, b in tokens if b for k in range(1, len(t) + 1) for c in combinations(sorted(t), k)}:
        n, s = sum(items <= t for t, _ in tokens), sum(items <= t for t, b in tokens if b)
        if s >= least and s / n >= 0.6:
            every[items] = (s, n)
    want = {tuple(sorted(k)): v for k, v in every.items() if not any(p < k and every[p][0] / every[p][1] >= v[0] / v[1] for p in every)}
    assert got == want and want
    judged = judge_urls(df.selectExpr("url"), [], mine_rules(df, limits)).where("verdict = 'block'").select("url").distinct().collect()
    assert {r.url for r in judged} == {u for u, _ in rows if u and "casino" in u and "/en/" in u}
    allow = MiningLimits(0.05, 5, 0.88)
    found = mine_rules(df, allow, verdict="allow")
    for r in found.collect():
        n, s = sum(set(r["items"]) <= t for t, _ in tokens), sum(set(r["items"]) <= t for t, b in tokens if not b)
        assert (r.support, r["rows"], r.verdict) == (s, n, "allow") and s / n >= 0.88
    both = mine_rules(df, limits).union(found)
    for r in judge_urls(df.selectExpr("url"), [], both).where("url is not null").collect():
        spam = "casino" in r.url and "/en/" in r.url
        assert r.verdict == ("block" if spam else "allow") and (spam or "news" not in r.url or r.mined_rule)


def test_clashing_internal_names(spark):
    df = spark.createDataFrame([(1, "http://a.com/en/1")], "page_id long, url string").selectExpr("*", "1 as __url", "2 as __rule", "3 as __mined")
    r = judge_urls(df, RULES, mine_rules(df.selectExpr("url", "true as blocked"))).first()
    assert (r["__url"], r["__rule"], r["__mined"], r["verdict"]) == (1, 2, 3, "block")
