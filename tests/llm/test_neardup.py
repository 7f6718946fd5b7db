import random

import numpy as np

from newsengine.llm.graphs import components
from newsengine.llm.neardup import near_duplicates, shingles, signatures


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    found = []
    for _ in range(40):
        a = rng.integers(0, 2**63, 300).astype(np.uint64)
        b = np.concatenate([a[:240], rng.integers(0, 2**63, 60).astype(np.uint64)])
        w, v = rng.uniform(0.5, 3, 300), rng.uniform(0.5, 3, 300)
        s = signatures([(a, w), (b, v)])
        true = sum(1 / (np.maximum(np.append(w, np.zeros(60)) / w[i], np.append(v[:240], np.append(np.zeros(60), v[240:])) / v[i]).sum()) for i in range(240))
        found.append((s[0] == s[1]).mean() - true)
    assert abs(np.mean(found)) < 0.02
    assert (signatures([(np.zeros(0, np.uint64), np.zeros(0))]) == 0).all()


def brute(rows, least=0.8):
    sets = [set(x.tolist()) for x in shingles([t for _, t in rows])]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, t) in enumerate(rows):
        for m in range(k):
            j, u = rows[m]
            both = len(sets[k] & sets[m])
            if (t or "") == (u or "") or both and both / len(sets[k] | sets[m]) >= least:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in rows}


def test_classes_equal_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(30, 120))] for _ in range(12)]
    rows = []
    for b in base:
        for _ in range(rng.randint(1, 12)):
            t = list(b)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((len(rows), " ".join(t)))
    passage = " ".join(rng.choice(words) for _ in range(30))
    rows += [(len(rows) + k, " ".join(rng.choice(words) for _ in range(20)) + " " + passage) for k in range(20)]
    rows += [(500, None), (501, ""), (502, "One two"), (503, "one TWO"), (504, " ".join(base[0]))]
    rows += [(510 + k, " ".join(base[1])) for k in range(30)]
    df = spark.createDataFrame(rows + rows[:5] + [(None, "x")], "doc_id long, text string").selectExpr("*", "'a' as hash", "1 as key")
    got = {r.doc_id: r.class_id for r in near_duplicates(df).collect()}
    assert got == brute(rows)
    assert near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.id: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 150: 100, 200: 100}


def edited(rng, groups, size, words, edits):
    """Rows (id, text): copies of one passage per group, each with random edits, so that few pairs of a group are similar."""
    rows = []
    for g in range(groups):
        base = [f"g{g}x{k}" for k in range(words)]
        for _ in range(size):
            t = list(base)
            for at in rng.sample(range(words), edits):
                t[at] = f"new{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(t)))
    rng.shuffle(rows)
    return [(k, t) for k, (_, t) in enumerate(rows)]


def test_large_buckets_are_compared_exactly(spark):
    rows = edited(random.Random(5), 1, 150, 200, 3)
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(set(brute(rows).values())) > 12 and got == brute(rows)


def test_small_buckets_are_compared_exactly(spark):
    rows = edited(random.Random(6), 20, 12, 200, 3)
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_heavily_repeated_lines(spark):
    rng = random.Random(7)
    rows = []
    for k in range(20):
        own = " ".join(f"w{rng.randrange(10**6)}" for _ in range(104))
        line = "\n" + " ".join(f"r{rng.randrange(10**6)}" for _ in range(18))
        rows += [(2 * k, own), (2 * k + 1, own + line * 1000)]
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_contracted_components_equal_those_of_all_edges(spark):
    from newsengine.llm.graphs import components

    first, more = [(2, 1), (3, 2), (11, 10), (7, 7)], [(10, 3), (21, 20), (3, 2)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    at_once = {tuple(r) for r in components(frame(first + more)).collect()}
    in_turn = {tuple(r) for r in components(frame(more), components(frame(first))).collect()}
    assert at_once == in_turn == {(1, 1), (2, 1), (3, 1), (10, 1), (11, 1), (20, 20), (21, 20)}
    assert components(frame([])).count() == 0


def test_edited_copies_link_through_the_text_they_were_made_from(spark):
    import random

    rng = random.Random(3)
    base = [f"w{k}" for k in range(400)]
    rows = [(7000, " ".join(base))]
    for i in range(150):
        own = list(base)
        for at in rng.sample(range(400), 6):
            own[at] = f"x{i}y{at}"
        rows.append((i, " ".join(own)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0} and len(got) == 151


def test_recall_in_every_band_of_similarity(spark):
    """Pairs of known similarity, half of them with a repeated line: nine in ten at least share a class in every band."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(3000)]
    rows, pairs = [], {}
    while min((len(pairs.get(band, ())) for band in range(4)), default=0) < 60:
        a = [rng.choice(words) for _ in range(rng.randint(60, 260))]
        b = list(a)
        for _ in range(rng.randint(1, 6)):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 2)] = [rng.choice(words) for _ in range(rng.randint(0, 2))]
        line = [rng.choice(words) for _ in range(9)] * rng.choice([0, 40])
        x, y = (set(s.tolist()) for s in shingles([" ".join(a), " ".join(b + line)]))
        true = len(x & y) / len(x | y)
        band = int((true - 0.8) * 20)
        if 0.8 <= true < 1 and len(pairs.setdefault(band, [])) < 60:
            k = len(rows)
            rows += [(k, " ".join(a)), (k + 1, " ".join(b + line))]
            pairs[band].append(k)
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    recall = {band: sum(got[k] == got[k + 1] for k in ks) / len(ks) for band, ks in pairs.items()}
    assert len(recall) == 4 and min(recall.values()) >= 0.9, recall
