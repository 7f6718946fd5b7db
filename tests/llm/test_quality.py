import re
from collections import Counter

import numpy as np

from newsengine.llm.quality import COUNTS, IsolationForest, RuleForests, count_statistics, fit_forests, judge_quality, statistics

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    lines = [x for x in text.split("\n") if WORD.search(x)]
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


TEXTS = [None, "", " \n\t", "a", "a b c a b c", "x\nx\n y\nx", "é\u00a0ñ #| <b>", "und " * 200, "a b\x0bc\x0cd\r\ne", "\u2028a b\u2028", "word " * 3 + "é" * 10000]


def test_statistics_equal_brute_force():
    for t in TEXTS:
        assert statistics(t)[:5] == plain(t), t


def test_forest_isolates_what_is_far_away():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (500, 1)), [[30.0]]])
    s = IsolationForest.fit(x).score(x)
    assert s[-1] > s[:-1].max()
    assert IsolationForest.fit(np.zeros((5, 1))).score(np.zeros((2, 1))).shape == (2,)


def walk(forest, tree, point):
    """Path length of one point: the nodes on its way, and what the leaf's points would add."""
    node = 0
    while forest.feature[tree, node] >= 0:
        node = forest.left[tree, node] + int(point[forest.feature[tree, node]] >= forest.split[tree, node])
    return forest.path[tree, node]


def test_scores_equal_walks_through_every_tree():
    x = np.random.default_rng(3).normal(0, 1, (400, 3))
    forest = IsolationForest.fit(x, trees=20, sample=64)
    lengths = [np.mean([walk(forest, t, p) for t in range(20)]) for p in x]
    assert np.allclose(forest.score(x), 2.0 ** (-np.array(lengths) / forest.usual))
    # Depth alone: every point of a sample of two is isolated by one split.
    two = IsolationForest.fit(np.array([[0.0], [1.0]]), trees=5)
    assert [walk(two, t, p) for t in range(5) for p in ([0.0], [1.0])] == [1.0] * 10


def test_joint_forest_sees_what_single_statistics_do_not():
    rng = np.random.default_rng(4)
    # Two clouds on the diagonal; what is odd has the one's first and the other's second value.
    usual = rng.normal(0, 0.05, (400, 2)) + np.repeat([[0.0, 0.0], [1.0, 1.0]], 200, 0)
    odd = rng.normal(0, 0.03, (8, 2)) + [0.0, 1.0]
    x, good = np.concatenate([usual, odd]), np.arange(408) < 400
    forests = RuleForests.fit(x, good, most_good_lost=0.02)
    (columns, joint), *singles = forests.forests
    assert columns == [0, 1] and len(singles) == 2
    assert (joint.score(odd) >= joint.threshold).mean() > 0.8
    assert all((f.score(odd[:, c]) >= f.threshold).mean() < 0.2 for c, f in singles)
    assert (forests.score(usual) >= 0).mean() < 0.06


def prose(k):
    return " ".join(f"w{(k * 7 + i * i) % 97}x{i}" for i in range(80))


def test_judgement_and_edges(spark):
    good = [(i, prose(i)) for i in range(60)]
    bad = [(100 + i, " ".join(f"{w}###" for w in prose(i).split())) for i in range(15)]
    docs = spark.createDataFrame(good + bad + [(900, None), (901, ""), (902, "short"), (900, None)], "doc_id long, text string").selectExpr("*", "'z' as kept", "1 as n_words")
    labels = spark.createDataFrame([(i, 1) for i, _ in good[::2]] + [(i, 0) for i, _ in bad[::2]] + [(None, 1), (0, None)], "doc_id long, quality int")
    forests = fit_forests(docs, labels)
    got = {r.doc_id: (r.base_failed, r.kept) for r in judge_quality(docs, forests).collect()}
    assert all(got[i] == (False, True) for i, _ in good)
    assert all(got[i] == (False, False) for i, _ in bad)
    assert all(got[i] == (True, False) for i in (900, 901, 902))
    assert judge_quality(docs, forests).count() == docs.count()
    assert judge_quality(docs.limit(0), forests).count() == 0
    none = fit_forests(docs, labels.limit(0))
    assert judge_quality(docs, none).where("kept").count() == 75


def test_counts_frame(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for r in count_statistics(df).collect():
        assert tuple(r[c] for c in COUNTS[:5]) == plain(TEXTS[r.doc_id])
