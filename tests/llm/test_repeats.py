import random
import time
from collections import Counter

import numpy as np

from newsengine.llm.repeats import first_cells, remove_repeats


def brute(texts, window):
    raws = [(t or "").encode() for t in texts]
    times = Counter(r[i : i + window] for r in raws for i in range(len(r) - window + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - window + 1):
            if times[r[i : i + window]] > 1:
                gone[i : i + window] = True
        edges = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(r), int(gone.sum()), edges, bytes(np.frombuffer(r, np.uint8)[~gone])))
    return out


def check(spark, texts, window, gram):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'q' as kept", "5 as did")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(df, window=window, gram=gram).collect()}
    assert got == dict(enumerate(brute(texts, window)))


def prose(rng, n, letters="abcdeé "):
    return "".join(rng.choice(letters) for _ in range(n))


def test_equal_brute_force_at_400_bytes(spark):
    rng = random.Random(7)
    shared = [prose(rng, n) for n in (330, 345, 360, 399, 400, 420, 900)]
    texts = [None, "", "x", "a" * 399, "b" * 401, "ab" * 700, "und " * 300]
    for k in range(40):
        t = prose(rng, rng.randint(50, 900))
        for s in rng.sample(shared, rng.randint(0, 3)):
            at = rng.randrange(len(t) + 1)
            t = t[:at] + s + t[at:]
        texts.append(t)
    texts += [texts[8], texts[9][:700] + "!" + texts[9][700:], texts[10] + texts[10]]
    check(spark, texts, 400, 32)


def test_equal_brute_force_at_other_lengths(spark):
    rng = random.Random(8)
    texts = [prose(rng, rng.randint(0, 300), "ab") for _ in range(30)] + ["a" * 200, "ab" * 100, "é" * 60]
    check(spark, texts, 40, 8)


def test_repeated_rows_and_edges(spark):
    long = prose(random.Random(1), 600)
    rows = [(1, long), (1, long), (2, prose(random.Random(2), 500)), (None, long[:450])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in remove_repeats(df).collect())
    n = len(long.encode())
    assert got == [(0, len(long[:450].encode())), (1, n), (1, n), (2, 0)]
    assert remove_repeats(df.limit(0)).count() == 0


def test_every_window_is_in_one_cell():
    rng = random.Random(5)
    raws = [prose(rng, rng.randint(0, 3000)).encode() for _ in range(20)]
    c = first_cells(raws, 400, 32, 185)
    starts = Counter((r, s + k) for r, s, n in zip(c["row"].tolist(), c["start"].tolist(), c["count"].tolist()) for k in range(n))
    assert starts == Counter((i, s) for i, r in enumerate(raws) for s in range(len(r) - 399))


def test_clashing_internal_names(spark):
    from newsengine.llm.repeats import remove_repeats

    df = spark.createDataFrame([(1, "ab" * 300), (2, "x")], "doc_id long, text string").selectExpr("*", "5 as __did", "6 as __key", "7 as __packed")
    got = {r.doc_id: (r.n_removed, r["__did"], r["__key"], r["__packed"]) for r in remove_repeats(df).collect()}
    assert got == {1: (600, 5, 6, 7), 2: (0, 5, 6, 7)}


def test_many_rows_without_an_id_take_linear_time(spark):
    text = "".join(chr(97 + (k * k + 3 * k) % 23) for k in range(3000))
    rows = [(None, text, "x")] * 2500 + [(1, text[:1000] + "own end of another text", "y"), (2, "alone " * 20, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    began = time.perf_counter()
    found = remove_repeats(df, keep=["doc_id"]).collect()
    assert time.perf_counter() - began < 90
    assert len(found) == len(rows)
    assert {(r.n_bytes, r.n_removed, r.n_spans) for r in found if r.doc_id is None} == {(3000, 3000, 1)}
    assert {r.doc_id: r.n_removed for r in found if r.doc_id is not None} == {1: 1000, 2: 0}


def brute_words(texts, words):
    split = [(t or "").encode().split() for t in texts]
    times = Counter(tuple(w[i : i + words]) for w in split for i in range(len(w) - words + 1))
    out = []
    for w in split:
        under = {i + k for i in range(len(w) - words + 1) if times[tuple(w[i : i + words])] > 1 for k in range(words)}
        out.append(len(under))
    return out


def test_passages_of_over_50_words_under_400_bytes(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    blanks = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c"]
    some = lambda n: "".join(word() + rng.choice(blanks) for _ in range(n))
    short = " ".join(rng.choice("abcdefg") for _ in range(51))
    shared = [some(n) for n in (50, 51, 52, 60, 83, 120, 200)] + [short]
    texts = [None, "", " \n", "x", short + " own", "other " + "\n".join(short.split(" ")), "und " * 90, "a b " * 51]
    for _ in range(40):
        t = some(rng.randint(20, 150))
        for s in rng.sample(shared, rng.randint(0, 3)):
            t = t + s + some(rng.randint(0, 60))
        texts.append(t)
    texts += [texts[9], texts[10] + "\n" + texts[10], texts[11] + " more"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in remove_repeats(df, words=51).collect()}
    want = brute_words(texts, 51)
    assert [got[i].n_repeat_words for i in range(len(texts))] == want
    assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for _, r in sorted(got.items())] == brute(texts, 400)
    assert (got[4].n_repeat_words, got[4].n_removed) == (51, 0) and any(w and not got[i].n_removed for i, w in enumerate(want))


def test_words_of_long_texts_do_not_depend_on_pieces(monkeypatch):
    from newsengine.llm import repeats

    rng = random.Random(12)
    texts = [prose(rng, n, "abcdeé \n\t").encode() for n in (0, 1, 5, 700, 3000)] + [b"a" * 900, b"  " * 200]
    whole = [x.tolist() for x in repeats.words_of(texts)]
    assert [len(x) for x in whole] == [len(t.split()) for t in texts]
    monkeypatch.setattr(repeats, "PIECE", 64)
    assert [x.tolist() for x in repeats.words_of(texts)] == whole
    cells = first_cells(repeats.words_of(texts), 51, 4, 32)
    starts = Counter((r, s + k) for r, s, n in zip(cells["row"].tolist(), cells["start"].tolist(), cells["count"].tolist()) for k in range(n))
    assert starts == Counter((i, s) for i, w in enumerate(whole) for s in range(len(w) - 50))
