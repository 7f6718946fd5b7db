import random

import numpy as np

from newsengine.llm.chat import PIECE, ROLES, STATES, Hmm, fit_hmm, format_chats, observe

MARKS = {"user": ["User: ", "Q: ", "[human] "], "assistant": ["Assistant: ", "A: ", "[AI] "], "system": ["System: ", "Context: ", "[system] "]}


def talk(rng, conv, n):
    rows = []
    for turn in range(n):
        role = "system" if turn == 0 and rng.random() < 0.3 else ["user", "assistant"][turn % 2]
        body = "What is it?" if role == "user" else "\n".join(["It is a thing that has a long description, with words."] * rng.randint(1, 3))
        rows.append((conv, turn, role, (rng.choice(MARKS[role]) if rng.random() < 0.7 else "") + body))
    return rows


def test_markers():
    for line, marker in [("User: hi", 2), ("  **Assistant:** x", 3), ("[system] y", 1), ("Q: z", 2), ("A bird", 0), ("users: x", 0), ("plain", 0), ("", 0)]:
        assert observe(line, True)[0] == marker, line


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    m = Hmm.from_counts(rng.random((STATES + 1, STATES)) * 9, [rng.random((STATES, n)) * 9 for n in (4, 5, 2, 2)])
    from itertools import product

    for n in (1, 2, 4):
        seen = [observe(x, k == 0) for k, x in enumerate(["User: a", "b?", "long " * 9, ""][:n])]
        s = m.scores(seen)
        value = lambda p: m.step[STATES, p[0]] + s[0, p[0]] + sum(m.step[a, b] + s[k + 1, b] for k, (a, b) in enumerate(zip(p, p[1:])))
        best = max(product(range(STATES), repeat=n), key=value)
        assert abs(value(m.viterbi(seen)) - value(best)) < 1e-9
        assert abs(m.piece(seen)[STATES].max() - value(best)) < 1e-9


def test_roles_held_out_and_long_conversations(spark):
    rng = random.Random(6)
    rows = [r for c in range(150) for r in talk(rng, c, rng.randint(2, 8))]
    fit = fit_hmm(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    test = [r for c in range(1000, 1040) for r in talk(rng, c, 6)] + talk(rng, 5000, 3 * PIECE + 10)
    df = spark.createDataFrame(test, "conv_id long, turn long, true string, text string").selectExpr("*", "'x' as rendered")
    got = {(r.conv_id, r.turn): r for r in format_chats(df, fit).collect()}
    assert len(got) == len(test)
    assert np.mean([got[c, t].role == role for c, t, role, _ in test]) > 0.95
    long = [r for r in test if r[0] == 5000]
    seen = [observe(x, k == 0) for *_, text in long for k, x in enumerate(text.split("\n"))]
    path = iter(fit.viterbi(seen))
    for c, t, _, text in long:
        own = [next(path) for _ in text.split("\n")]
        assert got[c, t].role == ROLES[own[0] // 2]
    r = got[1000, 1]
    assert r.rendered.startswith(f"<|{r.role}|>\n") and r.rendered.endswith("<|end|>\n") and "Assistant:" not in r.rendered


def test_edges(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (None, 3, None, ""), (2, None, "robot", "x\n\ny"), (2, 1, "user", "z" * 50000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    fit = fit_hmm(df)
    assert format_chats(df, fit).count() == 5
    assert format_chats(df.limit(0), fit).count() == 0
    assert np.isfinite(fit_hmm(df.limit(0)).step).all()


def test_only_markers_of_the_decoded_role_go():
    from newsengine.llm.chat import render, without_marker

    for line in ("A) first option", "Model: T5 | size", "Q - is a letter", "  indented", "you - and me", "[1] note"):
        assert without_marker(line, "user") == line
    assert without_marker("User:  two spaces", "user") == " two spaces"
    assert without_marker("[AI] yes", "assistant") == "yes" and without_marker("**Human:** x", "user") == "x"
    assert without_marker("User: x", "assistant") == "User: x"
    assert render(["  def f():", "    return 1  "], [2, 3]) == ("user", "<|user|>\n  def f():\n    return 1  \n<|end|>\n", 1)
    assert render([""], [2]) == ("user", "<|user|>\n<|end|>\n", 1)


def test_a_conversation_without_an_order_is_cut_into_pieces(spark):
    from newsengine.llm.chat import ordered

    df = spark.createDataFrame([(1, None, "same")] * (3 * PIECE) + [(None, 1, "x")] * (PIECE + 1), "conv_id long, turn long, text string")
    sizes = {(r["__conv"], r["__piece"]): r["count"] for r in ordered(df, "conv_id", "turn", "text").groupBy("__conv", "__piece").count().collect()}
    assert sizes == {(1, 0): PIECE, (1, 1): PIECE, (1, 2): PIECE, (None, 0): PIECE, (None, 1): 1}


def test_text_that_looks_like_a_marker_stays(spark):
    rng = random.Random(8)
    fit = fit_hmm(spark.createDataFrame([r for c in range(80) for r in talk(rng, c, 6)], "conv_id long, turn long, role string, text string"))
    plain = [(1, 0, "What is it?"), (1, 1, "Model: T5 | size"), (1, 2, "And that?"), (1, 3, "It is a thing that has a long description, with words.")]
    marked = [(2, 0, "User: What is it?"), (2, 1, "Assistant: It is a thing, with words."), (2, 2, "[ai] is a word"), (2, 3, "Assistant: yes")]
    alone = [(3, 0, "Answer: 42"), (None, 0, "Context: see"), (None, 1, None)]
    got = {(r.conv_id, r.turn): r.rendered for r in format_chats(spark.createDataFrame(plain + marked + alone, "conv_id long, turn long, text string"), fit).collect()}
    assert len(got) == 11
    for c, t, text in plain + alone:
        assert (text or "") in got[c, t]
    assert "User:" not in got[2, 0] and "Assistant:" not in got[2, 1] and "[ai] is a word" in got[2, 2]
