"""The conversation trie against a brute-force version, over every band height."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from newsengine.llm.trie import prefix_trie, shared_prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, key string, depth int, place string"


def ordered(rows):
    """Turns of each conversation; the tests give tied turns equal content, whose order cannot matter."""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in by.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = sum(saved[k] for k in children[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    return sorted(
        (m[0], len(node), members[node[:-1]][0] if node else -1, len(m), len(children[node]), leaves[node], saved[node], hashlib.sha256(",".join(str(c) for c in m if len(convs[c]) == len(node)).encode()).hexdigest())
        for node, m in members.items()
    )


def rows_of(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", 7, "p") for r in rows], SCHEMA)


def made(seed, convs=60, longest=12, words=3):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-150, 420), convs):
        for t in range(rng.randint(1, longest)):
            rows.append((c, rng.choice([None, t]) if t == 0 else t, rng.choice(["user", "assistant", None]), rng.choice(["añb", "", None, "x" * 5][: words + 1])))
    return rows


@pytest.mark.parametrize("height", [2, 3, 16])
def test_plain_trie_equals_brute_force(spark, height):
    rows = made(1)
    assert rows_of(prefix_trie(table(spark, rows), height)) == brute(ordered(rows))


@pytest.mark.parametrize("height", [4, 16])
def test_shared_prefixes_equal_brute_force(spark, height):
    rows = made(2, convs=80, longest=8, words=2)
    assert rows_of(shared_prefix_trie(table(spark, rows), height)) == brute(rebuilt(ordered(rows)))


def test_deep_conversations_cross_many_bands(spark):
    rng = random.Random(4)
    stem = [(rng.choice(["u", "a"]), rng.choice("pq")) for _ in range(150)]
    rows = []
    for c in range(8):
        turns = stem[: 20 * (c + 1)] + [("u", f"own {c} {k}") for k in range(3 * c)]
        rows += [(c + 1000, k, r, t) for k, (r, t) in enumerate(turns)]
    assert rows_of(prefix_trie(table(spark, rows), 4)) == brute(ordered(rows))


def test_equal_conversations_and_equal_turns(spark):
    rows = [(c, k, "user", "same") for c in range(150) for k in range(3)]  # one group of copies
    rows += [(500, None, "user", "again")] * 40  # one turn forty times
    rows += [(None, 1, "user", "of no conversation")]
    rows += [(900 + c, 0, "user", f"{c}" * 30) for c in range(60)]  # a root with many children
    assert rows_of(prefix_trie(table(spark, rows))) == brute(ordered(rows))


def test_empty_and_turnless(spark):
    assert rows_of(prefix_trie(table(spark, []))) == []
    assert rows_of(shared_prefix_trie(table(spark, []))) == []
    alone = [(c, 0, "user", "hi") for c in range(101, 140)]  # their base is absent: many have no turns left
    want = brute(rebuilt(ordered(alone)))
    assert rows_of(shared_prefix_trie(table(spark, alone))) == want
    assert want[0][3] == 39
