import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from newsengine.llm.bpe import SpeculativeBpe, bpe_decode, bpe_encode

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    return SpeculativeBpe(PATH), Tokenizer.from_file(PATH)


def same(both, texts):
    mine, theirs = both
    got = [x.tolist() for x in mine.encode_batch(texts)]
    want = [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]
    assert got == want
    assert [mine.decode(x) for x in got] == [theirs.decode(x, skip_special_tokens=False) for x in want]


def test_random_texts_equal_the_library(both):
    rng = random.Random(1)
    letters = "ab cde  \n\t 'sll reve0123 é ñ \u0085\x1c\u00a0\u3000漢字🙂!!??##<|endoftext|>\u200b\u0301ẞ"
    same(both, ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) + rng.choice(["", "<|endoftext|>x"]) for _ in range(2000)])
    same(both, ["".join(rng.choice("aeinorst") for _ in range(rng.randint(0, 40))) for _ in range(2000)])


def test_long_words_take_the_heap(both):
    same(both, ["a" * 5000, "ab" * 3000, "!" * 4000, "then" * 500, "é" * 700, "x" * 63, "x" * 65])


def test_failing_words_are_merged_exactly(both):
    mine, _ = both
    words = ["thereatwh", "ingthe", "aseonthe", "erstand"]
    assert [list(t) for t in mine.encode_words(words)] == [mine.merge(w.encode()) for w in words]
    assert any(mine.propose(w.encode()) != mine.merge(w.encode()) for w in words)


def test_bytes_that_are_no_text(both):
    mine, theirs = both
    ids = [theirs.token_to_id("Ã"), theirs.token_to_id("a")]
    assert mine.decode(ids) == theirs.decode(ids, skip_special_tokens=False) == "\ufffda"
    assert mine.decode_batch(np.array(ids + ids), np.array([0, 1, 4])).to_pylist() == ["\ufffd", "a\ufffda"]


def test_frames(spark):
    rows = [(1, "a b", "keep"), (1, "a b", "keep"), (2, None, "x"), (3, "", None), (None, "<|endoftext|>", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe_decode(bpe_encode(df, PATH), PATH)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    got = sorted(((r.doc_id or 0), r.ids, r.decoded) for r in out.collect())
    assert got == [(0, [50256], "<|endoftext|>"), (1, [64, 275], "a b"), (1, [64, 275], "a b"), (2, [], ""), (3, [], "")]
    assert bpe_encode(df.limit(0), PATH).count() == 0
