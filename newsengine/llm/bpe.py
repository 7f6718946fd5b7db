"""Byte-level BPE encoding and decoding by speculation and verification.

A greedy longest match proposes the tokens of each pre-tokenized word. A token
sequence is the merge procedure's own result exactly if each token encodes to
itself and each adjacent pair, encoded alone, comes back as that pair. So one
vectorised look-up over the adjacent pairs of a whole batch of new words tells
which proposals stand; only the failing words are merged exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from newsengine.llm.frames import map_columns

# The published pre-tokenization pattern of byte-level BPE.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The word cache has two generations of about so many bytes; words of the older one that come again move on.
CACHED_BYTES = 24 << 20
#: What a cached word takes besides its characters and ids, about; and so many checked pairs are kept.
WORD_BYTES, ID_BYTES, CACHED_PAIRS = 160, 40, 200_000
#: Longer words are not kept in the cache.
CACHED_LENGTH = 64
#: Words of more bytes are merged with a heap.
LONG_WORD = 64


def byte_letters() -> dict[str, int]:
    """Printable stand-in of each byte in the vocabulary file, back to the byte."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenTable:
    """The bytes of every token."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.token = [b""] * self.size
        for s, i in vocab.items():
            if s not in self.special:
                self.token[i] = bytes(letters[c] for c in s)
        for s, i in self.special.items():
            self.token[i] = s.encode()
        self.sizes = np.array([len(t) for t in self.token], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(self.token), np.uint8)
        self.prepare(vocab, spec["model"]["merges"])

    def prepare(self, vocab: dict[str, int], merges: list) -> None:
        """Nothing more is needed to decode."""

    def decode_batch(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of the ids between consecutive offsets; bytes that are no UTF-8 become U+FFFD."""
        ids = ids[offsets[0] : offsets[-1]]
        sizes = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        data = self.blob[np.repeat(self.starts[ids] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        cuts = ends[offsets - offsets[0]]
        try:
            data.decode("utf-8")
            inner = cuts[cuts < len(data)]
            whole = not len(inner) or not ((np.frombuffer(data, np.uint8)[inner] & 0xC0) == 0x80).any()
        except UnicodeDecodeError:
            whole = False
        if whole and len(data) < 1 << 31:
            return pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data))
        return pa.array([data[i:j].decode("utf-8", "replace") for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.string())

    def decode(self, ids: list[int]) -> str:
        """Text of one list of ids, special tokens as their strings."""
        return self.decode_batch(np.asarray(ids, np.int64), np.array([0, len(ids)]))[0].as_py()


class SpeculativeBpe(TokenTable):
    """Tokens with their merges, as an encoder."""

    def prepare(self, vocab: dict[str, int], merges: list) -> None:
        self.ids = {self.token[i]: i for s, i in vocab.items() if s not in self.special}
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(merges):
            x, y = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[x] * self.size + vocab[y]] = rank
            self.made.append(vocab[x + y])
        self.none = len(self.made)
        self.first = [self.ids.get(bytes([i]), 0) for i in range(256)]
        # A trie in one dictionary: node * 256 + byte leads to the next node, whose token is -1 if there is none.
        self.trie: dict[int, int] = {}
        self.ends = [-1]
        for t, i in self.ids.items():
            node = 0
            for c in t:
                key = node * 256 + c
                node = self.trie.get(key, 0)
                if not node:
                    node = self.trie[key] = len(self.ends)
                    self.ends.append(-1)
            self.ends[node] = i
        self.words = regex.compile(WORD_PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[str, tuple[int, ...]] = {s: (i,) for s, i in self.special.items()}
        self.older: dict[str, tuple[int, ...]] = {}
        self.held = 0
        self.names = [str(i) for i in range(self.size)]
        self.checked: dict[int, bool] = {}
        self.sound: dict[int, bool] = {}

    def merge(self, word: bytes) -> list[int]:
        """The merge procedure itself: lowest rank first, leftmost among equals."""
        if len(word) > LONG_WORD:
            return self.merge_long(word)
        size, get, none, made = self.size, self.ranks.get, self.none, self.made
        tok = [self.first[c] for c in word]
        ranks = [get(x * size + y, none) for x, y in zip(tok, tok[1:])]  # noqa: B905
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            tok[i : i + 2] = [made[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(tok[i - 1] * size + tok[i], none)
            if i < len(ranks):
                ranks[i] = get(tok[i] * size + tok[i + 1], none)
        return tok

    def merge_long(self, word: bytes) -> list[int]:
        """The same with a heap, for words whose repeated scans would cost their length squared."""
        n, size, get, made = len(word), self.size, self.ranks.get, self.made
        tok = [self.first[c] for c in word]
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, tok[i], tok[i + 1]) for i in range(n - 1) if (r := get(tok[i] * size + tok[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i] if tok[i] == a else -1
            if j < 0 or tok[j] != b:
                continue
            tok[i], tok[j] = made[rank], -1
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (r := get(tok[x] * size + tok[y])) is not None:
                    heapq.heappush(heap, (r, x, tok[x], tok[y]))
        return [t for t in tok if t >= 0]

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match from the left, by walks down the trie."""
        out, start, n, get, ends = [], 0, len(word), self.trie.get, self.ends
        while start < n:
            node, at, best, after = 0, start, -1, start + 1
            while at < n:
                node = get(node * 256 + word[at])
                if node is None:
                    break
                at += 1
                if ends[node] >= 0:
                    best, after = ends[node], at
            out.append(best)
            start = after
        return out

    def compatible(self, keys: np.ndarray) -> np.ndarray:
        """Whether each pair, coded left * size + right, is its own encoding."""
        unique, back = np.unique(keys, return_inverse=True)
        ok = np.empty(len(unique), bool)
        for k, key in enumerate(unique.tolist()):
            good = self.checked.get(key)
            if good is None:
                a, b = divmod(key, self.size)
                good = self.checked[key] = self.merge(self.token[a] + self.token[b]) == [a, b]
            ok[k] = good
        return ok[back]

    def own(self, ids: np.ndarray) -> np.ndarray:
        """Whether each token alone encodes to itself."""
        unique, back = np.unique(ids, return_inverse=True)
        ok = np.empty(len(unique), bool)
        for k, t in enumerate(unique.tolist()):
            if t not in self.sound:
                self.sound[t] = self.merge(self.token[t]) == [t]
            ok[k] = self.sound[t]
        return ok[back]

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Token ids of pre-tokenized words, verified in one vectorised pass."""
        raw = [w.encode("utf-8") for w in words]
        guess = [self.propose(w) for w in raw]
        sizes = np.fromiter(map(len, guess), np.int64, len(guess))
        flat = np.fromiter((t for g in guess for t in g), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(guess)), sizes)
        bad = np.zeros(len(guess), bool)
        bad[owner[~self.own(flat)]] = True
        if len(flat) > 1:
            inside = owner[1:] == owner[:-1]
            keys = (flat[:-1] * self.size + flat[1:])[inside]
            if len(keys):
                bad[owner[1:][inside][~self.compatible(keys)]] = True
        return [tuple(self.merge(raw[i])) if bad[i] else tuple(g) for i, g in enumerate(guess)]

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each whole text; null and empty texts have none."""
        if self.held > CACHED_BYTES:
            self.older, self.cache, self.held = self.cache, {s: (i,) for s, i in self.special.items()}, 0
        if len(self.checked) > CACHED_PAIRS:
            self.checked.clear()
        cache, find, special = self.cache, self.words.findall, self.special
        pieces: list[list[str]] = []
        for text in texts:
            parts: list[str] = []
            for part in self.cut.split(text) if text and self.cut else [text or ""]:
                parts += [part] if part in special else find(part)
            pieces.append(parts)
        seen: set[str] = set().union(*pieces)
        fresh = [w for w in seen if w not in cache]
        known = {w: ids for w in fresh if (ids := self.older.get(w)) is not None}
        new = [w for w in fresh if w not in known]
        known.update(zip(new, self.encode_words(new), strict=True))
        cache.update(known)
        self.held += sum(WORD_BYTES + len(w) + ID_BYTES * len(ids) for w, ids in known.items() if len(w) <= CACHED_LENGTH)
        out = [np.fromiter(chain.from_iterable(map(cache.__getitem__, parts)), np.int32) for parts in pieces]
        for w in new:
            if len(w) > CACHED_LENGTH:
                del cache[w]
        return out


@lru_cache(maxsize=2)
def loaded_tokens(path: str) -> TokenTable:
    return TokenTable(path)


@lru_cache(maxsize=1)
def loaded(path: str) -> SpeculativeBpe:
    """One encoder per worker process, kept between tasks."""
    return SpeculativeBpe(path)


#: A vocabulary file that every worker can read: its path, or a function that gives the path there.
Vocabulary = str | Callable[[], str]


def path_of(vocab: Vocabulary) -> str:
    return vocab() if callable(vocab) else vocab


def list_array(ids: list[np.ndarray]) -> pa.Array:
    """An Arrow list of each array of ids."""
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, type=pa.list_(pa.field("element", pa.int32(), False)))


IDS = T.ArrayType(T.IntegerType(), False)
DIGESTS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def bpe_round_trip(docs: DataFrame, vocab: Vocabulary, text_col: str = "text", ids_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256, decoded_sha256 and, if named, ``ids_col`` ARRAY<INT>.

    Each whole text is encoded and its ids decoded again in one pass; the
    digests are those of the decimal ids joined by commas and of the decoded
    UTF-8 text. Null and empty texts have no ids. Rows are independent, so
    repeated rows repeat and an empty table stays empty; clashing columns are
    replaced.
    """

    def make():
        bpe = loaded(path_of(vocab))
        name = bpe.names.__getitem__

        def work(texts):
            ids = bpe.encode_batch(texts)
            listed = list_array(ids)
            decoded = bpe.decode_batch(listed.values.to_numpy(), listed.offsets.to_numpy().astype(np.int64))
            told = [hashlib.sha256(",".join(map(name, own.tolist())).encode()).hexdigest() for own in ids]
            digests = [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in decoded.to_pylist()]
            return (*([listed] if ids_col else []), [len(own) for own in ids], told, digests)

        return work

    fields = [*([T.StructField(ids_col, IDS)] if ids_col else []), *DIGESTS]
    return map_columns(docs, docs.columns if keep is None else keep, [text_col], fields, make, rows=128)


def bpe_encode(docs: DataFrame, vocab: Vocabulary, text_col: str = "text", ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``ids_col`` ARRAY<INT>: the tokens of each whole text.

    ``vocab`` names a byte-level BPE file in JSON form that every worker
    can read. Null or empty text: empty array. Rows are independent, so
    repeated rows repeat and an empty table stays empty. An existing column
    named ``ids_col`` is replaced. Special tokens' strings in a text become
    their ids.
    """

    def make():
        bpe = loaded(path_of(vocab))
        return lambda texts: (list_array(bpe.encode_batch(texts)),)

    return map_columns(docs, docs.columns if keep is None else keep, [text_col], [T.StructField(ids_col, IDS)], make, rows=256)


def bpe_decode(docs: DataFrame, vocab: Vocabulary, ids_col: str = "ids", text_col: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``text_col``: the text that ``ids_col`` stands for; null ids give an empty text."""

    def make():
        bpe = loaded_tokens(path_of(vocab))

        def work(ids):
            filled = ids.fill_null([])
            return (bpe.decode_batch(filled.values.to_numpy(), filled.offsets.to_numpy().astype(np.int64)),)

        return work

    return map_columns(docs, docs.columns if keep is None else keep, [ids_col], [T.StructField(text_col, T.StringType())], make, rows=256, lists=False)
