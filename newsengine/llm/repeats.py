"""Repeated passages by a depth-limited radix sort of suffixes.

Only the first WINDOW bytes of a suffix matter: two suffixes that agree on them
are a repeated window. The suffixes are dealt into ever finer groups by digits,
the most significant first, and a suffix alone in its group leaves the sort.

The first digit is the rarest run of GRAM bytes of the window, the one whose
hash is least, which equal windows share at the same offset. Neighbouring
suffixes with the same such anchor form a cell, and a cell's digit is the
string that all its windows have in common. Later passes halve and quarter the
cells, down to single windows, whose digit is the window itself. Two cells that
agree on all bytes of all their windows are settled without going deeper, so
whole copies cost one digit and no pass sees all pairs of anything.

The same passes can sort suffixes of words beside those of bytes: each word then
stands for itself by its hash, and a window is a number of words.

Digits are compared by 64-bit polynomial hashes.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsengine.llm.frames import Scratch, fresh, map_columns, prepare_workers, release

#: Bytes of a repeated window, and of the run that anchors it.
WINDOW, GRAM = 400, 32
#: Windows in a cell at each pass; the last pass looks at single windows.
PASSES = (185, 24, 1)
#: The same for windows of words: words of a run, and windows in a cell.
WORD_GRAM, WORD_PASSES = 4, (32, 6, 1)
#: Marks the places of cells of words.
WORDS = 1 << 62
#: Texts are read in pieces of at most so many bytes.
PIECE = 1 << 20
# An odd base and its inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BLANK = re.compile(rb"[\x20\x09-\x0D]")
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX_A
        x = (x ^ (x >> np.uint64(27))) * MIX_B
        return x ^ (x >> np.uint64(31))


BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** k and INVERSE ** k for k up to at least n, kept by the worker."""
    if len(POWERS.get("up", ())) <= n:
        size = 1 << max(16, int(n).bit_length())
        for name, base in (("up", BASE), ("down", INVERSE)):
            out = np.ones(1, np.uint64)
            with np.errstate(over="ignore"):
                while len(out) < size:
                    out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
            POWERS[name] = out
    return POWERS["up"], POWERS["down"]


class Hashes:
    """Hash of any stretch of ``data``, bytes or hashed words, in constant time."""

    def __init__(self, data: np.ndarray):
        self.up, down = powers(len(data) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((BYTES[data] if data.dtype == np.uint8 else data) * down[: len(data)], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[end] - self.sums[start]) * self.up[start]


def anchors(hashes: Hashes, size: int, window: int, gram: int) -> np.ndarray:
    """Start of the run with the least hash in the window at each start; the first of equals."""
    grams = size - gram + 1
    at = np.arange(grams, dtype=np.uint64)
    keys = (mixed(hashes.of(at.astype(np.int64), at.astype(np.int64) + gram)) & np.uint64(0xFFFFFFFFFF000000)) | at
    wide = window - gram + 1
    rows = -(-grams // wide)
    grid = np.full(rows * wide, np.uint64(0xFFFFFFFFFFFFFFFF))
    grid[:grams] = keys
    grid = grid.reshape(rows, wide)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    n = size - window + 1
    return (np.minimum(behind[:n], ahead[wide - 1 : wide - 1 + n]) & np.uint64(0xFFFFFF)).astype(np.int64)


def digits(hashes: Hashes, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, size: int, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, full): hashes of what a cell's windows share, and of all that they cover.

    A cell holds the windows that start between ``low`` and ``high`` bytes
    ahead of their anchor, all in one class of ``size`` offsets.
    """
    kind = low // size
    deep = np.minimum(kind * size + size - 1, window - gram)
    tag = mixed((kind * 1009 + size).astype(np.uint64))
    with np.errstate(over="ignore"):
        key = mixed(hashes.of(anchor - kind * size, anchor - deep + window) + tag)
        full = mixed(hashes.of(anchor - high, anchor - low + window) + mixed((low * 4099 + high).astype(np.uint64)) + tag)
    return key.view(np.int64), full.view(np.int64)


def words_of(raw: list[bytes]) -> list[np.ndarray]:
    """The hash of each word of each text, words being what stands between blanks."""
    parts, owner = [], []
    for r, text in enumerate(raw):
        at = 0
        while at < len(text):  # pieces end at a blank
            blank = BLANK.search(text, at + PIECE)
            end = blank.start() if blank else len(text)
            parts.append(text[at:end])
            owner.append(r)
            at = end
    out: list[list[np.ndarray]] = [[] for _ in raw]
    at = 0
    while at < len(parts):
        n, size = 0, 0
        while at + n < len(parts) and (not n or size + len(parts[at + n]) <= PIECE):
            size += len(parts[at + n]) + 1
            n += 1
        data = np.frombuffer(b" ".join([b"", *parts[at : at + n], b""]), np.uint8)
        word = (data != 0x20) & ((data < 0x09) | (data > 0x0D))
        edges = np.flatnonzero(word[1:] != word[:-1]) + 1
        start, end = edges[::2], edges[1::2]
        values = mixed(Hashes(data).of(start, end))
        bounds = np.searchsorted(start, np.cumsum([1, *(len(p) + 1 for p in parts[at : at + n])]))
        for k in range(n):
            out[owner[at + k]].append(values[bounds[k] : bounds[k + 1]])
        at += n
    return [x[0] if len(x) == 1 else np.concatenate([np.zeros(0, np.uint64), *x]) for x in out]


def joined(parts: list) -> np.ndarray:
    """Stretches, bytes or arrays of hashed words, in one array."""
    return np.frombuffer(b"".join(parts), np.uint8) if isinstance(parts[0], bytes) else np.concatenate(parts)


def first_cells(raw: list, window: int, gram: int, size: int) -> dict[str, np.ndarray]:
    """Cells of a batch of texts, bytes or arrays of hashed words: row, start, count, low, key and full."""
    rows, bases, parts, total = [], [], [], 0
    for r, text in enumerate(raw):
        step = PIECE - window + 1
        for at in range(0, max(0, len(text) - window + 1), step):
            piece = text[at : at + PIECE]
            rows.append(r)
            bases.append((total, at, len(piece)))
            parts.append(piece)
            total += len(piece)
    out: dict[str, list] = {k: [] for k in ("row", "start", "count", "low", "key", "full")}
    at = 0
    while at < len(parts):  # about PIECE bytes or words at a time
        n, size_now = 0, 0
        while at + n < len(parts) and (not n or size_now + len(parts[at + n]) <= PIECE):
            size_now += len(parts[at + n])
            n += 1
        data = joined(parts[at : at + n])
        hashes = Hashes(data)
        anchor = anchors(hashes, len(data), window, gram)
        first = np.array([b[0] for b in bases[at : at + n]]) - bases[at][0]
        lengths = np.array([b[2] for b in bases[at : at + n]])
        windows = lengths - window + 1
        owner = np.repeat(np.arange(n), windows)
        begin = np.cumsum(windows) - windows
        s = np.arange(windows.sum()) - begin[owner] + first[owner]
        a = anchor[s]
        kind = (a - s) // size
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (kind[1:] != kind[:-1]) | (owner[1:] != owner[:-1])]))
        last = np.concatenate([new[1:], [len(s)]]) - 1
        own = owner[new]
        key, full = digits(hashes, a[new], a[new] - s[last], a[new] - s[new], size, window, gram)
        out["row"].append(np.array(rows[at : at + n])[own])
        out["start"].append(s[new] - first[own] + np.array([b[1] for b in bases[at : at + n]])[own])
        out["count"].append(last - new + 1)
        out["low"].append(a[new] - s[last])
        out["key"].append(key)
        out["full"].append(full)
        at += n
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}


def finer_cells(stretches: list, low: np.ndarray, count: np.ndarray, window: int, gram: int, size: int) -> dict[str, np.ndarray]:
    """Cells of ``size`` within cells given by the bytes or words that they cover: row, shift of the start, count, low, key, full."""
    lengths = np.array([len(x) for x in stretches], np.int64)
    base = np.cumsum(lengths) - lengths
    high = low + count - 1
    kinds = high // size - low // size + 1
    row = np.repeat(np.arange(len(stretches)), kinds)
    kind = (low // size)[row] + np.arange(len(row)) - np.repeat(np.cumsum(kinds) - kinds, kinds)
    lo = np.maximum(low[row], kind * size)
    hi = np.minimum(high[row], kind * size + size - 1)
    hashes = Hashes(joined(stretches))
    key, full = digits(hashes, base[row] + high[row], lo, hi, size, window, gram)
    return {"row": row, "shift": high[row] - hi, "count": hi - lo + 1, "low": lo, "key": key, "full": full}


# A cell's place in its text in one number: start, count of windows, and least distance to the anchor.
def packed(start: np.ndarray, count: np.ndarray, low: np.ndarray) -> np.ndarray:
    return start << 20 | count << 10 | low


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (place & (WORDS - 1)) >> 20, place >> 10 & 1023, place & 1023


CELL = "did long, key long, full long, place long, origin long, wanted boolean"


def sort_pass(cells: DataFrame, copies: bool, scratch: Scratch) -> tuple[DataFrame, DataFrame, list[str]]:
    """One digit: (settled places, what goes on to the next digit, what that is read from) of cells.

    A cell whose key no other cell has is out. Cells that agree on ``full``
    are settled; with ``copies`` equal places count as two, for repeated rows.
    Of the others in a group that has several kinds, one cell of each kind
    goes on, wanted only if it is not settled.

    Counts and kinds are summed in each task first and written before they are
    joined, so both joins meet plain shuffles, of which Spark can split the
    partition of a frequent key.
    """
    shared, shared_at = scratch.keep(cells.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"))
    live, live_at = scratch.keep(cells.join(shared, "key").select("did", "key", "full", "place", "origin", "wanted"))
    scratch.drop(shared_at)
    spot = F.struct("did", "place", "origin")
    kinds = live.groupBy("key", "full").agg(F.count("*").alias("m"), F.min(spot).alias("spot"), F.max(spot).alias("other"), F.max("wanted").alias("wanted"))
    kinds = kinds.withColumn("again", F.col("m") > 1 if copies else F.col("spot") != F.col("other")).select("key", "full", "spot", "again", "wanted")
    kinds, kinds_at = scratch.keep(kinds)
    settled, _ = scratch.keep(live.where("wanted").join(kinds.where("again and wanted").select("key", "full"), ["key", "full"]).select("did", "place"))
    scratch.drop(live_at)
    lone = ~F.col("again") & F.col("wanted")
    mixed_keys = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.max(lone).alias("lone")).where("kinds > 1 and lone").select("key")
    onward = kinds.join(mixed_keys, "key").select("spot.*", lone.alias("wanted"))
    return settled, onward, [kinds_at]


def deflated(texts: DataFrame, keep: list[str], text_col: str, packed_col: str) -> DataFrame:
    """``keep`` with the text's UTF-8 bytes deflated, so that a shuffle moves half as much."""

    def make():
        return lambda values: ([zlib.compress((t or "").encode("utf-8"), 1) for t in values],)

    return map_columns(texts, keep, [text_col], [T.StructField(packed_col, T.BinaryType())], make)


def cells_of_texts(texts: DataFrame, window: int, gram: int, words: int | None) -> DataFrame:
    """Cells of the first pass from (did, text)."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                part = whole.slice(at, 256)
                did = part.column(0).to_numpy()
                raw = [(t or "").encode("utf-8") for t in part.column(1).to_pylist()]
                found = [(0, first_cells(raw, window, gram, PASSES[0]))]
                if words:
                    found.append((WORDS, first_cells(words_of(raw), words, WORD_GRAM, WORD_PASSES[0])))
                for mark, c in found:
                    place = packed(c["start"], c["count"], c["low"]) | mark
                    zero = np.zeros(len(place), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (did[c["row"]], c["key"], c["full"], place, zero, zero == 0)], names=["did", "key", "full", "place", "origin", "wanted"])
        release()

    prepare_workers(texts.sparkSession)
    return texts.select("did", "text").mapInArrow(run, CELL)


def stretches_of(texts: DataFrame, cells: DataFrame, window: int, words: int | None) -> DataFrame:
    """What each cell covers, bytes or hashed words, (did, place, wanted, stretch); a text meets all its cells at once."""
    # Rows of one id and text share their key: a set holds each cell of the text once, however many such rows there are.
    wanted = cells.groupBy("did").agg(F.collect_set(F.struct("place", "wanted")).alias("cells"))
    both = deflated(texts, ["did"], "text", "packed").join(wanted, "did").select("did", "packed", "cells.place", "cells.wanted")

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                out: list[tuple] = []
                for row in whole.slice(at, 64).to_pylist():
                    raw, hashed = zlib.decompress(row["packed"]), None
                    for place, want in zip(row["place"], row["wanted"], strict=True):
                        start, count, _ = unpacked(place)
                        if place < WORDS:
                            stretch = raw[start : start + count - 1 + window]
                        else:
                            if hashed is None:
                                hashed = words_of([raw])[0]
                            stretch = hashed[start : start + count - 1 + words].tobytes()
                        out.append((row["did"], place, want, stretch))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], names=["did", "place", "wanted", "stretch"])

    prepare_workers(texts.sparkSession)
    return both.mapInArrow(run, "did long, place long, wanted boolean, stretch binary")


def cells_of_stretches(stretches: DataFrame, k: int, window: int, gram: int, words: int | None) -> DataFrame:
    """Finer cells, those of pass ``k``; ``origin`` is the place of the stretch."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                part = whole.slice(at, 2048)
                did, place, wanted = (part.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                given = part.column(3).to_pylist()
                start, count, low = unpacked(place)
                for mark in (0, WORDS):
                    here = np.flatnonzero(place & WORDS == mark)
                    if not len(here):
                        continue
                    if mark:
                        c = finer_cells([np.frombuffer(given[i], np.uint64) for i in here], low[here], count[here], words, WORD_GRAM, WORD_PASSES[k])
                    else:
                        c = finer_cells([given[i] for i in here], low[here], count[here], window, gram, PASSES[k])
                    row = here[c["row"]]
                    fine = packed(start[row] + c["shift"], c["count"], c["low"]) | mark
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (did[row], c["key"], c["full"], fine, place[row], wanted[row])], names=["did", "key", "full", "place", "origin", "wanted"])

    prepare_workers(stretches.sparkSession)
    return stretches.select("did", "place", "wanted", "stretch").mapInArrow(run, CELL)


def narrowed(stretches: DataFrame, cells: DataFrame, window: int, words: int | None) -> DataFrame:
    """What cells found within stretches cover."""
    inner = cells.select("did", F.col("origin").alias("place"), F.col("place").alias("fine"), "wanted")
    start = lambda c: F.shiftright(c, 20)
    word = F.col("fine") >= WORDS
    unit = F.when(word, 8).otherwise(1)
    size = F.shiftright("fine", 10).bitwiseAND(1023) - 1 + F.when(word, words or 0).otherwise(window)
    both = stretches.select("did", "place", "stretch").distinct().join(inner, ["did", "place"])
    return both.select("did", F.col("fine").alias("place"), "wanted", F.substring("stretch", ((start("fine") - start("place")) * unit + 1).cast("int"), (size * unit).cast("int")).alias("stretch"))


def repeated_windows(texts: DataFrame, window: int = WINDOW, gram: int = GRAM, words: int | None = None) -> DataFrame:
    """(did, place) of cells of (did, text) whose windows all start anywhere else as well; with ``words`` also of cells of windows of so many words."""
    scratch = Scratch(texts.sparkSession)
    found, onward, used = sort_pass(cells_of_texts(texts, window, gram, words), True, scratch)
    stretches, at = scratch.keep(stretches_of(texts, onward, window, words))
    for k in range(1, len(PASSES)):
        scratch.drop(*used)
        settled, onward, used = sort_pass(cells_of_stretches(stretches, k, window, gram, words), False, scratch)
        found = found.union(settled)
        used.append(at)
        if k + 1 < len(PASSES):
            stretches, at = scratch.keep(narrowed(stretches, onward, window, words))
    scratch.drop(*used)
    return found


def spans(places: list[int] | None, window: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes, or of words, under the windows of cells."""
    if not places:
        return []
    start, count, _ = unpacked(np.sort(np.array(places, np.int64)))
    end = np.maximum.accumulate(start + count - 1 + window)
    new = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    return list(zip(start[new].tolist(), end[np.concatenate([new[1:], [len(start)]]) - 1].tolist(), strict=True))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, keep: list[str] | None = None, words: int | None = None) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans (LONG) and ``kept`` BINARY.

    Texts are UTF-8 bytes; null and empty ones have none. Each byte under a
    ``window``-byte string that also starts anywhere else in the table, in the
    same text or another, is removed; overlaps count, and strings are judged
    on the input. ``kept`` is what is left, in order. Repeated rows are copies
    of each other. Clashing columns are replaced. ``window`` is at least
    ``gram`` and at most 1000.

    With ``words``, from 4 to 1000, n_repeat_words (LONG) follows: the words
    ``[^\\x20\\x09-\\x0D]+`` under strings of so many words that also start anywhere
    else, whatever blanks part them and however many bytes they take. It
    removes nothing.
    """
    keep = docs.columns if keep is None else keep
    added = ["n_bytes", "n_removed", "n_spans", "kept", *(["n_repeat_words"] if words else [])]
    own = [c for c in keep if c.lower() not in added]
    text = F.coalesce(F.col(text_col), F.lit(""))
    did = F.xxhash64(F.col(id_col), text)
    own_did, key, places_col, raw_col, packed_col = fresh(docs, "__did", "__key", "__places", "__text", "__packed")
    least = min(window, 2 * words - 1) if words else window
    found = repeated_windows(docs.select(did.alias("did"), text.alias("text")).where(F.octet_length("text") >= least), window, gram, words)
    places = found.groupBy(F.col("did").alias(key)).agg(F.collect_set("place").alias(places_col))
    slim = deflated(docs.select(*own, did.alias(own_did), text.alias(raw_col)), [*own, own_did], raw_col, packed_col)
    both = slim.join(places, F.col(own_did) == F.col(key), "left").drop(own_did, key)

    def make():
        def work(texts, places_):
            n, removed, runs, kept, repeated = [], [], [], [], []
            for t, p in zip(texts, places_, strict=True):
                raw = zlib.decompress(t)
                gone = spans([x for x in p or () if x < WORDS], window)
                n.append(len(raw))
                removed.append(sum(b - a for a, b in gone))
                runs.append(len(gone))
                kept.append(b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in gone)], [*(a for a, _ in gone), len(raw)], strict=True)))
                if words:
                    repeated.append(sum(b - a for a, b in spans([x for x in p or () if x >= WORDS], words)))
            return n, removed, runs, kept, *([repeated] if words else [])

        return work

    kinds = [T.StructField(c, T.BinaryType() if c == "kept" else T.LongType()) for c in added]
    return map_columns(both, own, [packed_col, places_col], kinds, make)
