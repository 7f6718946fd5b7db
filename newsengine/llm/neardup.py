"""Near-duplicates by ProbMinHash signatures, banding and exact verification.

Each distinct shingle of five words has its weight as the rate of a Poisson
process seeded by the shingle; all weights are 1, however often it occurs. An arrival falls on a random slot;
each slot keeps the earliest arrival's shingle, and a process ends once its
time is past the latest slot. Two texts agree on a slot with the chance of
their probability Jaccard similarity, here that of the sets. Bands of slots give candidate pairs,
whose Jaccard similarity over whole texts is then computed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsengine.llm.frames import cut, map_columns, prepare_workers
from newsengine.llm.graphs import components

#: Words of a shingle, and the least Jaccard similarity of near-duplicates.
WORDS, SIMILARITY = 5, 0.8
#: Bands of slots: two texts at the least similarity share a band with chance 1 - (1 - 0.8 ** 6) ** 24 > 0.999.
BANDS, ROWS = 24, 6
SLOTS = BANDS * ROWS
#: Cells over which shingles are counted to tell rare from common ones.
CELLS = 1 << 16
# Multipliers of the splitmix64 generator.
GOLDEN, MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def splitmix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + GOLDEN
        x = (x ^ (x >> np.uint64(30))) * MIX_A
        x = (x ^ (x >> np.uint64(27))) * MIX_B
        return x ^ (x >> np.uint64(31))


PLACES = splitmix(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)
SLOT_PLACES = splitmix(np.arange(100, 100 + SLOTS, dtype=np.uint64)).reshape(BANDS, ROWS) | np.uint64(1)


def shingles(texts: list[str | None]) -> list[np.ndarray]:
    """64-bit hashes of all runs of five lower-cased words; a shorter text is one run, an empty one has none."""
    known: dict[str, int] = {}
    ids = [[known.setdefault(w, len(known)) for w in (t or "").lower().split()] for t in texts]
    hashes = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in known], np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for own in ids:
            h = hashes[own] if own else np.zeros(0, np.uint64)
            k = min(WORDS, len(h))
            total = np.zeros(max(0, len(h) - WORDS + 1) or min(1, len(h)), np.uint64)
            for i in range(k):
                total = total + h[i : i + len(total)] * PLACES[i]
            out.append(splitmix(total))
    return out


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], slots: int = SLOTS) -> np.ndarray:
    """(texts, slots) of weighted shingles (hashes, weights); texts without shingles are all 0."""
    n = len(sets)
    sizes = [len(h) for h, _ in sets]
    time = np.full((n, slots), np.inf)
    time[[s == 0 for s in sizes]] = 0
    sig = np.zeros((n, slots), np.uint64)
    flat_time, flat_sig = time.reshape(-1), sig.reshape(-1)
    h = np.concatenate([x for x, _ in sets]) if n else np.zeros(0, np.uint64)
    w = np.concatenate([x for _, x in sets]) if n else np.zeros(0)
    doc = np.repeat(np.arange(n), sizes)
    t = np.zeros(len(h))
    state = h.copy()
    latest = time.max(1) if n else np.zeros(0)
    while len(h):
        state = splitmix(state)
        t = t - np.log1p(-(state >> np.uint64(11)).astype(float) / 2.0**53) / w
        live = t < latest[doc]
        h, w, doc, t, state = h[live], w[live], doc[live], t[live], state[live]
        place = doc * slots + (splitmix(state ^ MIX_A) % np.uint64(slots)).astype(np.int64)
        better = np.flatnonzero(t < flat_time[place])
        better = better[np.argsort(-t[better], kind="stable")]  # the last write is the earliest arrival
        flat_time[place[better]] = t[better]
        flat_sig[place[better]] = h[better]
        touched = np.unique(doc[better])
        latest[touched] = time[touched].max(1)
    return sig


def bands(sig: np.ndarray) -> np.ndarray:
    """(texts, BANDS) as int64."""
    with np.errstate(over="ignore"):
        return splitmix((sig.reshape(-1, BANDS, ROWS) * SLOT_PLACES).sum(2, dtype=np.uint64)).view(np.int64)


def weighted(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, all of weight 1: so slots agree with the chance of the sets' Jaccard similarity, which is what is verified."""
    kinds = np.unique(found)
    return kinds, np.ones(len(kinds))


def sign(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` with ``n_shingles`` (distinct) and ``bands``; texts without shingles have null bands."""

    def make():
        def work(texts):
            sets = [weighted(x) for x in shingles(texts)]
            keys = bands(signatures(sets))
            return [len(x) for x, _ in sets], [k.tolist() if len(x) else None for k, (x, _) in zip(keys, sets, strict=True)]

        return work

    return map_columns(docs, keep, [text_col], [T.StructField("n_shingles", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))], make, rows=1024)


def verify(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of ``texts`` (id, text) whose Jaccard similarity is at least ``least``."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    def make():
        def work(left, right):
            known: dict[str, np.ndarray] = {}
            new = list(dict.fromkeys([*left, *right]))
            known.update((t, np.unique(s)) for t, s in zip(new, shingles(new), strict=True))
            out = []
            for x, y in zip(left, right, strict=True):
                a, b = known[x], known[y]
                common = len(np.intersect1d(a, b, assume_unique=True))
                out.append(common / max(1, len(a) + len(b) - common))
            return (out,)

        return work

    return map_columns(both, ["a", "b"], ["text_a", "text_b"], [T.StructField("similarity", T.DoubleType())], make, rows=256).where(F.col("similarity") >= least)


def stars(keyed: DataFrame) -> DataFrame:
    """(a, b): each member of a bucket (key, id, m) with the bucket's head, the member that meets most others in all its buckets.

    Edited copies of one text are less like each other than like that text.
    It agrees with the most of them, so it is the head wherever it occurs and
    one round links them all. At a tie the least id is the head.
    """
    fame = keyed.groupBy("id").agg(F.sum("m").alias("fame"))
    heads = keyed.join(fame, "id").groupBy("key").agg(F.max_by("id", F.struct("fame", -F.col("id"))).alias("b"))
    return keyed.select("key", F.col("id").alias("a")).join(heads, "key").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def commonness(texts: DataFrame) -> np.ndarray:
    """In how many of ``texts`` shingles occur, summed over hash cells; its size is fixed."""

    def count(batches):
        n = np.zeros(CELLS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for found in shingles(batch.column(0).slice(at, 256).to_pylist()):
                    n += np.bincount((np.unique(found) % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used], pa.int64())], names=["k", "v"])

    prepare_workers(texts.sparkSession)
    table = texts.select("text").mapInArrow(count, "k int, v long").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(CELLS, np.int64)
    out[table["k"].to_numpy()] = table["v"].to_numpy()
    return np.minimum(out, 2**31 - 1).astype(np.int32)


def prefixes(texts: DataFrame, least: float) -> DataFrame:
    """(id, n, at, token): the rarest shingles of each text, of which two texts at ``least`` share at least one."""
    common = commonness(texts)

    def make():
        def work(given):
            sizes, tokens = [], []
            for found in shingles(given):
                own = np.unique(found)
                own = own[np.lexsort((own, common[(own % np.uint64(CELLS)).astype(np.int64)]))]
                sizes.append(len(own))
                tokens.append(own[: len(own) - math.ceil(least * len(own) - 1e-9) + 1].view(np.int64).tolist() if len(own) else [])
            return sizes, tokens

        return work

    fields = [T.StructField("n", T.LongType()), T.StructField("tokens", T.ArrayType(T.LongType()))]
    return map_columns(texts, ["id"], ["text"], fields, make, rows=256).select("id", "n", F.posexplode("tokens").alias("at", "token"))


def meeting(keyed: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, comp) of the texts that meet a text of another class in some bucket."""
    own = keyed.select("key", "id").join(labels, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
    mixed = own.groupBy("key").agg(F.min("comp").alias("c"), F.max("comp").alias("d")).where("c < d").select("key")
    return own.join(mixed, "key").select("id", "comp").distinct()


def across(members: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b): all pairs of ``members`` (id, comp) of different classes that can be at ``least``.

    The prefix, length and position filters are exact: the first shingle that
    two such texts share, rarest first, is in the prefix of both, and what
    follows it is long enough in both. The largest class of a shingle is not
    joined with itself.
    """
    tokens = cut(prefixes(texts.join(members.select("id"), "id", "left_semi"), least).join(members, "id"))
    kinds = tokens.groupBy("token", "comp").agg(F.count("*").alias("m"))
    kinds = kinds.groupBy("token").agg(F.max_by("comp", F.struct("m", "comp")).alias("most"), F.count("*").alias("kinds")).where("kinds > 1").select("token", "most")
    shared = cut(tokens.join(kinds, "token"))
    x, y = shared.where("comp <> most").alias("x"), shared.alias("y")
    n, m = F.col("x.n"), F.col("y.n")
    apart = (F.col("x.comp") != F.col("y.comp")) & ((F.col("y.comp") == F.col("y.most")) | (F.col("x.id") < F.col("y.id")))
    sized = (n >= least * m - 1e-6) & (m >= least * n - 1e-6)
    rest = 1 + F.least(n - 1 - F.col("x.at"), m - 1 - F.col("y.at")) >= least / (1 + least) * (n + m) - 1e-6
    found = x.join(y, (F.col("x.token") == F.col("y.token")) & apart & sized & rest)
    return found.select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row per document: (``id_col``, exact_id, class_id).

    ``exact_id`` is the least id with the same text. Texts are linked if the
    Jaccard similarity of their sets of five lower-cased words is at least
    ``least``; ``class_id`` is the least id of the connected class.

    Equal texts stand for each other, so thousands of copies cost one
    signature row. In a bucket every text is first compared with the one
    that meets most others; then all texts whose classes still meet in a bucket are compared with
    each other, by an exact filter on their rarest shingles. Null texts count as empty; empty
    texts are copies of each other and similar to nothing else. Null ids are
    left out. Rows that repeat an id with one text are one document; an id
    with several texts belongs to the class that joins them.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("hash", F.unhex(F.md5("text")))
    signed = cut(sign(rows, "text", ["id", "hash"]).groupBy("hash").agg(F.min("id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")))
    # The written rows are numbered, so buckets, pairs and links hold short ids whatever those of the documents are.
    signed = signed.select(F.monotonically_increasing_id().alias("id"), "hash", "least", "n_shingles", "bands")
    keyed = signed.where("bands is not null").select("id", "n_shingles", F.posexplode("bands")).select("id", "n_shingles", F.xxhash64("pos", "col").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    keyed = cut(keyed.join(shared, "key"))
    sizes = signed.select("id", "n_shingles")
    wanted = signed.select("id", "hash").join(keyed.select("id").distinct(), "id", "left_semi")
    # Texts move once: copies meet in the task that reads them, and the rest is dealt by hash.
    texts = cut(rows.groupBy("hash").agg(F.first("text").alias("text")).join(wanted, "hash").select("id", "text"))

    def possible(pairs: DataFrame) -> DataFrame:
        n = lambda c: sizes.select(F.col("id").alias(c), F.col("n_shingles").alias(f"n_{c}"))
        return pairs.join(n("a"), "a").join(n("b"), "b").where((F.col("n_a") >= least * F.col("n_b")) & (F.col("n_b") >= least * F.col("n_a"))).select("a", "b")

    tested = cut(possible(stars(keyed)))
    labels = components(cut(verify(tested, texts, least).select("a", "b")))
    fresh = cut(across(cut(meeting(keyed, labels)), texts, least).join(tested, ["a", "b"], "left_anti"))
    if fresh.limit(1).count():
        labels = components(cut(verify(fresh, texts, least).select("a", "b")), labels)
    joined = signed.select("id", "hash", "least").join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    named = joined.groupBy("comp").agg(F.min("least").alias("class_id"))
    classes = joined.join(named, "comp").select("hash", F.col("least").alias("exact_id"), "class_id")
    return rows.select("id", "hash").distinct().join(classes, "hash").groupBy(F.col("id").alias(id_col)).agg(F.min("exact_id").alias("exact_id"), F.min("class_id").alias("class_id"))
