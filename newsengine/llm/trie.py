"""The trie of conversations that begin alike, with totals of every subtree.

A node is a distinct sequence of first turns. Texts are reduced to digests in
the scan; a node's key is the sum of hashes of (depth, turn digest) along its
path, 128 bits in four sums, so that paths of any length are summed by ranges.
Subtree totals come by bands of ``HEIGHT`` depths: each node explodes to its
ancestors within its band only; the roots of the bands are a trie of their own,
a ``HEIGHT``-th as deep, that is rolled up first in the same way, and their
completed totals go to the ancestors in the band above. A node so makes at most
``HEIGHT`` rows a level, and the levels are the logarithm of the depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsengine.llm.frames import cut, prepare_workers

#: Depths of a band.
HEIGHT = 16
#: Ids of a block that is joined to one string.
BLOCK = 1 << 16
MASK = 0xFFFFFFFF
LANES = ["__l0", "__l1", "__l2", "__l3"]


def root() -> Column:
    return F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))


def turn_digests(conversations: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, digest, n_chars) of every row with a conversation id; null roles and texts are empty."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t)))
    return conversations.where(F.col(conv).isNotNull()).select(F.col(conv).alias("conv_id"), F.col(order).alias("turn"), digest.alias("digest"), F.length(t).cast("long").alias("n_chars"))


def before_ranges(ranged: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """``ranged`` with each of ``sums`` over the rows of its conversation in earlier ranges."""
    past = Window.partitionBy("conv_id").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    each = ranged.groupBy("conv_id", "__range").agg(*[v.alias(k) for k, v in sums.items()])  # one row a conversation and range
    return ranged.join(each.select("conv_id", "__range", *[F.coalesce(F.sum(k).over(past), F.lit(0)).alias(k) for k in sums]), ["conv_id", "__range"])


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with place, from 1, in each conversation's ``order`` (nulls first), and the range that it was found in.

    Rows are dealt out by ranges of (conversation, order, a number of their
    own), so a conversation of any size is spread over many tasks.
    """
    ranged = cut(rows.withColumn("__own", F.monotonically_increasing_id()).repartitionByRange("conv_id", *order, "__own").withColumn("__range", F.spark_partition_id()))
    here = F.row_number().over(Window.partitionBy("conv_id", "__range").orderBy(*order, "__own"))
    return before_ranges(ranged, {"__before": F.count("*")}).withColumn("place", here + F.col("__before")).drop("__own", "__before")


def shared_turns(conv: Column) -> Column:
    """How many first turns a conversation takes from the one that its hundred begins with: 0 to 5."""
    return (F.crc32(conv.cast("string").cast("binary")) % 6).cast("int")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, kind, place, digest, n_chars): the first turns of conversation c - c % 100, then c's own after as many."""
    own = cut(numbered(turns, ["turn", "digest"]).select("conv_id", "place", "digest", "n_chars"))
    convs = own.where("place = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("__base"), shared_turns(F.col("conv_id")).alias("__h"))
    heads = own.where("place <= 5").withColumnRenamed("conv_id", "__base")  # at most five rows for at most 199 conversations each
    first = convs.join(heads, "__base").where("place <= __h").select("conv_id", F.lit(0).alias("kind"), "place", "digest", "n_chars")
    rest = own.where(F.col("place") > shared_turns(F.col("conv_id"))).select("conv_id", F.lit(1).alias("kind"), "place", "digest", "n_chars")
    return first.unionByName(rest), own.where("place = 1").select("conv_id")


def folded(lanes: list[Column]) -> Column:
    """Four sums as a key: each modulo 2^32, two to a long."""
    a, b, c, d = [x.bitwiseAND(F.lit(MASK)) for x in lanes]
    return F.struct(F.shiftleft(a, 32).bitwiseOR(b).alias("a"), F.shiftleft(c, 32).bitwiseOR(d).alias("b"))


def prefix_keys(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, key, parent, n_chars) for every prefix of every conversation but the empty one."""
    rows = numbered(turns, ["kind", "place"] if "kind" in turns.columns else ["turn", "digest"])
    hashes = [F.xxhash64(F.lit(k), "depth", "digest") for k in range(2)]
    lanes = [x for h in hashes for x in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(MASK)))]
    deep = cut(rows.select("conv_id", "__range", F.col("place").cast("long").alias("depth"), "digest", "n_chars"))
    deep = deep.select("conv_id", "__range", "depth", "n_chars", *[x.alias(n) for n, x in zip(LANES, lanes, strict=True)])
    past = Window.partitionBy("conv_id", "__range").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    summed = before_ranges(deep, {f"{n}b": F.sum(n) for n in LANES})
    # Sums of numbers under 2^32 fit a long for 2^31 turns of one conversation.
    running = summed.select("conv_id", "depth", "n_chars", *LANES, *[(F.sum(n).over(past) + F.col(f"{n}b")).alias(f"{n}s") for n in LANES])
    now, up = [F.col(f"{n}s") for n in LANES], [F.col(f"{n}s") - F.col(n) for n in LANES]
    return running.select("conv_id", "depth", folded(now).alias("key"), folded(up).alias("parent"), "n_chars")


def ancestors(chain: DataFrame, height: int) -> DataFrame:
    """(key, lower, up): a node's ancestors within its band; for a band's root also (lower) those in the band above."""
    band, at_root = F.floor(F.col("depth") / height), F.col("depth") % height == 0
    dealt = chain.select("conv_id", "depth", "key", F.explode(F.when(at_root, F.array(band, band - 1)).otherwise(F.array(band))).alias("band"))
    # At most height + 1 rows a group.
    paths = dealt.groupBy("conv_id", "band").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "key"))), lambda x: x["key"]).alias("path"))
    whole = paths.select(F.when(F.col("band") == 0, F.concat(F.array(root()), F.col("path"))).otherwise(F.col("path")).alias("path"))
    steps = whole.select(F.posexplode("path").alias("at", "key"), "path").where("at > 0")
    return steps.groupBy("key", (F.col("at") == height).alias("lower")).agg(F.first(F.slice("path", 1, F.col("at"))).alias("up"))


def rolled_up(chain: DataFrame, values: DataFrame, deepest: int, height: int = HEIGHT) -> DataFrame:
    """(key, *values) summed over every node's subtree, itself included.

    ``chain`` has (conv_id, depth, key) of every prefix of every conversation,
    ``values`` a row for each node, the root included, with columns to sum.
    """
    names = [c for c in values.columns if c != "key"]
    total = [F.sum(c).alias(c) for c in names]
    up = cut(ancestors(chain, height))
    raise_ = lambda found: found.select(F.explode("up").alias("key"), *names)
    inner = raise_(up.where("not lower").join(values, "key"))
    partial = values.select("key", *names).union(inner).groupBy("key").agg(*total)
    if deepest < height:
        return partial
    partial = cut(partial)
    roots = chain.where(F.col("depth") % height == 0).select("conv_id", (F.col("depth") / height).cast("long").alias("depth"), "key")
    heads = roots.select("key").distinct().union(chain.sparkSession.range(1).select(root().alias("key")))
    done = rolled_up(roots, partial.join(heads, "key"), deepest // height, height)
    carried = raise_(up.where("lower").join(done, "key"))
    return partial.union(carried).groupBy("key").agg(*total)


def ends_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the ids of each key, ascending, joined by commas.

    Ids are sorted by ranges of (key, id) and joined in blocks, so a key with
    many ids becomes a few rows; its digest reads them one after the other and
    holds one block at a time.
    """
    prepare_workers(ends.sparkSession)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def row():
            return pa.RecordBatch.from_pylist([{"a": key[0], "b": key[1], "first": ids[0], "ids": ",".join(map(str, ids))}], schema=pa.schema([("a", pa.int64()), ("b", pa.int64()), ("first", pa.int64()), ("ids", pa.string())]))

        for batch in batches:
            for a, b, c in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if (a, b) != key or len(ids) >= BLOCK:
                    if ids:
                        yield row()
                    key, ids = (a, b), []
                ids.append(c)
        if ids:
            yield row()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for batch in batches:
            a_, b_, sums = [], [], []
            for a, b, _, ids in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if (a, b) == key:
                    held.update(b"," + ids.encode())
                    continue
                if held is not None:
                    a_, b_, sums = [*a_, key[0]], [*b_, key[1]], [*sums, held.hexdigest()]
                key, held = (a, b), hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(a_, pa.int64()), pa.array(b_, pa.int64()), pa.array(sums, pa.string())], names=["a", "b", "ends_sha256"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([held.hexdigest()])], names=["a", "b", "ends_sha256"])

    flat = ends.select("key.a", "key.b", "conv_id")
    joined = flat.repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id").mapInArrow(blocks, "a long, b long, first long, ids string")
    done = joined.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(digest, "a long, b long, ends_sha256 string")
    return done.select(F.struct("a", "b").alias("key"), "ends_sha256")


def trie_nodes(turns: DataFrame, convs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row a node of the trie of ``turns``: (conv_id, kind, place, digest, n_chars), or turn in place of kind and place.

    ``convs`` has each conversation id once, those without turns included.
    Columns: conv_id (least member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256. Equal rows are separate
    turns. No conversation gives no row.
    """
    chain = cut(prefix_keys(turns))
    nodes = chain.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.count("*").alias("n_convs"), F.first("n_chars").alias("n_chars"))
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    top = top.select(root().alias("key"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast(chain.schema["key"].dataType).alias("parent"), "n_convs", F.lit(0).cast("long").alias("n_chars"))
    children = nodes.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = cut(nodes.unionByName(top).join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    values = nodes.select("key", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved_tokens"))
    deepest = chain.agg(F.max("depth")).first()[0] or 0
    totals = rolled_up(chain.select("conv_id", "depth", "key"), values, deepest, height)
    # Each conversation ends at its deepest prefix, one without turns at the root.
    last = chain.select("conv_id", "depth", "key").union(convs.select("conv_id", F.lit(0).cast("long"), root())).groupBy("conv_id").agg(F.max_by("key", "depth").alias("key"))
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(totals, "key").join(ends_digests(last), "key", "left").join(parents, "parent", "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text) as they are; see ``trie_nodes``.

    Turns are ordered by ``turn`` (null first), ties by their content's digest;
    rows without a conversation id are in no conversation.
    """
    turns = turn_digests(conversations)
    return trie_nodes(turns, turns.select("conv_id").distinct(), height)


def shared_prefix_trie(conversations: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The trie after every conversation c has taken its first turns from c - c % 100, as many as ``shared_turns`` says."""
    turns, convs = rebuilt(turn_digests(conversations))
    return trie_nodes(turns, convs, height)
