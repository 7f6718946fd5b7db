"""Chat formatting: a hidden Markov model recovers who speaks, then turns are rendered one way."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from newsengine.llm.frames import cut, prepare_workers

# How transcripts mark speakers, and the canonical turn.
ROLES = ["system", "user", "assistant"]
SPEAKERS = {"system": "system|context|instructions?|sys", "user": "user|human|customer|question|you|q|me", "assistant": "assistant|ai|bot|model|answer|agent|gpt|a"}
NAMES = "(" + "|".join(f"(?P<{r}>{p})" for r, p in SPEAKERS.items()) + ")"
#: A hint for the model: a speaker's name with any mark around or behind it.
MARKER = re.compile(r"^\s*(?:[\[<(*#>|-]+\s*)?" + NAMES + r"(?:\s*[\])>*|]+\s*[:>-]?|\s*[:>-])\s*", re.I)
#: What is taken away: a name and a colon, or a name in a closed pair of brackets, and one space behind it.
SPOKEN = re.compile(r"(?:" + NAMES + r"[ \t]*:|(?:\[" + NAMES.replace("(?P<", "(?P<b_") + r"\]|<\|?" + NAMES.replace("(?P<", "(?P<c_") + r"\|?>|\*\*" + NAMES.replace("(?P<", "(?P<d_") + r":?\*\*)[ \t]*:?) ?", re.I)
#: Styles of markers, in the order of the pattern's parts.
STYLES = ["name:", "[name]", "<name>", "**name**"]
TURN = "<|{role}|>\n{text}<|end|>\n"
#: States: role * 2, plus 1 where a line goes on with the turn before.
STATES = 2 * len(ROLES)
#: So many rows of a conversation, one after another, are decoded in one piece.
PIECE = 256
FEATURES = [len(ROLES) + 1, 5, 2, 2]  # kinds: marker, length, question, first line of its row


def observe(line: str, first: bool) -> tuple[int, ...]:
    """Kinds of one line: whose marker, length class, question mark at the end, first of its row."""
    m = MARKER.match(line)
    marker = 1 + next(k for k, r in enumerate(ROLES) if m[r]) if m else 0
    return marker, min(4, int(math.log2(1 + len(line)) / 2)), int(line.rstrip().endswith("?")), int(first)


@dataclass
class Hmm:
    """Log probabilities: of the next state (the last row: of the first state), and of each feature's kinds."""

    step: np.ndarray
    emit: list[np.ndarray]

    @classmethod
    def from_counts(cls, step: np.ndarray, emit: list[np.ndarray], smooth: float = 0.5) -> Hmm:
        log = lambda c: np.log((c + smooth) / (c + smooth).sum(-1, keepdims=True))
        return cls(log(step), [log(e) for e in emit])

    def scores(self, seen: list[tuple[int, ...]]) -> np.ndarray:
        kinds = np.array(seen, np.int64).reshape(len(seen), len(FEATURES))
        return sum(e[:, kinds[:, k]].T for k, e in enumerate(self.emit))

    def piece(self, seen: list[tuple[int, ...]]) -> np.ndarray:
        """(STATES + 1, STATES): best log score from each state before a piece to each state at its end."""
        scores = self.scores(seen)
        best = self.step + scores[0]
        for s in scores[1:]:
            best = (best[:, :, None] + self.step[None, :STATES]).max(1) + s
        return best

    def viterbi(self, seen: list[tuple[int, ...]], before: int = STATES, after: int | None = None) -> list[int]:
        """Best states; ``before`` is the state ahead of the piece, ``after`` the state that it must end in."""
        scores = self.scores(seen)
        if not len(scores):
            return []
        v = self.step[before] + scores[0]
        back = []
        for s in scores[1:]:
            way = v[:, None] + self.step[:STATES]
            back.append(way.argmax(0))
            v = way.max(0) + s
        at = int(v.argmax()) if after is None else after
        path = [at]
        for b in reversed(back):
            at = int(b[at])
            path.append(at)
        return path[::-1]


def lines_of(text: str | None) -> list[str]:
    return (text or "").split("\n")


def states_of(role: str | None, n: int) -> list[int]:
    k = ROLES.index(role) * 2 if role in ROLES else 2
    return [k] + [k + 1] * (n - 1)


def ordered(df: DataFrame, conv: str, order: str, *cols: str) -> DataFrame:
    """Rows of one piece, PIECE of a conversation's rows at most, together and in order; ties are ordered by the text.

    Rows are dealt out by ranges of (conversation, order, text, a number of
    their own). A row's place is its number within its range plus the sizes of
    the conversation's earlier ranges, so a conversation of any size, whatever
    its order column holds, is spread over many tasks.
    """
    names = [f"__c{i}" for i in range(len(cols))]
    base = df.select(F.col(conv).alias("__conv"), F.col(order).alias("__order"), *[F.col(c).alias(n) for c, n in zip(cols, names, strict=True)])
    ranged = cut(base.withColumn("__own", F.monotonically_increasing_id()).repartitionByRange("__conv", "__order", *names, "__own").withColumn("__range", F.spark_partition_id()))
    sizes = ranged.groupBy("__conv", "__range").agg(F.count("*").alias("__size"))
    # One row per conversation and range.
    before = Window.partitionBy("__conv").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("__conv").alias("__c"), F.col("__range").alias("__r"), F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    number = F.row_number().over(Window.partitionBy("__conv", "__range").orderBy("__order", *names, "__own")) - 1
    placed = ranged.withColumn("__number", number).join(sizes, F.col("__conv").eqNullSafe(F.col("__c")) & (F.col("__range") == F.col("__r")))
    row = F.col("__before") + F.col("__number")
    pieces = placed.select("__conv", "__order", F.floor(row / PIECE).alias("__piece"), row.alias("__row"), *names)
    return pieces.repartition("__conv", "__piece").sortWithinPartitions("__conv", "__piece", "__row")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each conversation's piece, across batches."""
    now: list[dict] = []
    for b in batches:
        for row in b.to_pylist():
            if now and (row["__conv"], row["__piece"]) != (now[0]["__conv"], now[0]["__piece"]):
                yield now
                now = []
            now.append(row)
    if now:
        yield now


def fit_hmm(labelled: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> Hmm:
    """Count states over all labelled rows; each task sends its own sums only."""
    sizes = [(STATES + 1) * STATES, *[STATES * n for n in FEATURES]]
    n = sum(sizes)

    def count(batches):
        c = np.zeros(n)
        cuts = np.cumsum([0, *sizes])
        for rows in runs(batches):
            states, seen = [], []
            for r in rows:
                ls = lines_of(r["__c1"])
                states += states_of(r["__c0"], len(ls))
                seen += [observe(x, k == 0) for k, x in enumerate(ls)]
            if rows[0]["__piece"] <= 0:
                c[STATES * STATES + states[0]] += 1
            for a, b in zip(states[:-1], states[1:], strict=True):
                c[a * STATES + b] += 1
            for s, kinds in zip(states, seen, strict=True):
                for k, kind in enumerate(kinds):
                    c[cuts[1 + k] + s * FEATURES[k] + kind] += 1
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(c[at], pa.float64())], names=["k", "v"])

    prepare_workers(labelled.sparkSession)
    total = np.zeros(n)
    for row in ordered(labelled, conv, order, role, text).mapInArrow(count, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        total[row["k"]] = row["v"]
    parts = np.split(total, np.cumsum(sizes)[:-1])
    return Hmm.from_counts(parts[0].reshape(STATES + 1, STATES), [p.reshape(STATES, -1) for p in parts[1:]])


def boundaries(source: DataFrame, model: Hmm) -> DataFrame:
    """(conv, piece, before, after) for the pieces of conversations that have several.

    Each piece becomes one matrix of best scores between states, 42 numbers
    for a block of rows; a conversation's matrices are chained in order.
    """
    kind = source.schema["__conv"].dataType
    arrow = to_arrow_type(kind)
    long = source.groupBy("__conv").agg(F.min("__piece").alias("a"), F.max("__piece").alias("b")).where("a < b").select(F.col("__conv").alias("conv"))
    several = source.join(long, F.col("__conv").eqNullSafe(F.col("conv")), "left_semi")
    several = several.repartition("__conv", "__piece").sortWithinPartitions("__conv", "__piece", "__row")

    def matrices(batches):
        for rows in runs(batches):
            m = model.piece([observe(x, k == 0) for r in rows for k, x in enumerate(lines_of(r["__c0"]))])
            yield pa.RecordBatch.from_arrays([pa.array([rows[0]["__conv"]], arrow), pa.array([rows[0]["__piece"]], pa.int64()), pa.array([m.ravel().tolist()], pa.list_(pa.float64()))], names=["conv", "piece", "m"])

    def chain(batches):
        for b in batches:
            for row in b.to_pylist():
                ms = [np.array(x["m"]).reshape(STATES + 1, STATES) for x in row["ms"]]
                v = [ms[0][STATES]]
                for m in ms[1:]:
                    v.append((v[-1][:, None] + m[:STATES]).max(0))
                after = [int(v[-1].argmax())]
                for k in range(len(ms) - 1, 0, -1):
                    after.append(int((v[k - 1] + ms[k][:STATES, after[-1]]).argmax()))
                after = after[::-1]
                yield pa.RecordBatch.from_arrays([pa.array([row["conv"]] * len(ms), arrow), pa.array([x["piece"] for x in row["ms"]], pa.int64()), pa.array([STATES, *after[:-1]], pa.int32()), pa.array(after, pa.int32())], names=["conv", "piece", "before", "after"])

    prepare_workers(source.sparkSession)
    schema = T.StructType([T.StructField("conv", kind), T.StructField("piece", T.LongType()), T.StructField("m", T.ArrayType(T.DoubleType()))])
    made = several.mapInArrow(matrices, schema).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("piece", "m"))).alias("ms"))
    return made.mapInArrow(chain, T.StructType([*schema.fields[:2], T.StructField("before", T.IntegerType()), T.StructField("after", T.IntegerType())]))


def spoken(line: str) -> tuple[str, str, int] | None:
    """(style, role, length) of a speaker's marker at the very start of a line."""
    m = SPOKEN.match(line)
    if m is None:
        return None
    for style, p in zip(STYLES, ("", "b_", "c_", "d_"), strict=True):
        for role in ROLES:
            if m[f"{p}{role}"]:
                return style, role, m.end()
    return None


def without_marker(line: str, role: str, styles: list[str] | None = None) -> str:
    """``line`` without a marker at its start that names ``role`` in one of ``styles`` (any without them); anything else stays as it is."""
    found = spoken(line)
    if found is None or found[1] != role or (styles is not None and found[0] not in styles):
        return line
    return line[found[2] :]


def render(lines: list[str], states: list[int], styles: list[str] | None = None) -> tuple[str, str, int]:
    """(role of the first line, canonical turns, number of turns) of one row.

    A turn's first line loses a marker that names the decoded role in a style
    of the conversation's own; all other characters stay, white space
    included. An empty text is one empty turn.
    """
    turns: list[list] = []
    for line, s in zip(lines, states, strict=True):
        if s % 2 == 0 or not turns:
            turns.append([ROLES[s // 2], [without_marker(line, ROLES[s // 2], styles)]])
        else:
            turns[-1][1].append(line)
    text = lambda ls: "\n".join(ls) + ("\n" if any(ls) else "")
    return turns[0][0], "".join(TURN.format(role=r, text=text(ls)) for r, ls in turns), len(turns)


def own_styles(source: DataFrame) -> DataFrame:
    """(conv, styles): the marker styles in which a conversation names two speakers or more, at the start of rows.

    A single "Model: T5" or "Answer: 42" is so taken as content, not as a marker.
    """
    kind = source.schema["__conv"].dataType
    schema = T.StructType([T.StructField("conv", kind), T.StructField("style", T.StringType()), T.StructField("role", T.StringType())])

    def run(batches):
        for b in batches:
            found = [(c, m[0], m[1]) for c, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (m := spoken(lines_of(text)[0]))]
            cols = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], to_arrow_type(kind)), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["conv", "style", "role"])

    told = source.select("__conv", "__c0").mapInArrow(run, schema)
    named = told.groupBy("conv", "style").agg(F.countDistinct("role").alias("n")).where("n >= 2")
    return named.groupBy("conv").agg(F.collect_set("style").alias("styles"))  # at most four


def format_chats(transcripts: DataFrame, model: Hmm, conv: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """(conv, order, role, n_lines, n_turns, rendered) for every row of the transcripts.

    A row is a stretch of lines of a transcript; the model reads all lines of a
    conversation in order and says who speaks on each. ``role`` is the speaker
    of the row's first line, ``rendered`` the row's turns in one canonical
    form. Null texts are one empty line, null conversations are one
    conversation, rows without an order come first, ties are ordered by the
    text. Other columns are not read. A marker is taken away only in a style
    in which the conversation names two speakers. Conversations of more than ``PIECE``
    rows are decoded in pieces whose ends are fixed by the whole conversation,
    from 42 numbers of each piece.
    """
    prepare_workers(transcripts.sparkSession)
    source = cut(ordered(transcripts, conv, order, text))
    ends = boundaries(source, model)
    joined = source.join(ends, F.col("__conv").eqNullSafe(F.col("conv")) & (F.col("__piece") == F.col("piece")), "left").select(*source.columns, "before", "after")
    styles = own_styles(source)
    joined = joined.join(styles, F.col("__conv").eqNullSafe(styles["conv"]), "left").select(*source.columns, "before", "after", F.coalesce("styles", F.array().cast("array<string>")).alias("styles"))
    joined = joined.repartition("__conv", "__piece").sortWithinPartitions("__conv", "__piece", "__row")
    fields = [T.StructField(conv, source.schema["__conv"].dataType), T.StructField(order, source.schema["__order"].dataType), T.StructField("role", T.StringType()), T.StructField("n_lines", T.IntegerType()), T.StructField("n_turns", T.IntegerType()), T.StructField("rendered", T.StringType())]
    arrow = [to_arrow_type(f.dataType) for f in fields]

    def decode(batches):
        done: list[tuple] = []
        for rows in runs(batches):
            ls = [lines_of(r["__c0"]) for r in rows]
            seen = [observe(x, k == 0) for x_ in ls for k, x in enumerate(x_)]
            path = model.viterbi(seen, STATES if rows[0]["before"] is None else rows[0]["before"], rows[0]["after"])
            at = 0
            for r, own in zip(rows, ls, strict=True):
                role, text_, n = render(own, path[at : at + len(own)], r["styles"])
                at += len(own)
                done.append((r["__conv"], r["__order"], role, len(own), n, text_))
            if len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), arrow, strict=True)], names=[f.name for f in fields])
                done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), arrow, strict=True)], names=[f.name for f in fields])

    return joined.mapInArrow(decode, T.StructType(fields))
