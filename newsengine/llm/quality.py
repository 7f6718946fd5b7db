"""Quality rules: isolation forests over the statistics that such rules test.

One forest splits on all rule statistics together, and each statistic has a
forest of its own beside it. Path lengths over random splits tell how odd a
document is, and labelled rows set the score from which on each forest rejects;
one that does not tell bad rows from good ones gets no threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsengine.llm.frames import map_columns

# The symbols that the symbol rule counts.
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
UPPER = bytes(range(65, 91))
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs"]
#: Documents under so many words, or with a larger share of repeated words, fail the base rules.
MIN_WORDS, MAX_REPEAT = 50, 50
#: At most so many labelled rows fit the forest and its threshold.
LABELLED_ROWS = 20_000
#: Anomaly scores stay under 1, so this threshold rejects nothing.
NEVER = 2.0


def statistics(text: str | None) -> tuple[int, ...]:
    """COUNTS of one whole text; all 0 for null, empty and blank texts."""
    raw = (text or "").encode("utf-8")
    words = raw.split()
    n = len(words)
    if not n:
        return (0,) * len(COUNTS)
    chars = len(text) - (len(raw) - len(raw.translate(None, SPACES)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n >= 3:
        known: dict[bytes, int] = {}
        ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
        if len(known) < 1 << 21:
            triples = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
            _, back, times = np.unique(triples, return_inverse=True, return_counts=True)
        else:
            _, back, times = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0, return_inverse=True, return_counts=True)
        twice = times[back.ravel()] > 1
        if twice.any():
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= twice
            repeated = int(covered.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), len(raw) - len(raw.translate(None, UPPER)), raw.count(b"!")


def ratios(counts: np.ndarray) -> np.ndarray:
    """What the forest splits on: rates that do not depend on a text's length."""
    c = counts.astype(float)
    n = np.maximum(c[:, 0], 1)
    return np.stack([c[:, 1] / n, c[:, 2] / n, c[:, 3] / np.maximum(c[:, 5], 1), c[:, 4] / n, c[:, 6] / np.maximum(c[:, 1], 1), c[:, 7] / n], axis=1)


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT * counts[:, 0])


def usual_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    m = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(m - 1) + np.euler_gamma) - 2 * (m - 1) / m, np.where(n == 2, 1.0, 0.0))


@dataclass
class IsolationForest:
    feature: np.ndarray  # (trees, nodes), -1 at a leaf
    split: np.ndarray
    left: np.ndarray  # the right child follows the left one
    path: np.ndarray  # depth plus what a leaf's points would add
    usual: float
    threshold: float = NEVER

    @classmethod
    def fit(cls, x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 7) -> IsolationForest:
        rng = np.random.default_rng(seed)
        size = min(sample, len(x))
        top = max(1, int(np.ceil(np.log2(max(size, 2)))))
        nodes = 2 ** (top + 1)
        feature, split = np.full((trees, nodes), -1, np.int8), np.zeros((trees, nodes))
        left, path = np.zeros((trees, nodes), np.int32), np.zeros((trees, nodes))
        for t in range(trees):
            todo, used = [(0, x[rng.choice(len(x), size, replace=False)] if size else x, 0)], 1
            while todo:
                node, points, depth = todo.pop()
                low, high = (points.min(0), points.max(0)) if len(points) else (np.zeros(x.shape[1]),) * 2
                wide = np.flatnonzero(high > low)
                if depth >= top or len(points) < 2 or not len(wide):
                    path[t, node] = depth + usual_path(len(points))
                    continue
                f = int(rng.choice(wide))
                at = rng.uniform(low[f], high[f])
                feature[t, node], split[t, node], left[t, node] = f, at, used
                goes = points[:, f] < at
                todo += [(used, points[goes], depth + 1), (used + 1, points[~goes], depth + 1)]
                used += 2
        return cls(feature, split, left, path, float(usual_path(size)) or 1.0)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1, higher for points that random splits isolate early."""
        node = np.zeros((len(x), len(self.feature)), np.int64)
        tree = np.arange(len(self.feature))[None, :]
        rows = np.arange(len(x))[:, None]
        while True:
            f = self.feature[tree, node]
            inner = f >= 0
            if not inner.any():
                break
            right = x[rows, np.maximum(f, 0)] >= self.split[tree, node]
            node = np.where(inner, self.left[tree, node] + right, node)
        return 2.0 ** (-self.path[tree, node].mean(1) / self.usual)

    def calibrate(self, x: np.ndarray, good: np.ndarray, most_good_lost: float) -> None:
        """The score from which on rows are rejected.

        Among thresholds that lose at most the given share of good labelled
        rows, the one that best separates good from bad; half way to the next
        lower score. Without labelled rows of both kinds nothing is rejected.
        """
        self.threshold = NEVER
        if not good.any() or good.all():
            return
        s = self.score(x)
        at = np.unique(s)[::-1]
        good_lost = 1 - np.searchsorted(np.sort(s[good]), at, "left") / good.sum()
        bad_caught = 1 - np.searchsorted(np.sort(s[~good]), at, "left") / (~good).sum()
        gain = np.where(good_lost <= most_good_lost, bad_caught - good_lost, -1)
        k = int(np.argmax(gain))
        if gain[k] > 0:
            self.threshold = float((at[k] + at[k + 1]) / 2 if k + 1 < len(at) else at[k])


@dataclass
class RuleForests:
    """A calibrated forest over all columns of ``ratios``, then one for each of them."""

    forests: list[tuple[list[int], IsolationForest]]

    @classmethod
    def fit(cls, x: np.ndarray, good: np.ndarray, most_good_lost: float = 0.0005, trees: int = 50, sample: int = 256) -> RuleForests:
        every = list(range(x.shape[1]))
        out = []
        for k, columns in enumerate([every, *[[c] for c in every]]):
            forest = IsolationForest.fit(x[:, columns], 2 * trees if len(columns) > 1 else trees, sample, seed=k)
            forest.calibrate(x[:, columns], good, most_good_lost)
            out.append((columns, forest))
        return cls(out)

    def score(self, x: np.ndarray) -> np.ndarray:
        """How far the worst anomaly score lies over its threshold; 0 and more rejects."""
        return np.max([f.score(x[:, columns]) - f.threshold for columns, f in self.forests], axis=0) if len(x) else np.zeros(0)


def count_statistics(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the columns COUNTS (LONG) of each whole text; clashing columns are replaced."""

    def make():
        def work(texts):
            rows = [statistics(t) for t in texts]
            return tuple([r[k] for r in rows] for k in range(len(COUNTS)))

        return work

    return map_columns(docs, docs.columns if keep is None else keep, [text_col], [T.StructField(c, T.LongType()) for c in COUNTS], make)


def fit_forests(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = LABELLED_ROWS) -> RuleForests:
    """Forests with their thresholds, from at most ``rows`` labelled documents.

    Labelled ids are taken in the order of their hash, so the sample is the
    same at every run; an id with several labels counts as bad if any says
    so, and one with several texts is the one of least counts. Null ids and
    labels are left out.
    """
    ids = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min("quality").alias("__quality"))
    picked = ids.orderBy(F.xxhash64("__id"), "__id").limit(rows)
    mine = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    # ``picked`` has at most ``rows`` rows of two numbers, so its size is bounded.
    counted = count_statistics(mine.join(F.broadcast(picked), "__id"), "__text", keep=["__id", "__quality"])
    one = counted.groupBy("__id").agg(F.min(F.struct("__quality", *COUNTS)).alias("__row")).select("__id", "__row.*")
    found = one.toPandas().sort_values("__id", kind="stable")
    counts = found[COUNTS].to_numpy(np.int64).reshape(-1, len(COUNTS))
    passed = ~base_failed(counts)
    x, good = ratios(counts[passed]), found["__quality"].to_numpy()[passed] > 0
    return RuleForests.fit(x, good)


def judge_quality(docs: DataFrame, forest: RuleForests, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with COUNTS, ``base_failed``, ``score`` and ``kept``.

    Every row is judged on its whole text alone, so repeated rows repeat.
    Null, empty and short texts fail the base rules and are not kept.
    """

    def make():
        def work(texts):
            counts = np.array([statistics(t) for t in texts], np.int64).reshape(-1, len(COUNTS))
            failed, score = base_failed(counts), forest.score(ratios(counts))
            return (*[counts[:, k] for k in range(len(COUNTS))], failed, score, ~failed & (score < 0))

        return work

    fields = [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    return map_columns(docs, docs.columns if keep is None else keep, [text_col], fields, make)
