"""Mixing sources to target weights with soft domain membership."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsengine.llm.frames import cut, fresh, map_columns

#: At most so many labelled rows train the classifier.
LABELLED_ROWS = 20_000
#: So many words at most are inputs of the classifier, each in at least so many of its documents.
MARKED_WORDS, COMMON = 64, 5
#: Lengths of a step that are tried: of the scaled gap, and of the plain gradient over its largest eigenvalue.
STEP_LENGTHS = ((1, 0.25, 0.06, 0.015), (1, 4, 16, 64, 256))
# A-Z to lower case, ASCII punctuation to spaces.
FOLD = bytes(ord(chr(i).lower()) if 65 <= i <= 90 else 32 if i < 128 and not chr(i).isalnum() else i for i in range(256))
UPPER, SYMBOLS = bytes(range(65, 91)), b"#*$%&|<>"


@dataclass
class DomainModel:
    """A softmax over marked words and a few rates."""

    domains: list[str]
    words: dict[bytes, int]
    weights: np.ndarray

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights[:-1] + self.weights[-1]
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def measured(text: str | None, words: dict[bytes, int]) -> tuple[int, np.ndarray]:
    """Words split at ASCII white space, and the classifier's inputs, of one whole text."""
    raw = (text or "").encode("utf-8")
    n = len(raw.split())
    x = np.zeros(len(words) + 4, np.float32)
    if n:
        plain = raw.translate(FOLD).split()
        kinds = set(plain)
        for w in kinds & words.keys():
            x[words[w]] = 1
        size = len(raw)
        x[-4:] = ((size - len(raw.translate(None, UPPER))) / size * 4, min(2.0, (size - len(raw.translate(None, SYMBOLS))) / n), min(2.0, raw.count(b"!") / n), 1 - len(kinds) / max(1, len(plain)))
    return n, x


def folded_words(text: str | None) -> list[str]:
    """The distinct words of one whole text that ``measured`` compares."""
    return [w.decode("utf-8") for w in set((text or "").encode("utf-8").translate(FOLD).split())]


def telling_words(found: DataFrame, sizes: dict[str, int], marked: int = MARKED_WORDS) -> list[str]:
    """The words whose presence in ``__text`` tells ``__domain`` best, by the chi-squared statistic; ties by the word."""
    words = map_columns(found, ["__domain"], ["__text"], [T.StructField("words", T.ArrayType(T.StringType()))], lambda: lambda texts: ([folded_words(t) for t in texts],))
    counts = words.select("__domain", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), *[F.count_if(F.col("__domain") == d).alias(f"n{k}") for k, d in enumerate(sizes)])
    mean = F.col("n") / float(sum(sizes.values()))
    apart = sum((F.pow((F.col(f"n{k}") + 0.5) / (size + 1.0) - mean, 2) * size for k, size in enumerate(sizes.values())), F.lit(0.0))
    gap = F.round(apart / (mean * (1 - F.least(mean, F.lit(0.999)))), 6)
    return [r.word for r in counts.where(F.col("n") >= COMMON).orderBy(gap.desc(), "word").limit(marked).collect()]


def train_domains(x: np.ndarray, domains: list[str], words: dict[bytes, int], rounds: int = 400) -> DomainModel:
    """Softmax weights by full-batch gradient steps on rows of ``measured`` inputs."""
    names = sorted(set(domains))
    model = DomainModel(names, words, np.zeros((len(words) + 5, len(names)), np.float32))
    if not len(x):
        return model
    goal = np.eye(len(names), dtype=np.float32)[[names.index(d) for d in domains]]
    xs = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
    first, second = np.zeros_like(model.weights), np.zeros_like(model.weights)
    for step in range(1, rounds + 1):
        z = xs @ model.weights
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = xs.T @ (p - goal) / len(xs) + 1e-5 * model.weights
        first += 0.1 * (g - first)
        second += 0.01 * (g**2 - second)
        model.weights -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return model


def fit_domains(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = LABELLED_ROWS) -> DomainModel:
    """Classifier of ``labels``.domain from at most ``rows`` labelled documents.

    ``labels`` has the id and a string ``domain``; ids are taken in the order
    of their hash, the least domain of an id counts, nulls are left out. Of
    several rows with one id the least text counts. Words are counted and
    texts measured in tasks: the driver gets at most ``rows`` short vectors.
    """
    ids = labels.where(F.col(id_col).isNotNull() & F.col("domain").isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min("domain").alias("__domain"))
    picked = ids.orderBy(F.xxhash64("__id"), "__id").limit(rows)
    # ``picked`` has at most ``rows`` short rows, so its size is bounded.
    mine = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(picked), "__id")
    found = cut(mine.groupBy("__id", "__domain").agg(F.min("__text").alias("__text")))
    sizes = {r["__domain"]: r["n"] for r in found.groupBy("__domain").agg(F.count("*").alias("n")).orderBy("__domain").collect()}
    words = {w.encode("utf-8"): k for k, w in enumerate(telling_words(found, sizes))} if sizes else {}
    inputs = T.StructField("inputs", T.ArrayType(T.FloatType()))
    table = map_columns(found, ["__id", "__domain"], ["__text"], [inputs], lambda: lambda texts: ([measured(t, words)[1].tolist() for t in texts],)).toPandas().sort_values("__id", kind="stable")
    x = np.array(table["inputs"].tolist(), np.float32).reshape(len(table), len(words) + 4)
    return train_domains(x, table["__domain"].tolist(), words)


def domain_posteriors(docs: DataFrame, model: DomainModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``posterior`` ARRAY<DOUBLE> in the order of ``model.domains``.

    Null and empty texts have 0 tokens and the posteriors of no evidence.
    """

    def make():
        def work(texts):
            found = [measured(t, model.words) for t in texts]
            x = np.array([v for _, v in found], np.float32).reshape(len(found), -1)
            return [n for n, _ in found], model.posteriors(x).astype(float).tolist() if len(found) else []

        return work

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("posterior", T.ArrayType(T.DoubleType()))]
    return map_columns(docs, docs.columns if keep is None else keep, [text_col], fields, make, rows=1024)


def rate_column(steps: list[list[float]]):
    """The document's rate after the projected steps so far: max(0, rate + posterior . step), from 1."""
    if not steps:
        return F.lit(1.0)
    moves = F.array(*[F.array(*[F.lit(float(v)) for v in s]) for s in steps])
    gain = lambda move: F.aggregate(F.zip_with("posterior", move, lambda p, v: p * v), F.lit(0.0), lambda a, b: a + b)
    return F.aggregate(moves, F.lit(1.0), lambda r, move: F.greatest(F.lit(0.0), r + gain(move)))


def fit_rates(posteriors: DataFrame, domains: list[str], shares: dict[str, float], anchor: str | None = None, rounds: int = 25, close: float = 1e-6) -> tuple[list[list[float]], dict[str, float], dict[str, float]]:
    """Projected-gradient least squares for nonnegative document rates.

    Minimises the squared gap between each domain's expected tokens, the sum
    of rate * n_tokens * posterior, and its target. Rates are weighed by their
    document's tokens, in which metric the gradient moves a rate by posterior
    . gap. Each round tries ``STEP_LENGTHS`` of that and of the gap scaled by
    the domains' token products over documents of positive rate, and takes
    the one that leaves the least gap after projection; the plain gradient
    over the largest eigenvalue is among them and always lessens it. A round
    is two aggregations over all documents of a few numbers per domain. Rates
    are a function of the steps alone, so no per-document state is kept
    between steps and a lost executor loses nothing.

    ``shares`` gives the target share of each domain. All tokens stay their
    number, or with ``anchor`` that domain's tokens do. Returns the steps (for
    ``rate_column``), targets and what was reached. A target that no rates
    meet, as that of a domain without documents, or one that is open after
    ``rounds`` shows in what was reached (``targets_met``).
    """
    d = len(domains)
    share = np.array([shares.get(x, 0.0) for x in domains], float)
    share = share / share.sum() if share.sum() > 0 else np.full(d, 1 / max(d, 1))
    if not d:
        return [], {}, {}
    p = [F.col("posterior")[k] for k in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]

    def totals(steps: list[list[float]], *columns: Column) -> np.ndarray:
        rated = posteriors.select("n_tokens", "posterior", rate_column(steps).alias("__r"))
        row = rated.agg(*[F.sum(F.col("n_tokens") * c).alias(f"c{k}") for k, c in enumerate(columns)]).first()
        return np.array([v or 0.0 for v in row], float)

    def square(flat: np.ndarray) -> np.ndarray:
        out = np.zeros((d, d))
        for (i, j), v in zip(pairs, flat, strict=True):
            out[i, j] = out[j, i] = v
        return out

    rate, live = F.col("__r"), (F.col("__r") > 0).cast("int")
    expected = [rate * c for c in p]
    products = [p[i] * p[j] for i, j in pairs]
    first = totals([], *expected, *products)
    reached, whole = first[:d], square(first[d:])
    total = reached.sum()
    if anchor in domains and share[domains.index(anchor)] > 0:
        total = reached[domains.index(anchor)] / share[domains.index(anchor)]
    target = share * total
    largest = np.linalg.eigvalsh(whole).max()
    steps: list[list[float]] = []
    while len(steps) < rounds and largest > 0:
        gap = target - reached
        if np.abs(gap).max() <= close * max(target.sum(), 1):
            break
        gram = square(totals(steps, *[live * c for c in products]))
        scaled = np.linalg.lstsq(gram + 1e-9 * np.trace(gram) * np.eye(d), gap, rcond=None)[0]
        moves = [v * s for v, lengths in zip((scaled, gap / largest), STEP_LENGTHS, strict=True) for s in lengths]
        moved = [F.greatest(F.lit(0.0), rate + sum((p[k] * float(m[k]) for k in range(d)), F.lit(0.0))) for m in moves]
        tried = totals(steps, *[r * c for r in moved for c in p]).reshape(-1, d)
        left = np.nan_to_num(np.square(target - tried).sum(1), nan=np.inf)
        best = int(np.argmin(left))
        if left[best] >= np.square(gap).sum():
            break
        steps.append(moves[best].tolist())
        reached = tried[best]
    return steps, dict(zip(domains, target.tolist(), strict=True)), dict(zip(domains, reached.tolist(), strict=True))


def targets_met(target: dict[str, float], reached: dict[str, float], within: float = 1e-4) -> bool:
    """Whether every domain's expected tokens are within that share of all target tokens."""
    return all(abs(target[k] - reached[k]) <= within * max(sum(target.values()), 1) for k in target)


def mix(posteriors: DataFrame, steps: list[list[float]]) -> DataFrame:
    """``posteriors`` with ``rate`` DOUBLE; a clashing column is replaced."""
    return posteriors.withColumn("rate", rate_column(steps))


def realise(docs: DataFrame, id_col: str = "doc_id", rate_col: str = "rate", text_col: str = "text") -> DataFrame:
    """Each row as many times as its rate says: the whole part, and one more with the chance of the rest.

    The chance is drawn from the hash of the id, the text and the row's number
    in the table as it is read, so rows that share an id, or are equal, are
    drawn apart, and a table that is read again gives the same rows. A null
    rate counts as 0.
    """
    text = F.col(text_col) if text_col in docs.columns else F.lit("")
    chance = F.pmod(F.xxhash64(F.col(id_col), text, F.monotonically_increasing_id()), F.lit(1 << 20)) / F.lit(float(1 << 20))
    copies = F.floor(F.coalesce(F.col(rate_col), F.lit(0.0)) + 1e-6 + chance).cast("int")
    copy = fresh(docs, "__copy")
    return docs.withColumn(copy, copies).where(F.col(copy) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy)))).drop(copy)
