"""Main text of web pages: a recurrent labeller reads every block of a page.

A page becomes the sequence of its leaf blocks. Each block is a vector of its
hashed tag path (tags, class and id words of the open elements), its hashed
words and a few rates. A bidirectional LSTM in numpy reads the sequence both
ways, so each block is classified with the whole page as context.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsengine.llm.frames import map_columns, prepare_workers

# Fixed values of HTML: elements without an end tag, text-level elements,
# elements whose content is no text, and which open elements a start tag ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("math mi mn mo ms mtext mrow msup msub mfrac msqrt mroot mover munder semantics annotation a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rt rp s samp small span strike strong sub sup time tt u var".split())
RAW = frozenset("script style".split())
HIDDEN = frozenset("script style template iframe svg".split())
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "body": {"head", "title"}}
ENDS |= {t: {"p"} for t in "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split()}
ATTRS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

PATH_SLOTS, WORD_SLOTS, RATES = 64, 32, 8
INPUTS = PATH_SLOTS + WORD_SLOTS + RATES
#: The network reads longer sequences in pieces of so many blocks, carrying its states from piece to piece.
PIECE = 1024


@dataclass
class Block:
    path: tuple[str, ...]
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    @property
    def text(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).split())


TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
SPACE = " \t\n\r\f/"


def tag_end(page: str, at: int) -> int:
    """Where the tag whose attributes begin at ``at`` ends, past its ``>``; -1 if it never does.

    A quote opens a value only right after ``=``, so a quote elsewhere is a
    plain character; one that is never closed ends with the first ``>``.
    """
    size, start = len(page), at
    close: dict[str, int] = {}
    while True:
        mark = MARK.search(page, at)
        if mark is None:
            return -1
        if mark[0] == ">":
            return mark.end()
        quote = mark[0][-1]
        if close.get(quote) == -1:
            at = mark.end()
            continue
        close[quote] = end = page.find(quote, mark.end())
        if end < 0:
            first = page.find(">", start)
            return first + 1 if first >= 0 else -1
        at = min(end + 1, size)


MARK = re.compile(r">|=[ \t\n\r\f]*[\"']")


def scan(page: str):
    """(kind, name, stretch) of each piece of a page: text, a start or an end tag; every character is looked at a bounded number of times.

    Comments, declarations and the content of ``RAW`` elements give nothing;
    a ``<`` that begins no tag is text, and so is a tag that never ends.
    """
    at, size = 0, len(page)
    endless: dict[str, bool] = {}
    while at < size:
        low = page.find("<", at)
        if low != at:
            yield "text", "", page[at : low if low >= 0 else size]
            if low < 0:
                return
            at = low
        if page.startswith("<!--", at):
            end = page.find("-->", at + 2)  # <!--> and <!---> are whole comments
            at = end + 3 if end >= 0 else size
            continue
        if page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at)
            at = end + 1 if end >= 0 else size
            continue
        m = TAG.match(page, at)
        end = tag_end(page, m.end()) if m and not endless.get("tag") else -1
        if end < 0:
            if m:
                endless["tag"] = True
            yield "text", "", "<"
            at += 1
            continue
        name = m[2].lower()
        yield ("end" if m[1] else "start"), name, page[m.end() : end - 1]
        at = end
        if not m[1] and name in RAW and not endless.get(name):
            close = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            if close is None:
                endless[name] = True  # an element that is never closed hides nothing but its own text
                after = page.find("<", at)
                at = after if after >= 0 else size
            else:
                at = close.start()


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks with text, in page order; markup inside a block is dropped, ``br`` is white space."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    links = hidden = 0
    now: Block | None = None

    def path() -> tuple[str, ...]:
        return tuple(x for _, marks in stack for x in marks)

    pieces = list(scan(page or ""))
    closers = Counter(name for kind, name, _ in pieces if kind == "end" and name in HIDDEN)
    for kind, name, rest in pieces:
        if kind == "text":
            if hidden:
                continue
            if now is None:
                if rest.isspace():
                    continue
                now = Block(path())
                out.append(now)
            now.parts.append(rest)
            if links:
                now.linked += len(rest)
            continue
        if name in HIDDEN:
            # An element that is not closed from here on hides nothing.
            if kind == "end":
                closers[name] -= 1
                hidden = max(0, hidden - 1)
            elif not rest.endswith("/") and closers[name] > 0:
                hidden += 1
            continue
        if name not in INLINE and kind == "end" and name in ("article", "body", "html", "main"):
            hidden = 0  # what was left open inside ends with it
        if kind == "end":
            if name == "a":
                links = max(0, links - 1)
            if name not in INLINE and name not in VOID:
                now = None
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        links = 0
                        break
            continue
        if name == "br":
            if now is not None:
                now.parts.append(" ")
            continue
        if name == "a":
            links += 1
        if name in INLINE or name in ("img", "wbr"):
            continue
        now = None
        if name in VOID:
            continue
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] not in ENDS.get(name, ()):
                break
            del stack[k]
        marks = [name]
        for a in ATTRS.finditer(rest):
            marks += [f"{x.lower()}" for x in NAME.findall(a[2] or a[3] or a[4] or "")]
        stack.append((name, tuple(f"<{marks[0]}>" if i == 0 else x for i, x in enumerate(marks))))
    return [b for b in out if b.text]


def slot(word: str, slots: int, known: dict[str, int]) -> int:
    """A signed place: hash modulo ``slots``, with the sign in the lowest bit."""
    if (x := known.get(word)) is None:
        if len(known) > 500_000:
            known.clear()
        h = zlib.crc32(word.encode("utf-8", "replace"))
        x = known[word] = (h >> 1) % slots * 2 + (h & 1)
    return x


class Reader:
    """Vectors of blocks; keeps the places of words it has seen."""

    def __init__(self):
        self.paths: dict[tuple[str, ...], np.ndarray] = {}
        self.marks: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def path(self, path: tuple[str, ...]) -> np.ndarray:
        v = self.paths.get(path)
        if v is None:
            if len(self.paths) > 20_000:
                self.paths.clear()
            v = np.zeros(PATH_SLOTS, np.float32)
            for mark in {*path, *(f"leaf {x}" for x in path[-1:])}:
                x = slot(mark, PATH_SLOTS, self.marks)
                v[x >> 1] += 1 - 2 * (x & 1)
            self.paths[path] = v
        return v

    def vectors(self, page: list[tuple[tuple[str, ...], str, int]]) -> np.ndarray:
        """(blocks, INPUTS) of (path, text, linked characters)."""
        out = np.zeros((len(page), INPUTS), np.float32)
        for k, (path, text, linked) in enumerate(page):
            words = text.split(" ")
            out[k, :PATH_SLOTS] = self.path(path)
            x = np.array([slot(w, WORD_SLOTS, self.words) for w in words])
            bag = np.bincount(x, minlength=2 * WORD_SLOTS).astype(np.float32)
            out[k, PATH_SLOTS : PATH_SLOTS + WORD_SLOTS] = (bag[0::2] - bag[1::2]) / np.sqrt(len(words))
            n = len(text)
            out[k, PATH_SLOTS + WORD_SLOTS :] = (np.log1p(n) / 4, np.log1p(len(words)) / 3, min(1.0, linked / n), (text.count(".") + text.count(",")) * 10 / (n + 10), float(text[-1] in ".!?…"), k / len(page), float("©" in text), min(1.0, len(page) / 50))
        return out


@dataclass
class BiLstm:
    """Weights of both directions (2, inputs + hidden + 1, 4 * hidden) and of the output."""

    w: np.ndarray
    out: np.ndarray

    @classmethod
    def new(cls, hidden: int = 16, seed: int = 3) -> BiLstm:
        rng = np.random.default_rng(seed)
        w = rng.normal(0, 1 / np.sqrt(INPUTS + hidden), (2, INPUTS + hidden + 1, 4 * hidden)).astype(np.float32)
        w[:, -1, hidden : 2 * hidden] = 1  # forget gates start open
        return cls(w, rng.normal(0, 0.2, 2 * hidden + 1).astype(np.float32))

    def one_way(self, x: np.ndarray, mask: np.ndarray, way: int, trace: list | None = None, state: list[np.ndarray] | None = None) -> np.ndarray:
        """Hidden states (pages, steps, hidden); way 1 reads backwards. Masked steps keep the state.

        ``state`` holds the two states to begin with, and those at the end afterwards.
        """
        n, steps, _ = x.shape
        size = self.w.shape[2] // 4
        w = self.w[way]
        gates_in = x.reshape(-1, INPUTS) @ w[:INPUTS] + w[-1]
        gates_in = gates_in.reshape(n, steps, -1)
        h, c = state or (np.zeros((n, size), np.float32), np.zeros((n, size), np.float32))
        hidden = np.zeros((n, steps, size), np.float32)
        for t in range(steps - 1, -1, -1) if way else range(steps):
            g = gates_in[:, t] + h @ w[INPUTS:-1]
            s = 1 / (1 + np.exp(-np.clip(g[:, : 3 * size], -30, 30)))
            z = np.tanh(g[:, 3 * size :])
            c_new = s[:, size : 2 * size] * c + s[:, :size] * z
            th = np.tanh(c_new)
            m = mask[:, t, None]
            if trace is not None:
                trace.append((t, h, c, s, z, th, m))
            c = np.where(m, c_new, c)
            h = np.where(m, s[:, 2 * size :] * th, h)
            hidden[:, t] = h
        if state is not None:
            state[:] = h, c
        return hidden

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self.one_way(x, mask, 0), self.one_way(x, mask, 1)], axis=2)
        return both @ self.out[:-1] + self.out[-1]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the mean log loss over unmasked blocks, by backpropagation through time."""
        size = self.w.shape[2] // 4
        traces: list[list] = [[], []]
        states = [self.one_way(x, mask, way, traces[way]) for way in (0, 1)]
        both = np.concatenate(states, axis=2)
        p = 1 / (1 + np.exp(-(both @ self.out[:-1] + self.out[-1])))
        d = ((p - y) * mask / mask.sum()).astype(np.float32)
        d_out = np.append(np.einsum("nts,nt->s", both, d), d.sum()).astype(np.float32)
        d_w = np.zeros_like(self.w)
        for way in (0, 1):
            w = self.w[way]
            d_hidden = d[:, :, None] * self.out[way * size : (way + 1) * size]
            dh, dc = np.zeros_like(states[way][:, 0]), np.zeros_like(states[way][:, 0])
            d_gates = np.zeros((*x.shape[:2], 4 * size), np.float32)
            for t, h, c, s, z, th, m in reversed(traces[way]):
                i, f, o = s[:, :size], s[:, size : 2 * size], s[:, 2 * size :]
                dh = dh + d_hidden[:, t]
                dh_new, dc_new = np.where(m, dh, 0), np.where(m, dc, 0)
                dc_new = dc_new + dh_new * o * (1 - th**2)
                g = np.concatenate([dc_new * z * i * (1 - i), dc_new * c * f * (1 - f), dh_new * th * o * (1 - o), dc_new * i * (1 - z**2)], axis=1)
                d_gates[:, t] = g
                d_w[way, INPUTS:-1] += h.T @ g
                dh = np.where(m, 0, dh) + g @ w[INPUTS:-1].T
                dc = np.where(m, dc_new * f, dc)
            flat = d_gates.reshape(-1, 4 * size)
            d_w[way, :INPUTS] = x.reshape(-1, INPUTS).T @ flat
            d_w[way, -1] = flat.sum(0)
        return d_w, d_out

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], rounds: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 5) -> None:
        """Adam over batches of pages of similar length."""
        rng = np.random.default_rng(seed)
        order = np.argsort([len(p) for p in pages], kind="stable")
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        params = [self.w, self.out]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step, total = 0, rounds * len(groups)
        for _ in range(rounds):
            for k in rng.permutation(len(groups)):
                x, mask = padded([pages[i] for i in groups[k]])
                y = np.zeros(mask.shape, np.float32)
                for r, i in enumerate(groups[k]):
                    y[r, : len(labels[i])] = labels[i]
                step += 1
                slow = rate * (1 - 0.9 * step / total)
                for p, g, a, b in zip(params, self.gradients(x, mask, y), first, second, strict=True):
                    g = g * min(1.0, 5 / (np.linalg.norm(g) + 1e-9))
                    a += 0.1 * (g - a)
                    b += 0.001 * (g**2 - b)
                    p -= slow * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)

    def long_logits(self, page: np.ndarray) -> np.ndarray:
        """The same for one page of any length in bounded memory: states go on from piece to piece, both ways."""
        size = self.w.shape[2] // 4
        starts = list(range(0, len(page), PIECE))
        out = np.full(len(page), self.out[-1], np.float32)
        for way in (0, 1):
            state = [np.zeros((1, size), np.float32), np.zeros((1, size), np.float32)]
            for at in reversed(starts) if way else starts:
                x, mask = padded([page[at : at + PIECE]])
                out[at : at + PIECE] += self.one_way(x, mask, way, None, state)[0] @ self.out[way * size : (way + 1) * size]
        return out

    def main_blocks(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Whether each block of each page is main text, read with the whole page as context whatever its length."""
        out = [np.zeros(len(p), bool) if len(p) <= PIECE else self.long_logits(p) > 0 for p in pages]
        order = [i for i in np.argsort([len(p) for p in pages], kind="stable") if 0 < len(pages[i]) <= PIECE]
        at = 0
        while at < len(order):
            group = [order[at]]
            while at + len(group) < len(order) and len(group) < 128 and len(pages[order[at + len(group)]]) * (len(group) + 1) <= 16_384:
                group.append(order[at + len(group)])
            at += len(group)
            x, mask = padded([pages[i] for i in group])
            yes = self.logits(x, mask) > 0
            for r, i in enumerate(group):
                out[i] = yes[r, : len(pages[i])]
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((len(pages), steps, INPUTS), np.float32), np.zeros((len(pages), steps), bool)
    for r, p in enumerate(pages):
        x[r, : len(p)], mask[r, : len(p)] = p, True
    return x, mask


# Words that name the parts of a page in class and id attributes.
MAIN_NAMES = "article content post entry main story body text page single".split()
SIDE_NAMES = {
    "menu": "nav menu navbar navigation breadcrumb topbar",
    "head": "header masthead banner logo site top",
    "foot": "footer bottom copyright legal foot",
    "side": "sidebar aside widget related recommended popular trending tags",
    "note": "cookie consent notice alert gdpr popup modal message warning",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion",
    "form": "form newsletter subscribe signup search login field input contact",
    "talk": "comments comment reply discussion respond thread",
    "share": "share social follow author meta byline date",
}
SIDE_TAGS = {"menu": ["nav", "div", "ul"], "head": ["header", "div"], "foot": ["footer", "div"], "side": ["aside", "div", "section"], "note": ["div", "section", "aside"], "ad": ["div", "aside", "ins"], "form": ["form", "div"], "talk": ["section", "div", "ol"], "share": ["div", "ul", "p"]}
LEAVES = {"menu": ["li", "div"], "head": ["div", "p", "h1"], "foot": ["p", "div", "li"], "side": ["li", "p", "h3", "div"], "note": ["p", "div", "button"], "ad": ["p", "div"], "form": ["label", "p", "button", "legend", "option"], "talk": ["p", "div", "li", "h3"], "share": ["li", "div"]}


def made_page(rng: np.random.Generator, texts: list[str]) -> tuple[list, np.ndarray]:
    """A page put together from blocks of text in layouts that the given pages need not have."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    text = lambda: pick(texts)
    short = lambda: " ".join(text().split(" ")[: int(rng.integers(1, 9))])
    rows: list[tuple] = []
    y: list[int] = []

    def side(kind: str, around: tuple[str, ...]) -> None:
        names = [pick(SIDE_NAMES[kind].split()) for _ in range(int(rng.integers(1, 3)))]
        tag = pick(SIDE_TAGS[kind])
        if rng.random() < 0.25 and tag in ("nav", "header", "footer", "aside", "form"):
            names = []
        inner = (*around, f"<{tag}>", *names, *(("<ul>",) if rng.random() < 0.3 else ()))
        long = {"menu": 0.02, "head": 0.1, "foot": 0.3, "side": 0.4, "note": 0.6, "ad": 0.6, "form": 0.3, "talk": 0.9, "share": 0.05}[kind]
        for _ in range(int(rng.integers(1, 9 if kind in ("menu", "side", "talk") else 4))):
            leaf = pick(LEAVES[kind])
            t = text() if rng.random() < long else short()
            marks = (f"<{leaf}>", *((pick(SIDE_NAMES[kind].split()),) if rng.random() < 0.2 else ()))
            rows.append(((*inner, *marks), t, len(t) if rng.random() < {"menu": 0.95, "side": 0.6, "share": 0.7}.get(kind, 0.1) else 0))
            y.append(0)

    page = ("<html>", "<body>")
    rows.append((("<html>", "<head>", "<title>"), short(), 0))
    y.append(0)
    if rng.random() < 0.4:
        page = (*page, "<div>", pick(["page", "wrapper", "container", "site", "layout"]))
    for kind in rng.permutation(["note", "head", "menu", "ad", "side"])[: int(rng.integers(1, 6))]:
        side(str(kind), page)
    tag = pick(["article", "article", "main", "div", "section"])
    names = [pick(MAIN_NAMES) for _ in range(int(rng.integers(1, 3)))] if tag in ("div", "section") or rng.random() < 0.4 else []
    inner = (*page, f"<{tag}>", *names)
    for k in range(int(rng.integers(1, 16))):
        leaf = "h1" if k == 0 and rng.random() < 0.8 else pick(["p"] * 8 + ["h2", "h3", "li", "blockquote", "pre", "td", "div", "figcaption"])
        around = inner + {"li": ("<ul>",), "td": ("<table>", "<tr>")}.get(leaf, ())
        t = short() if leaf[0] == "h" or rng.random() < 0.15 else text()
        rows.append(((*around, f"<{leaf}>"), t, len(t) if rng.random() < 0.03 else 0))
        y.append(1)
        if rng.random() < 0.08:
            side(pick(["ad", "side", "form", "share", "note"]), inner if rng.random() < 0.8 else page)
    for kind in rng.permutation(["talk", "side", "form", "foot", "share", "ad", "menu"])[: int(rng.integers(1, 6))]:
        side(str(kind), inner if rng.random() < 0.15 else page)
    if rng.random() < 0.7:
        side("foot", page)
    return rows, np.array(y, np.float32)


def weak_label(path: tuple[str, ...]) -> float | None:
    """What a given page's own markup says of a block: main, not main, or nothing."""
    marks = set(path)
    if marks & {"<nav>", "<header>", "<footer>", "<aside>", "<form>", "<title>", "<button>", "<select>"} or marks & {x for names in SIDE_NAMES.values() for x in names.split()}:
        return 0.0
    return 1.0 if marks & {"<article>", "<main>"} else None


def train(pages: list[str | None], made: int = 1500, seed: int = 11) -> BiLstm:
    """A labeller from a bounded list of pages and ``made`` pages in other layouts.

    Given pages are labelled by their own markup where it is plain; blocks of
    unknown kind are learnt only from the made pages, whose kinds are known.
    """
    rng = np.random.default_rng(seed)
    reader, xs, ys, texts = Reader(), [], [], []
    for page in pages:
        found = blocks(page)
        texts += [b.text for b in found if weak_label(b.path) == 1.0]
        y = [weak_label(b.path) for b in found]
        if found and None not in y:
            xs.append(reader.vectors([(b.path, b.text, b.linked) for b in found]))
            ys.append(np.array(y, np.float32))
    texts = texts or ["A sentence of some words, to begin with.", "Short text."]
    for _ in range(made):
        rows, y = made_page(rng, texts)
        xs.append(reader.vectors(rows))
        ys.append(y)
    model = BiLstm.new()
    model.fit(xs, ys)
    return model


def fit_labeller(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", rows: int = 300) -> BiLstm:
    """Train on the at most ``rows`` pages whose ids hash lowest, the same at every run.

    The bounded sample is trained on in one task, so a lost executor only
    means that the task runs again; the weights come back to the driver.
    """
    ids = pages.select(F.col(id_col).alias("__id")).where(F.col(id_col).isNotNull()).distinct().orderBy(F.xxhash64("__id"), "__id").limit(rows)
    # ``ids`` has at most ``rows`` rows of one number, so its size is bounded.
    found = pages.select(F.col(id_col).alias("__id"), F.col(html_col).alias("__html")).join(F.broadcast(ids), "__id").groupBy("__id").agg(F.min("__html").alias("__html"))

    def learn(batches):
        rows_ = sorted(((r["__id"], r["__html"]) for b in batches for r in b.to_pylist()), key=lambda r: r[0])
        model = train([h for _, h in rows_])
        yield pa.RecordBatch.from_arrays([pa.array([model.w.tobytes()], pa.binary()), pa.array([model.out.tobytes()], pa.binary())], names=["w", "out"])

    prepare_workers(pages.sparkSession)
    made = found.repartition(1).mapInArrow(learn, "w binary, out binary").first()
    out = np.frombuffer(made["out"], np.float32)
    hidden = (len(out) - 1) // 2
    return BiLstm(np.frombuffer(made["w"], np.float32).reshape(2, INPUTS + hidden + 1, 4 * hidden), out)


def extract_main_text(pages: DataFrame, model: BiLstm, html_col: str = "html", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``pages`` with ``text_col``: the main blocks of the whole page, one a line.

    Character references are decoded and white space within a block becomes
    one space. Null and empty pages, and pages without main text, give an
    empty text. An existing column named ``text_col`` is replaced.
    """

    def make():
        reader = Reader()

        def work(pages_):
            found = [blocks(p) for p in pages_]
            texts = [[b.text for b in bs] for bs in found]
            main = model.main_blocks([reader.vectors([(b.path, t, b.linked) for b, t in zip(bs, ts, strict=True)]) for bs, ts in zip(found, texts, strict=True)])
            return (["\n".join(t for t, y in zip(ts, ys, strict=True) if y) for ts, ys in zip(texts, main, strict=True)],)

        return work

    return map_columns(pages, pages.columns if keep is None else keep, [html_col], [T.StructField(text_col, T.StringType())], make, rows=128)
