"""Main text of web pages by a recurrent block labeller.

A page is cut into its blocks in page order. Each block is described by hashed vectors of
its tag path (names, classes, ids, roles of all open elements) and of its words, and a few numbers.
A bidirectional LSTM in numpy reads the whole page and labels every block as article
or not, so a block is judged by all that stands before and behind it.

There are no labelled pages. The labeller learns from a bounded sample of the pages
themselves: blocks inside elements whose names say what they are (nav, footer, aside, form,
names like ad, cookie or comment; article, main) are marked by these names. Each sample page is also learned in
changed forms: other layouts around the same blocks, with sidebars, notices, forms and
comments made of its own words, and names left out, so that neighbours have to decide.

Defined cases: null or empty html, and pages without a block that is article, give the
empty text. Broken markup is read as far as it goes: an end tag closes what it names if that is open, a
block start closes an open paragraph. Other columns are ignored.
"""

import html as entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements that begin a new block, that are empty, whose content is no text.
BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html iframe label legend li main menu nav ol option p pre
search section select summary table tbody td tfoot th thead title tr ul textarea""".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math textarea iframe object select head title".split())
# Elements that a new element of the same kind closes.
SELF_CLOSING = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"},
                "th": {"td", "th", "tr"}, "option": {"option"}}
# Names that say what an element holds.
ARTICLE_NAMES = frozenset("article main post entry story content articlebody".split())
OTHER_NAMES = frozenset("""nav header footer aside form menu sidebar ad ads advert advertisement banner cookie consent notice
comment comments reply breadcrumb breadcrumbs share social related newsletter subscribe promo sponsor popup modal login
search navigation complementary contentinfo disclaimer widget pager pagination toolbar button""".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_STOP = re.compile("[>\"']")
_NAMES = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PART = re.compile(r"[a-z]+")


@dataclass
class Block:
    path: tuple[tuple[str, ...], ...]  # names of each open element, outermost first
    text: str


def _tag_end(page: str, at: int, last: dict[str, int]) -> tuple[int, int]:
    """(end of the attributes, end of the tag) from behind its name. `last` holds the last place of each quotation mark;
    one that is not closed ends, with the tag, at the next `>`. No character is looked at twice."""
    while found := _STOP.search(page, at):
        mark, here = found.group(), found.start()
        if mark == ">":
            return here, here + 1
        if last[mark] <= here:
            stop = page.find(">", here)
            return (stop, stop + 1) if stop >= 0 else (len(page), len(page))
        at = page.find(mark, here + 1) + 1
    return len(page), len(page)


def blocks_of(page: str | None) -> Iterator[Block]:
    """The text blocks of a page in order, white space made single and trimmed."""
    open_: list[tuple[str, tuple[str, ...]]] = []
    buffer: list[str] = []
    page, at = page or "", 0
    last, head_ends = {q: page.rfind(q) for q in "\"'"}, True

    def closed() -> Iterator[Block]:
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            yield Block(tuple(n for _, n in open_), text)

    while at < len(page):
        found = _TOKEN.search(page, at)
        end = found.start() if found else len(page)
        if end > at:
            buffer.append(entities.unescape(page[at:end]))
        if not found:
            break
        name = (found.group(2) or "").lower()
        if not name:
            at = found.end()
            continue
        said_to, at = _tag_end(page, found.end(), last)
        said = page[found.end():said_to]
        if name == "br":
            buffer.append("\n")
        if found.group(1):
            depth = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == name), None)
            if depth is not None:
                if any(n in BLOCKS for n, _ in open_[depth:]):
                    yield from closed()
                del open_[depth:]
            continue
        if name in BLOCKS:
            yield from closed()
        if open_ and name in SELF_CLOSING.get(open_[-1][0], ()):
            open_.pop()
        elif name in BLOCKS and any(n == "p" for n, _ in open_):  # a paragraph ends, with what is open in it
            del open_[max(i for i, (n, _) in enumerate(open_) if n == "p"):]
        if name in RAW:
            if name != "head" and not said.rstrip().endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = stop.end() if stop else len(page)
            elif name == "head" and head_ends:
                stop = re.compile(r"</head\b[^>]*>|<body\b", re.I).search(page, at)
                head_ends = stop is not None
                at = at if not stop else stop.start() if stop.group().lower().startswith("<body") else stop.end()
            continue
        if name in EMPTY or said.rstrip().endswith("/") and name not in BLOCKS:
            continue
        names = " ".join(_NAMES.findall(said)).lower()
        open_.append((name, (name, *dict.fromkeys(_PART.findall(names)))))
    yield from closed()


def name_label(path) -> int | None:
    """1 inside an article, 0 inside what names itself as something else, None if no name tells; the innermost decides."""
    for names in reversed(path):
        if any(n in OTHER_NAMES for n in names):
            return 0
        if any(n in ARTICLE_NAMES for n in names):
            return 0 if names[0] != "article" and len(names) > 1 and any(n in OTHER_NAMES for n in names) else 1
    return None


PATH_SIZE, WORD_SIZE = 48, 24


def _slot(word: str, size: int, salt: int) -> tuple[int, float]:
    h = zlib.crc32(word.encode("utf-8", "replace"), salt)
    return h % size, 1.0 if h >> 31 else -1.0


class Features:
    """Vectors of blocks; paths are remembered."""

    def __init__(self):
        self._paths: dict = {}

    def path(self, path) -> np.ndarray:
        v = self._paths.get(path)
        if v is None:
            v = np.zeros(PATH_SIZE)
            for depth, names in enumerate(path):
                weight = 1.0 if depth == len(path) - 1 else 0.7
                for n in names:
                    for salt in (1, 2):
                        at, sign = _slot(n, PATH_SIZE, salt)
                        v[at] += sign * weight
            if len(self._paths) > 20_000:
                self._paths.clear()
            self._paths[path] = v
        return v

    def page(self, blocks: list[Block]) -> np.ndarray:
        out = np.zeros((len(blocks), PATH_SIZE + WORD_SIZE + 4))
        for i, b in enumerate(blocks):
            out[i, :PATH_SIZE] = self.path(b.path)
            words = b.text.lower().split()
            for w in words:
                at, sign = _slot(w, WORD_SIZE, 3)
                out[i, PATH_SIZE + at] += sign
            out[i, PATH_SIZE:PATH_SIZE + WORD_SIZE] /= max(1.0, len(words)) ** 0.5 * 4
            out[i, -4:] = [np.log1p(len(words)) / 4, i / 40 if i < 40 else 1.0, len(b.path) / 10, float(b.text[-1:] in ".!?")]
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with one output per block."""

    def __init__(self, inputs: int, hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for side in "fb":
            self.p[f"w{side}"] = rng.normal(0, 0.15, (inputs, 4 * hidden))
            self.p[f"u{side}"] = rng.normal(0, 0.15, (hidden, 4 * hidden))
            bias = np.zeros(4 * hidden)
            bias[hidden:2 * hidden] = 1.0  # gates begin open for what is remembered
            self.p[f"c{side}"] = bias
        self.p["out"] = rng.normal(0, 0.15, 2 * hidden)
        self.p["bias"] = np.zeros(1)

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool):
        """Hidden states (pages, steps, hidden) of one direction; padded steps leave the state alone."""
        n, steps, _ = x.shape
        z_in = x @ self.p[f"w{side}"] + self.p[f"c{side}"]
        h, c, k = np.zeros((n, self.hidden)), np.zeros((n, self.hidden)), self.hidden
        out, tape = np.zeros((n, steps, k)), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = z_in[:, t] + h @ self.p[f"u{side}"]
            i, f, o, g = _sigmoid(z[:, :k]), _sigmoid(z[:, k:2 * k]), _sigmoid(z[:, 2 * k:3 * k]), np.tanh(z[:, 3 * k:])
            m = mask[:, t, None]
            new = m * (f * c + i * g) + (1 - m) * c
            if keep:
                tape.append((t, h, c, i, f, o, g, new, m))
            c = new
            h = m * (o * np.tanh(c)) + (1 - m) * h
            out[:, t] = h
        return out, tape

    def odds(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return sum(self._run(x, mask, side, False)[0] @ w for side, w in zip("fb", np.split(self.p["out"], 2))) + self.p["bias"]

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over blocks of positive weight, by backpropagation through time."""
        runs = {side: self._run(x, mask, side, True) for side in "fb"}
        w = dict(zip("fb", np.split(self.p["out"], 2)))
        d = (_sigmoid(runs["f"][0] @ w["f"] + runs["b"][0] @ w["b"] + self.p["bias"]) - y) * weight / max(1.0, weight.sum())
        grad = {"bias": np.array([d.sum()]),
                "out": np.concatenate([np.einsum("nt,ntk->k", d, runs[s][0]) for s in "fb"])}
        k = self.hidden
        for side in "fb":
            dw, du, dc_ = (np.zeros_like(self.p[f"{name}{side}"]) for name in "wuc")
            dh, dc = np.zeros((len(x), k)), np.zeros((len(x), k))
            for t, h, c, i, f, o, g, new, m in reversed(runs[side][1]):
                dh = dh + d[:, t, None] * w[side]
                tanh = np.tanh(new)
                inner = m * dh
                step_c = m * dc + inner * o * (1 - tanh ** 2)
                dz = np.concatenate([step_c * g * i * (1 - i), step_c * c * f * (1 - f), inner * tanh * o * (1 - o),
                                     step_c * i * (1 - g ** 2)], axis=1)
                dw += x[:, t].T @ dz
                du += h.T @ dz
                dc_ += dz.sum(axis=0)
                dh = (1 - m) * dh + dz @ self.p[f"u{side}"].T
                dc = step_c * f + (1 - m) * dc
            grad |= {f"w{side}": dw, f"u{side}": du, f"c{side}": dc_}
        return grad

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray, np.ndarray]], epochs: int, rate: float, batch: int = 32, seed: int = 5):
        """Adam over pages of (features, labels, weights)."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for a in range(0, len(order), batch):
                step += 1
                x, mask, y, weight = _padded([pages[i] for i in order[a:a + batch]])
                for k, g in self.gradient(x, mask, y, weight).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] -= rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
        return self


def _padded(pages):
    steps = max(len(p[0]) for p in pages)
    x = np.zeros((len(pages), steps, pages[0][0].shape[1]))
    mask, y, weight = (np.zeros((len(pages), steps)) for _ in range(3))
    for i, (f, label, w) in enumerate(pages):
        x[i, :len(f)], mask[i, :len(f)], y[i, :len(f)], weight[i, :len(f)] = f, 1.0, label, w
    return x, mask, y, weight


def _varied(blocks: list[Block], labels: list[int], rng) -> tuple[list[Block], list[int]]:
    """The page with another layout: its article in other elements, other things around and between."""
    words = " ".join(b.text for b in blocks).split()

    def made(low, high):
        at = int(rng.integers(0, max(1, len(words) - high)))
        return " ".join(words[at:at + int(rng.integers(low, high))]) or "x"

    html, body = ("html",), ("body",)
    inside = [(html, body, ("article",)), (html, body, ("main",)), (html, body, ("main",), ("article",)),
              (html, body, ("div", "content")), (html, body, ("div", "post"), ("div", "entry")),
              (html, body, ("div", "main"), ("section",)), (html, body, ("div", "page"), ("div", "article", "body"))][rng.integers(0, 7)]
    other = [("nav",), ("header",), ("footer",), ("aside",), ("form",), ("div", "sidebar"), ("div", "ad"), ("div", "ads"),
             ("div", "advert"), ("div", "banner"), ("div", "cookie"), ("div", "cookie", "notice"), ("div", "notice"),
             ("div", "comments"), ("section", "comments"), ("div", "comment"), ("ul", "menu"), ("div", "related"),
             ("div", "share"), ("div", "newsletter"), ("div", "promo"), ("section", "reader", "comments"), ("ol", "comments"),
             ("div", "popup"), ("div", "disclaimer"), ("ul", "breadcrumb"), ("div", "widget")]
    leaves = [("p",), ("li",), ("a",), ("span",), ("div",), ("h3",), ("label",), ("button",)]

    def aside(base):
        at = (*base, other[rng.integers(0, len(other))])
        return [(Block((*at, leaves[rng.integers(0, len(leaves))]) if rng.random() < 0.7 else at, made(1, 30)), 0)
                for _ in range(rng.integers(1, 5))]

    if rng.random() < 0.25:  # fragments without the outer elements, and short pages
        body_of, inside = (), inside[2:]
    else:
        body_of = (html, body)
    if rng.random() < 0.25:
        kept = sorted(rng.permutation(len(blocks))[:int(rng.integers(1, 6))])
        blocks, labels = [blocks[i] for i in kept], [labels[i] for i in kept]

    out = []
    for _ in range(rng.integers(0, 4)):
        out += aside(body_of)
    for b, label in zip(blocks, labels):
        if label:
            tail = b.path[-1:] if b.path and b.path[-1][0] not in ("article", "main", "body", "div") else (("p",),)
            out.append((Block((*inside, *tail), b.text), 1))
            if rng.random() < 0.1:
                out += aside(inside)
    for _ in range(rng.integers(0, 4)):
        out += aside(inside if rng.random() < 0.2 else body_of)
    return [b for b, _ in out], [label for _, label in out]


def train(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", sample_pages: int = 200, longest: int = 200,
          epochs: int = 12, variants: int = 3, seed: int = 11) -> Labeller:
    """Fit on about `sample_pages` pages, chosen by a hash; of a sampled page the first `longest` blocks teach.

    Only fitting is bounded so; `extract` labels every block of every page.
    """
    total = pages.count()
    part = min(1.0, sample_pages / max(1, total))
    key = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.octet_length(html_col)), F.lit(1 << 30))
    sample = pages.where(key < int(part * (1 << 30))).select(F.col(html_col).cast("string").alias("html"))

    def cut(parts):
        for batch in parts:
            rows = [list(blocks_of(t))[:longest] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([[[" ".join(n) for n in b.path] for b in r] for r in rows], pa.list_(pa.list_(pa.string()))),
                 pa.array([[b.text[:400] for b in r] for r in rows], pa.list_(pa.string()))], names=["paths", "texts"])

    rows = sample.mapInArrow(cut, "paths array<array<string>>, texts array<string>").toArrow().to_pylist()
    rng = np.random.default_rng(seed)
    features, learned = Features(), []
    for r in sorted(rows, key=lambda r: str(r["texts"])):
        blocks = [Block(tuple(tuple(n.split(" ")) for n in p), t) for p, t in zip(r["paths"], r["texts"])]
        labels = [name_label(b.path) for b in blocks]
        if not blocks:
            continue
        learned.append((features.page(blocks), np.array([label or 0 for label in labels], float),
                        np.array([label is not None for label in labels], float)))
        for _ in range(variants):
            b, y = _varied(blocks, [label or 0 for label in labels], rng)
            if b:
                learned.append((features.page(b), np.array(y, float), np.ones(len(y))))
    model = Labeller(PATH_SIZE + WORD_SIZE + 4)
    return model.fit(learned, epochs, 0.02) if learned else model


def main_texts(pages: list[str | None], model: Labeller, features: Features, steps: int = 20_000) -> list[str]:
    """The article text of each page. Pages of like length are labelled together, `steps` blocks at a time."""
    blocks = [list(blocks_of(p)) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i, b in enumerate(blocks) if b), key=lambda i: len(blocks[i]))
    at = 0
    while at < len(order):
        group = [order[at]]
        while at + len(group) < len(order) and len(blocks[order[at + len(group)]]) * (len(group) + 1) <= steps:
            group.append(order[at + len(group)])
        at += len(group)
        x, mask, _, _ = _padded([(features.page(blocks[i]), 0.0, 0.0) for i in group])
        for i, odds in zip(group, model.odds(x, mask)):
            out[i] = "\n\n".join(b.text for b, o in zip(blocks[i], odds) if o > 0)
    return out


def extract(pages: DataFrame, model: Labeller, html_col: str = "html", text_out: str = "text") -> DataFrame:
    """All columns of `pages` but the html, and the article text. An existing column of its name is replaced."""
    kept = [c for c in pages.columns if c not in (html_col, text_out)]
    sent = pages.sparkSession.sparkContext.broadcast(model)
    chosen = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{html_col}`").cast("string").alias(html_col))

    def rows(parts):
        features = Features()
        for batch in parts:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = main_texts(part.column(len(kept)).to_pylist(), sent.value, features)
                yield pa.RecordBatch.from_arrays([*part.columns[:len(kept)], pa.array(texts, pa.string())], names=[*kept, text_out])

    return chosen.mapInArrow(rows, pages.select([F.col(f"`{c}`") for c in kept]).schema.add(text_out, "string"))
