"""Main text of web pages by a recurrent block labeller.

A page is read as the sequence of its text blocks (text between block-level tags, character references
decoded, white space folded). Each block gives one vector: its tag path (names and classes of all
open elements, hashed), its words (hashed) and a few sizes. A bidirectional LSTM reads the sequence,
so every block is labelled with the whole page in view; blocks labelled as main text are joined.

The labeller is trained here on generated pages with known labels: ``TRAINING_PAGES`` of them, from a fixed
seed, with the places where sites put articles, menus, notices, adverts, forms and comments. It never sees the table.

Cases: null or empty html and pages without main text give an empty text; broken markup is read as far as it goes
(unclosed elements end with their parent, an unclosed svg or select also with the next block-level element; scripts, styles,
titles, text areas and iframes run on to the end of the page); repeated rows give repeated results; null ids and urls stay; other columns
are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm import words as W
from tallyloom.llm.common import batches_of, cached, rows_of

TRAINING_PAGES = 480
EPOCHS = 6
HIDDEN = 16
PATH_BINS, WORD_BINS, SIZES = 256, 64, 5
WIDTH = PATH_BINS + WORD_BINS + SIZES
#: Blocks that are labelled at a time.
HELD_BLOCKS = 8_192

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>?", re.S)
_CLASSES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
_INLINE |= frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mprescripts".split())
_INLINE |= frozenset("mtable mtr mtd mstyle mpadded mphantom menclose merror semantics annotation annotation-xml".split())
#: Content that is not text of the page: raw text up to its end tag, and elements.
_RAW = frozenset("script style title textarea iframe".split())
_SILENT = frozenset("noscript template svg object select".split())
#: Elements that end an svg or select without its end tag.
_BREAKS = frozenset("address article aside blockquote body dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table ul".split())
#: An element that starts ends an open one of these kinds, within the given container.
_ENDS = {"li": ("li", ("ul", "ol")), "dt": ("dt", ("dl",)), "dd": ("dd", ("dl",)), "tr": ("tr", ("table",)), "td": ("td", ("tr",)), "th": ("th", ("tr",))}


def blocks_of(html: str) -> list[tuple[tuple[str, ...], str, float]]:
    """(tag path, text, share of it inside links) of every non-empty block, in page order."""
    found, stack, parts = [], [], []
    at, linked, total, in_link = 0, 0, 0, 0
    inline = []  # open inline elements and the depth they stand at
    mute = None  # depth of the outermost silent element and number of inline elements around it

    def flush():
        nonlocal linked, total
        text = " ".join("".join(parts).split())
        if text:
            found.append((tuple(stack), text, linked / max(total, 1)))
        parts.clear()
        linked = total = 0

    def cut(depth: int):
        nonlocal mute
        del stack[depth:]
        while inline and inline[-1][1] > depth:
            inline.pop()
        if mute and depth <= mute[0]:
            mute = None

    def close(name: str, within: tuple[str, ...] = (), least: int = 0):
        for k in range(len(stack) - 1, least - 1, -1):
            own = stack[k].split(".", 1)[0]
            if own == name:
                cut(k)
                return
            if own in within:
                return

    def close_inline(name: str):
        for k in range(len(inline) - 1, -1, -1):
            if inline[k][0] == name:
                del inline[k:]
                if mute and k < mute[1]:
                    cut(mute[0])
                return

    def breaks(name: str) -> bool:
        """Whether an element ends the svg or select it starts in, as that has no end tag of its own."""
        own = stack[mute[0]]
        if name == "body" or name not in _BREAKS or own not in ("svg", "select") or "foreignobject" in stack[mute[0] :]:
            return name == "body"
        following = re.compile(f"<(/?){own}\\b", re.I).search(html, at)
        return following is None or not following[1]

    def take(chunk: str):
        nonlocal linked, total
        if chunk and not mute:
            chunk = entities.unescape(chunk) if "&" in chunk else chunk
            parts.append(chunk)
            total += len(chunk)
            linked += len(chunk) if in_link else 0

    while True:
        tag = _TAG.search(html, at)
        take(html[at : tag.start()] if tag else html[at:])
        if tag is None:
            flush()
            return found
        at = tag.end()
        if tag[2] is None:
            continue
        name = tag[2].lower()
        if not tag[0].endswith(">"):  # an odd quote: the tag ends with the next bracket
            end = html.find(">", at)
            at = len(html) if end < 0 else end + 1
        if name not in _INLINE:
            flush()
        if mute and not tag[1] and breaks(name):
            cut(mute[0])
        if tag[1]:
            close_inline(name) if name in _INLINE else close(name)
            if name == "a":
                in_link = 0
        elif name in _RAW or name in _SILENT:
            if tag[0].endswith("/>"):
                continue
            end = re.compile(f"</{name}[^>]*>?", re.I).search(html, at) if name in _RAW else None
            if end:
                at = end.end()
            elif name in _RAW and not (mute and stack[mute[0]] == "svg"):
                at = len(html)
            else:
                mute = mute or (len(stack), len(inline))
                stack.append(name)
        elif name not in _VOID:
            if name in _INLINE:
                if not tag[0].endswith("/>"):
                    inline.append((name, len(stack)))
                if name == "a" and not mute:
                    in_link = 1
                continue
            least = mute[0] + 1 if mute else 0
            close("p", ("div", "section", "article", "main", "aside", "td", "li", "body"), least)
            if name in _ENDS:
                close(*_ENDS[name], least)
            classes = " ".join("".join(x) for x in _CLASSES.findall(tag[3]))
            stack.append(".".join([name, *re.split(r"[^a-z0-9]+", classes.lower())]) if classes else name)


def _bin(token: str) -> int:
    return zlib.crc32(token.encode()) % PATH_BINS


@lru_cache(20_000)
def _path_bins(path: tuple[str, ...]) -> tuple[int, ...]:
    bins = set()
    for element in path:
        name, *classes = element.split(".")
        bins.add(_bin(name))
        bins |= {_bin("." + c) for c in classes if c}
    bins.add(_bin("last:" + (path[-1].split(".")[0] if path else "")))
    return tuple(bins)


def vectors(blocks: list[tuple[tuple[str, ...], str, float]]) -> np.ndarray:
    out = np.zeros((len(blocks), WIDTH), np.float32)
    if not blocks:
        return out
    texts = [text.encode() for _, text, _ in blocks]
    line = np.frombuffer(b" ".join(texts), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    starts, hashes = W.word_hashes(line)
    where = np.searchsorted(ends, starts, "right")
    counts = np.bincount(where * WORD_BINS + (hashes % np.uint64(WORD_BINS)).astype(np.int64), minlength=len(blocks) * WORD_BINS)
    counts = counts.reshape(len(blocks), WORD_BINS)
    n_words = counts.sum(1)
    for k, (path, _, _) in enumerate(blocks):
        out[k, list(_path_bins(path))] = 1.0
    out[:, PATH_BINS : PATH_BINS + WORD_BINS] = np.sqrt(counts / np.maximum(n_words, 1)[:, None])
    place = np.arange(len(blocks)) / max(len(blocks) - 1, 1)
    out[:, -SIZES:] = np.stack([np.log1p(n_words) / 5, [share for _, _, share in blocks], place, n_words < 4, n_words > 20], 1)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with a logistic output; ``weights`` are plain arrays."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = 7):
        if weights is None:
            draw = np.random.default_rng(seed)
            weights = {"out": draw.normal(0, 0.2, 2 * HIDDEN), "bias": np.zeros(1)}
            for side in "fb":
                weights[f"{side}x"] = draw.normal(0, 0.1, (WIDTH, 4 * HIDDEN))
                weights[f"{side}h"] = draw.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
                weights[f"{side}c"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
        self.weights = {k: v.astype(np.float32) for k, v in weights.items()}

    def _run(self, side: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        """States over time (steps first) of one direction; a masked step leaves the state as it is."""
        w = self.weights
        steps, rows, _ = x.shape
        given = x.reshape(steps * rows, -1) @ w[f"{side}x"] + w[f"{side}c"]
        given = given.reshape(steps, rows, -1)
        h, c = np.zeros((rows, HIDDEN), np.float32), np.zeros((rows, HIDDEN), np.float32)
        states, trace = np.zeros((steps, rows, HIDDEN), np.float32), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = given[t] + h @ w[f"{side}h"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            fresh = f * c + i * g
            after = np.tanh(fresh)
            if keep:
                trace.append((t, h, c, i, f, o, g, after, m))
            c = np.where(m, fresh, c)
            h = np.where(m, o * after, h)
            states[t] = h
        return states, trace

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        forward, backward = (self._run(side, x, mask, False)[0] for side in "fb")
        return _sigmoid(np.concatenate([forward, backward], 2) @ self.weights["out"] + self.weights["bias"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        runs = {side: self._run(side, x, mask, True) for side in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], 2)
        score = _sigmoid(both @ self.weights["out"] + self.weights["bias"])
        error = np.where(mask, score - labels, 0).astype(np.float32) / max(mask.sum(), 1)
        made = {"out": np.einsum("tr,trk->k", error, both), "bias": np.array([error.sum()])}
        for n, side in enumerate("fb"):
            into = error[:, :, None] * self.weights["out"][n * HIDDEN : (n + 1) * HIDDEN]
            recurrent = self.weights[f"{side}h"]
            dh = dc = np.zeros(into.shape[1:], np.float32)
            dz_all = np.zeros((*into.shape[:2], 4 * HIDDEN), np.float32)
            dwh = np.zeros_like(recurrent)
            for t, h, c, i, f, o, g, after, m in reversed(runs[side][1]):
                total = dh + into[t]
                inner = np.where(m, total, 0)
                dnew = np.where(m, dc, 0) + inner * o * (1 - after**2)
                dz = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), inner * after * o * (1 - o), dnew * i * (1 - g**2)], 1)
                dz_all[t] = dz
                dwh += h.T @ dz
                dh = np.where(m, dz @ recurrent.T, total)
                dc = np.where(m, dnew * f, dc)
            flat = dz_all.reshape(-1, 4 * HIDDEN)
            made[f"{side}x"], made[f"{side}h"], made[f"{side}c"] = x.reshape(-1, WIDTH).T @ flat, dwh, flat.sum(0)
        return made

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = 0.01, seed: int = 7) -> Labeller:
        """Adam over batches of 32 pages of (vectors, labels)."""
        draw, step = np.random.default_rng(seed), 0
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for _ in range(epochs):
            order = draw.permutation(len(pages))
            for low in range(0, len(order), 32):
                chosen = [pages[k] for k in order[low : low + 32]]
                x, mask = padded([v for v, _ in chosen])
                labels = np.zeros(mask.shape, np.float32)
                for k, (_, own) in enumerate(chosen):
                    labels[: len(own), k] = own
                step += 1
                for k, g in self.gradients(x, mask, labels).items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    rise = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                    self.weights[k] = (self.weights[k] - rate * rise).astype(np.float32)
        return self


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(steps, pages, width) and the mask of real steps."""
    steps = max((len(p) for p in pages), default=0)
    x, mask = np.zeros((steps, len(pages), WIDTH), np.float32), np.zeros((steps, len(pages)), bool)
    for k, page in enumerate(pages):
        x[: len(page), k], mask[: len(page), k] = page, True
    return x, mask


class Generator:
    """Pages with known main text, in the layouts sites use."""

    def __init__(self, seed: int):
        self.draw = np.random.default_rng(seed)
        self.main: set[str] = set()

    def pick(self, *options):
        return options[int(self.draw.integers(len(options)))]

    def words(self, low: int, high: int) -> str:
        syllables = "the of and er an in le de que la un ich ein und el los con ra mi to st re ou".split()
        made = ["".join(self.pick(*syllables) for _ in range(int(self.draw.integers(1, 5)))) for _ in range(int(self.draw.integers(low, high)))]
        return " ".join(made).capitalize() + self.pick(".", "", "!", " $$$")

    def text(self, low: int, high: int, is_main: bool = False) -> str:
        made = self.words(low, high)
        if is_main:
            self.main.add(" ".join(made.split()))
        return made

    def paragraphs(self) -> str:
        made = []
        for _ in range(int(self.draw.integers(1, 10))):
            kind = self.draw.random()
            own = self.text(1, 4, True) if kind < 0.2 else self.text(5, 60, True)
            made.append(
                self.pick(f"<p>{own}</p>", f"<p>{own}</p>", f"<p>{own}", f"<p><b>{own}<br>", f"<h2>{own}</h2>", f"<ul><li>{own}</li></ul>", f"<blockquote><p>{own}</p></blockquote>")
            )
            if self.draw.random() < 0.12:
                made.append(self.aside())
        return "".join(made)

    def links(self) -> str:
        items = "".join(f'<li><a href="/x">{self.text(1, 4)}</a></li>' for _ in range(int(self.draw.integers(2, 9))))
        return f"<ul>{items}</ul>"

    def aside(self) -> str:
        """What is not main text, wherever it stands."""
        short, long = self.text(1, 8), self.text(5, 30)
        name = self.pick("ad", "ads", "advert", "advertisement", "sponsored", "banner", "promo")
        notice = self.pick("cookie", "cookies", "notice", "consent", "gdpr", "alert", "popup", "newsletter", "subscribe")
        side = self.pick("sidebar", "side", "widget", "related", "share", "social", "breadcrumbs")
        return self.pick(
            f'<div class="{name}">{short}</div>',
            f'<div class="{name}"><p>{long}</p></div>',
            f'<div id="{notice}" class="{notice}-bar"><p>{long}</p><button>{self.text(1, 3)}</button></div>',
            f'<div class="{notice}">{long}</div>',
            f'<aside class="{side}"><h3>{short}</h3>{self.links()}</aside>',
            f"<aside><h3>{short}</h3><p>{long}</p></aside>",
            f'<div class="{side}"><p>{long}</p>{self.links()}</div>',
            f'<form action="/s"><label>{short}</label><input name="q"><p>{long}</p><button>{self.text(1, 3)}</button></form>',
        )

    def comments(self) -> str:
        name, box = self.pick(("comment", "comments"), ("reply", "replies"), ("comment", "discussion"), ("response", "comment-list"))
        body = "".join(f'<div class="{name}"><b>{self.text(1, 3)}</b><p>{self.text(3, 40)}</p></div>' for _ in range(int(self.draw.integers(1, 6))))
        return self.pick(f'<section class="{box}"><h3>{self.text(1, 4)}</h3>{body}</section>', f'<div id="{box}">{body}</div>')

    def page(self) -> tuple[str, list[int]]:
        self.main = set()
        chance = self.draw.random
        title = self.text(2, 12, True)
        body = f"<h1>{title}</h1>" + self.paragraphs()
        if chance() < 0.15:
            body = f"<header><h1>{title}</h1></header>" + self.paragraphs()
        inner = self.comments() if chance() < 0.15 else ""
        body = self.pick(f"<article>{body}{inner}</article>", f"<article>{body}{inner}</article>", f"<main><article>{body}</article>{inner}</main>")
        if chance() < 0.3:
            content = self.pick("content", "post", "entry content", "main", "article body", "story")
            body = self.pick(f'<div class="{content}">', f'<div id="{content}">', "<main>") + body.replace("<article>", "<div>").replace("</article>", "</div>") + self.pick("</div>", "</div>", "</main>")
        before = [f"<nav>{self.links()}</nav>"] if chance() < 0.8 else [f'<div class="{self.pick("menu", "nav", "navbar", "navigation")}">{self.links()}</div>']
        if chance() < 0.4:
            before.insert(0, f"<header><p>{self.text(2, 10)}</p></header>")
        before += [self.aside() for _ in range(int(self.draw.integers(0, 3)))]
        after = [self.aside() for _ in range(int(self.draw.integers(0, 3)))]
        if chance() < 0.4:
            after.append(self.comments())
        if chance() < 0.9:
            after.append(self.pick(f"<footer>&copy; {self.text(2, 12)}</footer>", f"<footer><p>{self.text(2, 12)}</p>{self.links()}</footer>", f'<div class="footer">{self.text(2, 20)}</div>'))
        page = f"<html><head><title>{title}</title></head><body>{''.join(before)}{body}{''.join(after)}" + self.pick("</body></html>", "")
        return page, [int(text in self.main) for _, text, _ in blocks_of(page)]


@lru_cache(1)
def trained(pages: int = TRAINING_PAGES, seed: int = 11) -> dict[str, np.ndarray]:
    """Weights of the labeller, from generated pages; the same for the same numbers."""
    generator, examples = Generator(seed), []
    for _ in range(pages):
        page, labels = generator.page()
        examples.append((vectors(blocks_of(page)), np.array(labels, np.float32)))
    return Labeller().fit(examples).weights


def label(model: Labeller, pages: list[list]) -> list[list[bool]]:
    """Which blocks of each page are main text."""
    order, result = sorted(range(len(pages)), key=lambda k: len(pages[k])), [[] for _ in pages]
    low = 0
    while low < len(order):
        high = low + 1
        while high < len(order) and (high - low + 1) * len(pages[order[high]]) <= HELD_BLOCKS:
            high += 1
        x, mask = padded([vectors(pages[k]) for k in order[low:high]])
        if len(x):
            scores = model.scores(x, mask)
            for n, k in enumerate(order[low:high]):
                result[k] = (scores[: len(pages[k]), n] >= 0.5).tolist()
        low = high
    return result


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars, n_blocks, n_main`` of every row."""
    shared = pages.sparkSession.sparkContext.broadcast(trained())  # a fixed number of weights
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())] + [(n, pa.int64()) for n in ("n_chars", "n_blocks", "n_main")]
    )

    def run(batches):
        model = cached("labeller", lambda: Labeller(shared.value))

        def rows():
            held, n = [], 0
            for batch in batches:
                for page, url, html in rows_of(batch):
                    held.append((page, url, blocks_of(html or "")))
                    n += len(held[-1][2]) + 1
                    if n >= HELD_BLOCKS:
                        yield from finished(held)
                        held, n = [], 0
            yield from finished(held)

        def finished(held):
            for (page, url, blocks), kept in zip(held, label(model, [b for _, _, b in held])):
                text = " ".join(text for (_, text, _), k in zip(blocks, kept) if k)
                yield page, url, text, len(text), len(blocks), sum(kept)

        yield from batches_of(rows(), schema, lambda row: len(row[2]))

    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_main long")
