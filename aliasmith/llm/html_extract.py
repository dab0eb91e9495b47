"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A leaf block is the text between two borders of block elements, with the elements that are open
around it; inline elements don't divide. Every block has binary features: its ancestors' tags and
the words of their class and id attributes, and of its text the length, the share in links, marks,
digits and its place in the page. The field labels the blocks of a page in order, 1 for main text
and 0 for the rest, with weights for each feature and label and for neighbouring labels. Weights
come from maximum likelihood on labelled pages (forward-backward, gradient ascent), labels from
Viterbi, both for many pages side by side.

The labelled pages are written here in several layouts, their labels known as they are written
(labelled_pages); train takes any others too.

Markup may be broken: unclosed elements end with their parents, stray end tags are ignored, and
scripts, styles and comments that don't end go on to the end of the page. A null page gives null
text, one without text an empty string. Rows of equal or null page_id each get a result.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages that the query's field is trained on: at most so many.
TRAIN_PAGES = 300
STEPS, L2 = 150, 1e-3
#: Blocks of a batch of pages that are decoded together.
BATCH_BLOCKS = 20_000

_MARK = re.compile(r"<!--[\s\S]*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe)\b[^<>]*>[\s\S]*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-z][a-z0-9:-]*)([^<>]*)>", re.I)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")
_DIGIT = re.compile(r"[0-9]")
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr input".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SAME = frozenset("li dt dd tr td th option p".split())

_TAGS = "html head title body nav ul ol li dl footer header aside article main section div h1 h2 h3 h4 h5 h6 p td th tr table tbody blockquote pre figure figcaption form button select option address details".split()
_NAMES = "ad ads advert banner promo sponsor nav menu breadcrumb sidebar side widget related share social comment comments footer foot copyright cookie header head top login search tag tags content main article post entry story body text page container wrapper".split()
_FEATURES = ["bias", "parent-other", *(f"in-{t}" for t in _TAGS), *(f"parent-{t}" for t in _TAGS), *(f"name-{t}" for t in _NAMES)]
_FEATURES += [*(f"words-{k}" for k in range(8)), *(f"links-{k}" for k in range(4)), *(f"marks-{k}" for k in range(4)), "ends-sentence", "copyright", "digits", "upper-start", *(f"place-{k}" for k in range(5)), "alone"]
_ID = {f: i for i, f in enumerate(_FEATURES)}


def _element_features(tag: str, names: str) -> int:
    """Features, as bits, that an open element gives to every block in it."""
    found = 1 << _ID.get(f"in-{tag}", 0)
    for w in _WORDS.findall(names):
        if (k := _ID.get(f"name-{w}")) is not None:
            found |= 1 << k
    return found


def _path_features(tag: str | None, above: int) -> list[int]:
    """above: bits of all open elements; tag: of the innermost."""
    found = above | 1 << _ID["bias"] | 1 << _ID.get(f"parent-{tag}", _ID["parent-other"])
    return [i for i in range(found.bit_length()) if found >> i & 1]


def _text_features(text: str, linked: int) -> list[int]:
    n = text.count(" ") + 1
    share = linked / max(1, len(text))
    marks = text.count(".") + text.count(",") + text.count("!") + text.count("?")
    found = [_ID[f"words-{min(7, n.bit_length() - 1)}"], _ID[f"links-{0 if not linked else 1 if share < 0.3 else 2 if share < 0.7 else 3}"], _ID[f"marks-{min(3, marks.bit_length())}"]]
    if text[-1] in ".!?:…\"":
        found.append(_ID["ends-sentence"])
    if "©" in text or "opyright" in text:
        found.append(_ID["copyright"])
    if _DIGIT.search(text):
        found.append(_ID["digits"])
    if text[0].isupper():
        found.append(_ID["upper-start"])
    return found


def blocks(page: str, cache: dict | None = None) -> tuple[list[str], list[list[int]]]:
    """Texts of the leaf blocks of a page in order, and their features."""
    cache = {} if cache is None else cache
    texts: list[str] = []
    features: list[list[int]] = []
    path: list[tuple[str, int]] = []  # each with the bits of all that are open up to it
    opened: dict[str, int] = {}
    parts: list[str] = []
    link, linked = 0, 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            raw = "".join(parts)
            text = " ".join((_html.unescape(raw) if "&" in raw else raw).split())
            if text:
                key = path[-1] if path else (None, 0)
                if (own := cache.get(key)) is None:
                    own = cache[key] = _path_features(*key)
                texts.append(text)
                features.append(own + _text_features(text, linked))
            parts, linked = [], 0

    last = 0
    for m in _MARK.finditer(page):
        if m.start() > last:
            parts.append(page[last : m.start()])
            if link:
                linked += m.start() - last
        last = m.end()
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(2):
            if tag == "a":
                link = 0
            if tag in _INLINE:
                continue
            if opened.get(tag):
                flush()
                while True:
                    last_tag, _ = path.pop()
                    opened[last_tag] -= 1
                    if last_tag == tag:
                        break
            continue
        if tag == "a":
            link = 1
        if tag in _INLINE:
            continue
        if tag in _VOID:
            parts.append(" ")
            if tag == "hr":
                flush()
            continue
        flush()
        link = 0
        if path and (path[-1][0] == tag and tag in _SAME or path[-1][0] == "p" and tag in _CLOSES_P):
            opened[path.pop()[0]] -= 1
        more = m.group(4)
        if more.endswith("/"):
            continue
        names = " ".join(x for g in _ATTRIBUTE.findall(more) for x in g if x).lower() if "=" in more else ""
        path.append((tag, (path[-1][1] if path else 0) | _element_features(tag, names)))
        opened[tag] = opened.get(tag, 0) + 1
    if last < len(page):
        parts.append(page[last:])
    flush()
    n = len(texts)
    for i, f in enumerate(features):
        f.append(_ID[f"place-{5 * i // n}"])
    if n == 1:
        features[0].append(_ID["alone"])
    return texts, features


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def _padded(features: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature ids of all blocks in a row, where each block's begin, and page and place of each block."""
    lens = np.array([len(p) for p in features])
    ids = np.array([i for p in features for b in p for i in b], np.int64)
    first = np.cumsum([0] + [len(b) for p in features for b in p])[:-1]
    page = np.repeat(np.arange(len(features)), lens)
    place = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
    return ids, first, page, place


@dataclass(frozen=True)
class Field:
    weights: np.ndarray  # features x 2
    step: np.ndarray  # label x next label
    begin: np.ndarray
    end: np.ndarray

    def emissions(self, features: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """Pages x places x 2 scores, and blocks a page; every page has one at least."""
        ids, first, page, place = _padded(features)
        lens = np.bincount(page)
        out = np.zeros((len(features), lens.max(), 2))
        out[page, place] = np.add.reduceat(self.weights[ids], first, axis=0)
        return out, lens

    def decode(self, features: list[list[list[int]]]) -> list[np.ndarray]:
        """Viterbi labels of each page."""
        result = [np.zeros(0, np.int64)] * len(features)
        order = [i for i in sorted(range(len(features)), key=lambda i: len(features[i])) if features[i]]
        at = 0
        while at < len(order):
            # pages of like length together
            most = len(features[order[at]]) * 2
            stop = at + 1
            while stop < len(order) and len(features[order[stop]]) <= most and (stop - at) * len(features[order[stop]]) <= BATCH_BLOCKS:
                stop += 1
            group = order[at:stop]
            at = stop
            e, lens = self.emissions([features[i] for i in group])
            n, t, _ = e.shape
            score = e[:, 0] + self.begin
            back = np.zeros((n, t, 2), np.int8)
            for k in range(1, t):
                to = score[:, :, None] + self.step
                best = to.argmax(1)
                live = (k < lens)[:, None]
                back[:, k] = np.where(live, best, np.arange(2))
                score = np.where(live, to.max(1) + e[:, k], score)
            labels = np.zeros((n, t), np.int64)
            labels[:, -1] = (score + self.end).argmax(1)
            for k in range(t - 1, 0, -1):
                labels[:, k - 1] = back[np.arange(n), k, labels[:, k]]
            for i, row, size in zip(group, labels, lens):
                result[i] = row[:size]
        return result


def fit(features: list[list[list[int]]], labels: list[list[int]], steps: int = STEPS) -> Field:
    """Field of maximum likelihood, with a penalty on the weights; pages without blocks don't count."""
    use = [i for i, f in enumerate(features) if f]
    features, labels = [features[i] for i in use], [labels[i] for i in use]
    size = len(_FEATURES)
    x = [np.zeros((size, 2)), np.zeros((2, 2)), np.zeros(2), np.zeros(2)]
    if not features:
        return Field(*x)
    ids, first, page, place = _padded(features)
    block = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(ids)]))
    lens = np.bincount(page)
    n, t = len(lens), lens.max()
    y = np.array([v for p in labels for v in p])
    seen = [np.zeros((size, 2)), np.zeros((2, 2)), np.bincount(y[place == 0], minlength=2).astype(float), np.bincount(y[place == lens[page] - 1], minlength=2).astype(float)]
    np.add.at(seen[0], (ids, y[block]), 1)
    inner = np.flatnonzero(place > 0)
    np.add.at(seen[1], (y[inner - 1], y[inner]), 1)
    m = [np.zeros_like(v) for v in x]
    v2 = [np.zeros_like(v) for v in x]
    for it in range(1, steps + 1):
        e, _ = Field(*x).emissions(features)
        a, b = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        a[:, 0] = e[:, 0] + x[2]
        for k in range(1, t):
            a[:, k] = np.where((k < lens)[:, None], e[:, k] + _lse(a[:, k - 1, :, None] + x[1], 1), a[:, k - 1])
        b[:, -1] = x[3]
        for k in range(t - 2, -1, -1):
            b[:, k] = np.where((k + 1 < lens)[:, None], _lse(x[1] + (e[:, k + 1] + b[:, k + 1])[:, None, :], 2), x[3])
        z = _lse(a[:, -1] + x[3], 1)
        p = np.exp(a + b - z[:, None, None])[page, place]
        expected = [np.zeros((size, 2)), np.zeros((2, 2)), p[place == 0].sum(0), p[place == lens[page] - 1].sum(0)]
        for c in (0, 1):
            expected[0][:, c] = np.bincount(ids, p[block, c], size)
        pg, pl = page[inner], place[inner]
        pair = a[pg, pl - 1][:, :, None] + x[1] + (e[pg, pl] + b[pg, pl])[:, None, :] - z[pg][:, None, None]
        expected[1] = np.exp(pair).sum(0)
        for j in range(4):
            g = (seen[j] - expected[j]) / n - L2 * x[j]
            m[j] = 0.9 * m[j] + 0.1 * g
            v2[j] = 0.99 * v2[j] + 0.01 * g * g
            x[j] = x[j] + 0.1 * (m[j] / (1 - 0.9**it)) / (np.sqrt(v2[j] / (1 - 0.99**it)) + 1e-8)
    return Field(*x)


_SYLLABLES = "the an tion er ing re le que eau der sch ung ver ein de la os ado con par men st lo ra".split()


def _sentence(r: Random, low: int, high: int) -> str:
    words = ["".join(r.choices(_SYLLABLES, k=r.randint(1, 3))) for _ in range(r.randint(low, high))]
    for i in range(len(words) - 1):
        if r.random() < 0.08:
            words[i] += ","
    return " ".join(words).capitalize() + r.choice([".", ".", ".", "", "!", "?", "***"])


def _text(r: Random, low: int, high: int) -> str:
    return " ".join(_sentence(r, 3, 14) for _ in range(r.randint(low, high)))


def labelled_pages(count: int = TRAIN_PAGES, seed: int = 1, layouts: tuple[int, ...] = (0, 1, 2, 3, 4, 5)) -> list[tuple[str, list[int]]]:
    """(page, label of each leaf block) of pages in the layouts numbered."""
    r = Random(seed)
    out = []
    for _ in range(count):
        kind = r.choice(layouts)
        pieces: list[str] = []
        labels: list[int] = []

        def put(before: str, text: str, after: str, label: int, pieces: list[str] = pieces, labels: list[int] = labels) -> None:
            pieces.append(before + text + after)
            labels.append(label)

        def links(tag: str, n: int) -> None:
            for _ in range(n):
                put(f"<{tag}><a href=\"/x\">", _sentence(r, 1, 3), f"</a></{tag}>", 0)

        def paragraphs(n: int, before: str = "<p>", after: str = "</p>", label: int = 1) -> None:
            for _ in range(n):
                text = _text(r, 1, 6) if r.random() < 0.8 else _sentence(r, 1, 6)
                put(before, text if r.random() < 0.8 else f"<b>{text}<br>{_sentence(r, 2, 9)}", after, label)

        body = r.randint(1, 9)
        pieces.append("<!DOCTYPE html><html><head><meta charset=utf-8>")
        put("<title>", _sentence(r, 2, 9), "</title><style>p{}</style></head><body>", 0)
        if kind == 0:
            pieces.append("<nav><ul>")
            links("li", r.randint(2, 8))
            pieces.append("</ul></nav><!-- ad -->")
            if r.random() < 0.7:
                put('<div class="ad">', _text(r, 1, 3), "</div>", 0)
            put("<article><h1>", _sentence(r, 2, 9), "</h1>", 1)
            paragraphs(body)
            pieces.append("</article>")
            put("<footer>", f"&copy; {_sentence(r, 1, 3)} &middot; {_text(r, 1, 2)}", "</footer>", 0)
        elif kind == 1:
            pieces.append('<header class="top"><div id="menu">')
            links("div", r.randint(2, 6))
            pieces.append('</div></header><div id="content" class="post">')
            put("<h2>", _sentence(r, 2, 9), "</h2>", 1)
            paragraphs(body)
            if r.random() < 0.5:
                pieces.append("<ul>")
                paragraphs(r.randint(1, 4), "<li>", "</li>")
                pieces.append("</ul>")
            pieces.append('</div><div class="sidebar">')
            put("<h3>", _sentence(r, 1, 3), "</h3>", 0)
            links("li", r.randint(1, 5))
            paragraphs(r.randint(0, 2), label=0)
            put('</div><div class="footer"><p>', f"Copyright {r.randint(1999, 2030)} {_sentence(r, 1, 4)}", "</p></div>", 0)
        elif kind == 2:
            pieces.append('<table><tr><td class="nav">')
            links("p", r.randint(2, 6))
            pieces.append('</td><td class="main">')
            paragraphs(body)
            pieces.append("</td></tr><tr><td class=foot>")
            put("<p>", _sentence(r, 2, 8), "</p>", 0)
            pieces.append("</td></tr></table>")
        elif kind == 3:
            put('<header><div class="banner">', _text(r, 1, 2), "</div></header>", 0)
            put("<main><section><h1>", _sentence(r, 2, 8), "</h1>", 1)
            paragraphs(body)
            if r.random() < 0.5:
                put("<blockquote>", _text(r, 1, 3), "</blockquote>", 1)
            pieces.append("</section></main><aside>")
            paragraphs(r.randint(1, 3), label=0)
            pieces.append('</aside><div class="comments">')
            paragraphs(r.randint(0, 3), label=0)
            put("</div><footer><small>", _sentence(r, 1, 5), "</small></footer>", 0)
        elif kind == 4:
            links("p", r.randint(2, 6))
            paragraphs(body)
            put("<p>", f"&copy; {_sentence(r, 1, 4)}", "</p>", 0)
        else:
            pieces.append('<div class="nav">')
            links("div", r.randint(2, 6))
            pieces.append('</div><div class="entry text">')
            paragraphs(body, "<div>", "</div>")
            pieces.append('</div><div class="related">')
            links("div", r.randint(2, 5))
            put('</div><div class="promo">', _text(r, 1, 2), "</div>", 0)
        pieces.append("</body></html>")
        out.append(("".join(pieces), labels))
    return out


def train(pages: list[tuple[str, list[int]]] | None = None) -> Field:
    """The field trained on labelled pages, those of this module unless others are given; one whose number of labels isn't that of its blocks is an error."""
    pages = labelled_pages() if pages is None else pages
    features = [blocks(p)[1] for p, _ in pages]
    for f, (_, labels) in zip(features, pages):
        if len(f) != len(labels):
            raise ValueError(f"{len(labels)} labels for {len(f)} blocks")
    return fit(features, [y for _, y in pages])


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """(page_id, text, n_blocks, n_kept) of every page: its main blocks, a line each."""
    shared = pages.sparkSession.sparkContext.broadcast(field or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                raw = b.column("html").to_pylist()
                found = [blocks(p, cache) if p is not None else ([], []) for p in raw]
                if len(cache) > 100_000:
                    cache.clear()
                labels = shared.value.decode([f for _, f in found])
                kept = [[t for t, y in zip(texts, ys) if y] for (texts, _), ys in zip(found, labels)]
                null = np.array([p is None for p in raw], bool)
                yield pa.RecordBatch.from_arrays(
                    [b.column("page_id"), pa.array([None if p is None else "\n".join(k) for p, k in zip(raw, kept)], pa.string()), pa.array([len(t) for t, _ in found], pa.int64(), mask=null), pa.array([len(k) for k in kept], pa.int64(), mask=null)],
                    ["page_id", "text", "n_blocks", "n_kept"],
                )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, "page_id long, text string, n_blocks long, n_kept long")
