"""Main text of HTML pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: the text between two borders of block elements, with the elements open
around it. Each block has features of its ancestors (tags, words of class, id and role) and of its text
(length, share in links, punctuation, place); the field scores blocks and transitions between the two
labels, and Viterbi picks the labels of the whole page together. It is trained once per driver by gradient
ascent on the exact likelihood (forward and backward passes), on ``TRAIN_PAGES`` generated, labelled pages
of many layouts (a documented bound; the corpus isn't sampled).

What no reader sees (head, scripts, styles, templates, comments of the markup) makes no block. Character
references are decoded, white space inside a block becomes one space, blocks are joined by one newline in
page order; nothing else is dropped or capped. Broken markup is read on: stray end tags are ignored, and an
open paragraph ends where a block element begins.

One narrow pass, no shuffle. Null html counts as empty; a page without main text gives an empty text; long
pages are read whole, in time linear in their length; repeated pages give repeated rows; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veriframe.llm.common import slices

TRAIN_PAGES = 500
EPOCHS = 80
MAIN, OTHER = 1, 0

#: Elements that begin and end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead tr ul".split()
)
#: Elements whose content no reader sees, or that isn't text.
HIDDEN = frozenset("head script style template noscript iframe object svg canvas audio video".split())
RAW = frozenset(("script", "style", "textarea", "title"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

_TAG = re.compile(r"""<!--(?:.*?-->|.*)|<[!?][^<>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^<>"'])*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])|\Z", re.I) for t in RAW}
_WORDS = re.compile(r"[a-z]+")


@lru_cache(20_000)
def _names(attributes: str) -> tuple[str, ...]:
    found = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes))
    return tuple(sorted(set(_WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", found).lower()))))


class Open:
    """The open elements of a page. Every step is one look-up, however deep the page is nested.

    An element's context is the set of features of all elements around it and its own; with ``known``, of those only that a
    model knows, so that it stays small.
    """

    def __init__(self, known=None):
        self.known = known
        self.stack: list[tuple[str, frozenset, int]] = []  # tag, context, blocks up to here
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.hidden = 0
        self.made: dict[tuple, frozenset] = {}

    def context(self) -> tuple[frozenset, str]:
        return self.stack[-1][1] if self.stack else frozenset(), self.stack[self.blocks[-1]][0] if self.blocks else ""

    def enter(self, tag: str, names: tuple[str, ...]) -> None:
        around = self.stack[-1][1] if self.stack else frozenset()
        key = around, tag, names
        own = self.made.get(key)
        if own is None:
            new = {f"in:{tag}"} if tag in BLOCK else set()
            new.update(f"name:{w}" for w in names)
            own = self.made[key] = around.union(f for f in new if self.known is None or f in self.known)
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.hidden += tag in HIDDEN
        self.stack.append((tag, own, len(self.blocks)))

    def leave(self, place: int) -> None:
        """Close the element at a place and all within it."""
        for tag, _, _ in reversed(self.stack[place:]):
            self.places[tag].pop()
            self.hidden -= tag in HIDDEN
            if tag in BLOCK:
                self.blocks.pop()
        del self.stack[place:]

    def last(self, tag: str) -> int | None:
        found = self.places.get(tag)
        return found[-1] if found else None

    def holds_block(self, place: int) -> bool:
        """Whether a block is open within the element at a place."""
        return len(self.blocks) > self.stack[place][2]


def blocks(page: str, known=None) -> list[tuple[tuple, str, int]]:
    """(context, text, characters in links) for each leaf block with text, in order; see ``Open``."""
    out: list[tuple[tuple, str, int]] = []
    linked = 0
    parts: list[str] = []
    now = Open(known)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((now.context(), text, linked))
            parts.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece and not now.hidden:
            parts.append(piece)
            if now.places.get("a"):
                linked += len(piece)

    at = 0
    while m := _TAG.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            place = now.last(tag)
            if tag in BLOCK:
                flush()
            if place is not None and (tag in BLOCK or tag in HIDDEN or not now.holds_block(place)):
                now.leave(place)
            continue
        attributes = m[3] or m[6] or ""
        if tag in BLOCK:
            flush()
            # a block ends an open paragraph, an item ends the item before it
            if now.blocks:
                e = now.stack[now.blocks[-1]][0]
                if e == "p" or e == tag and tag in ("li", "option", "td", "th", "tr", "dt", "dd"):
                    now.leave(now.blocks[-1])
        elif tag == "body" or tag == "br":
            add(" ")
        if tag == "body" and now.hidden:
            now.leave(min(now.places[t][0] for t in HIDDEN if now.places.get(t)))
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            if tag == "textarea" and not now.hidden:
                now.enter(tag, ())
                add(page[at : end.start()])
                flush()
                now.leave(len(now.stack) - 1)
            at = end.start()
            close = page.find(">", at)
            at = len(page) if close < 0 else close + 1
            continue
        now.enter(tag, _names(attributes) if "=" in attributes else ())
    add(page[at:])
    flush()
    return out


@lru_cache(20_000)
def around(context: tuple[frozenset, str]) -> tuple[str, ...]:
    """Features of the open elements."""
    return tuple(sorted(context[0] | {f"own:{context[1]}"}))


def text_features(text: str, linked: int, place: int, n: int) -> list[str]:
    size = len(text)
    found = [f"len:{min(size.bit_length(), 11)}", f"link:{min(4, 4 * linked // size)}", f"at:{4 * place // n}"]
    if text[-1] in ".!?…\"'”":
        found.append("stop")
    if text.count(",") > 1:
        found.append("commas")
    if "©" in text or text[:9].lower() == "copyright":
        found.append("copyright")
    if text.isupper():
        found.append("upper")
    return found


class Field:
    """Weights: features by label, transitions, first labels."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary
        self.emit = np.zeros((len(vocabulary), 2))
        self.step = np.zeros((2, 2))
        self.first = np.zeros(2)
        self._memo: dict[tuple, np.ndarray] = {}

    def scores(self, page: list[tuple]) -> np.ndarray:
        out, n = np.zeros((len(page), 2)), len(page)
        for i, (stack, text, linked) in enumerate(page):
            own = self._memo.get(stack)
            if own is None:
                own = sum((self.emit[self.vocabulary[f]] for f in around(stack) if f in self.vocabulary), np.zeros(2))
                if len(self._memo) < 50_000:
                    self._memo[stack] = own
            out[i] = own
            for f in text_features(text, linked, i, n):
                if f in self.vocabulary:
                    out[i] += self.emit[self.vocabulary[f]]
        return out

    def decode(self, scores: np.ndarray) -> list[int]:
        """Viterbi."""
        if not len(scores):
            return []
        (a, b), (c, d) = self.step.tolist()
        s = scores.tolist()
        x, y = s[0][0] + self.first[0], s[0][1] + self.first[1]
        back = []
        for p, q in s[1:]:
            back.append((x + a < y + c, x + b < y + d))
            x, y = max(x + a, y + c) + p, max(x + b, y + d) + q
        labels = [int(y > x)]
        for step in reversed(back):
            labels.append(int(step[labels[-1]]))
        return labels[::-1]


def train(pages: list[list[tuple]], labels: list[list[int]], epochs: int = EPOCHS, rate: float = 0.2, decay: float = 1e-3) -> Field:
    """Maximum likelihood with a quadratic penalty; Adam over the exact gradient of the whole sample."""
    listed = [[list(around(s)) + text_features(t, k, i, len(p)) for i, (s, t, k) in enumerate(p)] for p in pages]
    vocabulary: dict[str, int] = {f: i for i, f in enumerate(sorted({f for p in listed for b in p for f in b}))}
    field, n, longest = Field(vocabulary), len(pages), max(map(len, pages))
    size = np.array([len(p) for p in pages])
    row = np.array([i * longest + j for i, p in enumerate(listed) for j, b in enumerate(p) for _ in b])
    col = np.array([vocabulary[f] for p in listed for b in p for f in b])
    gold, real = np.zeros((n, longest), int), np.arange(longest) < size[:, None]
    for i, y in enumerate(labels):
        gold[i, : len(y)] = y
    one = np.eye(2)[gold] * real[..., None]
    pairs = np.einsum("nta,ntb->ab", one[:, :-1], one[:, 1:])
    weights = [field.emit, field.step, field.first]
    m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for epoch in range(1, epochs + 1):
        s = np.stack([np.bincount(row, field.emit[col, k], n * longest) for k in (0, 1)], 1).reshape(n, longest, 2)
        f, b = np.zeros_like(s), np.zeros_like(s)
        f[:, 0] = s[:, 0] + field.first
        for t in range(1, longest):
            f[:, t] = np.where(real[:, t, None], s[:, t] + np.logaddexp.reduce(f[:, t - 1, :, None] + field.step, axis=1), f[:, t - 1])
        total = np.logaddexp.reduce(f[:, -1], axis=1)
        for t in range(longest - 2, -1, -1):
            ahead = np.logaddexp.reduce(field.step + (s[:, t + 1] + b[:, t + 1])[:, None, :], axis=2)
            b[:, t] = np.where(real[:, t + 1, None], ahead, 0.0)
        p = np.exp(f + b - total[:, None, None]) * real[..., None]
        joint = np.exp(f[:, :-1, :, None] + field.step + (s[:, 1:] + b[:, 1:])[:, :, None, :] - total[:, None, None, None]) * real[:, 1:, None, None]
        d = (one - p).reshape(-1, 2)
        slope = [np.stack([np.bincount(col, d[row, k], len(vocabulary)) for k in (0, 1)], 1), pairs - joint.sum((0, 1)), (one[:, 0] - p[:, 0]).sum(0)]
        for w, g, mm, vv in zip(weights, slope, m, v, strict=True):
            g = g / n - decay * w
            mm += 0.1 * (g - mm)
            vv += 0.01 * (g * g - vv)
            w += rate * (mm / (1 - 0.9**epoch)) / (np.sqrt(vv / (1 - 0.99**epoch)) + 1e-8)
    return field


def labelled_page(rng: random.Random) -> tuple[str, list[int]]:
    """A generated page and the labels of its blocks."""
    word = lambda: "".join(rng.choices("abcdefghilmnoprstuvéü", k=rng.randint(1, 9)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: words(1, 14).capitalize() + rng.choice((".", ".", ".", "!", "?", ""))
    prose = lambda: " ".join(sentence() for _ in range(rng.choice((1, 1, 2, 3, 6, 12))))
    labels: list[int] = []

    def leaf(text: str, label: int) -> str:
        labels.append(label)
        return text

    def links(label: int, tag: str = "li") -> str:
        return "".join(f"<{tag}><a href='/{word()}'>{leaf(words(1, 3), label)}</a></{tag}>" for _ in range(rng.randint(1, 8)))

    def named(tag: str, names: tuple[str, ...], body, bare: float = 0.15) -> str:
        name = rng.choice(names)
        at = "" if rng.random() < bare and tag != "div" else f' {rng.choice(("class", "id"))}="{name}"'
        return f"<{tag}{at}>{body()}</{tag}>"

    def some(a: int, b: int, label: int, tag: str = "p") -> str:
        return "".join(f"<{tag}>{leaf(prose(), label)}</{tag}>" for _ in range(rng.randint(a, b)))

    other = {
        "nav": lambda: named("nav", ("nav", "menu", "topnav"), lambda: f"<ul>{links(OTHER)}</ul>"),
        "menu": lambda: named("div", ("menu", "nav-bar", "navigation", "breadcrumb", "breadcrumbs"), lambda: f"<ul>{links(OTHER)}</ul>"),
        "header": lambda: named("header", ("header", "site-header", "masthead"), lambda: f"<h1>{leaf(words(1, 4), OTHER)}</h1>" + (some(1, 1, OTHER) if rng.random() < 0.5 else "")),
        "ad": lambda: named("div", ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad"), lambda: leaf(prose(), OTHER) if rng.random() < 0.6 else some(1, 2, OTHER)),
        "aside": lambda: named("aside", ("sidebar", "related", "widget", "aside"), lambda: f"<h3>{leaf(words(1, 3), OTHER)}</h3>" + (some(1, 3, OTHER) if rng.random() < 0.5 else f"<ul>{links(OTHER)}</ul>")),
        "side": lambda: named("div", ("sidebar", "related", "widget", "share", "social", "newsletter", "subscribe"), lambda: some(1, 3, OTHER)),
        "notice": lambda: named("div", ("cookie", "cookie-notice", "consent", "notice", "gdpr-banner", "alert", "popup"), lambda: some(1, 2, OTHER)),
        "form": lambda: named("form", ("search", "login", "newsletter", "contact"), lambda: f"<label>{leaf(words(1, 4), OTHER)}</label><button>{leaf(words(1, 2), OTHER)}</button>"),
        "comments": lambda: named(rng.choice(("section", "div")), ("comments", "comment-list", "discussion", "responses", "reader-comments"), lambda: f"<h2>{leaf(words(1, 2), OTHER)}</h2>" + "".join(f'<div class="comment">{some(1, 2, OTHER)}</div>' for _ in range(rng.randint(1, 4))), 0.0),
        "footer": lambda: named("footer", ("footer", "site-footer"), lambda: leaf(rng.choice(("&copy; ", "", "")) + words(2, 14), OTHER) if rng.random() < 0.7 else some(1, 3, OTHER), 0.6),
    }
    titled = lambda: rng.choice(("h1", "h1", "h2"))

    def article() -> str:
        t = titled()
        parts = [f"<{t}>{leaf(words(1, 12), MAIN)}</{t}>"] if rng.random() < 0.9 else []
        for _ in range(rng.randint(1, 12)):
            kind = rng.random()
            if kind < 0.75:
                parts.append(some(1, 1, MAIN))
            elif kind < 0.8:
                parts.append(f"<h2>{leaf(words(1, 6), MAIN)}</h2>")
            elif kind < 0.86:
                parts.append("<ul>" + "".join(f"<li>{leaf(words(1, 20), MAIN)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
            elif kind < 0.9:
                parts.append(f"<blockquote>{some(1, 2, MAIN)}</blockquote>")
            elif kind < 0.93:
                parts.append(f"<pre>{leaf(words(2, 12), MAIN)}</pre>")
            elif kind < 0.96:
                parts.append(f"<table><tr><td>{leaf(words(1, 4), MAIN)}</td><td>{leaf(words(1, 4), MAIN)}</td></tr></table>")
            else:
                parts.append(other[rng.choice(("ad", "aside", "side", "form"))]())
        if rng.random() < 0.12:
            parts.append(other["comments"]())
        return "".join(parts)

    home = rng.choice(("article", "article", "main", "post", "content", "plain"))
    body = []
    for k in rng.sample(("nav", "menu", "header", "ad", "notice", "form"), rng.randint(1, 4)):
        body.append(other[k]())
    if home in ("article", "main"):
        body.append(f"<{home}>{article()}</{home}>")
    elif home == "plain":
        body.append(f"<div>{article()}</div>")
    else:
        body.append(named("div", ("post", "post-content", "entry-content", "article-body", "story", "content", "main-content", "text"), article))
    for k in rng.sample(("aside", "side", "ad", "comments", "form", "menu"), rng.randint(0, 3)):
        body.append(other[k]())
    if rng.random() < 0.9:
        body.append(other["footer"]())
    return f"<html><head><title>{words(1, 5)}</title></head><body>{''.join(body)}</body></html>", labels


@cache
def trained(n: int = TRAIN_PAGES, seed: int = 17) -> Field:
    rng = random.Random(seed)
    sample = [labelled_page(rng) for _ in range(n)]
    cut = [blocks(p) for p, _ in sample]
    good = [(b, y) for b, (_, y) in zip(cut, sample, strict=True) if b and len(b) == len(y)]
    return train([b for b, _ in good], [y for _, y in good])


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page or "", field.vocabulary)
    return "\n".join(b[1] for b, y in zip(found, field.decode(field.scores(found)), strict=True) if y == MAIN)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html)."""
    shared = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            texts = [main_text(p, shared.value) for p in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
