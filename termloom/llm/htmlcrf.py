"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into leaf blocks (text between block-level boundaries) with the tags and marks of their open
ancestors. Each block has binary features of its ancestors and its text; the chain labels blocks as article
or other, weights are trained on labelled pages by gradient ascent on the conditional likelihood, and pages
are decoded by Viterbi. Features hash into a fixed number of columns.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import pieces

# Fixed values of HTML: elements that hold no text to read, have no end, end a block, or are closed by a sibling.
UNREAD = frozenset("script style noscript template iframe object svg math canvas select textarea head title".split())
RAW = frozenset("script style title textarea iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big button cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
}
SCOPE = frozenset("ul ol dl table tbody thead tfoot div section article aside nav main header footer form body blockquote figure fieldset details td th".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
QUOTED = re.compile(r"""=\s*(?:"[^"]*"?|'[^']*'?)""")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s/=]|$)", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACES = re.compile(r"\s+")
MARKS = frozenset(["class", "id", "role"])


class Block:
    __slots__ = ("parts", "path", "marks", "links", "chars")

    def __init__(self, path: tuple[str, ...], marks: tuple[str, ...]) -> None:
        self.parts: list[str] = []
        self.path, self.marks, self.links, self.chars = path, marks, 0, 0

    @property
    def text(self) -> str:
        return SPACES.sub(" ", "".join(self.parts)).strip()


def leaf_blocks(page: str) -> list[Block]:
    """The readable leaf blocks of a page in order; null characters and unclosed tags do no harm."""
    blocks: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], bool]] = []  # tag, marks, hidden
    opened: Counter[str] = Counter()  # tags on the stack
    block: Block | None = None
    unread = links = 0

    def add(raw: str) -> None:
        nonlocal block
        if unread or not raw:
            return
        text = html_lib.unescape(raw) if "&" in raw else raw
        if block is None:
            if not text.strip():
                return
            block = Block(tuple(t for t, _, _ in stack if t not in INLINE), tuple(m for _, ms, _ in stack for m in ms))
            blocks.append(block)
        block.parts.append(text)
        n = len(text.strip())
        block.chars += n
        if links:
            block.links += n

    def close(tag: str) -> None:
        nonlocal block, unread, links
        while stack:
            t, _, hidden = stack.pop()
            opened[t] -= 1
            unread -= hidden
            links -= t == "a"
            if t not in INLINE:
                block = None
            if t == tag:
                break

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        if lt > at:
            add(page[at:lt])
        m = TOKEN.match(page, lt)
        if m is None:  # a bare less-than sign
            add("<")
            at = lt + 1
            continue
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if opened[tag]:
                close(tag)
            elif tag == "p" or tag == "br":
                block = None
            continue
        if tag == "br":
            if block is not None:
                block.parts.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                block = None
            continue
        ends = CLOSED_BY.get(tag)
        if ends and any(opened[t] for t in ends):
            for t, _, _ in reversed(stack):
                if t in ends:
                    close(t)
                    break
                if t in SCOPE:
                    break
        elif not ends and tag not in INLINE and opened["p"]:
            for t, _, _ in reversed(stack):  # a block ends an open paragraph and what it holds
                if t == "p":
                    close("p")
                    break
                if t in SCOPE:
                    break
        marks: list[str] = []
        hidden = tag in UNREAD
        if m[3] and not m[3].isspace():
            for name, value in ATTRIBUTE.findall(m[3]):
                name = name.lower()
                if name in MARKS:
                    marks += [w.lower() for w in NAME_PART.findall(value)]
                elif name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                    hidden = True
                elif name == "aria-hidden" and "true" in value.lower():
                    hidden = True
            hidden = hidden or bool(HIDDEN.search(QUOTED.sub("=''", m[3])))
        if tag not in INLINE:
            block = None
        if tag in RAW:  # its content is no markup
            end = re.compile(rf"</{tag}\s*(?:>|/|$)", re.I).search(page, at)
            if end is None:
                break
            gt = page.find(">", end.start())
            at = n if gt < 0 else gt + 1
            continue
        if m[3].rstrip().endswith("/") and tag in ("svg", "math"):
            continue
        stack.append((tag, tuple(marks), hidden))
        opened[tag] += 1
        unread += hidden
        links += tag == "a"
    return [b for b in blocks if b.text]


COLUMNS = 4096


@lru_cache(1 << 16)
def _column(name: str) -> int:
    return crc32(name.encode()) % COLUMNS


def _size(n: int) -> int:
    return min(10, n.bit_length())


@lru_cache(1 << 14)
def _ancestry(path: tuple[str, ...], marks: tuple[str, ...]) -> tuple[int, ...]:
    names = {f"in:{t}" for t in path} | {f"mark:{m}" for m in marks}
    names |= {f"leaf:{path[-1] if path else ''}", "bias"}
    names |= {f"mark:{m[:-1]}" for m in marks if m.endswith("s")}
    return tuple(sorted({_column(x) for x in names}))


def block_columns(b: Block) -> list[int]:
    text = b.text
    words = text.count(" ") + 1
    share = 4 * b.links // max(1, b.chars)
    names = [f"words:{_size(words)}", f"links:{share}", f"stops:{_size(text.count('. ') + text.count(', '))}", f"end:{text[-1] if text[-1] in '.!?:' else 'a'}", f"leafwords:{b.path[-1] if b.path else ''}:{_size(words)}"]
    if "\N{COPYRIGHT SIGN}" in text:
        names.append("copyright")
    return [*_ancestry(b.path, b.marks), *(_column(x) for x in names)]


class Field:
    """Weights of a two-label linear chain: per column and label, per label pair, and of the first label."""

    def __init__(self, state: np.ndarray, pair: np.ndarray, start: np.ndarray) -> None:
        self.state, self.pair, self.start = state, pair, start

    def potentials(self, page: list[list[int]]) -> np.ndarray:
        return np.array([self.state[c].sum(0) for c in page])

    def decode(self, page: list[list[int]]) -> list[int]:
        """The best label sequence (Viterbi); 1 is article."""
        if not page:
            return []
        rows = self.potentials(page).tolist()
        (aa, ab), (ba, bb) = self.pair.tolist()
        s0, s1 = self.start[0] + rows[0][0], self.start[1] + rows[0][1]
        back = []
        for p0, p1 in rows[1:]:
            from0, from1 = s1 + ba > s0 + aa, s1 + bb > s0 + ab
            back.append((from0, from1))
            s0, s1 = (s1 + ba if from0 else s0 + aa) + p0, (s1 + bb if from1 else s0 + ab) + p1
        out = [int(s1 > s0)]
        for step in reversed(back):
            out.append(int(step[out[-1]]))
        return out[::-1]


def train(pages: list[tuple[list[list[int]], list[int]]], rounds: int = 60, rate: float = 0.5, ridge: float = 1e-4) -> Field:
    """Fit by full-batch gradient ascent (AdaGrad) on the mean conditional log-likelihood."""
    field = Field(np.zeros((COLUMNS, 2)), np.zeros((2, 2)), np.zeros(2))
    sums = [np.full_like(w, 1e-8) for w in (field.state, field.pair, field.start)]
    for _ in range(rounds):
        grads = [-ridge * w for w in (field.state, field.pair, field.start)]
        for columns, labels in pages:
            if not columns:
                continue
            e = field.potentials(columns)
            n = len(e)
            fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
            fwd[0] = field.start + e[0]
            for i in range(1, n):
                fwd[i] = np.logaddexp.reduce(fwd[i - 1][:, None] + field.pair, axis=0) + e[i]
            for i in range(n - 2, -1, -1):
                bwd[i] = np.logaddexp.reduce(field.pair + e[i + 1] + bwd[i + 1], axis=1)
            z = np.logaddexp.reduce(fwd[-1])
            gap = np.eye(2)[labels] - np.exp(fwd + bwd - z)
            for i, c in enumerate(columns):
                np.add.at(grads[0], c, gap[i] / len(pages))
            for i in range(1, n):
                grads[1] -= np.exp(fwd[i - 1][:, None] + field.pair + e[i] + bwd[i] - z) / len(pages)
                grads[1][labels[i - 1], labels[i]] += 1 / len(pages)
            grads[2] += gap[0] / len(pages)
        for w, g, s in zip((field.state, field.pair, field.start), grads, sums, strict=True):
            s += g**2
            w += rate * g / np.sqrt(s)
    return field


def labelled_pages(seed: int = 7, n: int = 240) -> list[tuple[str, list[str]]]:
    """Labelled training pages: (html, texts of the article's blocks). Layouts vary by seeded choices; words are invented."""
    rng = np.random.default_rng(seed)
    syllables = "ba ce di fo gu la me ni po ru sa te vi xo zu".split()

    def word() -> str:
        return "".join(rng.choice(syllables, rng.integers(1, 5)))

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in range(rng.integers(a, b)))

    def prose(a: int = 4, b: int = 60) -> str:
        out = []
        for _ in range(rng.integers(1, 5)):
            out.append(words(a, b).capitalize() + rng.choice([".", ".", ".", "?", "!", ","]))
        return " ".join(out)

    def pick(*options: str) -> str:
        return str(rng.choice(options))

    def links(tag: str = "li") -> str:
        items = "".join(f"<{tag}><a href='/{word()}'>{words(1, 4)}</a></{tag}>" for _ in range(rng.integers(2, 9)))
        return f"<ul>{items}</ul>" if tag == "li" else items

    def other(kind: str) -> str:
        if kind == "menu":
            return pick(f"<nav>{links()}</nav>", f'<div class="{pick("menu", "navbar", "nav-main", "topnav", "breadcrumbs")}">{links(pick("li", "span", "div"))}</div>', f'<div role="navigation">{links()}</div>')
        if kind == "header":
            return pick(f"<header><div>{words(1, 6)}</div>{links()}</header>", f'<div id="{pick("header", "masthead", "site-header", "banner")}"><p>{words(1, 9)}</p></div>')
        if kind == "footer":
            return pick(f"<footer>&copy; {words(1, 4)} &middot; {prose(2, 12)}</footer>", f'<div class="{pick("footer", "site-footer", "copyright")}"><p>&copy; {prose(2, 20)}</p>{links()}</div>')
        if kind == "side":
            return pick(f"<aside><h3>{words(1, 4)}</h3><p>{prose(3, 20)}</p>{links()}</aside>", f'<div class="{pick("sidebar", "side", "widget", "related", "recommended", "more-stories")}"><h3>{words(1, 4)}</h3><p>{prose(3, 25)}</p>{links()}</div>')
        if kind == "notice":
            return f'<div class="{pick("cookie-notice", "cookie", "notice", "consent", "alert", "popup", "modal", "banner", "newsletter", "subscribe")}"><p>{prose(3, 25)}</p>{pick("", "<button>" + words(1, 3) + "</button>")}</div>'
        if kind == "ad":
            return f'<div class="{pick("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot")}">{pick("", "<p>")}{prose(3, 30)}</div>'
        if kind == "form":
            return f'<form{pick("", " class=" + chr(34) + "search" + chr(34))}><label>{words(1, 5)}</label><input type="text"><p>{words(2, 12)}</p><button>{words(1, 3)}</button></form>'
        if kind == "share":
            return f'<div class="{pick("share", "social", "tags", "byline", "meta", "pagination")}">{links(pick("li", "span"))}</div>'
        body = "".join(f'<{pick("div", "li")} class="comment"><b>{word()}</b><p>{prose(3, 40)}</p>' for _ in range(rng.integers(1, 5)))
        return pick(f'<section class="{pick("comments", "comment-list", "discussion", "replies")}"><h3>{words(1, 3)}</h3>{body}</section>', f'<div id="{pick("comments", "disqus-thread", "responses")}">{body}</div>')

    pages = []
    for _ in range(n):
        keep: list[str] = []

        def block(tag: str, text: str, keep: list[str] = keep) -> str:
            keep.append(text)
            inner = text
            if rng.random() < 0.2:
                i = text.find(" ")
                inner = f"<{(t := pick('b', 'em', 'a href=x', 'span'))}>{text[:i]}</{t.split()[0]}>{text[i:]}" if i > 0 else text
            return f"<{tag}>{inner}" + (f"</{tag}>" if tag != "p" or rng.random() < 0.7 else "")

        def article() -> list[str]:
            parts = [block("h1", words(2, 12))] if rng.random() < 0.9 else []
            for _ in range(rng.integers(1, 9)):
                u = rng.random()
                if u < 0.72:
                    parts.append(block("p", prose() if rng.random() < 0.8 else words(1, 8)))
                elif u < 0.8:
                    parts.append(block(pick("h2", "h3"), words(1, 8)))
                elif u < 0.87:
                    tag = pick("ul", "ol")
                    parts.append(f"<{tag}>" + "".join(block("li", words(1, 25)) for _ in range(rng.integers(2, 6))) + f"</{tag}>")
                elif u < 0.93:
                    parts.append("<blockquote>" + block("p", prose()) + "</blockquote>")
                elif u < 0.96:
                    parts.append("<table>" + "".join("<tr>" + block("td", words(1, 5)) + block("td", words(1, 5)) + "</tr>" for _ in range(rng.integers(1, 4))) + "</table>")
                else:
                    parts.append(block("pre", words(3, 20)))
                if rng.random() < 0.12:
                    parts.append(other(pick("ad", "share", "notice", "side")))
            return parts

        inner = "".join(article())
        shape = pick("article", "article", "article", "main", "div", "div", "section", "bare")
        name = pick("content", "post", "article-body", "entry-content", "story", "main", "post-body", "text")
        wrap = {"article": f"<article>{inner}</article>", "main": f"<main>{inner}</main>", "div": f'<div class="{name}">{inner}</div>', "section": f'<section id="{name}">{inner}</section>', "bare": inner}[shape]
        before = [other(k) for k in ("notice", "header", "menu", "ad", "form") if rng.random() < 0.6]
        after = [other(k) for k in ("share", "side", "ad", "comments", "form", "notice", "footer") if rng.random() < 0.55]
        pages.append((f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{''.join(before)}{wrap}{''.join(after)}</body></html>", keep))
    return pages


def labelled_columns(pages: list[tuple[str, list[str]]]) -> list[tuple[list[list[int]], list[int]]]:
    """Features and labels: blocks whose texts occur, in order, among the article's texts are article."""
    out = []
    for page, keep in pages:
        blocks, at, labels = leaf_blocks(page), 0, []
        for b in blocks:
            hit = at < len(keep) and b.text == keep[at]
            at += hit
            labels.append(int(hit))
        out.append(([block_columns(b) for b in blocks], labels))
    return out


@lru_cache(1)
def default_field() -> Field:
    return train(labelled_columns(labelled_pages()))


def main_text(page: str | None, field: Field) -> str:
    blocks = leaf_blocks(page) if page else []
    labels = field.decode([block_columns(b) for b in blocks])
    return "\n\n".join(b.text for b, keep in zip(blocks, labels, strict=True) if keep)


def extract(pages: DataFrame, html: str = "html", carry: list[str] | None = None, field: Field | None = None, to: str = "text") -> DataFrame:
    """The carried columns (all but the html, if None) and the main text of every page.

    Null and empty pages, and pages without an article block, have an empty text. Every block the field
    labels as article is kept whole. Rows are treated one by one; repeated rows and clashing names of
    other columns do no harm. The field defaults to one trained on labelled_pages().
    """
    carry = [c for c in pages.columns if c != html] if carry is None else carry
    field = field or default_field()
    src = pages.select(F.col(html).cast("string").alias("html"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            out = [main_text(p, field) for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(out, pa.string())], [*[f"c{i}" for i in range(b.num_columns - 1)], "out"])

    kinds = ", ".join([*[f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(src.schema.fields[1:])], "out string"])
    return src.mapInArrow(run, kinds).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], F.col("out").alias(to))
