"""HTML extraction by the maximum-scoring subsequence.

A page is a sequence of words and tags. A word scores by how likely its block is content (a logistic model of the block's
length, links, sentences and place, and of the elements around it), a tag scores negative; one linear scan finds the
contiguous region of the highest sum. Within the region an element is left out if its own words and tags, summed in the
same way, score below a bound: an advert, a notice or a menu inside the article. All weights are learned from labelled
pages, which ``labelled_pages`` writes with many wrappers, known and invented names, and boilerplate of every kind.

Names of an element are taken whole and by their last telling part (``site-footer``: footer, ``notice-board``: board). An element
that holds most of a page's words says nothing by its name or kind, as a form or a class around everything does.

Defined cases: null or empty html gives an empty text; unclosed tags, comments and scripts end with the page;
stray end tags are ignored; of equal regions the first wins; whole pages are read and nothing is capped. Scripts, styles,
templates, frames, the page's title and controls of forms (text areas, selections, data lists) are no text; anything else
inside an article is. Rows that repeat are extracted each; an empty table gives no rows; extra columns pass, those named like an
output are replaced.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from pathloom.llm.shared import map_text

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[^\W\d_]+")
SENTENCE = re.compile(r"[.!?…。！？][\"')\]»”’]*$")
#: Elements whose content is no text of the page.
SILENT = {"script", "style", "noscript", "template", "title", "iframe", "textarea", "select", "datalist"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td",
    "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Parts of names that say where or how an element stands, not what it is.
VAGUE = set("area bar block body bottom box center cell col column container content first float footerless grid group holder inner item items last left list main outer page panel part region right row section site small static sticky text top unit wide widget wrap wrapper".split())
#: An element says what it is only if it holds less than this part of the page's words.
MOST = 0.6
#: An article or main element with this part of the page's words makes the rest something else.
ARTICLE_SHARE = 0.1


@dataclass
class Element:
    """An element of blocks: its kind and names, its parent's place, and the words in it."""

    tag: str
    names: frozenset[str]
    parent: int
    depth: int
    words: int = 0
    features: frozenset[str] = frozenset()


@dataclass
class Block:
    """A run of text between block tags."""

    parts: list[str] = field(default_factory=list)
    features: frozenset[str] = frozenset()
    element: int = -1
    words: int = 0
    linked: int = 0
    tags_before: int = 0
    text: str = ""


def _names(attributes: str) -> frozenset[str]:
    """Whole names, and the last telling part of each."""
    out = set()
    for kind, value in ATTRIBUTE.findall(attributes):
        for name in value.strip("\"'").split():
            parts = [p.lower() for p in PART.findall(name)]
            telling = [p for p in parts if p not in VAGUE]
            out.add(f"{'role' if kind.lower() == 'role' else 'name'}:{'-'.join(parts)}")
            out.add(f"is:{telling[-1] if telling else parts[-1] if parts else ''}")
    return frozenset(out)


def parse(page: str) -> tuple[list[Block], list[Element]]:
    """The page's blocks with text, in order, and the elements that they stand in."""
    blocks: list[Block] = []
    elements: list[Element] = []
    stack: list[int] = []
    at, end, tags, links = 0, len(page), 0, 0
    current = Block()

    def close() -> None:
        nonlocal current, tags
        text = " ".join("".join(current.parts).split())
        if text:
            current.text, current.words, current.element = text, len(text.split()), stack[-1] if stack else -1
            current.tags_before, tags = tags, 0
            blocks.append(current)
        current = Block()

    def say(raw: str) -> None:
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            current.parts.append(text)
            if links:
                current.linked += len(text.split())

    while at < end:
        found = TAG.search(page, at)
        if not found:
            say(page[at:])
            break
        say(page[at : found.start()])
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        tags += 1
        closing = bool(found[1] or found[4])
        attributes = found[3] or found[6] or ""
        if name in SILENT:
            if not closing and not attributes.endswith("/"):
                stop = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = stop.end() if stop else end
                tags += 1
            if name == "title":
                close()
        elif name == "br":
            current.parts.append(" ")
        elif name == "a":
            links = 0 if closing else 1
        elif name in BLOCKS:
            close()
            if not closing:
                if stack and elements[stack[-1]].tag == "p":
                    stack.pop()
                if name == "li" and stack and elements[stack[-1]].tag == "li":
                    stack.pop()
                if name not in VOID:
                    elements.append(Element(name, _names(attributes), stack[-1] if stack else -1, len(stack)))
                    stack.append(len(elements) - 1)
                    links = 0
            else:
                for k in range(len(stack) - 1, -1, -1):
                    if elements[stack[k]].tag == name:
                        del stack[k:]
                        break
    close()
    _describe(blocks, elements)
    return blocks, elements


def _describe(blocks: list[Block], elements: list[Element]) -> None:
    """Gives blocks their features: of themselves, their place, and the elements around them."""
    for b in blocks:
        if b.element >= 0:
            elements[b.element].words += b.words
    for e in reversed(elements):
        if e.parent >= 0:
            elements[e.parent].words += e.words
    total = sum(b.words for b in blocks) or 1
    bodies = [k for k, e in enumerate(elements) if e.tag in ("article", "main") and e.words >= ARTICLE_SHARE * total]
    body = max(bodies, key=lambda k: (elements[k].words, elements[k].depth), default=-1)
    inside = set()
    for k, e in enumerate(elements):
        if k == body or e.parent in inside:
            inside.add(k)
        own = frozenset() if e.words > MOST * total else frozenset({f"in:{e.tag}{'@' if e.tag in ('header', 'footer', 'aside', 'section', 'div') and e.parent in inside else ''}"} | e.names)
        e.features = (elements[e.parent].features if e.parent >= 0 else frozenset()) | own
    size = lambda n: 1 if n < 4 else 2 if n < 13 else 3 if n < 41 else 4
    for k, b in enumerate(blocks):
        share, tag = b.linked / b.words, elements[b.element].tag if b.element >= 0 else ""
        near = max((x.words for x in blocks[max(0, k - 1) : k + 2] if x is not b and x.linked < 0.5 * x.words), default=0)
        links = "all" if share > 0.8 else "some" if share > 0.3 else "few"
        told = {f"own:{tag}", f"links:{links}", f"size:{size(b.words)}", f"links:{links}:size:{size(b.words)}", f"near:{size(near)}", f"ends:{bool(SENTENCE.search(b.text))}", f"third:{3 * k // len(blocks)}"}
        if body >= 0:
            told.add("out" if b.element not in inside else "within")
        b.features = (elements[b.element].features if b.element >= 0 else frozenset()) | told


#: Words of the labelled pages.
FILLER = "the committee met again on friday to discuss how the old harbour could be kept open through winter and who would pay for it".split()
#: Wrappers of an article in the labelled pages; ? is an invented name.
ARTICLES = (
    "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="post-body">{}</div>', '<div class="?">{}</div>',
    '<div class="article story entry">{}</div>', '<div id="main" role="main">{}</div>', "<div>{}</div>", "<section>{}</section>", "{}", '<form id="?"><div class="?">{}</div></form>', '<section class="?"><div>{}</div></section>',
)
#: Names of boilerplate, in the languages of many sites.
JUNK_NAMES = (
    "ad ads advert advertisement werbung anzeige publicidad publicite sponsored sponsor promo promotion banner nav navigation navbar menu breadcrumb breadcrumbs sidebar seitenleiste barra-lateral related recommended related-posts"
    " share sharing social comments comment kommentare comentarios commentaires disqus-thread reply replies respond footer pie fusszeile header masthead cabecera kopfzeile cookie cookies cookie-notice notice hinweis aviso consent gdpr"
    " privacy newsletter subscribe subscription signup login register popup modal overlay copyright legal pagination pager toolbar tools alert warning tags tagcloud categories search"
).split()
JUNK_TAGS = ("nav", "header", "footer", "aside", "menu", "dialog", "form")
JUNK_ROLES = ("navigation", "banner", "complementary", "contentinfo", "search")


def labelled_pages(pages: int = 520, seed: int = 11) -> Iterator[tuple[str, list[tuple[str, bool]]]]:
    """(html, its blocks and whether each is main text): articles in wrappers of known and invented names, with boilerplate of
    every kind before, within and after them."""
    rng = random.Random(seed)
    invented = lambda: "".join(rng.choice(("ka", "mo", "ri", "tu", "ze", "plo", "qu", "xa", "ven", "dor")) for _ in range(rng.randint(2, 4)))
    told: list[tuple[str, bool]] = []

    def run(n: int, stop: str = "") -> str:
        at = rng.randrange(len(FILLER))
        return " ".join(FILLER[(at + k * 7 + rng.randint(0, 2)) % len(FILLER)] for k in range(n)) + stop

    def said(text: str, good: bool) -> str:
        told.append((text, good))
        return text

    def links(n: int, good: bool, words: tuple[int, int] = (1, 3)) -> str:
        kind = rng.choice(("ul", "ol", "ul"))
        return f"<{kind}>" + "".join(f'<li><a href="/x{k}">{said(run(rng.randint(*words)), good)}</a></li>' for k in range(n)) + f"</{kind}>"

    def junk(inside: bool) -> str:
        name = rng.choice(JUNK_NAMES)
        name = rng.choice((name, name, f"site-{name}", f"{name}-{rng.choice(('box', 'wrapper', 'left', 'list'))}", f"{invented()} {name}"))
        tag, kind = rng.choice(("div", "div", "section", "ul")), rng.random()
        if kind < 0.3:
            tag, opened = (t := rng.choice(JUNK_TAGS)), f"<{t}>"
        elif kind < 0.36:
            opened = f'<{tag} role="{rng.choice(JUNK_ROLES)}">'
        elif kind < 0.46 and not inside:
            opened = f'<{tag} class="{invented()}">'
        else:
            opened = f'<{tag} {rng.choice(("class", "id"))}="{name}">'
        form = rng.random()
        if form < 0.4:
            held = (f"<h3>{said(run(rng.randint(1, 3)), False)}</h3>" if rng.random() < 0.4 else "") + links(rng.randint(2, 6), False, rng.choice(((1, 2), (1, 3), (3, 7))))
        elif form < 0.55:
            held = "".join(f"<p>{said(run(rng.randint(2, 30), '.'), False)}</p>" for _ in range(rng.randint(1, 4)))
        elif form < 0.7:
            held = "".join(f"<{(t := rng.choice(('p', 'li', 'div')))}>{said(run(rng.randint(3, 40), rng.choice('.!?')), False)}</{t}>" for _ in range(rng.randint(1, 3))) if "com" in opened else said(run(rng.randint(2, 9)), False)
        else:
            held = said(run(rng.choice((2, 5, 12, 25, 40)), rng.choice(("", ".", "!"))), False)
        return f"{opened}{held}</{tag}>"

    def article(inside: bool) -> str:
        out = [f"<{(t := rng.choice(('h1', 'h1', 'h2')))}>{said(run(rng.randint(3, 9)), True)}</{t}>"]
        for _ in range(rng.randint(2, 8)):
            kind = rng.random()
            if kind < 0.62:
                out.append(f"<p>{said(run(rng.choice((5, 18, 35, 60, 90)), rng.choice('..!?')), True)}</p>")
            elif kind < 0.7:
                out.append(f"<h2>{said(run(rng.randint(2, 6)), True)}</h2>")
            elif kind < 0.76:
                out.append(f"<{(t := rng.choice(('ul', 'ol')))}>" + "".join(f"<li>{said(run(rng.randint(2, 18)), True)}</li>" for _ in range(rng.randint(2, 5))) + f"</{t}>")
            elif kind < 0.82:
                out.append(f"<h2>{said(rng.choice(('Sources', 'References', 'Quellen', 'Further reading')), True)}</h2>" + links(rng.randint(2, 4), True, (4, 10)))
            elif kind < 0.9:
                out.append(f"<{(t := rng.choice(('blockquote', 'pre', 'div', 'figcaption', 'address')))}>{said(run(rng.randint(4, 25)), True)}</{t}>")
            elif kind < 0.92:
                out.append("<table><tr>" + "".join(f"<td>{said(run(rng.randint(1, 5)), True)}</td>" for _ in range(rng.randint(2, 5))) + "</tr></table>")
            elif kind < 0.95:
                out.append(f'<div class="{rng.choice((invented(), "notice-board", "ad-hoc", "text", "header-image", "comment-culture"))}"><p>{said(run(rng.choice((12, 30, 50)), "."), True)}</p></div>')
            else:
                out.append(junk(True))
        return "".join(out)

    for k in range(pages):
        told.clear()
        wrapper = ARTICLES[k % len(ARTICLES)]
        while "?" in wrapper:
            wrapper = wrapper.replace("?", invented(), 1)
        before = "".join(junk(False) for _ in range(rng.randint(0, 4)))
        middle = wrapper.replace("{}", article(any(x in wrapper for x in ("article", "main", "content"))))
        after = "".join(junk(False) for _ in range(rng.randint(0, 4)))
        whole = f"{before}{middle}{after}"
        if rng.random() < 0.15:
            whole = f'<form id="aspnetForm">{whole}</form>' if rng.random() < 0.5 else f'<div class="{rng.choice(JUNK_NAMES)}-layout {invented()}">{whole}</div>'
        yield f"<html><head><title>{run(5)}</title></head><body class='{invented()}'>{whole}</body></html>", list(told)


@dataclass
class Weights:
    """Of features (a block's log odds of being content), of a tag, of a boilerplate word, and the bound below which an element
    of the region is left out, for each of its words."""

    bias: float
    features: dict[str, float]
    tag: float
    junk: float
    bound: float = 0.0

    def odds(self, block: Block) -> float:
        return self.bias + sum(self.features.get(f, 0.0) for f in sorted(block.features))

    def word(self, odds: float) -> float:
        """The score of a word of a block."""
        return float(np.tanh(odds / 2)) if odds > 0 else self.junk * float(np.tanh(odds / 2))


def region(scores: list[tuple[float, float]]) -> tuple[int, int]:
    """First and past-last block of the best contiguous region; ``scores``: of the tags before a block, of its words. The tags
    before a region's first block aren't in it."""
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for k, (tags, words) in enumerate(scores):
        if k == start or total + tags <= 0:
            total, start = 0.0, k
        else:
            total += tags
        total += words
        if total > best:
            best, best_at = total, (start, k + 1)
    return best_at


def left_out(blocks: list[Block], elements: list[Element], first: int, last: int, words: list[float], bound: float) -> set[int]:
    """The blocks of the region that stand in elements whose words score below the bound on the whole; a block of no
    element that is all in the region counts by itself."""
    sums: dict[int, float] = {}
    counts: dict[int, int] = {}
    whole = {-1: 0}
    for k in range(first, last):
        at = blocks[k].element
        while at >= 0:
            sums[at], counts[at] = sums.get(at, 0.0) + blocks[k].words * words[k], counts.get(at, 0) + blocks[k].words
            at = elements[at].parent
    out = set()
    for k in range(first, last):
        at, low = blocks[k].element, blocks[k].words * words[k] < bound * blocks[k].words and blocks[k].element in whole
        while at >= 0 and not low:
            low = counts[at] == elements[at].words and sums[at] < bound * counts[at]
            at = elements[at].parent
        if low:
            out.add(k)
    return out


def extract(page: str, weights: Weights) -> str:
    """The main text: blocks of the best region without the elements that are left out, joined by an empty line."""
    return "\n\n".join(b.text for b in main_blocks(*parse(page), weights))


def main_blocks(blocks: list[Block], elements: list[Element], weights: Weights) -> list[Block]:
    words = [weights.word(weights.odds(b)) for b in blocks]
    first, last = region([(-weights.tag * b.tags_before, b.words * w) for b, w in zip(blocks, words, strict=True)])
    out = left_out(blocks, elements, first, last, words, weights.bound)
    return [blocks[k] for k in range(first, last) if k not in out]


def learn(pages: Iterator[tuple[str, list[tuple[str, bool]]]] | None = None) -> Weights:
    """Weights from labelled pages: features by logistic regression over their blocks, then the weights of tags and
    boilerplate words and the bound of elements that give most pages their exact text."""
    parsed = []
    for page, told in pages or labelled_pages():
        blocks, elements = parse(page)
        if [b.text for b in blocks] == [t for t, _ in told]:
            parsed.append((blocks, elements, [good for _, good in told]))
    rows = [(b.features, good) for blocks, _, goods in parsed for b, good in zip(blocks, goods, strict=True)]
    counts: dict[str, int] = {}
    for features, _ in rows:
        for f in features:
            counts[f] = counts.get(f, 0) + 1
    names = sorted(f for f, n in counts.items() if n >= 4)
    column = {f: k for k, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)), np.float32)
    for k, (features, _) in enumerate(rows):
        x[k, [column[f] for f in features if f in column]] = 1
    y = np.array([float(c) for _, c in rows], np.float32)
    w, pace = np.zeros(len(names) + 1, np.float32), np.full(len(names) + 1, 1e-8, np.float32)
    x = np.concatenate([x, np.ones((len(rows), 1), np.float32)], 1)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum())).astype(np.float32)
    for _ in range(400):
        slope = x.T @ (weight * (1 / (1 + np.exp(-(x @ w))) - y)) + 2e-5 * w
        pace += slope * slope
        w -= 0.3 * slope / np.sqrt(pace)
    bias = float(w[-1])
    found = Weights(bias, dict(zip(names, w[:-1].tolist(), strict=True)), 0.0, 0.0)
    best, chosen = -1.0, found
    for tag in (0.1, 0.02):
        for junk in (0.3, 0.1, 0.03):
            for bound in (0.0, -0.1, -0.2, -0.4):
                tried = Weights(found.bias, found.features, tag, junk, bound * junk)
                right = sum(main_blocks(blocks, elements, tried) == [b for b, good in zip(blocks, goods, strict=True) if good] for blocks, elements, goods in parsed[::5])
                if right > best:
                    best, chosen = right, tried
    return chosen


def main_text(df: DataFrame, html: str = "html", text: str = "text", weights: Weights | None = None) -> DataFrame:
    """Replaces each whole page by its main text and the number of its code points."""
    shared = df.sparkSession.sparkContext.broadcast(weights or learn())  # a few hundred floats

    def fn(pages: list[str]) -> list[list]:
        texts = [extract(p, shared.value) for p in pages]
        return [texts, [len(t) for t in texts]]

    return map_text(df, html, {text: "string", "n_chars": "bigint"}, fn, drop=(html,))
