"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is split at its block elements into leaf blocks, each with the elements it is in. Features are the
ancestors' tags and words of their class, id and role, the block's own tag and its text's length, links
and punctuation, and the same of its neighbours. Emission weights and transitions are trained by maximum
likelihood on labelled pages, which training_pages() makes in many layouts with invented words, so the
model knows no vocabulary; the best labelling of a page is found by Viterbi's algorithm.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import parts

#: Elements that end a block of text where they start and end.
BLOCKS = frozenset(
    "address article aside blockquote body button canvas caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe "
    "legend li main menu nav noscript object ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without text of the page: their content is skipped.
SILENT = frozenset("script style head title noscript template iframe".split())
RAW = frozenset("script style title textarea iframe noscript".split())
#: Elements that say what is in them; the nearest one is a feature.
SECTIONS = frozenset("article main aside nav header footer form dialog".split())
#: What a start tag closes, up to the element that holds it.
CLOSES = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table tbody thead tfoot"), "td": ("td th", "tr"), "th": ("td th", "tr"), "option": ("option", "select")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
KEEP_P = BLOCKS - frozenset("body html head button col colgroup object iframe noscript option optgroup template title canvas textarea select tbody td tfoot th thead tr caption legend summary".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|[\"'][^>]*+(?:>|\Z)|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
#: One attribute after the other, so that nothing inside a value is taken for a name.
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[a-z]+")


class Open:
    """An open element; what blocks inside it share is made once an element.

    tag, names: its own; below: the one it is in; own: the nearest block element, itself included; section:
    the nearest of SECTIONS; new: features of its tag and names that no element it is in has. The features of a block are those
    along its chain of elements, so each element keeps its own alone and deep nesting takes linear memory.
    """

    __slots__ = ("tag", "below", "own", "section", "new")

    def __init__(self, tag: str, names: tuple[str, ...], below: Open | None, held: Counter):
        self.tag, self.below = tag, below
        self.own = tag if tag in BLOCKS else below.own if below else "body"
        self.section = tag if tag in SECTIONS else below.section if below else "none"
        marks = {f"a={tag}", *(f"c={w}" for w in names), *(f"d={w[:-1]}" for w in names if w.endswith("s"))}
        self.new = tuple(sorted(m for m in marks if not held[m]))
        held.update(self.new)

    def marks(self) -> list[str]:
        """Features of the element and all it is in."""
        found, element = [], self
        while element:
            found += element.new
            element = element.below
        return sorted(found)


@dataclass
class Block:
    text: str
    tag: str
    section: str
    element: Open | None
    linked: int
    features: list[str] = field(default_factory=list)


def _names(attributes: str) -> tuple[str, ...]:
    """Words of class, id and role, and `hidden` where the element isn't shown."""
    if not attributes or not attributes.strip():
        return ()
    out: list[str] = []
    for name, a, b, c in _ATTR.findall(attributes):
        value, name = (a or b or c).lower(), name.lower()
        if name == "style":
            out += ["hidden"] * ("display:none" in value.replace(" ", ""))
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            out.append("hidden")
        elif name in ("class", "id", "role"):
            out += _PART.findall(value)
    return tuple(out)


def leaf_blocks(page: str | None) -> list[Block]:
    """Runs of text that no block element parts, in page order, decoded and with single spaces; none is empty.

    End tags that match nothing open are skipped, open elements end with the page, and a tag that the page's
    end cuts off is a tag.
    """
    page = page or ""
    stack: list[Open] = []
    held: Counter = Counter()  # features of the open elements
    opened: dict[str, list[int]] = {}  # places in the stack by tag
    blocks: list[Block] = []
    parts: list[str] = []
    linked = links = silent = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            top = stack[-1] if stack else None
            blocks.append(Block(text, top.own if top else "body", top.section if top else "none", top, linked))
        parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if silent or not raw:
            return
        text = entities.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if links:
            linked += len(text.strip())

    def pop(k: int) -> None:
        nonlocal links, silent
        for element in stack[k:]:
            held.subtract(element.new)
            links -= element.tag == "a"
            silent -= element.tag in SILENT
            opened[element.tag].pop()
        del stack[k:]

    def nearest(tags) -> int:
        """Place of the innermost open element of these tags, or -1."""
        return max((opened[t][-1] for t in tags if opened.get(t)), default=-1)

    at, n = 0, len(page)
    while at < n:
        found = _TAG.search(page, at)
        if not found:
            say(page[at:])
            break
        say(page[at : found.start()])
        at = found.end()
        tag = found[2] and found[2].lower()
        if not tag:
            continue
        if found[1]:
            k = nearest((tag,))
            if tag in BLOCKS:
                flush()
            if k >= 0 and tag not in ("html", "body"):
                pop(k)
            continue
        if tag in BLOCKS:
            flush()
            if tag in KEEP_P:
                if stack and stack[-1].own == "p":
                    pop(nearest(("p",)))
            if tag in CLOSES:
                closed, holds = CLOSES[tag]
                k = nearest(closed)
                if k > nearest(holds):
                    pop(k)
            if tag == "body" and opened.get("head"):
                pop(opened["head"][0])
        elif tag == "br":
            parts.append(" ")
        if tag in VOID or found[3].endswith("/") and tag not in BLOCKS:
            continue
        opened.setdefault(tag, []).append(len(stack))
        stack.append(Open(tag, _names(found[3]), stack[-1] if stack else None, held))
        links += tag == "a"
        silent += tag in SILENT
        if tag in RAW:
            end = re.compile(rf"</{tag}\b", re.I).search(page, at)
            stop = end.start() if end else n
            if tag == "textarea":
                say(page[at:stop])
            at = stop
    flush()
    return blocks


def _level(x: float, steps: tuple[float, ...]) -> int:
    return sum(x >= s for s in steps)


def _own(b: Block) -> list[str]:
    n = len(b.text)
    marks = sum(map(b.text.count, ".,;!?。，"))
    return [f"n{_level(n, (8, 20, 40, 80, 160, 400))}", f"l{_level(b.linked / n, (0.01, 0.3, 0.7, 0.95))}", f"m{_level(marks, (1, 2, 4, 8))}", f"t={b.tag}"]


def featured(blocks: list[Block]) -> list[Block]:
    """The blocks, each with the names of its own and its neighbours' features; those of its elements come apart, see Open.marks."""
    own = [_own(b) for b in blocks]
    for k, b in enumerate(blocks):
        f = ["bias", *own[k], f"{b.tag}{own[k][1]}", f"{b.tag}{own[k][0]}"]
        f += [f"near={b.section}", f"near={b.section}{own[k][1]}"]
        f += [f"-1{x}" for x in (own[k - 1] if k else ("edge",))] + [f"+1{x}" for x in (own[k + 1] if k + 1 < len(blocks) else ("edge",))]
        if any(s in b.text for s in ("©", "(c)", "®")):
            f.append("copyright")
        if b.text[-1:] in ".!?…\"”»":
            f.append("stop")
        if "|" in b.text or "·" in b.text or "»" in b.text[:-1]:
            f.append("bar")
        b.features = f
    return blocks


@dataclass
class Field:
    """The trained field: score of label 1 by feature, and of (label, next label), 0 for all else."""

    weights: dict[str, float]
    moves: list[list[float]]

    def decode(self, blocks: list[Block]) -> list[int]:
        """The best labels of a page's blocks by Viterbi's algorithm; ties go to label 0."""
        w, t = self.weights, self.moves
        back: list[tuple[int, int]] = []
        a, b = 0.0, 0.0
        above: dict[int, float] = {}  # what the features of an element and those it is in weigh

        def shared(element: Open | None) -> float:
            chain = []
            while element and id(element) not in above:
                chain.append(element)
                element = element.below
            total = above[id(element)] if element else 0.0
            for x in reversed(chain):
                total += sum(w.get(f, 0.0) for f in x.new)
                above[id(x)] = total
            return total

        for k, block in enumerate(blocks):
            e = sum(w.get(f, 0.0) for f in block.features) + shared(block.element)
            if not k:
                a, b = 0.0, e
                continue
            from_a, from_b = (0 if a + t[0][0] >= b + t[1][0] else 1), (0 if a + t[0][1] >= b + t[1][1] else 1)
            back.append((from_a, from_b))
            a, b = max(a + t[0][0], b + t[1][0]), max(a + t[0][1], b + t[1][1]) + e
        if not blocks:
            return []
        out = [int(b > a)]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]


def train(pages: list[tuple[list[Block], list[int]]], steps: int = 150, rate: float = 0.1, ridge: float = 2e-3) -> Field:
    """Maximum-likelihood field of labelled pages, by Adam on the exact gradient (forward-backward)."""
    every = lambda b: b.features + (b.element.marks() if b.element else [])
    names = {f: k for k, f in enumerate(sorted({f for blocks, _ in pages for b in blocks for f in every(b)}))}
    size, longest = len(pages), max(len(blocks) for blocks, _ in pages)
    place, column = [], []
    labels, real = np.zeros((size, longest), int), np.zeros((size, longest), bool)
    for p, (blocks, y) in enumerate(pages):
        labels[p, : len(y)], real[p, : len(y)] = y, True
        for k, b in enumerate(blocks):
            found = every(b)
            place += [p * longest + k] * len(found)
            column += [names[f] for f in found]
    place, column = np.array(place), np.array(column)
    theta = np.zeros(len(names) + 4)
    m = v = np.zeros_like(theta)
    for step in range(1, steps + 1):
        emit = np.zeros((size, longest, 2))
        emit[..., 1] = np.bincount(place, theta[:-4][column], size * longest).reshape(size, longest)
        move = theta[-4:].reshape(2, 2)
        fore, aft = np.zeros_like(emit), np.zeros_like(emit)
        fore[:, 0] = emit[:, 0]
        for k in range(1, longest):
            fore[:, k] = np.where(real[:, k, None], np.logaddexp(fore[:, k - 1, 0, None] + move[0], fore[:, k - 1, 1, None] + move[1]) + emit[:, k], fore[:, k - 1])
        for k in range(longest - 2, -1, -1):
            ahead = aft[:, k + 1] + emit[:, k + 1]
            aft[:, k] = np.where(real[:, k + 1, None], np.logaddexp(ahead[:, 0, None] + move[:, 0], ahead[:, 1, None] + move[:, 1]), 0)
        total = np.logaddexp(fore[:, -1, 0], fore[:, -1, 1])
        one = np.where(real, np.exp(fore[..., 1] + aft[..., 1] - total[:, None]), 0)
        both = np.exp(fore[:, :-1, :, None] + move + (emit + aft)[:, 1:, None, :] - total[:, None, None, None]) * real[:, 1:, None, None]
        seen = np.zeros((2, 2))
        np.add.at(seen, (labels[:, :-1][real[:, 1:]], labels[:, 1:][real[:, 1:]]), 1)
        gap = (np.where(real, labels, 0) - one).ravel()
        grad = np.concatenate([np.bincount(column, gap[place], len(names)), (seen - both.sum(axis=(0, 1))).ravel()]) / size - ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field({f: float(theta[k]) for f, k in names.items() if abs(theta[k]) > 1e-4}, theta[-4:].reshape(2, 2).tolist())


def training_pages(count: int = 700, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Labelled pages: html and, for each of its leaf blocks, 1 for the article's and 0 for all else.

    Blocks carry their label in an attribute while a page is made. Layouts, element names and class names
    are drawn at random, words are random letters.
    """
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzäéñ") for _ in range(rnd.randint(1, 9)))
    title = lambda n: " ".join(word() for _ in range(rnd.randint(1, n))).capitalize()
    sentence = lambda: " ".join(word() for _ in range(rnd.randint(1, 22))).capitalize() + rnd.choice(".......!?")
    prose = lambda n: " ".join(sentence() for _ in range(rnd.randint(1, n)))
    link = lambda: f'<a href="/{word()}">{title(3)}</a>'
    some = lambda f, n: "".join(f() for _ in range(rnd.randint(1, n)))

    def box(tags: str, classes: str, inside: str) -> str:
        """An element of one of the tags; a div always, others often, with one of the classes."""
        tag, name = rnd.choice(tags.split()), rnd.choice(classes.split())
        attr = "" if tag not in ("div", "section", "ul", "p") and rnd.random() < 0.6 else f' {rnd.choice(["class", "class", "id"])}="{name}{rnd.choice(["", "", "-" + word()])}"'
        return f"<{tag}{attr}>{inside}</{tag}>"

    def leaf(text: str, tag: str, label: int) -> str:
        return f"<{tag}><!--{label}-->{text}" + (f"</{tag}>" if tag != "p" or rnd.random() < 0.8 else "")

    def off(tag: str, text: str) -> str:
        return leaf(text, tag, 0)

    def menu() -> str:
        return box("nav nav nav ul div", "menu nav navigation navbar breadcrumb breadcrumbs topnav", "<ul>" + some(lambda: off("li", link()), 9) + "</ul>")

    def header() -> str:
        return box("header header div", "header masthead top site-header banner logo", off(rnd.choice(["div", "h1", "p", "h2"]), rnd.choice([link(), title(5)])) + (menu() if rnd.random() < 0.5 else ""))

    def footer() -> str:
        return box("footer footer div", "footer site-footer bottom copyright legal", some(lambda: off(rnd.choice(["p", "div", "span"]) if rnd.random() < 0.9 else "p", rnd.choice([f"&copy; {word()} &middot; {prose(2)}", prose(2), link() + " | " + link(), title(6)])), 3))

    def notice() -> str:
        return box("div div aside section dialog", "cookie cookies notice alert banner consent gdpr message popup modal warning", off(rnd.choice(["p", "div"]), prose(3)) + (off("button", title(2)) if rnd.random() < 0.5 else ""))

    def advert() -> str:
        return box("div div div aside section", "ad ads advert advertisement adsense sponsored sponsor promo promotion", off(rnd.choice(["div", "p"]), rnd.choice([prose(3), link() + " " + prose(1)])))

    def sidebar() -> str:
        return box("aside aside div section", "sidebar side widget related recommended popular trending teaser", some(lambda: off(rnd.choice(["h2", "h3", "h4"]), title(4)) + rnd.choice([lambda: "<ul>" + some(lambda: off("li", link()), 6) + "</ul>", lambda: some(lambda: off("p", prose(3)), 3)])(), 3))

    def form() -> str:
        return box("form", "form search newsletter subscribe login signup contact", rnd.choice(["", off("p", prose(2))]) + off("label", title(3)) + "<input name=q>" + off("button", title(2)) + (f"<select>{off('option', title(2))}{off('option', title(2))}</select>" if rnd.random() < 0.3 else ""))

    def comments() -> str:
        one = lambda: box("div li div section div li article", "comment comment-body reply response discussion", off(rnd.choice(["div", "p", "h4"]), title(3)) + some(lambda: off("p", prose(4)), 2))
        return box("section div div ol", "comments comment-list discussion responses replies disqus", off(rnd.choice(["h2", "h3"]), title(3)) + some(one, 5) + (form() if rnd.random() < 0.3 else ""))

    def share() -> str:
        return box("div ul", "share social sharing tags meta pagination pager", some(lambda: off("li", link()), 5))

    def on() -> str:
        r = rnd.random()
        if r < 0.2:  # very short text, text without stops, in columns or of one word again and again
            return leaf(rnd.choice([lambda: word().capitalize() + ".", lambda: title(3) + rnd.choice(["", ".", "!"]), lambda: title(60), lambda: " | ".join(title(2) for _ in range(rnd.randint(1, 30))), lambda: " ".join([word()] * rnd.randint(1, 60)), lambda: "©®"[rnd.randint(0, 1)] + prose(2)])(), "p", 1)
        if r < 0.7:
            return leaf(("<b>" if rnd.random() < 0.2 else "") + prose(6) + (f" {link()} {prose(2)}" if rnd.random() < 0.4 else "") + ("<br>" if rnd.random() < 0.1 else ""), rnd.choice(["p"] * 9 + ["div"]), 1)
        if r < 0.78:
            return leaf(title(7), rnd.choice(["h2", "h3"]), 1)
        if r < 0.86:
            return f"<{(t := rnd.choice(['ul', 'ol']))}>" + some(lambda: leaf(rnd.choice([prose(2), title(8)]), "li", 1), 6) + f"</{t}>"
        if r < 0.9:
            return "<blockquote>" + some(lambda: leaf(prose(3), "p", 1), 2) + "</blockquote>"
        if r < 0.93:
            return leaf(prose(2), "pre", 1)
        if r < 0.96:
            return "<table>" + some(lambda: "<tr>" + leaf(title(3), "td", 1) + leaf(title(3), "td", 1) + "</tr>", 4) + "</table>"
        return "<figure><img src=x>" + leaf(prose(1), "figcaption", 1) + "</figure>"

    def unseen() -> str:
        """An element that isn't shown."""
        attr = rnd.choice(["hidden", "hidden", 'style="display:none"', 'style="color:red; display: none"', 'aria-hidden="true"'])
        return f"<{(t := rnd.choice(['div', 'div', 'p', 'section', 'span']))} {attr}>" + (off("p", prose(4)) if t != "p" else f"<!--0-->{prose(4)}") + f"</{t}>"

    made = []
    for _ in range(count):
        head = leaf(title(9), "h1", 1) if rnd.random() < 0.85 else ""
        if head and rnd.random() < 0.15:
            head = f"<header>{head}</header>"
        middle = head + some(lambda: on() + (rnd.choice([advert, advert, form, share, sidebar, notice, unseen])() if rnd.random() < 0.2 else ""), 14)
        if rnd.random() < 0.12:  # one short paragraph, mostly without a heading
            middle = rnd.choice(["", "", head]) + leaf(prose(2), "p", 1)
        body = box("article article article main main div div section", "content main article post entry story article-body entry-content post-content text body page", middle)
        if rnd.random() < 0.25:
            body = box("main div section", "main content container wrapper page", body)
        alone = rnd.random() < 0.12  # nothing but the article
        before = [f() for f in (header, menu, notice, advert, sidebar, form) if not alone and rnd.random() < 0.4]
        after = [f() for f in (share, sidebar, comments, comments, form, advert, notice, menu) if not alone and rnd.random() < 0.3]
        rnd.shuffle(before)
        rnd.shuffle(after)
        end = footer() if not alone and rnd.random() < 0.85 else ""
        page = f"<!DOCTYPE html><html><head><title>{title(8)}</title></head><body>" + "".join(before) + body + "".join(after) + end + "</body></html>"
        marked = leaf_blocks(re.sub(r"<!--(\d)-->", "\\1\x00", page))
        made.append((re.sub(r"<!--\d-->", "", page), [int(b.text[0]) if b.text[1:2] == "\x00" else 0 for b in marked]))
    return made


@lru_cache
def model() -> Field:
    """The field trained on training_pages(), a few seconds once a driver."""
    labelled = [(featured(leaf_blocks(page)), y) for page, y in training_pages()]
    return train([(blocks, y) for blocks, y in labelled if blocks and len(blocks) == len(y)])


def main_text(page: str | None, field: Field) -> str:
    """Blocks labelled 1, in page order, joined by line feeds."""
    blocks = featured(leaf_blocks(page))
    return "\n".join(b.text for b, y in zip(blocks, field.decode(blocks), strict=True) if y)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page; other columns are not read.

    html may be null (empty), cut off or of any length; text is empty if there is no article. Repeated rows
    give repeated rows.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model())
    schema = "page_id long, url string, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = [main_text(x, sent.value) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, schema)
