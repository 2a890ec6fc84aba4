"""HTML extraction by wrapper induction over the pages of a host.

Pages of a host that open the same containers are one layout; a layout of at least LEAST pages
has its longest page as pivot, and other pages go by the longest of their host.  The tree of
block elements of every page is aligned with its pivot's by simple tree matching: matched
elements have matched parents, keep the order of children, and are as many as can be (an equal
text counts as one more); equal shapes match as they are.  So each element of a page has a
place, that of its partner in the pivot.  Over counts of (layout, place, text) made in Spark, a
text is repeated that stands at its place on nearly all pages that have the element around it (so
that a passage shared by a few articles is none).  Constant nodes are template and
left out: an element with a class or id whose own whole text is repeated, and a plain block whose
text is, where such text is the lesser part of a page (a page that is mostly repeated text is a
copy, not a template around changing text); varying slots, and elements without a partner, are
content.  The region of a layout is the smallest container around every text block of all its
pages that is neither template nor repeated.  Pivots, repeated marks and regions are rows of a
pivot's size at most, joined to the pages by host and layout (by broadcast below a checked size);
each page is read in order, with a stack, in time and memory in proportion to its length, and
matched in time in proportion to the products of unequal lists of children.

Block rules: block elements part the text; inside a block white space becomes one space;
blocks are joined by two line feeds; inline elements, left out or not, part nothing.  Menus,
headers and footers of the page, sidebars, notices, adverts, forms, scripts, styles and reader
comments are left out by element or role, and by a class or id that is such a name or is made
of such names and words of page structure ("ad-slot", not "menu-design"), inside the region
too; a header inside an article is part of it, and names say nothing of headings, of the page's
frame, of articles, and (but for plain names of adverts) of paragraphs, quotes, lists' items and
cells inside an article, nor of inline text there.  A form that holds an article, or most of a
page's text with a paragraph or heading in it, is only the page's frame and is kept.

Edge cases: null and empty html give an empty text; a null url or one without a host shares
a nameless host; a page of a layout without changing text, or left without text, falls back to its article, main or body;
unclosed elements end with their parent or the next block; a quote that nothing closes is a
plain character, a "<" that nothing closes is text; a script, style, title or the like that
is never closed takes the rest of the page, as in browsers; repeated rows give equal texts;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.storage import durable

#: Share of the pages with a place on which a text must be the same to be template, and the least number of them.
CONSTANT, LEAST = 0.8, 3
#: A plain block is template from so many pages on, and where such blocks are at most this share of a page's changing text.
PLAIN_LEAST, PLAIN_SHARE = 5, 1 / 2
#: Ends each step of a path where paths are compared; marks of runs of blocks are sums by this base and prime.
_END, _BASE, _PRIME = "\x01", 1_000_003, (1 << 61) - 1

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>\"'=]*>)?|<[!?]|</")
_STOP = re.compile(r"[>=]")
_ATTRIBUTE = re.compile(r"""([^\s=/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|(\S*)))?""")
_WORD = re.compile(r"[a-z]+|[0-9]+")
# Elements and names by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center datalist dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("nav aside footer button menu dialog head noscript template select option datalist".split()) | RAW
#: Blocks of running text, and names of adverts that count even for these.
TEXTUAL = frozenset("p blockquote pre li dd dt td th tr tbody thead caption figure figcaption summary address".split())
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising sponsored".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist disqus consent cookie cookies copyright
    footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination paywall popup promo promoted promotion related
    replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget""".split()
)
#: Words of page structure: beside a name they leave it a name.
STRUCTURE = frozenset(
    """area articles author avatar bar block body bottom box button buttons col column container content count cta div entry footer form global group header heading
    icon icons inner item items js left like link links list main message meta mobile news nojs outer page pages panel post posts primary reply right row section secondary site slot
    stories sub text thread title top ui unit user web wrap wrapper zone""".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that may be a content region.
REGIONS = frozenset("html body main article section div center".split())
CLOSED_BY = {"p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
INLINE_CLOSED = frozenset("b i em strong a span u s small big font code sub sup mark q cite abbr label".split())


def _no_content(name: str) -> bool:
    """Whether a class or id names something that is no content."""
    if name in NAMES:
        return True
    words = _WORD.findall(name)
    return any(w in NAMES for w in words) and all(w in NAMES or w in STRUCTURE or w.isdigit() or len(w) == 1 for w in words)


def _names(attrs: str) -> tuple[str, int]:
    """A short mark of an element's class or id, and whether its names or role say it is no content: 2 for a plain name of adverts or a role."""
    mark, out, seen = "", 0, set()
    if "=" in attrs:
        for m in _ATTRIBUTE.finditer(attrs):
            kind = m[1].lower()
            if kind not in ("class", "id", "role") or kind in seen:
                continue
            seen.add(kind)
            words = (m[2] or m[3] or m[4] or "").lower().split()
            if kind == "role":
                out = 2 if any(w in ROLES for w in words) else out
            else:
                out = 2 if words and all(w in ADVERTS for w in words) else max(out, int(any(map(_no_content, words))))
                if words and (kind == "class" or not mark):
                    mark = "." + words[0]
    return mark, out


def _tag_end(page: str, at: int, dead: set[str]) -> int:
    """Where the ``>`` of a tag stands whose attributes begin at ``at``; -1 if nowhere.  ``dead``: quotes that close no more."""
    while (m := _STOP.search(page, at)) is not None:
        if m[0] == ">":
            return m.start()
        at = m.end()
        while at < len(page) and page[at] in " \t\n\r\f":
            at += 1
        q = page[at : at + 1]
        if q in ('"', "'") and q not in dead:
            end = page.find(q, at + 1)
            if end < 0:
                dead.add(q)
            else:
                at = end + 1
    return -1


def _tokens(page: str) -> Iterator[tuple[str, bool, str, str]]:
    """(text before a tag, whether it is an end tag, its name, its attributes), and at last the text left, without a tag."""
    at, n, dead = 0, len(page), set()
    while (m := _TAG.search(page, at)) is not None:
        text, at = page[at : m.start()], m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if page.startswith("!--", m.start() + 1):
                end = page.find("-->", m.start() + 2)
                end = n if end < 0 else end + 3
            else:  # a section of character data is a comment here, as in browsers: it ends at the next ">"
                end = page.find(">", at) + 1 or n
            at = end
            yield text, False, "", ""
            continue
        attrs = m[3]
        if attrs is None:
            end = _tag_end(page, m.end(2), dead)
            if end < 0:
                yield text + page[m.start() :], False, "", ""
                return
            attrs, at = page[m.end(2) : end + 1], end + 1
        attrs = attrs[:-1]
        raw = tag in RAW and not m[1]
        yield text, bool(m[1]), "pre" if tag == "xmp" else tag, attrs
        if raw:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if tag == "xmp":  # shown as it stands
                yield entities.escape(page[at : end.start() if end else n]), True, "pre", ""
            at = end.end() if end else n
    yield page[at:], False, "", ""


def events(page: str) -> Iterator[tuple]:
    """("open", tag, mark, dropped), ("close", tag) and ("text", string) of a page, with implied ends written out."""
    stack: list[str] = []
    count: Counter[str] = Counter()

    def pop() -> tuple[str, str]:
        count[stack[-1]] -= 1
        return "close", stack.pop()

    for text, ends, tag, attrs in _tokens(page):
        if text:
            yield "text", text
        if not tag:
            continue
        if ends:
            if count[tag]:
                while (e := pop())[1] != tag:
                    yield e
                yield e
            continue
        if tag in RAW:
            continue
        if tag in BLOCK or tag == "option":
            # an inline element left open ends at the next block, and so does an open paragraph
            while stack and (stack[-1] in INLINE_CLOSED or tag in CLOSED_BY.get(stack[-1], ())):
                yield pop()
        mark, dropped = _names(attrs)
        yield "open", tag, mark, dropped
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            yield "close", tag
        else:
            stack.append(tag)
            count[tag] += 1
    while stack:
        yield pop()


def left_out(tag: str, named: int, in_article: bool, near: str) -> bool:
    """Whether an element is no content by itself (``near``: the block element around it)."""
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    if not named or tag in HEADINGS or tag in ("html", "body", "main", "article"):
        return False
    if tag in TEXTUAL:
        return named == 2 or not in_article
    return tag in BLOCK or not (in_article or near in TEXTUAL or near in HEADINGS)


#: Pairs of two lists of children that are weighed at once.
LISTS = 1 << 20


class Tree:
    """An ordered tree in order of opening: parent, label and own text of each node, as numbers; node 0 is the root."""

    __slots__ = ("parent", "label", "text", "kids", "size", "shape", "full")

    def __init__(self, parent: list[int], label: list[int], text: list[int]):
        n = len(parent)
        self.parent, self.label, self.text = parent, np.array(label, np.int64), np.array(text, np.int64)
        self.kids: list[list[int]] = [[] for _ in range(n)]
        self.size, self.shape, self.full = [1] * n, [0] * n, [0] * n
        for i in range(1, n):
            self.kids[parent[i]].append(i)
        for i in range(n - 1, -1, -1):  # subtrees are hashed from below: equal ones need no matching
            self.shape[i] = hash((label[i], *[self.shape[k] for k in self.kids[i]]))
            self.full[i] = hash((self.shape[i], text[i], *[self.full[k] for k in self.kids[i]]))
            if i:
                self.size[parent[i]] += self.size[i]

    def dumps(self) -> bytes:
        return np.array([self.parent, self.label, self.text], np.int64).tobytes()

    @classmethod
    def loads(cls, raw: bytes) -> Tree:
        return cls(*np.frombuffer(raw, np.int64).reshape(3, -1).tolist())


class Matching:
    """Simple tree matching of a page's tree ``b`` with its pivot's ``a``, an equal own text counting as one more match."""

    def __init__(self, a: Tree, b: Tree):
        self.a, self.b, self.known = a, b, {}

    def _open(self, x: int, y: int) -> bool:
        """Whether the weight of a pair has to be found from that of its children."""
        a, b = self.a, self.b
        return bool(a.kids[x]) and bool(b.kids[y]) and a.label[x] == b.label[y] and a.shape[x] != b.shape[y] and (x, y) not in self.known

    def _weights(self, xs: list[int], ys: list[int]) -> np.ndarray:
        """Weights of all pairs of the pivot's nodes ``xs`` and the page's ``ys``."""
        a, b, at, bt = self.a, self.b, np.array(xs), np.array(ys)
        w = np.equal.outer(a.label[at], b.label[bt]) * (1 + np.equal.outer(a.text[at], b.text[bt]))
        for i, x in enumerate(xs):
            if a.kids[x]:
                for j in np.flatnonzero(w[i]):
                    y = ys[j]
                    if a.shape[x] == b.shape[y]:
                        n = a.size[x]
                        w[i, j] = n + int((a.text[x : x + n] == b.text[y : y + n]).sum())
                    elif b.kids[y]:
                        w[i, j] += self.known[x, y]
        return w

    def _best(self, xs: list[int], ys: list[int]) -> np.ndarray:
        """Best weights of all beginnings of the two lists; steps go along the shorter one."""
        w = self._weights(xs, ys)
        best = np.zeros((len(xs) + 1, len(ys) + 1), np.int64)
        rows, w = (best, w) if len(xs) <= len(ys) else (best.T, w.T)
        for i in range(len(w)):
            np.maximum.accumulate(np.maximum(rows[i, 1:], rows[i, :-1] + w[i]), out=rows[i + 1, 1:])
        return best

    def _last(self, xs: list[int], ys: list[int]) -> np.ndarray:
        """The best weights of ``xs`` and all beginnings of ``ys``; few rows are held."""
        if len(xs) * len(ys) <= LISTS:
            return self._best(xs, ys)[-1]
        row, step = np.zeros(len(ys) + 1, np.int64), max(1, LISTS // len(ys))
        for at in range(0, len(xs), step):
            for w in self._weights(xs[at : at + step], ys):
                row = np.concatenate(([0], np.maximum.accumulate(np.maximum(row[1:], row[:-1] + w))))
        return row

    def _ends(self, x: int, y: int) -> tuple[list[int], list[int], list[tuple[int, int]]]:
        """The children of a pair without the equal subtrees at both ends, and the pairs of those."""
        a, b, xs, ys = self.a, self.b, self.a.kids[x], self.b.kids[y]
        lo, most = 0, min(len(xs), len(ys))
        while lo < most and a.full[xs[lo]] == b.full[ys[lo]]:
            lo += 1
        hi = 0
        while hi < most - lo and a.full[xs[-1 - hi]] == b.full[ys[-1 - hi]]:
            hi += 1
        pairs = list(zip(xs[:lo], ys[:lo], strict=True)) + list(zip(xs[len(xs) - hi :], ys[len(ys) - hi :], strict=True))
        return xs[lo : len(xs) - hi], ys[lo : len(ys) - hi], pairs

    def _weigh(self, x: int, y: int) -> None:
        """The weight of the best matching below a pair, and of all pairs below that it rests on; a stack, as trees are deep."""
        todo = [(x, y)]
        while todo:
            x, y = todo[-1]
            xs, ys, pairs = self._ends(x, y)
            deeper = [(c, d) for c in xs if self.a.kids[c] for d in ys if self._open(c, d)]
            if deeper:
                todo += deeper
                continue
            todo.pop()
            if (x, y) not in self.known:
                self.known[x, y] = sum(2 * self.a.size[c] for c, _ in pairs) + (int(self._last(xs, ys)[-1]) if xs and ys else 0)

    def partners(self) -> list[int]:
        """The pivot's node of each node of the page, -1 without one."""
        a, b = self.a, self.b
        to, todo = [-1] * len(b.parent), [(0, 0)]
        while todo:
            x, y = todo.pop()
            if a.shape[x] == b.shape[y]:
                to[y : y + b.size[y]] = range(x, x + a.size[x])
                continue
            to[y] = x
            xs, ys, pairs = self._ends(x, y)
            todo += pairs
            if len(xs) == len(ys) == 1:  # no other pair to weigh it against
                todo += [(c, d) for c, d in zip(xs, ys, strict=True) if a.label[c] == b.label[d]]
                continue
            for c in xs:
                for d in ys if a.kids[c] else ():
                    if self._open(c, d):
                        self._weigh(c, d)
            todo += self._traced(xs, ys)
        return to

    def _traced(self, xs: list[int], ys: list[int]) -> list[tuple[int, int]]:
        """The matched pairs of two lists; long ones are halved, so that few rows of weights are held."""
        if not xs or not ys:
            return []
        if len(xs) > 1 and len(xs) * len(ys) > LISTS:
            half = len(xs) // 2
            cut = int(np.argmax(self._last(xs[:half], ys) + self._last(xs[half:][::-1], ys[::-1])[::-1]))
            return self._traced(xs[:half], ys[:cut]) + self._traced(xs[half:], ys[cut:])
        rows, out, i, j = self._best(xs, ys), [], len(xs), len(ys)
        while i and j and rows[i, j]:
            if rows[i, j] == rows[i - 1, j]:
                i -= 1
            elif rows[i, j] == rows[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((xs[i], ys[j]))
        return out


class Page:
    """The text blocks of a page outside what is left out, and the elements that hold them.

    Block elements are numbered in order: ``parent``, ``step`` (element and its mark), ``depth`` and ``key`` (64 bits of the
    path, the same for equal siblings) of each.
    ``blocks`` are (place of the nearest block element, text) in order; ``named`` and ``containers`` are (place, first
    block, end block) of the block elements with a class or id, and of those that may be a region."""

    __slots__ = ("blocks", "named", "containers", "parent", "step", "depth", "key", "marks", "sums")

    def __init__(self, page: str):
        self.blocks: list[tuple[int, str]] = []
        self.named: list[tuple[int, int, int]] = []
        self.containers: list[tuple[int, int, int]] = []
        self.parent, self.step, self.depth, self.key = [0], [""], [0], [0]
        known: dict[tuple[int, str], int] = {}
        parts: list[str] = []
        # tag, place, left out, place and tag of the nearest block, first block, whether it has a mark
        stack: list[tuple[str, int, bool, int, str, int, bool]] = [("#", 0, False, 0, "", 0, False)]
        inside_article = 0
        forms: list[tuple[int, int, bool]] = []  # first block, end block, whether it is outside articles and holds prose
        open_forms: list[list] = []  # whether an article, a paragraph or a heading was met in each open form

        def end() -> None:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                self.blocks.append((stack[-1][3], text))

        for e in events(page):
            tag, place, dropped, near, near_tag, lo, marked = stack[-1]
            if e[0] == "text":
                if not dropped:
                    parts.append(e[1])
            elif e[0] == "open":
                inside_article += e[1] in ("article", "main")
                bad = dropped or left_out(e[1], e[3], inside_article > 0, near_tag)
                own = place
                if e[1] in BLOCK and not bad:
                    own, step = len(self.key), e[1] + e[2]
                    under = self.key[place], step
                    if under not in known:
                        known[under] = below(*under)
                    self.parent.append(place)
                    self.step.append(step)
                    self.depth.append(self.depth[place] + 1)
                    self.key.append(known[under])
                if not dropped:
                    if e[1] == "br":
                        parts.append(" ")
                    elif e[1] in BLOCK:
                        end()
                if open_forms and not bad:
                    for met in open_forms if e[1] in ("article", "main") else open_forms[-1:]:
                        met[0] = met[0] or e[1] in ("article", "main")
                    open_forms[-1][1] = open_forms[-1][1] or e[1] == "p" or e[1] in HEADINGS
                if e[1] == "form":
                    open_forms.append([False, False])
                block = e[1] in BLOCK
                stack.append((e[1], own, bad, own if block else near, e[1] if block else near_tag, len(self.blocks), bool(e[2])))
            elif len(stack) > 1:
                inside_article -= tag in ("article", "main")
                if tag in BLOCK:
                    end()
                if tag == "form":
                    article, prose = open_forms.pop()
                    if open_forms:
                        open_forms[-1][1] = open_forms[-1][1] or prose
                    if not dropped and not article:
                        forms.append((lo, len(self.blocks), prose and not inside_article))
                if not dropped and tag in BLOCK:
                    if marked:
                        self.named.append((place, lo, len(self.blocks)))
                    if tag in REGIONS:
                        self.containers.append((place, lo, len(self.blocks)))
                stack.pop()
        end()
        self._drop(forms)
        # sums over the blocks' marks, so that the mark of any run of blocks takes one step
        self.marks = [mark(t) % _PRIME for _, t in self.blocks]
        self.sums = [0]
        for m in self.marks:
            self.sums.append((self.sums[-1] * _BASE + m + 1) % _PRIME)

    def _drop(self, forms: list[tuple[int, int, bool]]) -> None:
        """Take out the blocks of forms, but for those with prose in them and most of the page's text."""
        sizes = [0, *accumulate(len(t) for _, t in self.blocks)]
        gone = self.covered((lo, hi) for lo, hi, prose in forms if hi > lo and not (prose and 2 * (sizes[hi] - sizes[lo]) > sizes[-1]))
        if any(gone):
            at = [0, *accumulate(not g for g in gone)]
            self.blocks = [b for b, g in zip(self.blocks, gone, strict=True) if not g]
            self.named, self.containers = ([(p, at[lo], at[hi]) for p, lo, hi in spans] for spans in (self.named, self.containers))

    def path(self, place: int) -> str:
        """A place as a string, each step ended by _END: an order that keeps common beginnings."""
        steps = []
        while place:
            steps.append(self.step[place] + _END)
            place = self.parent[place]
        return "".join(reversed(steps))

    def run(self, lo: int, hi: int) -> int:
        """A mark of the texts of blocks ``lo`` to ``hi``."""
        return (self.sums[hi] - self.sums[lo] * pow(_BASE, hi - lo, _PRIME)) % _PRIME

    def tree(self) -> Tree:
        """The tree of block elements, with a mark of each one's own texts."""
        texts = [0] * len(self.key)
        for (p, _), m in zip(self.blocks, self.marks, strict=True):
            texts[p] = (texts[p] * _BASE + m + 1) % _PRIME
        labels = {x: mark(x) for x in set(self.step)}
        return Tree(self.parent, [labels[x] for x in self.step], texts)

    def facts(self, to: list[int], pivot: Tree) -> set[tuple[int, int, int | None]]:
        """(place, element around it, text's mark) of the blocks and of the whole texts of the named elements that have a partner
        ``to[...]`` in the pivot, and (-1 - element, element, None) for each element of the pivot with children that the page has."""
        own = {(2 * to[p], pivot.parent[to[p]], m) for (p, _), m in zip(self.blocks, self.marks, strict=True) if to[p] >= 0}
        own |= {(2 * to[p] + 1, pivot.parent[to[p]], self.run(lo, hi)) for p, lo, hi in self.named if hi > lo and to[p] >= 0}
        return own | {(-1 - t, t, None) for t in to if t >= 0 and pivot.kids[t]}

    def covered(self, spans: Iterable[tuple[int, int]]) -> list[bool]:
        """Which blocks lie in any of the spans."""
        edge = [0] * (len(self.blocks) + 1)
        for lo, hi in spans:
            edge[lo] += 1
            edge[hi] -= 1
        return [n > 0 for n in accumulate(edge[:-1])]

    def template(self, repeated: frozenset, to: list[int], inside: list[tuple[int, int, int]] | None = None) -> list[tuple[int, int, int]]:
        """Named elements whose whole text is one that their layout repeats; only those below the elements ``inside``, where given."""
        if not repeated:
            return []
        found = [n for n in self.named if n[2] > n[1] and (2 * to[n[0]] + 1, self.run(n[1], n[2])) in repeated]
        if inside is None or not inside:
            return found
        within, depth = self.covered((lo, hi) for _, lo, hi in inside), self.depth[inside[0][0]]
        return [n for n in found if within[n[1]] and self.depth[n[0]] > depth]

    def plain(self, repeated: frozenset, to: list[int], *often: bool) -> list[bool]:
        """Which blocks' own texts are repeated; ``often``: on PLAIN_LEAST pages at least."""
        return [(2 * to[p], m, *often) in repeated for (p, _), m in zip(self.blocks, self.marks, strict=True)]

    def changing(self, repeated: frozenset, to: list[int]) -> str | None:
        """The path of the least element around all blocks whose text is not repeated, outside template; None without any."""
        out = self.covered((lo, hi) for _, lo, hi in self.template(repeated, to))
        near, under = None, set()
        for (p, _), same, o in zip(self.blocks, self.plain(repeated, to), out, strict=True):
            if o or same:
                continue
            if near is None:
                near = p
            climbed, at = [], p
            while at not in under and at != near:  # what is known to lie below ``near`` stays below it
                climbed.append(at)
                if self.depth[at] > self.depth[near]:
                    at = self.parent[at]
                elif self.depth[at] < self.depth[near]:
                    under.add(near)
                    near = self.parent[near]
                else:
                    under.add(near)
                    at, near = self.parent[at], self.parent[near]
            under.update(climbed)
            under.discard(near)
        return None if near is None else self.path(near)


def mark(text: str) -> int:
    """64 bits of a text, signed."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def below(key: int, step: str) -> int:
    """The key of a step below a place."""
    return mark(f"{key}>{step}")


def smallest(low: str, high: str) -> str:
    """The smallest region around all paths from ``low`` to ``high`` (forms of ``Page.path``), in the same form."""
    steps = os.path.commonprefix([low, high]).split(_END)[:-1]
    while steps and steps[-1].partition(".")[0] not in REGIONS:
        steps.pop()
    return "".join(s + _END for s in steps)


def key_of(path: str) -> int:
    """The key of a place, from its path."""
    key = 0
    for step in path.split(_END)[:-1]:
        key = below(key, step)
    return key


def induce(pages: list[str]) -> dict:
    """The wrapper of pages of one layout: pivot (a tree), region (a path; None without changing text), template (paths within
    it) and repeated (marks).  ``extract`` makes the same from counts over all pages."""
    parsed = [Page(p) for p in pages if p]
    pivot = Page(max(filter(None, pages), key=len)).tree() if parsed else None
    partners = [Matching(pivot, p.tree()).partners() for p in parsed]
    seen, same, whose = Counter(), Counter(), {}
    for page, to in zip(parsed, partners, strict=True):
        whole = page.run(0, len(page.blocks))
        for place, around, text in page.facts(to, pivot):
            if text is None:
                seen[around] += 1
            else:
                same[place, around, text] += 1
                whose.setdefault((place, around, text), set()).add(whole)
    kept = {f: n for f, n in same.items() if n >= LEAST and n >= CONSTANT * seen[f[1]] and len(whose[f]) > 1}
    repeated = frozenset({(f[0], f[2]) for f in kept} | {(f[0], f[2], True) for f, n in kept.items() if n >= PLAIN_LEAST})
    paths = [c for page, to in zip(parsed, partners, strict=True) if (c := page.changing(repeated, to)) is not None]
    region = smallest(min(paths), max(paths)) if paths else None
    template, key = set(), key_of(region) if paths else 0
    for page, to in zip(parsed, partners, strict=True) if paths else ():
        own = [c for c in page.containers if page.key[c[0]] == key]
        template |= {page.path(n[0]) for n in page.template(repeated, to, own)}
    return {"pivot": pivot, "region": region, "template": sorted(template), "repeated": repeated}


def main_text(page: str | None, wrapper: dict | None) -> str:
    """The main text of a page under the wrapper of its layout."""
    if not page:
        return ""
    p = Page(page)
    if wrapper and wrapper["region"] is not None:
        key, repeated = key_of(wrapper["region"]), wrapper["repeated"]
        to = Matching(wrapper["pivot"], p.tree()).partners() if repeated else [-1] * len(p.key)
        own = [c for c in p.containers if p.key[c[0]] == key]
        within = p.covered((lo, hi) for _, lo, hi in own) if wrapper["region"] else [True] * len(p.blocks)
        out = p.covered((lo, hi) for _, lo, hi in p.template(repeated, to, own))
        kept = [(len(t), same, t) for (_, t), same, w, o in zip(p.blocks, p.plain(repeated, to, True), within, out, strict=True) if w and not o]
        new, old = sum(n for n, same, _ in kept if not same), sum(n for n, same, _ in kept if same)
        texts = [t for _, same, t in kept if not same or old > PLAIN_SHARE * new]
        if texts:
            return "\n\n".join(texts)
    main = [(lo, hi) for place, lo, hi in p.containers if p.step[place].partition(".")[0] in ("article", "main")]
    within = p.covered(main) if main else [True] * len(p.blocks)
    return "\n\n".join(t for (_, t), w in zip(p.blocks, within, strict=True) if w)


def host_of(url):
    """The host of a url, in lower case; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


#: Bytes of pivots and marks that are broadcast; beyond, pages and pivots meet by a shuffle.
SMALL = 64 << 20
_CONTAINERS = r"(?i)<(?:html|body|main|article|section|div|center)\b[^>]*>"
#: Of these, those that are left out by name say nothing of a layout, and so do numbers in names.
_LEFT_OUT = rf"(?i)\b(?:class|id|role)\s*=[^>]*\b(?:{'|'.join(sorted(NAMES | ROLES))})\b"


def laid_out(pages: DataFrame) -> DataFrame:
    """page_id, url, html, host, layout (a hash of the set of containers that a page opens, but for those left out by name) and
    pick (longer pages first)."""
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    opened = F.filter(F.array_distinct(F.regexp_extract_all("html", F.lit(_CONTAINERS), F.lit(0))), lambda t: ~t.rlike(_LEFT_OUT))
    tags = F.array_sort(F.array_distinct(F.transform(opened, lambda t: F.regexp_replace(t, "[0-9]+", ""))))
    pick = F.least(F.char_length("html"), F.lit(1 << 22)).cast("long") * F.lit(1 << 40) + F.pmod(F.xxhash64("html"), F.lit(1 << 40))
    return rows.withColumns({"layout": F.xxhash64(F.array_join(tags, "")), "pick": F.when(F.col("html") != "", pick)})


def _sized(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= SMALL else df


class Wrappers:
    """What is known of the layouts of all hosts: pivots by (host, pivot), and which of them a page goes by."""

    def __init__(self, rows: DataFrame):
        held = rows.where("pick is not null")
        slim = durable(held.groupBy("host", "layout").agg(F.count(F.lit(1)).alias("n"), F.max("pick").alias("pivot")), "html-layouts")
        self.of_layout = slim.where(F.col("n") >= LEAST).select("host", "layout", "pivot")
        self.of_host = slim.groupBy("host").agg(F.sum("n").alias("n"), F.max("pivot").alias("pivot")).where(F.col("n") >= LEAST).select("host", "pivot")
        asked = durable(self.of_layout.select("host", "pivot").unionByName(self.of_host).distinct(), "html-asked").withColumnRenamed("pivot", "pick")
        found = held.join(_sized(asked, asked.count() * 64), ["host", "pick"], "left_semi")

        def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                made = [Page(h.as_py()).tree().dumps() for h in b.column("html")]
                yield pa.RecordBatch.from_pydict({"host": b.column("host"), "pivot": b.column("pick"), "tree": pa.array(made, pa.binary())})

        made = found.select("host", "pick", "html").mapInArrow(trees, "host string, pivot long, tree binary")
        self.known = durable(made.groupBy("host", "pivot").agg(F.min("tree").alias("tree")), "html-pivots")

    def add(self, facts: DataFrame, name: str) -> None:
        """More columns by (host, pivot)."""
        self.known = durable(self.known.join(facts, ["host", "pivot"], "left"), name)

    def beside(self, rows: DataFrame) -> DataFrame:
        """``rows`` with what is known of each page's layout, or else of its host."""
        more = [c for c in self.known.columns if c not in ("host", "pivot")]
        long = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in more), F.lit(64))
        size = self.known.agg(F.coalesce(F.sum(long), F.lit(0))).first()[0]
        packed = F.struct("pivot", *more)
        layouts = self.of_layout.join(self.known, ["host", "pivot"]).select("host", "layout", packed.alias("__l"))
        hosts = self.of_host.join(self.known, ["host", "pivot"]).select("host", packed.alias("__h"))
        joined = rows.join(_sized(layouts, size), ["host", "layout"], "left").join(_sized(hosts, size), "host", "left").withColumn("__k", F.coalesce("__l", "__h"))
        return joined.select("page_id", "url", "html", "host", *[F.col("__k")[c].alias(c) for c in ("pivot", *more)])


class _Trees:
    """Pivots met so far, by their bytes."""

    def __init__(self) -> None:
        self.held: dict[bytes, Tree] = {}

    def __call__(self, raw: bytes) -> Tree:
        if raw not in self.held:
            if len(self.held) > 1000:
                self.held.clear()
            self.held[raw] = Tree.loads(raw)
        return self.held[raw]


class _Known:
    """Repeated marks met so far, by their text."""

    def __init__(self):
        self.sets: dict[str | None, frozenset] = {}

    def __call__(self, text: str | None) -> frozenset:
        if text not in self.sets:
            if len(self.sets) > 10_000:
                self.sets.clear()
            rows = [tuple(map(int, x.split(":"))) for x in text.split(",")] if text else []
            self.sets[text] = frozenset(rows) | {r[:2] for r in rows}
        return self.sets[text]


def repeated_texts(rows: DataFrame) -> DataFrame:
    """host, pivot, repeated: the (place, text) marks that a layout repeats, counted over all its pages (host, html, pivot, tree).

    A text is repeated if it stands at its place on at least CONSTANT of the pages that have the element around it, and
    not only in copies of one page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree_of = _Trees()
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            for host, pivot, page, raw in zip(*(b.column(n).to_pylist() for n in ("host", "pivot", "html", "tree")), strict=True):
                parsed, tree = Page(page), tree_of(raw)
                whole = parsed.run(0, len(parsed.blocks))
                for fact in parsed.facts(Matching(tree, parsed.tree()).partners(), tree):
                    for c, v in zip(cols, (host, pivot, *fact, whole), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_pydict({"host": pa.array(cols[0], pa.string())} | {n: pa.array(c, pa.int64()) for n, c in zip(("pivot", "place", "around", "mark", "whole"), cols[1:], strict=True)})

    facts = rows.where("tree is not null and html <> ''").select("host", "pivot", "html", "tree").mapInArrow(run, "host string, pivot long, place long, around long, mark long, whole long")
    counts = facts.groupBy("host", "pivot", "place", "around", "mark").agg(F.count(F.lit(1)).alias("n"), F.min("whole").alias("low"), F.max("whole").alias("high"))
    often = durable(counts.where(F.col("n") >= LEAST), "html-often")
    seen = often.where("mark is null").select("host", "pivot", "around", F.col("n").alias("seen"))
    kept = often.where("mark is not null and low <> high").join(seen, ["host", "pivot", "around"]).where(F.col("n") >= F.lit(CONSTANT) * F.col("seen"))
    pair = F.concat_ws(":", F.col("place").cast("string"), F.col("mark").cast("string"), F.when(F.col("n") >= PLAIN_LEAST, "1"))
    # few texts a place of the pivot pass CONSTANT
    return kept.groupBy("host", "pivot").agg(F.array_join(F.sort_array(F.collect_list(pair)), ",").alias("repeated"))


def regions(rows: DataFrame) -> DataFrame:
    """host, pivot, low, high: the first and last of the paths around the changing text of the pages of a layout (host, html, pivot, tree, repeated).

    A layout that repeats nothing has none: all its text is changing, and its region is the whole page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tree_of = _Known(), _Trees()
        for b in batches:
            found = []
            for host, pivot, page, raw, r in zip(*(b.column(n).to_pylist() for n in ("host", "pivot", "html", "tree", "repeated")), strict=True):
                parsed = Page(page)
                path = parsed.changing(known(r), Matching(tree_of(raw), parsed.tree()).partners())
                if path is not None:
                    found.append((host, pivot, path, path))
            cols = list(zip(*found, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, c, t in zip(("host", "pivot", "low", "high"), cols, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)})

    asked = rows.where("tree is not null and html <> '' and repeated is not null").select("host", "pivot", "html", "tree", "repeated")
    return asked.mapInArrow(run, "host string, pivot long, low string, high string").groupBy("host", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    rows = laid_out(pages)
    wrappers = Wrappers(rows)
    wrappers.add(repeated_texts(wrappers.beside(rows)), "html-repeated")
    wrappers.add(regions(wrappers.beside(rows)), "html-regions")
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tree_of = _Known(), _Trees()
        for b in batches:
            texts = []
            for page, raw, r, low, high in zip(b.column("html"), *(b.column(n).to_pylist() for n in ("tree", "repeated", "low", "high")), strict=True):
                if r is None:
                    wrapper = {"pivot": None, "region": "", "repeated": frozenset()} if raw is not None else None
                else:
                    wrapper = {"pivot": tree_of(raw), "region": smallest(low, high), "repeated": known(r)} if low is not None else None
                texts.append(main_text(page.as_py(), wrapper))
            yield pa.RecordBatch.from_pydict(
                {"page_id": b.column("page_id"), "url": b.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
            )

    joined = wrappers.beside(rows).select("page_id", "url", "html", "tree", "repeated", "low", "high")
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
