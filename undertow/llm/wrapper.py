"""Main text of web pages by wrapper induction.

Pages of one host are DOM trees that are aligned by simple tree matching and merged to the host's
template tree. All pages are then aligned with their host's tree, and Spark counts what each text slot holds on
the host's different articles: slots that hold the same on most of them are the host's template, slots that vary are
content. A page's text is the content of its main container, less what its markup or the host's template tells to
be no part of the article.
"""

from __future__ import annotations

import html as entities
import json
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.llm.common import texts_in, written

#: Fixed values (HTML): elements without an end tag, elements that never hold article text, blocks, and what closes what.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template textarea title iframe svg select object canvas audio video".split()
NEVER = set(RAW) | set("head nav header footer aside form button menu dialog option label fieldset".split())
BLOCK = set("html body address article blockquote br center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr li main ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"},
}
CLOSES_P = BLOCK - {"br", "html", "body"} | {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset"}
ENDS = {t: frozenset(CLOSES.get(t, set()) | ({"p"} if t in CLOSES_P else set())) for t in CLOSES_P | CLOSES.keys()}  # what a start tag closes
SCOPE = set("html body table td th ul ol dl div section article main aside nav header footer form blockquote".split())
#: Words of class names and ids that mark other parts than the article, and words that may go with them.
#: Only a name all of whose words are of these, and one of the first kind, marks a part: "share-bar", not "share-prices".
PARTS = set(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside ad ads advert adverts advertisement advertising "
    "banner promo promotion sponsor sponsored cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe signup login "
    "search share sharing social related recommended recommendations comment comments commentlist reply replies disqus respond "
    "pagination pager widget toolbar hidden".split()
)
BESIDE = set("area bar block body bottom box button buttons center container content count form group icons inner item items left link links list main outer page panel posts right row section site slot text thread top unit wrap wrapper".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: A text slot is the host's template if at least this share of all its different articles, and so many, have it, and there
#: are at most this share of different texts among them; within a main container only if it never differs. (What counts as
#: a page's article is the text of its main containers, else of the whole page; copies of a page count once.) A host has
#: a template only if some slot of most articles holds mostly different texts: pages that vary nowhere are near copies.
LEAST_OUTSIDE, LEAST_WITHIN, LEAST_SHARE, MOST_VARIETY, CONTENT_VARIETY = 5, 8, 0.9, 0.5, 0.8
#: What a slot holds mostly is told from so many pages while trees grow. It only helps to align runs of like nodes.
SAMPLE = 128
#: A tree of more nodes than this, of at least SAMPLE pages, drops text slots that fewer of its pages than RARE have.
NODES, RARE = 4_000, 0.05
SHAPES_HELD = 200_000  # shapes of subtrees that a worker remembers
LAYOUTS_HELD = 200_000  # tags and texts of the layouts, nodes of the templates, and lengths of the alignments, that it remembers
HOSTS_HELD = 2000  # templates a task holds before it passes them on
SMALL_BYTES = 32 << 20  # of templates that may be broadcast; more are joined by a shuffle

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")\b(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>",
    re.S | re.I,
)
_END = re.compile(r"</[a-zA-Z]+\s*>\Z")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[a-z]+")
_DIGIT = re.compile(r"\d")


def _marks_part(names: str) -> bool:
    """Whether one of the class names or ids tells that an element is no part of the article."""
    for name in names.split():
        words = _WORD.findall(name)
        if not PARTS.isdisjoint(words) and all(w in PARTS or w in BESIDE for w in words):
            return True
    return False


class Node:
    """A node of a page. ``nth`` is a text's place among all texts of the page."""

    __slots__ = ("tag", "sig", "children", "text", "bad", "main", "nth")

    def __init__(self, tag: str, sig: str = "", bad: bool = False, main: bool = False, text: str | None = None, nth: int = -1) -> None:
        self.tag, self.sig, self.text, self.bad, self.main, self.nth, self.children = tag, sig or tag, text, bad, main, nth, []


def _kind(tag: str, attrs: str) -> tuple[str, bool, bool]:
    """An element's signature, whether it is no part of the article, and whether it is a main container."""
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower():
        return tag, tag in NEVER, tag in ("article", "main")
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
    names = f"{found.get('class', '')} {found.get('id', '')}".lower()
    bad = (
        tag in NEVER or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
        or found.get("role", "").lower() in ROLES or tag not in ("html", "body", "main") and _marks_part(names)
    )
    main = tag in ("article", "main") or found.get("role") == "main" or found.get("itemprop") == "articleBody"
    # Ids, and class names with digits, name one page or item and not its kind.
    kind = " ".join(c for c in found.get("class", "").lower().split() if not _DIGIT.search(c))
    return f"{tag}.{kind}" if kind else tag, bad, main


def _token(m: re.Match) -> str:
    """What a tag means for the tree: / and the name of an end tag, or a start tag's name, signature and flags in lines."""
    _, close, tag, attrs, close2, tag2, attrs2 = m.groups()
    if not tag:
        close, tag, attrs = close2, tag2, attrs2
    tag = tag.lower()
    if close:
        token = f"/{tag}"
    else:
        sig, bad, main = _kind(tag, attrs or "")
        token = f"{tag}\n{sig}\n{'b' * bad}{'m' * main}{'/' * (tag in VOID or (attrs or '').endswith('/'))}"
    if len(m[0]) < 200:
        if len(_tokens) >= 100_000:
            _tokens.clear()
        _tokens[m[0]] = token
    return token


_tokens: dict[str, str] = {}  # of tags that a worker has met


def tokens(page: str) -> tuple[list[str], list[str], list[int]]:
    """A token for each tag (see ``_token``) and each text (+, or nothing for a blank one) in page order; the texts without
    character references, and the digests of what they hold. Pages of equal tokens differ in their texts only."""
    out, spans, at, m = [], [], 0, None
    end = page.rfind(">") + 1  # no tag ends beyond
    for m in _TAG.finditer(page, 0, end):
        start = m.start()
        if at < start:
            spans.append((len(out), page[at:start]))
            out.append("+")
        at = m.end()
        if (m.lastindex or 0) > 1:  # neither a comment nor an element that never holds text
            out.append(_tokens.get(m[0]) or _token(m))
    unclosed = m is not None and m.end() == end and (m[0].startswith("<!--") and not m[0].endswith("-->") or m[1] and not _END.search(m[0]))
    if at < len(page) and not unclosed:
        spans.append((len(out), page[at:]))
        out.append("+")
    texts, digests = [], []
    for k, text in spans:
        if "&" in text:
            text = entities.unescape(text)
        own = " ".join(text.split())
        texts.append(text)
        digests.append(zlib.crc32(own.encode()))
        if not own:
            out[k] = ""
    return out, texts, digests


def tree(page: list[str]) -> Node:
    """The DOM tree of a page's tokens: elements and text nodes; end tags that HTML lets one leave out are put in."""
    root = Node("#root")
    stack, texts = [root], 0
    for token in page:
        if token in ("+", ""):
            stack[-1].children.append(Node("#text", text=token, nth=texts))
            texts += 1
            continue
        if token[0] == "/":
            tag = token[1:]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPE and tag not in SCOPE:
                    break
            continue
        tag, sig, flags = token.split("\n")
        if ends := ENDS.get(tag):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPE and stack[k].tag not in ends:
                    break
        node = Node(tag, sig, "b" in flags, "m" in flags)
        stack[-1].children.append(node)
        if "/" not in flags:
            stack.append(node)
    return root


def parse(page: str) -> Node:
    """The DOM tree with its texts."""
    found, texts, _ = tokens(page)
    todo = [root := tree(found)]
    while todo:
        x = todo.pop()
        todo += x.children
        if x.text is not None:
            x.text = texts[x.nth]
    return root


def pieces(root: Node, place: dict[int, int]) -> list[tuple[int, list[int]]]:
    """A page's text in pieces, each with a mark and its texts' places on the page (-1: a line's end). A mark is 1 for the
    main containers' text (the whole page's if there is none), 2 for the whole page's, 4 within a main container, and 8
    times the ``place`` of its text among the template's texts, from 1 on."""
    mains = {id(x) for x in main_nodes(root)}
    out: list[tuple[int, list[int]]] = []
    todo: list = [(root, 2 if mains else 3, 0)]  # no recursion: trees may be deep
    while todo:
        x, flags, within = todo.pop()
        if x is None:
            item, now = -1, flags
        elif x.text is not None:
            item, now = x.nth, flags
            if now & 3 and x.nth in place:
                now += 8 * place[x.nth] + 8 + within
        else:
            if x.bad and x is not root:
                flags = 0
                if x.tag not in ("html", "body", "form"):
                    continue
            gap = flags if x.tag in BLOCK else 0
            if id(x) in mains:
                flags |= 1
                gap |= 1
            if gap:
                todo.append((None, gap, 0))
            inside = 4 if within or x.main else 0
            if flags or mains:
                todo += [(c, flags, inside) for c in reversed(x.children)]
            item, now = -1, gap
        if now & 3:
            if not out or now != out[-1][0] or now >= 8:
                out.append((now, [item]))
            elif item >= 0 or out[-1][1][-1] >= 0:
                out[-1][1].append(item)
    return out


def clean(text: str) -> str:
    return " ".join((entities.unescape(text) if "&" in text else text).split())


class Layout:
    """What pages of equal tokens share. ``root`` is their tree as templates see it (numbered and placed), ``texts`` are the
    places on the page of the tree's texts, ``kept`` those of the texts in pieces, ``article`` the texts of the main
    containers by their places in ``kept``. ``code`` holds the tree and the pieces for ``Read``."""

    __slots__ = ("root", "texts", "kept", "article", "code")

    def __init__(self, found: list[str], shapes: Shapes) -> None:
        page = tree(found)
        self.root = as_template(page, 0)
        numbered(self.root, shapes)
        self.texts = sorted(x.first for x in _counted(self.root) if x is not self.root)
        own = pieces(page, {n: i for i, n in enumerate(self.texts)})
        self.kept = sorted({n for _, items in own for n in items if n >= 0})
        at = {n: i for i, n in enumerate(self.kept)} | {-1: -1}
        own = [(mark, [at[n] for n in items]) for mark, items in own]
        self.article = [i for mark, items in own if mark & 1 for i in items]
        placed(self.root)
        self.code = zlib.compress(json.dumps([flat(self.root, bare=True), own], separators=(",", ":")).encode(), 1)


class Read:
    """A layout's tree and pieces, and the slots of a template that its texts have."""

    __slots__ = ("root", "own", "plain", "met")

    def __init__(self, code: bytes, shapes: Shapes) -> None:
        nodes, self.own = json.loads(zlib.decompress(code))
        self.root = grown(nodes)
        numbered(self.root, shapes)
        placed(self.root)
        self.plain = [[i for mark, items in self.own if mark & flag for i in items] for flag in (1, 2)]
        self.met: dict[Slot, list[tuple[list[tuple[int, int, bool]], list[int]]]] = {}

    def slots(self, template: Slot, digests: tuple[int, ...], shapes: Shapes) -> list[int]:
        """``slots_of``, which rests on the texts by a few tests alone: pages that pass and fail the same have the same slots."""
        known = self.met.get(template, ())
        for tests, slots in known:
            if all([(digests[i] == value) is same for i, value, same in tests]):
                return slots
        tests: list[tuple[int, int, bool]] = []
        slots = slots_of(self.root, template, shapes, digests, tests)
        if len(known) < 32 and shapes.room(len(tests) + len(slots)):
            self.met.setdefault(template, []).append((tests, slots))
        return slots

    def text(self, texts: list[str], slots: list[int] | None = None, told: dict[int, int] | None = None) -> str:
        """The main containers' text without the slots in ``told`` (1: outside of main containers, 2: within them too), or
        the whole page's if that is empty."""
        texts, plain = [*texts, "\n"], self.plain
        if told:
            stays = [(mark, items) for mark, items in self.own if mark < 8 or told.get(slots[(mark >> 3) - 1], 0) <= (mark >> 2 & 1)]
            plain = [[i for mark, items in stays if mark & flag for i in items] for flag in (1, 2)]
        return " ".join("".join([texts[i] for i in plain[0]]).split()) or " ".join("".join([texts[i] for i in plain[1]]).split())


def main_nodes(root: Node) -> list[Node]:
    """Outermost main containers that stand in no other part."""
    found, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.main and not x.bad:
            inner = [c for c in _articles(x)] if x.tag != "article" else []
            found += inner or [x]
        elif not x.bad or x.tag in ("#root", "html", "body", "form"):
            todo += reversed([c for c in x.children if c.text is None])
    return found


def _articles(node: Node) -> list[Node]:
    out, todo = [], list(node.children)
    while todo:
        x = todo.pop(0)
        if x.tag == "article" and not x.bad:
            out.append(x)
        elif x.text is None and not x.bad:
            todo = x.children + todo
    return out


class Shapes:
    """Numbers for shapes of subtrees (a signature and the children's shapes), and how well two shapes match."""

    def __init__(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.shapes: list[tuple] = []
        self.sizes: list[int] = []
        self.weights: dict[tuple[int, int], int] = {}
        self.layouts: dict[tuple[str, ...], Layout] = {}
        self.reads: dict[bytes, Read] = {}
        self.middles: dict[tuple[tuple[int, ...], tuple[int, ...]], list[tuple[int, int]]] = {}
        self.templates: dict[str, Slot] = {}
        self.held = 0  # size of what these four hold

    def number(self, sig: str, children: tuple[int, ...]) -> int:
        key = (sig, children)
        if (n := self.numbers.get(key)) is None:
            n = self.numbers[key] = len(self.shapes)
            self.shapes.append(key)
            self.sizes.append(1 + sum(self.sizes[c] for c in children))
        return n

    def layout(self, found: list[str]) -> Layout:
        """The layout of a page's tokens; those of the pages before are remembered."""
        key = tuple(found)
        if (x := self.layouts.get(key)) is None:
            x = Layout(found, self)
            if self.room(len(found)):
                self.layouts[key] = x
        return x

    def read(self, code: bytes) -> Read:
        if (x := self.reads.get(code)) is None:
            x = Read(code, self)
            if self.room(self.sizes[x.root.shape]):
                self.reads[code] = x
        return x

    def template(self, text: str) -> Slot:
        """The tree of a template's JSON, numbered and placed."""
        if (x := self.templates.get(text)) is None:
            x = loaded(text)
            self.room(numbered(x, self))
            self.templates[text] = placed(x)
        return x

    def room(self, size: int) -> bool:
        if self.held + size > LAYOUTS_HELD:
            for kept in (self.layouts, self.reads, self.middles, self.templates):
                kept.clear()
            self.held = 0
        self.held += size
        return size <= LAYOUTS_HELD // 10

    def weight(self, a: int, b: int) -> int:
        """Nodes that simple tree matching pairs in two subtrees: none if the roots differ, else 1 and the best
        alignment of the children in order. No recursion: pairs of children are weighed before their parents."""
        if (w := self._known(a, b)) is not None:
            return w
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if self._known(x, y) is not None:
                todo.pop()
                continue
            kids_x, kids_y = self.shapes[x][1], self.shapes[y][1]
            i, n, m = self._middle(kids_x, kids_y)
            open_ = [(k, j) for k in set(kids_x[i:n]) for j in set(kids_y[i:m]) if self._known(k, j) is None]
            if open_:
                todo += open_
                continue
            self.weights[(x, y) if x < y else (y, x)] = 1 + sum(self._known(kids_x[k], kids_y[j]) for k, j in self.aligned(kids_x, kids_y))
            todo.pop()
        return self._known(a, b)

    def _known(self, a: int, b: int) -> int | None:
        if a == b:
            return self.sizes[a]
        (sig_a, kids_a), (sig_b, kids_b) = self.shapes[a], self.shapes[b]
        if sig_a != sig_b:
            return 0
        return self.weights.get((a, b) if a < b else (b, a)) if kids_a and kids_b else 1

    @staticmethod
    def _middle(a, b) -> tuple[int, int, int]:
        """What is left of two child lists without their equal ends: from i to n of the one, to m of the other."""
        i, n, m = 0, len(a), len(b)
        while i < n and i < m and a[i] == b[i]:
            i += 1
        while n > i and m > i and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
        return i, n, m

    def aligned(self, a: list[int], b: list[int]) -> list[tuple[int, int]]:
        """The alignment of two child lists with most weight. Equal ends are always part of a best one."""
        i, n, m = self._middle(a, b)
        pairs, tail = [(k, k) for k in range(i)], [(n + k, m + k) for k in range(len(a) - n)]
        if n > i and m > i:
            key = (tuple(a[i:n]), tuple(b[i:m]))
            if (middle := self.middles.get(key)) is None:
                middle = self._best(*key)
                if self.room(n - i + m - i):
                    self.middles[key] = middle
            pairs += [(i + x, i + y) for x, y in middle]
        return pairs + tail

    def _best(self, a: tuple[int, ...], b: tuple[int, ...]) -> list[tuple[int, int]]:
        at_a, at_b = ({x: k for k, x in enumerate(dict.fromkeys(s))} for s in (a, b))
        w = np.array([[self.weight(x, y) for y in at_b] for x in at_a])[[at_a[x] for x in a]][:, [at_b[y] for y in b]]
        best = np.zeros((len(a) + 1, len(b) + 1), np.int64)
        for x in range(len(a)):
            np.maximum.accumulate(np.maximum(best[x, 1:], best[x, :-1] + w[x]), out=best[x + 1, 1:])
        best = best.tolist()
        x, y, pairs = len(a), len(b), []
        while x and y:
            if best[x][y] == best[x - 1][y]:
                x -= 1
            elif best[x][y] == best[x][y - 1]:
                y -= 1
            else:
                x, y = x - 1, y - 1
                pairs.append((x, y))
        return pairs[::-1]


_shapes = Shapes()


def _fresh_shapes() -> Shapes:
    """The worker's shapes; begun anew when they are many. Trees numbered before must be numbered again."""
    global _shapes
    if len(_shapes.shapes) > SHAPES_HELD or len(_shapes.weights) > 4 * SHAPES_HELD:
        _shapes = Shapes()
    return _shapes


class Slot:
    """A node of a template. ``n`` is how many pages have the text slot (for the root: how many pages there are), ``sample``
    what it held on those of least digests. ``first`` is a text's place on its page; ``placed`` makes it the place of a node's
    first text among the tree's, and adds ``size``, the number of texts."""

    __slots__ = ("sig", "children", "sample", "shape", "n", "first", "size")

    def __init__(self, sig: str, children: list[Slot] | None = None, sample: dict[int, int] | None = None, n: int = 0, first: int = -1) -> None:
        self.sig, self.children, self.sample, self.n, self.first = sig, children or [], sample or {}, n, first


def numbered(root, shapes: Shapes) -> int:
    """Gives each node of a tree (of a page or a template) the number of its shape; the number of nodes."""
    todo = [(root, False)]
    while todo:
        x, done = todo.pop()
        if done:
            x.shape = shapes.number(x.sig, tuple(c.shape for c in x.children))
        else:
            todo.append((x, True))
            todo += [(c, False) for c in x.children]
    return shapes.sizes[root.shape]


def pruned(root: Slot) -> None:
    """Drops text slots that few of the pages have, and elements without any text slot left."""
    least, todo = RARE * root.n, [(root, False)]
    while todo:
        x, done = todo.pop()
        if done:
            x.children = [c for c in x.children if c.children or c.sig == "#text" and c.n >= least]
        else:
            todo.append((x, True))
            todo += [(c, False) for c in x.children if c.children]


def as_template(node: Node, article: int) -> Slot:
    """Of a page: elements and texts that aren't blank."""
    root = Slot(node.sig, sample={article: 0}, n=1)
    todo = [(node, root)]
    while todo:
        x, t = todo.pop()
        for c in x.children:
            if c.text is None:
                if c.tag not in RAW:
                    t.children.append(Slot(c.sig))
                    todo.append((c, t.children[-1]))
            elif text := clean(c.text):
                t.children.append(Slot("#text", sample={article: zlib.crc32(text.encode())}, n=1, first=c.nth))
    return root


def copied(node: Slot, article: int, digests: list[int]) -> Slot:
    """A layout's tree with a page's texts."""
    root = Slot(node.sig, sample={article: 0}, n=1)
    todo = [(node, root)]
    while todo:
        x, t = todo.pop()
        t.shape = x.shape
        for c in x.children:
            if c.sig == "#text":
                t.children.append(u := Slot(c.sig, sample={article: digests[c.first]}, n=1, first=c.first))
                u.shape = c.shape
            else:
                t.children.append(u := Slot(c.sig))
                todo.append((c, u))
    return root


def _only(x: Slot) -> list[int]:
    """The sample of a node's only text; empty if it has several."""
    while len(x.children) == 1:
        x = x.children[0]
    return list(x.sample.values()) if x.sig == "#text" else []


def _mostly(own: list[int]) -> int | None:
    """What at least half of a sample hold."""
    if len(own) < 2:
        return own[0] if own else None
    value, n = Counter(own).most_common(1)[0]
    return value if 2 * n >= len(own) else None


def _same(a: Slot, b: Slot) -> bool:
    """Whether the only texts of two nodes held mostly the same."""
    if (text := _mostly(_only(b))) is None:
        return False
    own = _only(a)
    n = 2 * own.count(text)
    return n > len(own) or n == len(own) > 0 and _mostly(own) == text


def aligned(mine: list[Slot], other: list[Slot], shapes: Shapes, same=_same) -> list[tuple[int, int]]:
    """``Shapes.aligned`` of two lists of nodes. Of runs of one shape the last ones meet while they hold the same text,
    and the rest from the front on: a foot line stays one slot, however many paragraphs stand before it."""
    n, m, k = len(mine), len(other), 0
    while k < min(n, m) and mine[n - k - 1].shape == other[m - k - 1].shape and same(mine[n - k - 1], other[m - k - 1]):
        k += 1
    return shapes.aligned([c.shape for c in mine[: n - k]], [c.shape for c in other[: m - k]]) + [(n - i, m - i) for i in range(k, 0, -1)]


def _least(a: dict[int, int], b: dict[int, int]) -> dict[int, int]:
    """The samples of two slots as one of at most SAMPLE pages."""
    if len(b) == 1 and len(a) >= SAMPLE and min(b) > max(a):
        return a
    both = {**a, **{k: min(v, a.get(k, v)) for k, v in b.items()}}
    return both if len(both) <= SAMPLE else {k: both[k] for k in sorted(both)[:SAMPLE]}


def _counted(u: Slot) -> list[Slot]:
    """The root and text slots of a page's tree."""
    met, todo = [], [u]
    while todo:
        x = todo.pop()
        if x.n:
            met.append(x)
        todo += x.children
    return met


def merge(t: Slot, u: Slot, shapes: Shapes, met: list[tuple[Slot, int]] | None = None) -> Slot:
    """Adds template ``u`` to ``t``; both are numbered, and so is the result. ``met`` gets the slots of ``u``'s texts there."""
    todo, grown = [(t, u)], False
    while todo:
        t0, u0 = todo.pop()
        if u0.sample:
            t0.sample = _least(t0.sample, u0.sample)
        t0.n += u0.n
        if met is not None and u0.n:
            met.append((t0, u0.first))
        mine, other = t0.children, u0.children
        pairs = aligned(mine, other, shapes)
        todo += [(mine[i], other[j]) for i, j in pairs if mine[i].children or other[j].children or other[j].n]
        if len(pairs) < len(other):
            taken, out, at, grown = {j: i for i, j in pairs}, [], 0, True
            for j, child in enumerate(other):
                if j in taken:
                    out += mine[at : taken[j] + 1]
                    at = taken[j] + 1
                else:
                    out.append(child)
                    if met is not None:
                        met += [(x, x.first) for x in _counted(child)]
            t0.children = out + mine[at:]
    if grown and numbered(t, shapes) > NODES and t.n >= SAMPLE:
        pruned(t)
        numbered(t, shapes)
    return t


def placed(root: Slot) -> Slot:
    """Gives each node of a numbered template its size and the place of its first text slot."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += x.children
    for x in reversed(order):
        x.size = 1 if x.sig == "#text" else sum(c.size for c in x.children)
    root.first = 0
    for x in order:
        at = x.first
        for c in x.children:
            c.first = at
            at += c.size
    return root


def slots_of(page: Slot, template: Slot, shapes: Shapes, digests: tuple[int, ...], tests: list[tuple[int, int, bool]]) -> list[int]:
    """The template's text slot of each of the page's texts in order; -1 for none. Both trees are numbered and placed.
    ``tests`` gets what was asked of the texts: which one, the digest, and whether it is that."""

    def same(x: Slot, t: Slot) -> bool:
        while len(x.children) == 1:
            x = x.children[0]
        if x.sig != "#text" or (value := _mostly(_only(t))) is None:
            return False
        tests.append((x.first, value, digests[x.first] == value))
        return tests[-1][2]

    slots, todo = [-1] * page.size, [(page, template)]
    while todo:
        x, t = todo.pop()
        if x.shape == t.shape:
            slots[x.first : x.first + x.size] = range(t.first, t.first + t.size)
        else:
            todo += [(x.children[i], t.children[j]) for i, j in aligned(x.children, t.children, shapes, same)]
    return slots


def settled(root: Slot) -> Slot:
    """The tree without samples but for what each text slot held mostly."""
    todo = [root]
    while todo:
        x = todo.pop()
        todo += x.children
        value = _mostly(list(x.sample.values())) if x.sig == "#text" else None
        x.sample = {} if value is None else {0: value}
    return root


def flat(root: Slot, bare: bool = False) -> list[list]:
    """A tree in document order: deep trees nest nothing. A bare one has neither counts nor samples."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        out.append([x.sig, len(x.children)] if bare else [x.sig, len(x.children), x.n, *(n for kv in sorted(x.sample.items()) for n in kv)])
        todo += reversed(x.children)
    return out


def grown(nodes: list[list]) -> Slot:
    top = Slot("")
    open_ = [[top, 1]]
    for sig, children, *more in nodes:
        while not open_[-1][1]:
            open_.pop()
        open_[-1][1] -= 1
        slot = Slot(sig, None, dict(zip(more[1::2], more[2::2], strict=True)), more[0] if more else 0)
        open_[-1][0].children.append(slot)
        open_.append([slot, children])
    return top.children[0]


def dumped(root: Slot) -> str:
    return json.dumps(flat(root), separators=(",", ":"))


def loaded(text: str) -> Slot:
    return grown(json.loads(text))


def host_of(url: str | None) -> str:
    return (url or "").partition("://")[2].partition("/")[0].lower()


#: Columns of what ``read_pages`` writes: of a page, and of a tree.
_PAGE = {"_host": pa.string(), "_article": pa.int64(), "_texts": pa.list_(pa.string()), "_layout": pa.binary(), "_digests": pa.binary()}
_TREE = {"_tree": pa.string(), "_salt": pa.int32(), "_part": pa.int64(), "_nth": pa.int64(), "_n": pa.int64()}
_TYPES = "_host string, _article long, _texts array<string>, _layout binary, _digests binary, _tree string, _salt int, _part long, _nth long, _n long"


class Trees:
    """The trees of the hosts whose pages a task has met. Pages are merged in the order the task reads them. Once a tree holds
    a page's shape, more pages of that shape only add their texts and counts to the slots that the first one has; once the
    sample is full, their counts."""

    def __init__(self, shapes: Shapes) -> None:
        self.shapes = shapes
        self.held: dict[str, Slot] = {}
        self.known: dict[str, dict[int, list]] = {}  # by host and shape: pages that were only counted, and their slots
        self.worst: dict[str, int] = {}  # the largest digest of a full sample

    def count(self, host: str) -> None:
        for n, slots in self.known.pop(host, {}).values():
            for x, _ in slots if n else ():
                x.n += n

    def add(self, host: str, layout: Layout, key: int, digests: list[int]) -> None:
        shapes, shape, t = self.shapes, layout.root.shape, self.held.get(host)
        seen = self.known.setdefault(host, {})
        if (met := seen.get(shape)) is not None:
            if key > self.worst.get(host, key):
                met[0] += 1
                return
            for x, at in met[1]:
                x.n += 1
                own = digests[at] if at >= 0 else 0
                if len(x.sample) < SAMPLE:
                    x.sample[key] = min(own, x.sample.get(key, own))
                else:
                    x.sample = _least(x.sample, {key: own})
        else:
            u = copied(layout.root, key, digests)
            if t is not None and shapes.sizes[t.shape] + shapes.sizes[shape] > NODES:
                self.count(host)  # the tree may be pruned
                self.held[host] = t = merge(t, u, shapes)
            else:
                seen[shape] = [0, own := []]
                if t is None:
                    self.held[host] = t = u
                    own += [(x, x.first) for x in _counted(u)]
                else:
                    self.held[host] = t = merge(t, u, shapes, own)
        t = self.held[host]
        if len(t.sample) >= SAMPLE:
            self.worst[host] = max(t.sample)

    def out(self) -> tuple[list[str], list[str], list[int]]:
        """Hosts, trees and numbers of pages."""
        for host in self.held:
            self.count(host)
        return list(self.held), [dumped(t) for t in self.held.values()], [t.n for t in self.held.values()]


def read_pages(pages: DataFrame, keep: list[str], *, url: str, html: str, texts: bool = True, trees: bool = True) -> DataFrame:
    """A table of the pages, each read once (``keep``, ``_host``, its texts, their digests, its layout and its article's
    digest), and of each task's tree of every host, in rows of their own (``_tree`` is not null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, part, nth = _fresh_shapes(), TaskContext.get().partitionId(), 0
        grow = Trees(shapes)

        def made(n: int, own: dict[str, list], kept: dict[str, pa.Array]) -> pa.RecordBatch:
            columns = [kept[k] if kept else pa.nulls(n, kinds[k]) for k in keep]
            columns += [pa.array(own[k], kind) if k in own else pa.nulls(n, kind) for k, kind in (_PAGE | _TREE).items()]
            return pa.RecordBatch.from_arrays(columns, names=[*keep, *_PAGE, *_TREE])

        def out() -> pa.RecordBatch:
            hosts, grown_trees, n = grow.out()
            k = len(hosts)
            return made(k, {"_host": hosts, "_tree": grown_trees, "_salt": [part % 64] * k, "_part": [part] * k, "_nth": [nth] * k, "_n": n}, {})

        kinds = {}
        for batch in texts_in(batches, 128):
            kinds = kinds or {k: batch.column(k).type for k in keep}
            if len(grow.held) > HOSTS_HELD or len(shapes.shapes) > SHAPES_HELD:
                yield out()
                shapes, nth = _fresh_shapes(), nth + 1
                grow = Trees(shapes)
            rows: list[tuple] = []
            for u, h in zip(batch.column(url).to_pylist(), batch.column(html).to_pylist(), strict=True):
                host = host_of(u)
                if not h:
                    rows.append((host, None, None, None, None))
                    continue
                found, own, digests = tokens(h)
                layout = shapes.layout(found)
                digests = [digests[i] for i in layout.texts]
                if trees:
                    grow.add(host, layout, zlib.crc32(h.encode()), digests)
                if texts:
                    own = [own[i] for i in layout.kept]
                    line = [*own, "\n"]
                    article = zlib.crc32(" ".join("".join([line[i] for i in layout.article]).split()).encode())
                    rows.append((host, article, own, layout.code, struct.pack(f"<{len(digests)}I", *digests)))
            if texts:
                yield made(batch.num_rows, dict(zip(_PAGE, map(list, zip(*rows, strict=True)), strict=True)), {k: batch.column(k) for k in keep})
        if grow.held:
            yield out()

    kept = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep]
    return written(pages.select(*dict.fromkeys([*keep, url, html])).mapInArrow(run, ", ".join([*kept, _TYPES])), "wrapper-pages")


def merged(rows: DataFrame) -> DataFrame:
    """``host, template`` (JSON) from the trees in a table of ``read_pages``.

    A host's trees are merged in the order of tasks, first those of tasks with an equal number modulo 64, then the results;
    so a task that is run again gives the same. What single pages have of their own is dropped as a tree grows (see NODES).
    """

    def fold(last: bool):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            shapes, t = _fresh_shapes(), None
            for text in rows.sort_values(["part", "nth"])["template"]:
                u = loaded(text)
                numbered(u, shapes)
                t = u if t is None else merge(t, u, shapes)
            return rows.iloc[:1].assign(n=t.n, template=dumped(settled(t) if last else t))

        return run

    schema = "host string, salt int, part long, nth long, n long, template string"
    parts = rows.where("_tree is not null").selectExpr("_host as host", "_salt as salt", "_part as part", "_nth as nth", "_n as n", "_tree as template")
    some = parts.groupBy("host", "salt").applyInPandas(fold(False), schema)
    whole = some.groupBy("host").applyInPandas(fold(True), schema)
    return written(whole.where(F.col("n") >= LEAST_OUTSIDE).select("host", "template"), "wrapper-templates")


def induce(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """``host, template`` (JSON) of the hosts that have enough pages for a slot to be told."""
    return merged(read_pages(pages, [], url=url, html=html, texts=False))


def told_slots(aligned_pages: DataFrame) -> DataFrame:
    """``_host, _told``: the text slots (numbers from 0 on) that are a host's template, each with 1 (outside of main
    containers) or 2 (within them too).

    ``aligned_pages`` has _host, _article (digest), and _slots with what they hold in _digests. All articles count, each once:
    of copies the row of least arrays. Slot -1 stands for the article itself.
    """
    once = aligned_pages.groupBy("_host", "_article").agg(F.min(F.struct("_slots", "_digests")).alias("x"))
    own = once.select("_host", F.explode(F.arrays_zip("x._slots", "x._digests")).alias("x")).select("_host", F.col("x._slots").alias("slot"), F.col("x._digests").alias("digest"))
    kinds = own.groupBy("_host", "slot", "digest").agg(F.count("*").alias("n")).groupBy("_host", "slot").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    whole = kinds.groupBy("_host").agg(F.max(F.when(F.col("slot") < 0, F.col("n"))).alias("pages"), F.collect_list(F.when(F.col("slot") >= 0, F.struct("slot", "n", "kinds"))).alias("all"))
    least = lambda share: F.greatest(F.lit(float(LEAST_OUTSIDE)), share * F.col("pages"))
    varies = F.exists("all", lambda x: (x["n"] >= least(0.5)) & (x["kinds"] >= CONTENT_VARIETY * x["n"]))
    told = F.filter("all", lambda x: (x["n"] >= least(LEAST_SHARE)) & (x["kinds"] <= MOST_VARIETY * x["n"]))
    how = lambda x: F.when((x["kinds"] == 1) & (x["n"] >= LEAST_WITHIN), 2).otherwise(1)
    return whole.where(varies & (F.size(told) > 0)).select("_host", F.transform(told, lambda x: F.struct(x["slot"].alias("slot"), how(x).alias("how"))).alias("_told"))


def _looked_up(rows: DataFrame, table: DataFrame, size: str, how: str = "left") -> DataFrame:
    """``rows`` with the columns that ``table`` has for their host; the table is broadcast if its ``size`` is small."""
    small = (table.agg(F.sum(F.expr(size))).first()[0] or 0) <= SMALL_BYTES
    return rows.join(F.broadcast(table) if small else table, "_host", how)


def _aligned_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slots of pages, by their layouts and digests: what ``told_slots`` counts."""
    for batch in texts_in(batches, 512):
        shapes = _fresh_shapes()
        slots, held = [], []
        for t, code, raw in zip(*(batch.column(c).to_pylist() for c in ("_template", "_layout", "_digests")), strict=True):
            digests = struct.unpack(f"<{len(raw) // 4}I", raw)
            own = shapes.read(code).slots(shapes.template(t), digests, shapes)
            met = [(s, d) for s, d in zip(own, digests, strict=True) if s >= 0]
            slots.append([*(s for s, _ in met), -1])
            held.append([*(d for _, d in met), 0])
        made = [pa.array(slots, pa.list_(pa.int32())), pa.array(held, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column("_host"), batch.column("_article"), *made], names=["_host", "_article", "_slots", "_digests"])


def extract(pages: DataFrame, templates: DataFrame | None = None, *, url: str = "url", html: str = "html", columns: list[str] | None = None) -> DataFrame:
    """``pages`` plus ``text`` and ``n_chars`` (code points).

    The text is that of the main containers (article, main) in page order; of the whole page, if it has none.
    White space within it becomes single spaces. Null or empty html gives an empty text; an empty table gives no
    rows; pages without a host share a template, and pages of hosts with few articles are told by their markup
    alone. Repeated rows come back as often as they came; columns named as the new ones are replaced.

    Each page is read once, into its texts and its layout; its slots in the host's template follow from these. What the
    slots hold is counted over all pages, and the texts are put together without those that are told.
    """
    keep = [c for c in (columns or pages.columns) if c not in ("text", "n_chars")]
    rows = read_pages(pages, keep, url=url, html=html, trees=templates is None)
    templates = (merged(rows) if templates is None else templates).select(F.col("host").alias("_host"), F.col("template").alias("_template"))
    whole = rows.where("_tree is null")
    found = _looked_up(whole.where("_layout is not null").select("_host", "_article", "_layout", "_digests"), templates, "octet_length(_template)", "inner")
    slots = found.mapInArrow(_aligned_pages, "_host string, _article long, _slots array<int>, _digests array<long>")
    told = written(told_slots(slots).join(templates, "_host"), "wrapper-told")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts_in(batches, 128):
            shapes, texts = _fresh_shapes(), []
            for own, code, raw, told, t in zip(*(batch.column(c).to_pylist() for c in ("_texts", "_layout", "_digests", "_told", "_template")), strict=True):
                if code is None:
                    texts.append("")
                    continue
                page, slots = shapes.read(code), None
                if told:
                    slots = page.slots(shapes.template(t), struct.unpack(f"<{len(raw) // 4}I", raw), shapes)
                texts.append(page.text(own, slots, {s["slot"]: s["how"] for s in told or ()}))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*keep, "text", "n_chars"],
            )

    kept = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep]
    last = _looked_up(whole.select(*keep, "_host", "_texts", "_layout", "_digests"), told, "8 * size(_told) + octet_length(_template)")
    return last.select(*keep, "_texts", "_layout", "_digests", "_told", "_template").mapInArrow(put, ", ".join([*kept, "text string, n_chars long"]))
