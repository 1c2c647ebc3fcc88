"""Main text of web pages by union-free regular-expression inference over pages of one host.

A page is a tree of elements; neighbours of one kind are folded into a repeated group. What is left of a page without its
texts is its shape. All pages of a host are aligned into its wrapper, first those of one shape (in any order, as nothing but texts
differs), then the shapes, groupwise and the most frequent ones first: elements that some pages lack become optional, text that
differs becomes a slot, text that does not stays a constant of the template. The wrapper says where the article is
(its article or main elements, or else the innermost container of most of the slot text outside links) and what in it is the
template's. All of a page is learned, but for what lies in elements that are left out by their own names. Every page is then aligned
to the wrapper of its host, and all that falls into the article is its text, constants (such as a heading that all pages share) and elements that
the wrapper lacks too. Only blocks of constants before its first heading or slot and after its last are the template's: all of them in a
container that no element calls an article, as it may hold more than that; in article and main elements those whose whole text is
links, which are menus. A page that does not meet the wrapper's article, or has article elements beside it, is read with a wrapper of its own.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

MAX_DEPTH = 128  # elements that are nested deeper count as kids of the last one
BROADCAST_CHARS = 20_000_000  # of all wrappers
SALTS = 16
HELD_CHARS = 4_000_000  # of pages whose wrappers a task holds before it gives them on
MERGED = 64  # wrappers of a host, about, that are merged at a time
RARE = 500  # optional parts on fewer than one in so many of a host's differing pages leave its wrapper
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*>?)|[^<]+|<", re.DOTALL
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
# HTML's void, raw-text, block and paragraph-closing elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg"}
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SKIPPED_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "input", "label", "head", "canvas", "audio", "video"} | RAW
SKIPPED_NAMES = set(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads advert adverts advertisement banner promo promotion sponsor sponsored "
    "cookie cookies consent notice notices alert comment comments disqus reply replies share sharing social breadcrumb breadcrumbs related "
    "newsletter subscribe subscription popup modal overlay login signup search form widget".split()
)
# Words that only say what kind of box a class names.
BOX_NAMES = set("area bar block bottom box button buttons container content global inner item items left links list main mobile outer primary right row secondary section site slot sticky text thread title top unit widget wrap wrapper".split())
# Where an article may be; of these the innermost that holds most text is taken.
CONTAINERS = {"page", "html", "body", "main", "article", "section", "div", "center", "table", "tbody", "tr", "td", "form"}
LEAST_SHARE = 0.8  # of the slot text, that the article holds
LEAST_PAGES = 3  # that differ, before equal texts count as the template's
MOST_CONSTANT = 0.3  # of an article's text, that may be the template's
ARTICLES = ("main", "article")  # by number, from 1, the later one counts
NAMED, INFERRED = 1, 2  # the article's nodes, by an element's name or by where the text is
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
TURNS = 16  # of alignment by keys that occur once
SKIPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}


class Element:
    """An element or (tag "") a text."""

    __slots__ = ("tag", "names", "role", "kids", "text", "key")

    def __init__(self, tag: str, attributes: str = "", text: str = ""):
        self.tag, self.text, self.kids = tag, text, []
        found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(attributes)} if "=" in attributes else {}
        self.names = frozenset(f"{found.get('class', '')} {found.get('id', '')}".split())
        self.role = found.get("role", "")
        # Articles are what they are by any name.
        self.key = "#" if not tag else tag if tag in ARTICLES and not self.skipped else ".".join([tag, *sorted(self.names)])

    @property
    def skipped(self) -> bool:
        """True for what its element, role or (of containers) one whole name says is no article text."""
        if self.tag in SKIPPED_TAGS or self.role in SKIPPED_ROLES:
            return True
        return bool(self.names) and (self.tag in CONTAINERS or self.tag in ("ul", "ol", "span", "a")) and any(map(_names_a_box, self.names))


@lru_cache(maxsize=100_000)
def _names_a_box(name: str) -> bool:
    """True if a name is made of words for what is skipped, and for boxes."""
    words = [w for w in re.split(r"[-_]+", name) if w]
    return any(w in SKIPPED_NAMES for w in words) and all(w in SKIPPED_NAMES or w in BOX_NAMES or w.isdigit() for w in words)


def parse(page: str | None) -> Element:
    """The tree of a page; unclosed and misplaced tags are tolerated, in linear time."""
    root = Element("page")
    stack = [root]
    page = page or ""
    at = 0
    opened: Counter = Counter()

    def close(depth: int) -> None:
        for x in stack[depth:]:
            opened[x.tag] -= 1
        del stack[depth:]

    while at < len(page):
        found = TOKEN.match(page, at)
        at = found.end()
        token, tag = found[0], (found[2] or "").lower()
        if not tag:
            if token.startswith("<![CDATA["):
                token = token[9:].removesuffix("]]>")
            elif token.startswith("<") and len(token) > 1:
                continue
            stack[-1].kids.append(Element("", text=token))
        elif found[1]:
            if opened[tag] > 0:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
        else:
            if tag in BLOCKS and opened["p"] > 0:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p"))
            if tag in CLOSED_BY and stack[-1].tag in CLOSED_BY[tag]:
                close(len(stack) - 1)
            element = Element(tag, found[3] or "")
            stack[-1].kids.append(element)
            if tag in RAW:
                end = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|\\Z)[^>]*>?", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
            elif tag not in VOID and not (found[3] or "").rstrip("> \t\r\n").endswith("/") and len(stack) < MAX_DEPTH:
                stack.append(element)
                opened[tag] += 1
    return root


def squeeze(text: str) -> str:
    return " ".join(html.unescape(text).split())


# A wrapper node: [key, optional, repeated, kids, text, mass, article, pages]; text is None for a slot, and of a repeated group says by
# a hash what all its elements hold, None if that differs; mass is the number of
# characters of the slot text outside links below it; article is NAMED or INFERRED for (one of) the article's elements, but of
# a root the number of ARTICLES until these are marked; pages is how many that differ have it, LEAST_PAGES of a shape at most.


def _runs(element: Element) -> list[list[Element]]:
    """Kids without white space; neighbours of one kind together."""
    runs: list[list[Element]] = []
    for kid in element.kids:
        if not kid.tag and not kid.text.strip():
            continue
        if runs and kid.tag and runs[-1][0].key == kid.key:
            runs[-1].append(kid)
        else:
            runs.append([kid])
    return runs


def articles(tree: Element) -> tuple[int, list[Element]]:
    """The number of ARTICLES that a page has, 0 for none, and its outermost elements of this kind, in page order."""
    found: dict[str, list[Element]] = {}
    todo = [(tree, True, True)]
    while todo:
        x, *open_ = todo.pop()
        for i, tag in enumerate(ARTICLES):
            if open_[i] and x.tag == tag:
                found.setdefault(tag, []).append(x)
                open_[i] = False
        if open_[-1]:
            todo += [(kid, *open_) for kid in reversed(x.kids) if kid.tag and not kid.skipped]
    number = max((i + 1 for i, tag in enumerate(ARTICLES) if tag in found), default=0)
    return number, found[ARTICLES[number - 1]] if number else []


def wrap(element: Element) -> list:
    """The wrapper of one tree: neighbours with one key are folded into a repeated group; elements that are left out are taken without
    what they hold."""
    if not element.tag:
        text = squeeze(element.text)
        return ["#", False, False, [], text, len(text), 0, 1]
    skipped = element.skipped
    kids = [] if skipped else [_fold(run) for run in _runs(element)]
    mass = 0 if element.tag == "a" or skipped else sum(kid[5] for kid in kids)
    return [element.key, False, False, kids, "", mass, 0, 1]


def _fold(run: list[Element]) -> list:
    """The wrapper of neighbours of one kind."""
    node, *others = parts = [wrap(x) for x in run]
    texts = [text for x in parts for text in _constants(x)] if others else []
    for more in others:
        node = align(node, more)
        node[2], node[4] = True, f"={_hash(chr(0).join(texts)) if texts else ''}"
    return node


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of pairs, ordered by their first places, whose second places rise too."""
    ends: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for n, (_, k) in enumerate(pairs):
        at = bisect_left(ends, k)
        before.append(last[at - 1] if at else -1)
        ends[at:at + 1], last[at:at + 1] = [k], [n]
    found, n = [], last[-1] if last else -1
    while n >= 0:
        found.append(pairs[n])
        n = before[n]
    return found[::-1]


def _matched(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of equal keys, in the order of both, in near-linear time.

    Equal ends are matched first, then keys that both have once, and so on between these; where there are none, the first
    of a key is matched to the first, the second to the second, as far as their order allows.
    """
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b), 0)]
    while todo:
        i, i_end, k, k_end, turn = todo.pop()
        while i < i_end and k < k_end and a[i] == b[k]:
            found.append((i, k))
            i, k = i + 1, k + 1
        while i < i_end and k < k_end and a[i_end - 1] == b[k_end - 1]:
            i_end, k_end = i_end - 1, k_end - 1
            found.append((i_end, k_end))
        if i == i_end or k == k_end:
            continue
        ours, theirs = Counter(a[i:i_end]), Counter(b[k:k_end])
        once = {x for x in ours if ours[x] == 1 == theirs[x]} if turn < TURNS else set()
        if once:
            there = {b[n]: n for n in range(k, k_end) if b[n] in once}
            for x, y in [*_rising([(n, there[a[n]]) for n in range(i, i_end) if a[n] in once]), (i_end, k_end)]:
                todo.append((i, x, k, y, turn + 1))
                if x < i_end:
                    found.append((x, y))
                i, k = x + 1, y + 1
        else:
            places: dict[str, list[int]] = {}
            for n in range(k, k_end):
                places.setdefault(b[n], []).append(n)
            seen: Counter = Counter()
            pairs = []
            for n in range(i, i_end):
                if seen[a[n]] < len(places.get(a[n], ())):
                    pairs.append((n, places[a[n]][seen[a[n]]]))
                seen[a[n]] += 1
            found += _rising(pairs)
    return sorted(found)


def align(a: list, b: list) -> list:
    """The least general wrapper of both: mismatches become slots, optional or repeated groups."""
    if a[0] == "#":
        return ["#", a[1] or b[1], a[2] or b[2], [], a[4] if a[4] == b[4] else None, a[5] + b[5], 0, a[7] + b[7]]
    kids: list[list] = []
    i = k = 0
    for x, y in [*_matched([n[0] for n in a[3]], [n[0] for n in b[3]]), (len(a[3]), len(b[3]))]:
        kids += [[n[0], True, *n[2:]] for n in a[3][i:x] + b[3][k:y]]
        if x < len(a[3]):
            kids.append(align(a[3][x], b[3][y]))
        i, k = x + 1, y + 1
    folded: list[list] = []
    for kid in kids:
        if folded and folded[-1][0] == kid[0] and kid[0] != "#":
            folded[-1] = align(folded[-1], kid)
            folded[-1][2], folded[-1][4] = True, None
        else:
            folded.append(kid)
    return [a[0], a[1] or b[1], a[2] or b[2], folded, a[4] if a[4] == b[4] else None, a[5] + b[5], max(a[6], b[6]), a[7] + b[7]]


def expression(node: list) -> str:
    """The wrapper as a union-free regular expression."""
    inner = "".join(map(expression, node[3]))
    body = ("#TEXT" if node[4] is None else node[4]) if node[0] == "#" else f"<{node[0]}>{inner}</>"
    return f"({body})" + ("+" if node[2] else "") + ("?" if node[1] else "") if node[1] or node[2] else body


def _skipped_key(key: str) -> bool:
    tag, *names = key.split(".")
    return Element(tag, f'class="{" ".join(names)}"').skipped


def mark_article(wrapper: list) -> None:
    """Marks the article's nodes: the outermost article (or main) elements, if any page has one, or else the innermost container of most text."""

    def outermost(node: list, tag: str) -> list[list]:
        if node[0] == tag:
            return [node]
        return [] if _skipped_key(node[0]) else [found for kid in node[3] for found in outermost(kid, tag)]

    number, wrapper[6] = wrapper[6], 0
    if number:
        for node in outermost(wrapper, ARTICLES[number - 1]):
            node[6] = NAMED
        return
    node = wrapper
    while True:
        inner = [k for k in node[3] if k[5] >= LEAST_SHARE * wrapper[5] and k[5] and k[0].split(".")[0] in CONTAINERS and not _skipped_key(k[0])]
        if not inner:
            break
        node = inner[0]
    node[6] = INFERRED


def drop_constants(node: list) -> None:
    """Makes slots of the constants of an article, if they are too much of its text to be the template's."""

    def mass(x: list) -> tuple[int, int]:
        if x[0] == "#":
            return (0 if x[4] is None else x[5]), x[5]
        both = [mass(kid) for kid in x[3]]
        whole = sum(b[1] for b in both)
        return (whole if x[2] and x[4] is not None else sum(b[0] for b in both)), whole

    def free(x: list) -> None:
        if x[0] == "#" or x[2]:
            x[4] = None
        for kid in x[3]:
            free(kid)

    constant, whole = mass(node)
    if constant > MOST_CONSTANT * whole:
        free(node)


class Learned:
    """A wrapper with the number of its pages, and hashes of the first LEAST_PAGES texts that differ, by hash."""

    __slots__ = ("wrapper", "n", "seen")

    def __init__(self, wrapper: list, n: int, seen: list[int]):
        self.wrapper, self.n, self.seen = wrapper, n, seen

    def add(self, other: Learned) -> None:
        self.wrapper = align(self.wrapper, other.wrapper)
        self.n += other.n
        if len(self.seen) < LEAST_PAGES or other.seen[0] < self.seen[-1]:
            self.seen = sorted({*self.seen, *other.seen})[:LEAST_PAGES]

    def weigh(self) -> Learned:
        """Sets the number of pages that differ in all nodes of a wrapper of one shape."""
        todo = [self.wrapper]
        while todo:
            node = todo.pop()
            node[7] = len(self.seen)
            todo += node[3]
        return self


def learn(page: str | None) -> Learned:
    """The wrapper of one page, all that its article holds too."""
    tree = parse(page)
    wrapper = wrap(tree)
    wrapper[6], found = articles(tree)
    return Learned(wrapper, 1, [_hash("\n".join(block for x in found or [tree] for block in blocks(x, frozenset())))])


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63


def shape_of(wrapper: list) -> str:
    """The wrapper of a page without its texts, as an expression."""

    def bare(node: list) -> list:
        return [*node[:3], [bare(kid) for kid in node[3]], None if node[0] == "#" else "", *node[5:]]

    return expression(bare(wrapper))


def merge(found: list[Learned]) -> Learned:
    """One of several shapes of a host, the most frequent first, without rare parts."""
    first, *others = sorted(found, key=lambda x: -x.n)
    for x in others:
        first.add(x)
    todo = [first.wrapper]
    while todo:
        node = todo.pop()
        node[3] = [kid for kid in node[3] if not kid[1] or kid[7] * RARE >= first.wrapper[7]]
        todo += node[3]
    return first


def finish(found: Learned) -> list:
    """The wrapper to read by: its article is marked, and what reading does not ask for is left out."""
    wrapper, few = found.wrapper, len(found.seen) < LEAST_PAGES
    mark_article(wrapper)

    def settle(x: list) -> None:
        if (x[0] == "#" or x[2]) and (few or x[7] < LEAST_PAGES):
            x[4] = None
        for kid in x[3]:
            settle(kid)
        if x[6]:
            drop_constants(x)

    settle(wrapper)
    return wrapper


def trim(node: list) -> bool:
    """Takes away what lies below nodes without an article, and in articles that have no borders; True if there is an article."""
    if node[6]:
        if not _borders(node):
            node[3] = []
        return True
    if not sum([trim(kid) for kid in node[3]]):
        node[3] = []
        return False
    return True


def infer(pages: list[str]) -> list:
    """The wrapper of a host's pages, its article marked."""
    shapes: dict[str, Learned] = {}
    for page in pages:
        found = learn(page)
        shape = shape_of(found.wrapper)
        if shape in shapes:
            shapes[shape].add(found)
        else:
            shapes[shape] = found
    return finish(merge([x.weigh() for x in shapes.values()]))


def _constants(node: list) -> list[str] | None:
    """The texts below a wrapper node, if all of them are constants; of a repeated group what stands for them."""
    if node[0] == "#" or node[2]:
        return None if node[4] is None else [] if node[4] == "=" else [node[4]]
    found: list[str] = []
    for kid in node[3]:
        texts = _constants(kid)
        if texts is None:
            return None
        found += texts
    return found


def _borders(node: list) -> dict[int, list[str]]:
    """Blocks of constants before the first heading or slot below an article's node and after the last, by id, with their texts; in
    named articles only menus."""
    found: dict[int, list[str]] = {}
    for order in (1, -1):
        todo: list = node[3][::-order]
        while todo:
            kid = todo.pop()
            texts = _constants(kid)
            if texts is None:  # what holds a slot may begin with constants; a repeated group that differs is the page's own
                todo = [] if kid[2] or kid[0] == "#" else kid[3][::-order]
                continue
            if texts and _has_heading(kid):
                break
            if texts and kid[0].split(".")[0] in BLOCKS and (node[6] == INFERRED or _is_menu(kid)):
                found[id(kid)] = texts
    return found


def _is_menu(node: list) -> bool:
    """True if all words below a node lie in links."""
    if node[0] == "#":
        return node[4] is not None and not any(map(str.isalnum, node[4]))
    return node[0].split(".")[0] == "a" or all(map(_is_menu, node[3]))


def _has_heading(node: list) -> bool:
    return node[0].split(".")[0] in HEADINGS or any(map(_has_heading, node[3]))


class Reader:
    """Reads pages by one wrapper."""

    def __init__(self, wrapper: list):
        self.wrapper = wrapper
        self.named = False
        self.borders: dict[int, list[str]] = {}
        todo = [wrapper]
        while todo:
            node = todo.pop()
            self.named |= node[6] == NAMED
            if node[6]:
                self.borders |= _borders(node)
            todo += node[3]

    def read(self, tree: Element) -> list[str] | None:
        """The blocks of a page's article; None if the page has no element where the wrapper has the article, or articles elsewhere."""
        roots: list[Element] = []
        dropped: set[int] = set()
        todo: list[tuple[Element, list]] = [(tree, self.wrapper)]
        inside: list[tuple[Element, list]] = []
        while todo:
            element, node = todo.pop()
            if node[6]:
                roots.append(element)
                if self.borders:
                    inside.append((element, node))
            else:
                todo += reversed([(x, n) for run, n in self._aligned(element, node) for x in run if x.tag and not x.skipped])
        while inside:
            element, node = inside.pop()
            for run, n in self._aligned(element, node):
                if id(n) in self.borders:
                    if self.borders[id(n)] == _constants(_fold(run)):
                        dropped |= set(map(id, run))
                elif not n[2]:
                    inside += [(x, n) for x in run if x.tag]
        if not roots or self.named and len(roots) != len(articles(tree)[1]):
            return None
        return [b for root in roots for b in blocks(root, dropped)]

    @staticmethod
    def _aligned(element: Element, node: list) -> list[tuple[list[Element], list]]:
        """The kids of an element, neighbours of one kind together, and the wrapper nodes that they are aligned to."""
        runs = _runs(element)
        return [(runs[i], node[3][k]) for i, k in _matched([r[0].key for r in runs], [n[0] for n in node[3]])]


def blocks(element: Element, dropped: frozenset[int] | set[int]) -> list[str]:
    """Texts of the blocks of an element in page order, without skipped and dropped elements."""
    out: list[str] = []
    parts: list[str] = []

    def end() -> None:
        if text := " ".join("".join(parts).split()):
            out.append(text)
        parts.clear()

    todo: list = [element]
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif not x.tag:
            parts.append(html.unescape(x.text))
        elif x is element or not (x.skipped or id(x) in dropped):
            if x.tag == "br":
                parts.append(" ")
            block = x.tag in BLOCKS
            if block:
                end()
                todo.append(None)
            todo += reversed(x.kids)
    end()
    return out


def extract(page: str | None, reader: Reader | None) -> str:
    """Main text of a page: its blocks joined by an empty line."""
    tree = parse(page)
    found = reader.read(tree) if reader else None
    if found is None:
        found = Reader(infer([page or ""])).read(tree) or []
    return "\n\n".join(found)


def host_of(url):  # noqa: ANN001, ANN201
    """Column: lower-case host of a URL, empty for null."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def join_hosts(rows: DataFrame, known: DataFrame) -> DataFrame:
    """`rows` (with host and a hash h) left-joined with the wrapper of each host: broadcast up to BROADCAST_CHARS, else salted."""
    if (known.agg(F.sum(F.length("wrapper"))).first()[0] or 0) <= BROADCAST_CHARS:
        return rows.join(F.broadcast(known), "host", "left")
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("long")).join(salted, ["host", "salt"], "left").drop("salt")


LEARNED = "host string, shape long, n long, seen array<long>, wrapper string"


def _row(host: str, shape: int, found: Learned) -> tuple:
    return host, shape, found.n, found.seen, json.dumps(found.wrapper, ensure_ascii=False)


def _learned(row) -> Learned:  # noqa: ANN001
    return Learned(json.loads(row.wrapper), row.n, list(row.seen))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["host", "shape", "n", "seen", "wrapper"])


def by_shape(pages: DataFrame) -> DataFrame:
    """A row of LEARNED for each host and shape, over all pages: added up in the tasks that read them, then as they stream by in order of the shapes."""

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, int], Learned] = {}
        chars = 0
        for batch in batches:
            for host, page in zip(batch["host"], batch["html"], strict=True):
                found = learn(page)
                key = host, _hash(shape_of(found.wrapper))
                if key in held:
                    held[key].add(found)
                    continue
                held[key] = found
                chars += len(page)
                if chars > HELD_CHARS:
                    yield _frame([_row(*k, x) for k, x in held.items()])
                    held, chars = {}, 0
        yield _frame([_row(*k, x) for k, x in held.items()])

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, total = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples():
                if key != (row.host, row.shape):
                    if total:
                        out.append(_row(*key, total.weigh()))
                    key, total = (row.host, row.shape), _learned(row)
                else:
                    total.add(_learned(row))
            yield _frame(out)
        if total:
            yield _frame([_row(*key, total.weigh())])

    parts = pages.select(host_of(F.col("url")).alias("host"), "html").mapInPandas(combine, LEARNED)
    return parts.repartition("host", "shape").sortWithinPartitions("host", "shape").mapInPandas(stream, LEARNED)


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON), from all pages of a host.

    Shapes of a host are merged about MERGED at a time, by their hashes, until one wrapper is left, so that no task
    gets all of a large host and the result does not depend on how rows are spread.
    """

    def join(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        found = merge([_learned(row) for row in group.sort_values("shape").itertuples()])
        return _frame([_row(key[0], key[1], found)])

    def end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                wrapper = finish(_learned(row))
                trim(wrapper)
                out.append((row.host, json.dumps(wrapper, ensure_ascii=False)))
            yield pd.DataFrame(out, columns=["host", "wrapper"])

    found, turn = materialize(by_shape(pages), "shapes"), 0
    while True:
        counts = found.groupBy("host").agg(F.count("*").alias("shapes"))
        if (counts.agg(F.max("shapes")).first()[0] or 0) <= 1:
            return found.mapInPandas(end, "host string, wrapper string")
        group = F.pmod(F.xxhash64("shape", F.lit(turn)), F.ceil(F.col("shapes") / MERGED)).alias("group")
        found, turn = materialize(found.join(counts, "host").select(*found.columns, group).groupBy("host", "group").applyInPandas(join, LEARNED), "shapes"), turn + 1


def main_text(pages: DataFrame) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars.

    A null or empty page gives an empty text and 0. A null or odd URL belongs to the host "". Rows that repeat
    a page give equal rows; an empty table gives an empty result; other columns are not read. The whole html is read.
    """
    source = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    known = materialize(wrappers(source), "wrappers")

    @F.pandas_udf("string")
    def read(htmls: pd.Series, found: pd.Series) -> pd.Series:
        kept: dict[str, Reader] = {}
        out = []
        for page, wrapper in zip(htmls, found, strict=True):
            if wrapper is not None and wrapper not in kept:
                kept[wrapper] = Reader(json.loads(wrapper))
            out.append(extract(page, kept.get(wrapper)))
        return pd.Series(out, dtype=object)

    joined = join_hosts(source.withColumn("host", host_of(F.col("url"))).withColumn("h", F.xxhash64("page_id", "url")), known)
    return joined.select("page_id", "url", read("html", "wrapper").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
