"""HTML extraction with wrappers: union-free regular expressions inferred from the pages of each host.

A page's token stream (block tags and text blocks; inline tags, comments and raw-text elements leave no tokens) is read
into nested sibling lists. Repeated neighbours become repeated groups. The pages of a host are then aligned one after
another with the host's wrapper: siblings that only one side has become optional, runs become repeated groups, and
texts that differ become text slots, while equal ones stay part of the template. Every sibling counts the pages that
have it. Wrappers are folded within each batch
first (in the order of their digests), then by salted host, then by host, so that a hot host's pages never meet in one task.
Long sibling lists are aligned between the siblings that both have once, in order, so that wide pages take no square of time.

A host with varied markup outgrows MAX_NODES. Its wrapper then drops rare siblings by the frequent-items rule of Misra and
Gries (all supports fall by the same number), which keeps every sibling that a quarter of the pages have, in whatever
order pages are folded. Another pass over the pages of such hosts counts the exact support of each slot left and whether
all its pages agree, so that template text is told exactly. Siblings without a place in the wrapper are judged as in the
wrapper of their page alone.

Which slots are main text is the wrapper's decision first. Every slot counts the characters of its texts. From the root down,
the region moves into the element that holds REGION_PERCENT of the host's varying, unlinked text, while there is one that
isn't repeated and has elements of its own; it stops at an element that calls itself article or content. The region's own
siblings stay with it where they have varying, unlinked text in no part that is no article's: an opening paragraph or a note
at the end is as much the article's as its body. Further out, only siblings do that call themselves such (LEAD_WORDS). Pages
of a host with MIN_TEMPLATE_PAGES whose texts vary take the slots of all these, and varying headings outside.

Inside the region, and on hosts with fewer or equal pages, what parts of the page are called decides the rest: text inside
article or main elements, else inside content elements, else every slot that is neither in a list of links nor template
text (a text that is the same on all pages that have its slot, where these are MIN_TEMPLATE_PAGES at least and most of the
host's pages); never text of menus, headers, footers, sidebars, notices, adverts, forms and comments. A page without text in
the region is read by those rules alone. Extraction aligns each page with its host's wrapper and joins the texts of the main
slots; what it leaves out as template text equals the template's.

Defined results: null or empty html, and pages without main text, give an empty text; character references are decoded
as HTML does; a line break is white space inside a block; html cut off at any place is closed there; texts nested deeper
than MAX_DEPTH stand in a row at that depth, each in an element that says whether it is article, content or none; a null host is a host; repeated rows are extracted one by one.
"""

from __future__ import annotations

import itertools
import json
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from hashlib import blake2b
from html import unescape
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.text_stats import kept_apart
from quern.llm.workers import released
from quern.session import ensure_checkpoint_dir

MAX_NODES, MAX_DEPTH, MAX_PERIOD = 4000, 120, 6
SALTS = 32
#: Fewer pages with a slot don't tell template text from other text.
MIN_TEMPLATE_PAGES = 4
BROADCAST_BYTES = 64 << 20
REGION_PERCENT = 80
#: Sibling lists whose lengths' product is larger are cut at the siblings that both have once.
WIDE = 1 << 20

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
_NAMED = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Element names of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe noembed noframes title textarea xmp template svg math".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SIBLING_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
SCOPE = frozenset("table ul ol dl td th article section div body html main nav aside footer header form blockquote".split())

# What marks parts of a page that are not its article.
OTHER_ELEMENTS = frozenset("head nav aside footer form button select input dialog menu object canvas video audio datalist".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
OTHER_WORDS = frozenset(
    """nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead banner topbar footer sidebar aside widget
    ad ads advert adverts advertisement advertisements advertising adsense adbox sponsor sponsored promo promotion promoted
    cookie cookies consent gdpr notice notices alert notification popup modal overlay comment comments commentlist respond
    reply replies disqus share sharing social related recommended recommendations newsletter subscribe subscription signup
    login search pagination pager toolbar copyright disclaimer form""".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist respond reply replies disqus".split())
LEAD_WORDS = frozenset("lead lede standfirst summary intro introduction abstract dek deck excerpt teaser caption endnote endnotes footnote footnotes postscript".split())
MAIN_WORDS = frozenset("content main article post entry story body text page wrapper container layout".split())


class _Node:
    __slots__ = ("label", "name", "kids", "text")

    def __init__(self, label: str, name: str, text: str | None = None):
        self.label, self.name, self.kids, self.text = label, name, [], text


@lru_cache(maxsize=4096)
def _label(name: str, attributes: str) -> str:
    """name, with what its class, id and role say; digits count as 0."""
    found = {k.lower(): a or b or c for k, a, b, c in _NAMED.findall(attributes)} if attributes.strip(" /\n\t\r") else {}
    parts = [name, re.sub(r"\d+", "0", " ".join(sorted(found.get("class", "").split()))), re.sub(r"\d+", "0", found.get("id", "")), found.get("role", "").lower()]
    return "|".join(_short(p.replace("|", " ")) for p in parts).rstrip("|")


def _short(part: str) -> str:
    """A long class list, id or role as the words that _part looks for and a digest, in digits, of the whole."""
    if len(part) <= 80:
        return part
    told = sorted({w.lower() for w in _TOKEN.findall(part)} & (OTHER_WORDS | COMMENT_WORDS | MAIN_WORDS))
    return " ".join([*told, str(int.from_bytes(blake2b(part.encode("utf-8", "surrogatepass"), digest_size=12).digest()))])


def told_apart(text: str) -> str:
    """A text of up to 80 characters itself, a longer one by its beginning and a digest of the whole."""
    return text if len(text) <= 80 else f"{text[:40]}\n{blake2b(text.encode('utf-8', 'surrogatepass'), digest_size=16).hexdigest()}"


def _deep_label(stack: list[_Node], node: _Node) -> str:
    """The label of an element below MAX_DEPTH: its own, or the one of the elements around it there that says more."""
    around = stack[-1].label if len(stack) > MAX_DEPTH else ""
    article, content, no = _part(around)
    if around and (no or around.split("|")[0] == "header"):
        return around
    own_article, own_content, own_no = _part(node.label)
    if node.name == "header":
        in_article = article or any(_part(n.label)[0] for n in stack[1:MAX_DEPTH])
        return node.label if own_no or not in_article else around or "div"
    return node.label if own_no or own_article or (own_content and not article) or not (article or content) else around


def parse(html: str) -> _Node:
    """The page as nested sibling lists; texts are collapsed and labelled "#", or "@" if all of them is linked."""
    root = _Node("", "")
    stack, pieces, linked, plain = [root], [], 0, False
    opened: Counter[str] = Counter()
    at = 0

    def flush() -> None:
        nonlocal plain
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                slot = _Node("#" if plain else "@", "#", text)
                if len(stack) > MAX_DEPTH:  # stack[-1] isn't part of the tree
                    deep = _Node(stack[-1].label, stack[-1].label.split("|")[0])
                    deep.kids.append(slot)
                    stack[MAX_DEPTH - 1].kids.append(deep)
                else:
                    stack[-1].kids.append(slot)
        plain = False

    def close(i: int) -> None:
        flush()
        for n in stack[i:]:
            opened[n.name] -= 1
        del stack[i:]

    while at < len(html):
        m = _MARK.search(html, at)
        piece = html[at : m.start() if m else len(html)]
        if piece:
            pieces.append(piece)
            plain = plain or (not linked and not piece.isspace())
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name in RAW and not m[1]:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name in INLINE:
            if name == "a":
                linked = max(0, linked - 1) if m[1] else linked + 1
            elif name == "br":
                pieces.append(" ")
            continue
        if m[1]:
            for i in range(len(stack) - 1, 0, -1) if opened[name] else ():
                if stack[i].name == name:
                    close(i)
                    break
                if name == "p" and stack[i].name in SCOPE:
                    break
            else:
                flush()
            linked = 0
            continue
        if name in ENDS_PARAGRAPH and stack[-1].name == "p":
            close(len(stack) - 1)
        for ended in (SIBLING_ENDS.get(name) or (),):
            for i in range(len(stack) - 1, 0, -1) if any(opened[e] for e in ended) else ():
                if stack[i].name in ended:
                    close(i)
                elif stack[i].name in SCOPE and stack[i].name not in ended:
                    break
        flush()
        linked = 0
        if name not in VOID:
            node = _Node(_label(name, m[3]), name)
            if len(stack) < MAX_DEPTH:
                stack[-1].kids.append(node)
            else:
                node.label = _deep_label(stack, node)
            stack.append(node)
            opened[name] += 1
    close(0)
    return root


# A wrapper is a list of siblings: [kind, label, flags, kids, text, support, chars]; kind "e" (element), "#" (slot, whose text
# is kept while all pages agree, else None) or "g" (group). Flags: 1 optional, 2 repeated. Support: the pages that have it.
# Chars: those of all texts of a slot.


def _key(w: list):
    return tuple(_key(k) for k in w[3]) if w[0] == "g" else w[1]


def _merge(a: list, b: list, one_page: bool) -> list:
    """The alignment of two matching siblings."""
    text = a[4] if a[4] == b[4] else None
    support = max(a[5], b[5]) if one_page else a[5] + b[5]
    return [a[0], a[1], a[2] | b[2], align(a[3], b[3], one_page) if a[3] or b[3] else [], text, support, a[6] + b[6]]


def _once_in_both(a: list, b: list) -> list[tuple[int, int]]:
    """The places of keys that both lists have once, in the order of both: the longest such sequence."""
    from bisect import bisect_left

    na, nb = Counter(a), Counter(b)
    at = {k: i for i, k in enumerate(b) if nb[k] == 1 and na[k] == 1}
    pairs = [(i, at[k]) for i, k in enumerate(a) if k in at]
    tails, last, back = [], [], [-1] * len(pairs)
    for x, (_, j) in enumerate(pairs):
        d = bisect_left(tails, j)
        back[x] = last[d - 1] if d else -1
        tails[d : d + 1], last[d : d + 1] = [j], [x]
    out, x = [], last[-1] if last else -1
    while x >= 0:
        out.append(pairs[x])
        x = back[x]
    return out[::-1]


def _steps(a: list, b: list) -> Iterator[tuple[bool, int, int, int, int]]:
    """(equal, ranges of a and b) that cover both key lists in order."""
    if len(a) * len(b) <= WIDE:
        for op, i, j, k, n in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            yield op == "equal", i, j, k, n
        return
    i = k = 0
    for x, y in [*_once_in_both(a, b), (len(a), len(b))]:
        if (x - i) * (y - k) <= WIDE:
            yield from ((e, i + p, i + q, k + r, k + t) for e, p, q, r, t in _steps(a[i:x], b[k:y]))
        else:  # no sibling of these runs is in both once
            same = 0
            while same < min(x - i, y - k) and a[i + same] == b[k + same]:
                same += 1
            if same:
                yield True, i, i + same, k, k + same
            yield False, i + same, x, k + same, y
        if x < len(a):
            yield True, x, x + 1, y, y + 1
        i, k = x + 1, y + 1


def align(a: list, b: list, one_page: bool = False) -> list:
    """The wrapper of two sibling lists, of one page or of different ones: matching siblings merge, others become optional."""
    ka, kb = [_key(x) for x in a], [_key(x) for x in b]
    if ka == kb:
        return [_merge(x, y, one_page) for x, y in zip(a, b, strict=True)]
    out = []
    for equal, i, j, k, n in _steps(ka, kb):
        if equal:
            out += [_merge(x, y, one_page) for x, y in zip(a[i:j], b[k:n], strict=True)]
        else:
            out += [[w[0], w[1], w[2] | 1, *w[3:]] for w in chain(a[i:j], b[k:n])]
    return out


def fold_repeats(row: list) -> list:
    """Neighbouring equal runs of up to MAX_PERIOD siblings become one repeated sibling or group."""
    for period in range(1, MAX_PERIOD + 1):
        keys, out, i = [_key(x) for x in row], [], 0
        while i < len(row):
            n = 1
            while keys[i + n * period : i + (n + 1) * period] == keys[i : i + period] and i + (n + 1) * period <= len(row):
                n += 1
            if n == 1:
                out.append(row[i])
                i += 1
                continue
            body = row[i : i + period]
            for j in range(1, n):
                body = align(body, row[i + j * period : i + (j + 1) * period], one_page=True)
            out.append([*body[0][:2], body[0][2] | 2, *body[0][3:]] if period == 1 else ["g", "", 2, body, None, 1, 0])
            i += n * period
        row = out
    return row


def skeleton(nodes: list[_Node]) -> list:
    """The wrapper of one page."""
    return fold_repeats([["#", n.label, 0, [], told_apart(n.text), 1, len(n.text)] if n.text is not None else ["e", n.label, 0, skeleton(n.kids), None, 1, 0] for n in nodes])


def count(row: list) -> int:
    return sum(1 + count(w[3]) for w in row)


def one_page(html: str) -> list:
    row = skeleton(parse(html).kids)
    return [1, row, False, count(row), False]


def infer(wrapper: list | None, other: list) -> list:
    """One step of the inference; both sides are [pages, siblings, any dropped, nodes of all pages, texts varied before a drop]."""
    if wrapper is None:
        return other
    pages, row, nodes = wrapper[0] + other[0], align(wrapper[1], other[1]), wrapper[3] + other[3]
    most = max(MAX_NODES, 4 * nodes // pages)
    dropped = count(row) > 2 * most
    varied = wrapper[4] or other[4] or (dropped and _varies(row))
    return [pages, drop_rare(row, most) if dropped else row, dropped or wrapper[2] or other[2], nodes, varied]


def _supports(row: list, in_group: bool = False) -> Iterator[int]:
    for w in row:
        if not in_group:
            yield w[5]
        yield from _supports(w[3], w[0] == "g")


def drop_rare(row: list, most: int) -> list:
    """At most `most` siblings, besides those that stand right inside a group, which stay with it."""
    supports = sorted(_supports(row), reverse=True)
    return _lower(row, supports[most], False) if len(supports) > most else row


def _lower(row: list, by: int, in_group: bool) -> list:
    return [[*w[:3], _lower(w[3], by, w[0] == "g"), w[4], w[5] if in_group else w[5] - by, w[6]] for w in row if in_group or w[5] > by]


def slots(row: list) -> Iterator[list]:
    for w in row:
        if w[0] == "#":
            yield w
        else:
            yield from slots(w[3])


@lru_cache(maxsize=4096)
def _part(label: str) -> tuple[bool, bool, bool]:
    """(opens an article, opens other content, is no part of an article wherever it stands)."""
    name, classes, ident, role = ([*label.split("|"), "", "", ""])[:4]
    words = {w.lower() for w in _TOKEN.findall(f"{classes} {ident}")}
    comments = bool(words & COMMENT_WORDS)
    if name in ("article", "main") or role in ("main", "article"):
        return not comments, not comments, comments
    if name in ("html", "body"):
        return False, False, False
    other = name in OTHER_ELEMENTS or role in OTHER_ROLES or comments or bool(words & OTHER_WORDS and not words & MAIN_WORDS)
    return False, not other and bool(words & {"content", "article", "post", "entry", "story", "main"}), other


def _mass(w: list, least: float) -> int:
    """The characters of a sibling's varying, unlinked text outside parts that are no article's."""
    if w[0] == "#":
        return 0 if w[1] == "@" or (w[4] is not None and w[5] >= least) else w[6]
    if w[0] == "e" and _part(w[1])[2]:
        return 0
    return sum(_mass(k, least) for k in w[3])


def region(row: list, least: float) -> tuple[list | None, list]:
    """The element that holds the host's main text, as far down as its text is REGION_PERCENT of its siblings' too; and what
    stays with it: its own siblings with such text, and siblings of the elements around it that LEAD_WORDS name."""
    found, near, named = None, [], []
    while True:
        masses = [_mass(w, least) for w in row]
        best = max(range(len(row)), key=masses.__getitem__, default=-1)
        if best < 0 or not masses[best] or 100 * masses[best] < REGION_PERCENT * sum(masses):
            return found, near + named
        w = row[best]
        if w[0] != "e" or w[2] & 2 or all(k[0] == "#" for k in w[3]):
            return found, near + named
        named += [k for k in near if k[0] == "e" and {t.lower() for t in _TOKEN.findall(k[1])} & LEAD_WORDS]
        found, near, row = w, [k for i, k in enumerate(row) if i != best and masses[i]], w[3]
        article, content, _ = _part(w[1])
        if article or content:
            return found, near + named


HEADINGS = frozenset(f"h{i}" for i in range(1, 7))


def _judge(row: list, inside: int, other: bool, in_list: bool, least: float, main: list | None = None, within: bool = False, heading: bool = False, beside: tuple = ()) -> list:
    """The wrapper with, for each slot, the ways in which it is main text: 1 in an article, 2 in content, 4 elsewhere; and 8
    in the region `main`, in a sibling of it in `beside`, or in a heading whose text varies.

    A slot's text stays if it is template text, which `least` pages have. Elements tell whether they are in a list of links
    (1), and whether they are in the region (8).
    """
    out = []
    for w in row:
        kind, label, flags, kids, text, support, _ = w
        here = within or w is main or any(w is b for b in beside)
        if kind == "e":
            name = label.split("|")[0]
            article, content, no = _part(label)
            no = no or (name == "header" and not inside & 1)
            linked = in_list or (not inside and bool(flags & 2) and _all_linked(kids))
            inner = _judge(kids, inside | (1 if article else 0) | (2 if content else 0), other or no, linked, least, main, here, name in HEADINGS, beside)
            out.append([kind, label, flags, inner, None, (1 if linked else 0) | (8 if here else 0)])
        elif kind == "g":
            out.append([kind, label, flags, _judge(kids, inside, other, in_list or (not inside and _all_linked(kids)), least, main, here, heading, beside), None, 0])
        else:
            template = text if support >= least else None
            ways = 0 if other else (1 if inside & 1 else 0) | (2 if inside & 2 else 0) | (0 if in_list else 4)
            out.append([kind, label, flags, [], template, ways | (8 if here or (main is not None and heading and template is None) else 0)])
    return out


def _all_linked(kids: list) -> bool:
    slots = [k for k in kids if k[0] == "#"]
    return all(k[1] == "@" for k in slots) and all(_all_linked(k[3]) for k in kids if k[0] != "#") and bool(kids)


def _varies(row: list) -> bool:
    return any(w[4] is None if w[0] == "#" else _varies(w[3]) for w in row)


def _flat(row: list, number: Iterator[int]) -> list:
    """Siblings with groups written out: (label, ways or in a list, kids, template text, slot), and the places of each label."""
    out: list = []
    for w in row:
        if w[0] == "g":
            out += _flat(w[3], number)[0]
        else:
            out.append((w[1], w[5], _flat(w[3], number), w[4], next(number) if w[0] == "#" else -1))
    places: dict[str, list[int]] = {}
    for i, w in enumerate(out):
        places.setdefault(w[0], []).append(i)
    return [out, places]


class Wrapper:
    """A judged wrapper, ready to extract."""

    def __init__(self, pages: int, row: list, varied: bool):
        least = max(MIN_TEMPLATE_PAGES, pages // 2 + 1) if varied or _varies(row) else float("inf")
        self.main, beside = region(row, least) if least < float("inf") and pages >= MIN_TEMPLATE_PAGES else (None, [])
        self.row = _flat(_judge(row, 0, False, False, least, self.main, beside=tuple(beside)), itertools.count())
        self.slots = [w[4] for w in slots(row)]

    def texts(self, root: _Node) -> list[str]:
        """The main text blocks of a page, in page order."""
        found: list[tuple[int, str, int]] = []
        self._walk(root.kids, self.row, 0, False, 0, found)
        for need in (8, 0) if self.main is not None else (0,):
            for way in (1, 2, 4):
                got = [t for ways, t, _ in found if ways & way and ways & need == need]
                if got:
                    return got
        return []

    def tally(self, root: _Node) -> dict[int, bool]:
        """For each slot that a page has: whether all its texts there are the wrapper's."""
        found: list[tuple[int, str, int]] = []
        self._walk(root.kids, self.row, 0, False, 0, found)
        out: dict[int, bool] = {}
        for _, text, slot in found:
            if slot >= 0:
                out[slot] = out.get(slot, True) and self.slots[slot] == told_apart(text)
        return out

    def _walk(self, nodes: list[_Node], row: list, inside: int, other: bool, state: int, found: list) -> None:
        at, own = 0, None
        for n in nodes:
            if spots := row[1].get(n.label):
                at = next((i for i in spots if i >= at), spots[0])
                place = row[0][at]
            else:
                own = own or _flat(_judge(skeleton(nodes), inside, other, bool(state & 1), float("inf"), None, bool(state & 8)), itertools.repeat(-1))
                place = own[0][own[1][n.label][0]]
            if n.text is not None:
                found.append((place[1] & ~4 if place[3] is not None and place[3] == told_apart(n.text) else place[1], n.text, place[4]))
                continue
            article, content, no = _part(n.label)
            no = no or (n.name == "header" and not inside & 1)
            self._walk(n.kids, place[2], inside | (1 if article else 0) | (2 if content else 0), other or no, place[1], found)


@lru_cache(maxsize=512)
def load(wrapper: str) -> Wrapper:
    pages, row, _, _, varied = json.loads(wrapper) if wrapper else (0, [], False, 0, False)
    return Wrapper(pages, row, varied)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) -> (host, wrapper), one row for each host of a batch."""
    for b in batches:
        out: dict = {}
        hosts, pages = b.column(0).to_pylist(), b.column(1)
        digest = [blake2b((h.as_buffer() if h.is_valid else b""), digest_size=8).digest() for h in pages]
        for i in sorted(range(len(hosts)), key=lambda i: (digest[i], i)):
            out[hosts[i]] = infer(out.get(hosts[i]), one_page(pages[i].as_py() or ""))
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array([json.dumps(w) for w in out.values()], pa.string())], names=["host", "wrapper"])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (host, wrapper) rows -> one row for each host; holds one wrapper at a time."""
    host, wrapper, any_yet = None, None, False
    done = lambda: pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([json.dumps(wrapper)], pa.string()), pa.array([wrapper[2]], pa.bool_())], names=["host", "wrapper", "dropped"])
    for b in batches:
        for h, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if any_yet and h != host:
                yield done()
                wrapper = None
            host, any_yet = h, True
            wrapper = infer(wrapper, json.loads(w))
    if any_yet:
        yield done()


def infer_wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, wrapper): one wrapper for each host, from all its pages."""
    schema = "host string, wrapper string, dropped boolean"
    ensure_checkpoint_dir(pages.sparkSession)
    rows = pages.select(host_column(url).alias("host"), F.col(html).cast("string").alias("html")).mapInArrow(released(_partial), "host string, wrapper string")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    some = salted.repartition("host", "salt").sortWithinPartitions("salt", "host", "wrapper").select("host", "wrapper").mapInArrow(released(_fold), schema)
    found = some.select("host", "wrapper").repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(released(_fold), schema).checkpoint()
    if found.where("dropped").isEmpty():
        return found.select("host", "wrapper")
    return found.where("NOT dropped").select("host", "wrapper").unionByName(settle(pages, found.where("dropped").select("host", "wrapper"), url, html))


def settle(pages: DataFrame, wrappers: DataFrame, url: str, html: str) -> DataFrame:
    """wrappers with the exact support of each slot, and without a text where any page of the host has another."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict = {}
            for host, h, w in zip(*b.columns, strict=True):
                counts = out.setdefault(host.as_py(), {})
                for slot, same in load(w.as_py()).tally(parse(h.as_py() or "")).items():
                    n = counts.setdefault(slot, [0, 0])
                    n[0], n[1] = n[0] + 1, n[1] + (not same)
            rows = [(host, slot, *n) for host, counts in out.items() for slot, n in counts.items()]
            yield pa.RecordBatch.from_pylist([dict(zip(("host", "slot", "n", "others"), r, strict=True)) for r in rows], pa.schema([("host", pa.string()), ("slot", pa.int32()), ("n", pa.int64()), ("others", pa.int64())]))

    def patch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for w, counts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                wrapper, exact = json.loads(w), {c["slot"]: c for c in counts or ()}
                for i, slot in enumerate(slots(wrapper[1])):
                    c = exact.get(i, {"n": 0, "others": 0})
                    slot[4:6] = [None if c["others"] else slot[4], c["n"]]
                out.append(json.dumps(wrapper))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["host", "wrapper"])

    rows = pages.select(host_column(url).alias("__host"), F.col(html).cast("string").alias("__html"))
    counts = _beside(rows, wrappers).select("__host", "__html", "__wrapper").where("__wrapper IS NOT NULL").mapInArrow(released(tally), "host string, slot int, n long, others long")
    counts = counts.groupBy("host", "slot").agg(F.sum("n").alias("n"), F.sum("others").alias("others"))
    counts = counts.groupBy("host").agg(F.collect_list(F.struct("slot", "n", "others")).alias("counts"))  # the slots of a wrapper
    return wrappers.join(counts, "host", "left").select("host", "wrapper", "counts").mapInArrow(released(patch), "host string, wrapper string").checkpoint()


def _beside(rows: DataFrame, wrappers: DataFrame) -> DataFrame:
    """Rows with a __host and __html, and the __wrapper of each.

    Wrappers are broadcast while they take BROADCAST_BYTES or less; beyond that they are joined by salted host.
    """
    names = wrappers.select(F.col("host").alias("__host"), F.col("wrapper").alias("__wrapper"))
    size = names.agg(F.sum(F.octet_length("__wrapper").cast("double") + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(names), "__host", "left")
    salt = F.pmod(F.xxhash64("__html"), F.lit(SALTS)).cast("int")
    return rows.withColumn("__salt", salt).join(names.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["__host", "__salt"], "left")


def host_column(url: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def extract(pages: DataFrame, wrappers: DataFrame, url: str = "url", html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns `keep` of pages with text and n_chars."""
    pages, keep = kept_apart(pages, keep, ("text", "n_chars", "__host", "__html", "__wrapper", "__salt"))
    rows = pages.select(*keep, host_column(url).alias("__host"), F.col(html).cast("string").alias("__html"))
    joined = _beside(rows, wrappers)
    joined = joined.select(*keep, "__html", "__wrapper")
    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = len(keep)
            texts = ["\n".join(load(w.as_py() or "").texts(parse(h.as_py() or ""))) for h, w in zip(b.column(k), b.column(k + 1), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return joined.mapInArrow(released(run), schema)
