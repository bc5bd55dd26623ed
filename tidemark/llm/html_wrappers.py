"""Main text of web pages by wrappers that are inferred from the pages of a host.

A page is a stream of block tags and text slots (inline markup belongs to the slot). Streams of a
host are aligned one after the other into a wrapper, a regular expression without unions: what
two streams share stays, a part that one of them lacks becomes optional, a part that follows
itself becomes a repeated group, and a text that differs becomes a slot. The union is never
needed: two different parts at one place are two optional parts.

Each task aligns its pages host by host, and wrappers are aligned with each other, first in salted
groups and then by host, so a host with a third of all pages is spread like any other. The order
of alignment can change how optional parts are grouped, not which parts a wrapper has. Of a wrapper
the rules below pick the parts that are boilerplate; pages are then read along their host's wrapper.
"""

from __future__ import annotations

import html
import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.workers import kept
from tidemark.session import saved

BROADCAST_BYTES = 32 << 20
HELD_HOSTS = 5_000
#: characters of pages (a wrapper has at most as many), and of wrappers, that a task holds
HELD_CHARS = 64 << 20
LONGEST_GROUP = 4
ALIGN_BITS = 1 << 28

# Tags of HTML by what they mean here.
INLINE = set(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span"
    " strong sub sup time tt u var wbr".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript iframe template svg math".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | set("p li dd dt blockquote pre td th figcaption".split())
CLOSES_P = set(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu"
    " nav ol p pre section table ul".split()
)
CLOSED_BY_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIERS = set("table ul ol dl div section article body html".split())
# Tags and words of class, id or role that mark what is not the article.
DROP_TAGS = set(
    "head script style noscript iframe template svg math nav footer aside form button select input textarea label fieldset"
    " object embed canvas audio video dialog menu title".split()
)
DROP_WORDS = set(
    "ad ads adbox adslot advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments"
    " complementary consent contentinfo cookie cookies dialog disqus disclaimer footer gdpr masthead menu menubar modal nav navbar"
    " navigation newsletter notice notification pager pagination popup promo promoted promotion recommended related"
    " replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar"
    " widget widgets".split()
)
HEADER_WORDS = {"header", "banner", "masthead"}
# Words that make a name of boilerplate together with one of the above, as in share-bar or related-posts.
COMPANIONS = set(
    "area article articles aside author bar block blog body bottom box button buttons btn card cards center closed container"
    " content count entry feed form group header heading icon icons inline inner inpage input item items label left link links"
    " list main media meta module nav new news outer overlay page panel post posts right root row section single site slot small"
    " sticky stories story text thread title toggle top unit wrap wrapper".split()
)
SECTIONS = {"section", "header", "hgroup"}
# Mark of an element that is boilerplate also inside an article; no word of class or id is like it.
BOILERPLATE = "-"

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>\"']*)([^>]*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"([a-z])([A-Z])")
SPACE = re.compile(r"\s+")


MAIN_PARTS = "#main"


class Node:
    """An element with its blocks and slots. ``key``: tag and the marks of class, id and role."""

    __slots__ = ("tag", "key", "parts")

    def __init__(self, tag: str, key: str):
        self.tag, self.key, self.parts = tag, key, []


class Slot:
    """Text of a block between two of its blocks."""

    __slots__ = ("text", "linked")
    tag = key = "#"

    def __init__(self, text: str, linked: int):
        self.text, self.linked = text, linked


def _names_boilerplate(words: list[str]) -> bool:
    """Whether a whole class, id or role (its words) says boilerplate, not just one word of it."""
    drop = DROP_WORDS - HEADER_WORDS
    return not drop.isdisjoint(words) and all(w in DROP_WORDS or w in COMPANIONS or len(w) <= 2 for w in words)


def _marks(tag: str, attributes: str, code: bool = False) -> list[str]:
    """Words of class, id, role and itemprop, and ``BOILERPLATE`` if one of them names it as a whole.

    Digits do not count, as ids are often numbered. Ids of headings, prose and inline elements are
    not read, as they are made from the text; those of sections are, if as a whole they name
    boilerplate or the main part, but then not inside an article. In code nothing is boilerplate by name.
    """
    found, named = set(), False
    names = [(kind.lower(), token) for kind, value in ATTRIBUTE.findall(attributes) for token in value.strip("\"'").split()]
    section = tag in SECTIONS or any(kind == "class" and token.lower() == "section" for kind, token in names)
    for kind, token in names:
        if kind == "id" and (tag in PROSE or tag in INLINE):
            continue
        words = WORD.findall(CAMEL.sub(r"\1 \2", token).lower())
        whole = _names_boilerplate(words)
        if kind == "id" and section:
            if whole or not {"main", "article"}.isdisjoint(words):
                found.update(words)
            continue
        found.update(words)
        # a span of class comment is a comment in code
        named = named or whole and not code and not (tag in INLINE and words == ["comment"])
    return sorted(found | {BOILERPLATE}) if named else sorted(found)


def page_tree(source: str) -> Node:
    """The blocks and text slots of a page; markup may be broken or cut."""
    root = Node("#root", "#root")
    stack, texts, linked, links, at = [root], [], 0, 0, 0
    opened: Counter[str] = Counter()  # tags on the stack, and how many of them are articles or main parts

    def close(depth: int) -> None:
        for node in stack[depth:]:
            opened[node.tag] -= 1
            if opened[MAIN_PARTS]:
                opened[MAIN_PARTS] -= _is_article(node.key) > 0
        del stack[depth:]

    def close_tag(tag: str) -> None:
        depth = len(stack) - 1
        while stack[depth].tag != tag:
            depth -= 1
        close(depth)

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            plain = html.unescape(raw)
            texts.append(plain)
            if links:
                linked += len(plain)

    def flush() -> None:
        nonlocal linked
        if texts:
            whole = SPACE.sub(" ", "".join(texts)).strip()
            if whole:
                stack[-1].parts.append(Slot(whole, min(linked, len(whole))))
            texts.clear()
        linked = 0

    while True:
        m = TAG.search(source, at)
        if m is None:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        if m[1] is not None:
            text(m[1])
            continue
        name, closing, rest = m[3] or m[6], m[2] if m[3] else m[5], m[4] if m[3] else m[7]
        if name is None:
            continue
        name = name.lower()
        if name in RAW and not closing:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        if name in INLINE:
            marked = () if closing or not rest or name in VOID or opened["pre"] else _marks(name, rest)
            if BOILERPLATE not in marked and (opened[MAIN_PARTS] or DROP_WORDS.isdisjoint(marked)):
                if name == "br":
                    texts.append(" ")
                elif name == "a":
                    links = 0 if closing else 1
                if closing and name != "a" and opened[f"{name}!"]:
                    flush()
                    close_tag(f"{name}!")
                continue
            name += "!"
        if closing:
            if opened[name]:
                flush()
                links = 0
                close_tag(name)
            continue
        flush()
        links = 0
        if name in CLOSES_P and stack[-1].tag == "p":
            close(len(stack) - 1)
        if name in CLOSED_BY_SAME:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CLOSED_BY_SAME[name]:
                    close(i)
                    break
                if stack[i].tag in BARRIERS:
                    break
        node = Node(name, ".".join([name, *_marks(name.rstrip("!"), rest, opened["pre"] > 0)]) if rest else name)
        stack[-1].parts.append(node)
        if name not in VOID and not rest.rstrip().endswith("/"):
            stack.append(node)
            opened[name] += 1
            opened[MAIN_PARTS] += _is_article(node.key) > 0
    flush()
    return root


# ---------------------------------------------------------------- wrappers
# A wrapper is [key, optional, repeated, pages, parts]; the parts of a slot ("#") are
# [characters, linked characters, checksum of the text or -1 if it differs]; the key of a group
# of several parts is "(" and its parts' keys. Pages may nest without bound (tags that are never
# closed), so no function here calls itself for what a part contains.


def _fold(parts: list) -> list:
    """Make parts that follow themselves a repeated group, the shortest period first."""
    for period in range(1, LONGEST_GROUP + 1):
        out, i = [], 0
        while i < len(parts):
            keys = [p[0] for p in parts[i : i + period]]
            j = i + period
            while len(keys) == period and [p[0] for p in parts[j : j + period]] == keys:
                j += period
            if j == i + period or (period > 1 and all(k[0] in "#(" for k in keys)):
                out.append(parts[i])
                i += 1
                continue
            group = parts[i : i + period]
            for k in range(i + period, j, period):
                group = [merge(a, b, True) for a, b in zip(group, parts[k : k + period], strict=True)]
            if period == 1:
                group[0][2] = True
                out.append(group[0])
            else:
                out.append(["(" + "|".join(keys), False, True, 1, group])
            i = j
        parts = out
    return parts


def _slot_wrapper(slot: Slot) -> list:
    return ["#", False, False, 1, [len(slot.text), slot.linked, zlib.crc32(slot.text.encode("utf-8", "replace"))]]


def wrapper_of(part: Node | Slot) -> list:
    """The wrapper of one page, or of a part of it."""
    order, todo = [], [part]
    while todo:
        p = todo.pop()
        order.append(p)
        if p.key != "#":
            todo.extend(p.parts)
    done: dict[int, list] = {}
    for p in reversed(order):
        done[id(p)] = _slot_wrapper(p) if p.key == "#" else [p.key, False, False, 1, _fold([done.pop(id(x)) for x in p.parts])]
    return done[id(part)]


def merge(a: list, b: list, same_page: bool = False) -> list:
    """The wrapper that takes what either takes; both have the same key."""
    if a[0] == "#":
        return _merge_slots(a, b, same_page)
    waiting, result = [_merge(a, b, same_page)], None
    while waiting:
        try:
            waiting.append(_merge(*waiting[-1].send(result)))
            result = None
        except StopIteration as stop:
            result = stop.value
            waiting.pop()
    return result


def _merge_slots(a: list, b: list, same_page: bool) -> list:
    (m, k, x), (n, j, y) = a[4], b[4]
    return ["#", a[1] or b[1], a[2] or b[2], max(a[3], b[3]) if same_page else a[3] + b[3], [m + n, k + j, x if x == y else -1]]


# The generators below yield what they need merged, as (a, b, same page), and are sent the result.


def _merge(a: list, b: list, same_page: bool):
    pages = max(a[3], b[3]) if same_page else a[3] + b[3]
    return [a[0], a[1] or b[1], a[2] or b[2], pages, (yield from _align(a[4], b[4], same_page))]


def _pieces(a: list, b: list):
    """The two sides, or where they are very long both cut into as many pieces, which are aligned one with one."""
    n = max(1, -(-len(a) * len(b) // ALIGN_BITS))
    n = min(math.isqrt(n - 1) + 1, max(len(a), len(b), 1))
    for k in range(n):
        yield a[len(a) * k // n : len(a) * (k + 1) // n], b[len(b) * k // n : len(b) * (k + 1) // n]


def _common_counts(a: list[str], b: list[str]):
    """rest(i, j): how long the longest common subsequence of a[i:] and b[j:] is.

    A row of the table is kept as one whole number, a bit for each place where the count rises, and the next row
    comes of a few operations on it: a bit of memory a cell, and work by the machine word.
    """
    m = len(b)
    places: dict[str, int] = {}
    for j, key in enumerate(reversed(b)):
        places[key] = places.get(key, 0) | 1 << j
    full = (1 << m) - 1
    row, rows = full, [0] * (len(a) + 1)
    for i in range(len(a) - 1, -1, -1):
        hit = row & places.get(a[i], 0)
        row = ((row + hit) | (row - hit)) & full
        rows[i] = full ^ row
    return lambda i, j: (rows[i] & ((1 << (m - j)) - 1)).bit_count()


def _align(a: list, b: list, same_page: bool):
    """Longest common subsequence by keys; what only one side has becomes optional."""
    out: list = []
    if [x[0] for x in a] == [x[0] for x in b]:
        for x, y in zip(a, b, strict=True):
            out.append(_merge_slots(x, y, same_page) if x[0] == "#" else (yield x, y, same_page))
        return out
    for left, right in _pieces(a, b):
        n, m = len(left), len(right)
        rest = _common_counts([x[0] for x in left], [x[0] for x in right])
        i, j = 0, 0
        while i < n or j < m:
            if i < n and j < m and left[i][0] == right[j][0]:
                x, y = left[i], right[j]
                out.append(_merge_slots(x, y, same_page) if x[0] == "#" else (yield x, y, same_page))
                i, j = i + 1, j + 1
            elif j == m or i < n and rest(i + 1, j) >= rest(i, j + 1):
                out.append([left[i][0], True, *left[i][2:]])
                i += 1
            else:
                out.append([right[j][0], True, *right[j][2:]])
                j += 1
    return (yield from _fold_again(out))


def _fold_again(parts: list):
    """Neighbours of the same key, one of them repeated, are one repeated part."""
    out: list = []
    for p in parts:
        if out and out[-1][0] == p[0] and (out[-1][2] or p[2]):
            last = out[-1]
            out[-1] = _merge_slots(last, p, True) if p[0] == "#" else (yield last, p, True)
            out[-1][1], out[-1][2] = last[1] and p[1], True
        else:
            out.append(p)
    return out


def dump(w: list) -> str:
    """A wrapper or plan as JSON that does not nest: its parts in order, each with the number of its own parts."""
    out, todo = [], [w]
    while todo:
        p = todo.pop()
        if p[0] == "#":
            out.append(p)
        else:
            out.append([*p[:-1], len(p[-1])])
            todo.extend(reversed(p[-1]))
    return json.dumps(out)


def load(text: str) -> list:
    done: list = []
    for p in reversed(json.loads(text)):
        if p[0] != "#":
            p[-1] = [done.pop() for _ in range(p[-1])]
        done.append(p)
    return done[0]


# ---------------------------------------------------------------- rules


def _dropped(key: str, inside: bool) -> bool:
    tag, *marks = key.split(".")
    if tag in DROP_TAGS or (tag == "header" and not inside):
        return True
    if tag in ("html", "body", "#root", "article", "main"):
        return False
    return BOILERPLATE in marks if inside else not (DROP_WORDS | HEADER_WORDS).isdisjoint(marks)


def _is_article(key: str) -> int:
    """2: an article, 1: the main part, 0: neither."""
    tag, *marks = key.split(".")
    if tag == "article" or {"article", "body"} <= {*marks} or "articlebody" in marks:
        return 2
    return int(tag == "main" or "main" in marks)


def _preorder(w: list) -> list:
    out, todo = [], [w]
    while todo:
        p = todo.pop()
        out.append(p)
        if p[0] != "#":
            todo.extend(reversed(p[4]))
    return out


def _densest(w: list) -> list:
    """The smallest part that holds at least four fifths of the text outside links and boilerplate."""
    weights: dict[int, int] = {}
    for p in reversed(_preorder(w)):
        if p[0] == "#":
            weights[id(p)] = p[4][0] - p[4][1]
        else:
            dropped = p[0][0] != "(" and _dropped(p[0], False)
            weights[id(p)] = 0 if dropped else sum([weights[id(x)] for x in p[4]])
    total = weights[id(w)]
    while w[0] != "#":
        inner = next((p for p in w[4] if p[0] != "#" and p[0].split(".")[0] not in PROSE and weights[id(p)] >= 0.8 * total > 0), None)
        if inner is None or inner[2]:
            return w
        w = inner
    return w


# What holds a slot; a page gives the text of the first of these in which it has some.
IN_ARTICLE, IN_MAIN, IN_CORE, IN_PAGE = 8, 4, 2, 1


def decide(w: list) -> list:
    """What to take of the pages of a wrapper: [key, repeated, take, parts].

    ``take`` of a slot says in which of an article, the main part, the host's core and the page it is
    to be taken. The core is the part of the wrapper that holds nearly all text outside links, if that
    is not the whole body. In each of them, boilerplate by tag or class is left out, as are lists
    of links and short texts that all pages share outside prose.
    """
    core = _densest(w)
    if core[0].split(".")[0] in ("#root", "html", "body"):
        core = None
    varies = any(p[0] == "#" and p[4][2] == -1 for p in _preorder(w))
    whole: list = []
    todo = [(w, whole, IN_PAGE, 0, False)]
    while todo:
        p, parts, on, off, prose = todo.pop()
        if p[0] == "#":
            chars, linked, check = p[4]
            same = check != -1 and p[3] >= 5 and chars <= 60 * p[3] and varies
            doubtful = not prose and (same or linked >= 0.8 * chars)
            # what an article or the main part holds is theirs, however it looks
            take = on & ~off & (IN_ARTICLE | IN_MAIN if doubtful else -1)
            parts.append(["#", p[2], take, []])
            continue
        plan = [p[0], p[2], 0, []]
        parts.append(plan)
        if p[0][0] == "(":
            plan[1] = True
        else:
            inside = on & (IN_ARTICLE | IN_MAIN) | (IN_CORE if p is core else 0)
            if _dropped(p[0], True):
                off |= inside
            if _dropped(p[0], False):
                off |= (IN_ARTICLE | IN_MAIN | IN_CORE | IN_PAGE) & ~inside
            on |= (0, IN_MAIN, IN_ARTICLE | IN_MAIN)[_is_article(p[0])] | (IN_CORE if p is core else 0)
            prose = prose or p[0].split(".")[0] in PROSE
        if off != IN_ARTICLE | IN_MAIN | IN_CORE | IN_PAGE:
            todo.extend((x, plan[3], on, off, prose) for x in reversed(p[4]))
    return whole[0]


def extract(page: Node, plan: list) -> str:
    """The blocks that the wrapper takes of a page, joined by blanks.

    They are those of its articles, else of its main part, else of the host's core, else of the densest
    part of the page itself: a host may have templates with and without each of them.
    """

    def find(parts: list, key: str, start: int) -> tuple[int, list] | None:
        for i in range(start, len(parts)):
            if parts[i][0] == key:
                return i, parts[i]
            if parts[i][0][0] == "(":
                inner = find(parts[i][3], key, 0)
                if inner:
                    return i, inner[1]
        return None

    slots: list[tuple[Slot, int]] = []
    spans: dict[int, list] = {}  # of a part that is read: its first slot, the one after its last, whether it repeats
    frames = [[page, iter(page.parts), plan[3], 0]]
    spans[id(page)] = [0, 0, False]
    while frames:
        frame = frames[-1]
        owner, rest, plans, at = frame
        p = next(rest, None)
        if p is None:
            spans[id(owner)][1] = len(slots)
            frames.pop()
            continue
        hit = find(plans, p.key, at) or find(plans, p.key, 0)
        if hit is None:
            continue
        frame[3] = hit[0] if hit[1][1] or plans[hit[0]][0][0] == "(" else hit[0] + 1
        if p.key == "#":
            if hit[1][2]:
                slots.append((p, hit[1][2]))
        elif hit[1][3]:
            spans[id(p)] = [len(slots), len(slots), hit[1][1]]
            frames.append([p, iter(p.parts), hit[1][3], 0])
    for level in (IN_ARTICLE, IN_MAIN, IN_CORE):
        if any(take & level and p.linked < len(p.text) for p, take in slots):
            return " ".join([p.text for p, take in slots if take & level])
    before = [0]
    for p, take in slots:
        before.append(before[-1] + (len(p.text) - p.linked if take & IN_PAGE else 0))
    part: Node | None = page
    first, last = 0, len(slots)
    while part is not None:
        first, last, _ = spans[id(part)]
        found = (x for x in part.parts if id(x) in spans and x.tag not in PROSE)
        part = next((x for x in found if before[spans[id(x)][1]] - before[spans[id(x)][0]] >= 0.8 * before[-1] > 0), None)
        if part is not None and spans[id(part)][2]:
            break
    return " ".join([p.text for p, take in slots[first:last] if take & IN_PAGE])


# ---------------------------------------------------------------- Spark


def _infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, list] = {}
    chars = 0
    for batch in batches:
        for host, source in zip(batch["host"], batch["html"], strict=True):
            new = wrapper_of(page_tree(source))
            held[host] = merge(held[host], new) if host in held else new
            chars += len(source or "")
            if len(held) >= HELD_HOSTS or chars >= HELD_CHARS:
                yield _rows(held)
                held, chars = {}, 0
    yield _rows(held)


def _rows(held: dict[str, list]) -> pd.DataFrame:
    return pd.DataFrame({"host": list(held), "wrapper": [dump(w) for w in held.values()]}, dtype=object)


def _merge_sorted(last: bool):
    """Align the wrappers of each host; a partition comes sorted by host."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, whole, done = None, None, {}
        for batch in batches:
            for name, text in zip(batch["host"], batch["wrapper"], strict=True):
                new = load(text)
                if name == host:
                    whole = merge(whole, new)
                    continue
                if host is not None:
                    done[host] = decide(whole) if last else whole
                host, whole = name, new
            if len(done) >= HELD_HOSTS:
                yield _rows(done)
                done = {}
        if host is not None:
            done[host] = decide(whole) if last else whole
        yield _rows(done)

    return run


def host_of(url):
    """Host of a URL; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit("")))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper): for each host of ``pages`` (url, html), what to take of its pages, as JSON."""
    kind = "host string, wrapper string"
    rows = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    first = rows.mapInPandas(_infer, kind)
    salted = first.withColumn("_salt", F.pmod(F.xxhash64("wrapper"), F.lit(64)))
    second = salted.repartition("host", "_salt").sortWithinPartitions("host").select("host", "wrapper")
    third = second.mapInPandas(_merge_sorted(False), kind).repartition("host").sortWithinPartitions("host")
    return third.mapInPandas(_merge_sorted(True), kind)


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    plans = kept("wrapper plans", dict)
    for batch in batches:
        texts = []
        for source, plan in zip(batch["html"], batch["wrapper"], strict=True):
            if plan not in plans:
                if sum(map(len, plans)) > HELD_CHARS:
                    plans.clear()
                plans[plan] = load(plan)
            texts.append(extract(page_tree(source), plans[plan]))
        yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts})


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text), one row per row of ``pages`` (page_id, url, html).

    Other columns are not read. A null html counts as empty and gives an empty text; a page whose
    url has no host shares the wrapper of all such pages. The order of the rows is not kept.
    Wrappers are broadcast if they have at most 32 MB in all, else joined by host, where Spark
    splits the pages of a host with many.
    """
    wrappers = saved(infer_wrappers(pages), "wrappers")
    size = wrappers.agg(F.coalesce(F.sum(F.octet_length("wrapper") + F.octet_length("host")), F.lit(0))).first()[0]
    rows = pages.select(
        F.col("page_id").cast("string").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
        host_of(F.col("url")).alias("host"),
    )
    both = rows.join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers, "host")
    texts = both.select("page_id", "url", "html", "wrapper").mapInPandas(_extract, "page_id string, url string, text string")
    return texts.withColumn("page_id", F.col("page_id").cast("long"))
