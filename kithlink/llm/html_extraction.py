"""Main text of web pages by wrappers inferred per host.

A page is a stream of tags and texts, cut at the elements that make a region: a region's own stream holds its texts, each
after a block tag, and the regions in it. Streams of the same region of one host's pages are aligned one after the other
with the host's wrapper, which has a union-free regular expression for each region. At first all texts of the first page
are template. Aligned texts that are equal stay template; aligned texts that differ become slots; what repeats becomes a
repeated group; what one side lacks becomes optional, and neighbouring options a repeated group of optional tags.

A page's text is what lies in the content slots of its main region. The main region is that of all outermost article and
main elements if there is text in one, else the region with most varying text outside links, by the wrapper. There,
template is what the wrapper has aligned on every page: a text that stands once at the same place of each page, under
regions that each page has once, on pages that differ otherwise (`EVIDENCE` of them), and that isn't most of the text, as
on a host of near copies. Elements made for menus, headers, footers, sidebars and forms are furniture. Class and id words
are a hint: a region that they mark as furniture isn't content while the main region has other text.

Regions are folded per task and merged by host and region, so a host with a third of all pages is never one task's work.
A region seen on one page only tells that page nothing it doesn't know; a host's wrapper holds the others.

Defined cases: null and empty html have no text; a page without any content slot gives the empty text; pages that share
a page_id or a url are extracted each by itself; urls without a host share the host ''; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as _html
import json
import re
from bisect import bisect_left
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithlink.llm.common import materialise

#: Comments and declarations; elements whose content is raw; tags. A quote opens a value only after an equals sign.
_ATTRIBUTES = r"(?>[^>=]++|=\s*+(?>\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)?+)*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)|"
    rf"<(script|style|noscript|iframe|textarea|title)(?=[\s/>]){_ATTRIBUTES}>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)|"
    rf"<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"(?<![^\s/\"'])(class|id|role|hidden|aria-hidden|style)(?=[\s=/>]|\Z)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?", re.I)
#: Elements inside a line of text; all others begin a new block. Fixed values.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that make a region. Fixed values.
REGIONS = set("article main nav header footer aside form section div body td th figure dialog ul ol table template svg object select button".split())
FURNITURE_TAGS = {"nav", "header", "footer", "aside", "form", "dialog", "template", "svg", "object", "select", "button"}
CONTENT_ROLES, FURNITURE_ROLES = {"main", "article"}, {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert"}
#: Words of a class or id that mark furniture. Fixed values.
FURNITURE = set(
    "ad ads advert advertisement adverts sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar side rail "
    "widget footer header masthead topbar toolbar cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup login "
    "share sharing social comment comments commentlist disqus replies reply respond related recommended recommendations pagination pager search form copyright legal disclaimer".split()
)
#: Words that may stand beside those in one class name; with any other word the name isn't furniture. Fixed values.
BESIDE = set(
    "area bar block body bottom box button buttons center column container content entry fixed global icon icons inner item items left link links list main page panel post posts "
    "primary right row secondary section site sticky text thread title top wrap wrapper".split()
)
#: Of those, words of headers, which an article has too. Fixed values.
HEADERS, OF_CONTENT = {"header", "masthead", "banner"}, {"content", "entry", "post", "posts", "title", "text", "body"}
#: Pages of different texts that a text must be on to be template.
EVIDENCE = 4
#: Tags of a repeated group before regions count by their elements, so that classes of single pages don't widen it for ever.
GROUP = 256
_SPACE, _WORD = re.compile(r"\s+"), re.compile(r"[a-z]+")


def _furniture(names: str, in_content: bool) -> bool:
    for name in names.lower().split():
        words = set(_WORD.findall(name))
        hit = words & FURNITURE
        if hit and not words - FURNITURE - BESIDE and not (hit <= HEADERS and (in_content or words & OF_CONTENT)):
            return True
    return False


def _hash(text: str) -> str:
    import xxhash

    return xxhash.xxh64_hexdigest(text)


@lru_cache(1 << 16)
def _region(parent: str, step: str) -> str:
    return _hash(f"{parent}/{step}")


class Page:
    """blocks: (text, characters, those in links, region, kind), in page order; regions: (path, region around it, kind, stream).

    A stream has (symbol, block) for a text, with the block tag before it as symbol, and (step, -1) for a region; only steps
    hold a dot. Kinds: m in an article or main element, c other content, n and d the same marked by class words, f furniture."""

    def __init__(self, page: str):
        self.blocks: list[tuple[str, int, int, int, str]] = []
        self.regions: list[tuple[str, int, str, list]] = [("", 0, "c", [])]
        stack: list[tuple[str, int, str]] = []  # tag, region, mark before
        here, kind, last, links, at = 0, "c", "^", 0, 0
        run: list[str] = []
        linked = 0

        def end():
            nonlocal linked
            if run:
                text = _SPACE.sub(" ", "".join(run)).strip()
                if text:
                    n = len(text) - text.count(" ")
                    self.regions[here][3].append((last, len(self.blocks)))
                    self.blocks.append((text, n, min(n, linked), here, kind))
                run.clear()
                linked = 0

        def add(text):
            nonlocal linked
            text = _html.unescape(text)
            run.append(text)
            if links:
                linked += len(text) - text.count(" ")

        for m in _TOKEN.finditer(page):
            if m.start() > at and kind != "f":
                add(page[at : m.start()])
            at = m.end()
            name = m[3]
            if not name:
                continue
            name, closing = name.lower(), bool(m[2])
            if name == "a":
                links = 0 if closing else 1
            if name in INLINE:
                continue
            end()
            last = f"/{name}" if closing else name
            if "." in last:
                last = last.replace(".", "-")
            if name not in REGIONS:
                continue
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        here = self._parent(stack, k)
                        del stack[k:]
                        kind = stack[-1][2] if stack else "c"
                        break
            elif not (m[4].rstrip().endswith("/") and name in ("svg", "object")):
                if name in ("td", "th") and stack and stack[-1][0] in ("td", "th"):  # a cell ends where the next begins
                    here = self._parent(stack, len(stack) - 1)
                    stack.pop()
                    kind = stack[-1][2] if stack else "c"
                step, kind = self._enter(name, m[4], kind)
                path = _region(self.regions[here][0], step)
                self.regions[here][3].append((step, -1))
                self.regions.append((path, here, kind, []))
                stack.append((name, len(self.regions) - 1, kind))
                here = len(self.regions) - 1
        if at < len(page) and kind != "f":
            add(page[at:])
        end()

    @staticmethod
    def _parent(stack, k: int) -> int:
        return stack[k - 1][1] if k else 0

    @staticmethod
    def _enter(name: str, attributes: str, kind: str) -> tuple[str, str]:
        """The step and the kind of a region that begins inside one of `kind`."""
        given, role = {}, ""
        if attributes:
            for x in _ATTR.finditer(attributes):
                given.setdefault(x[1].lower(), x[2] or x[3] or x[4] or "")
            role = given.get("role", "").lower()
        inside = kind in "mn"
        if kind != "f":
            hidden = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "").lower()
            # A header inside the article holds its title; a page's own header does not.
            if hidden or role in FURNITURE_ROLES or (name in FURNITURE_TAGS and not (name == "header" and inside)):
                kind = "f"
            elif kind in "cm" and name not in ("body", "main") and _furniture(f"{given.get('class', '')} {given.get('id', '')}", inside):
                kind = "n" if inside else "d"
            elif kind == "c" and (name in ("article", "main") or role in CONTENT_ROLES):
                kind = "m"
        # Articles and pages have classes of their own: they don't make another region, nor do numbers.
        first = "" if name in ("article", "main", "body") else re.sub(r"\d+", "#", given.get("class", "").strip().partition(" ")[0])
        return f"{name}.{role if role in CONTENT_ROLES else first}", kind

    def kinds(self) -> str:
        """The kinds of text that the main text is looked for in."""
        there = {b[4] for b in self.blocks}
        return next((k for k in ("m", "n") if k in there), "cd")


# A node is ["t", symbol], ["+", nodes], ["?", nodes] or ["*", symbols]: a tag, a repeated group, an optional group, and
# a repeated group of optional tags, in which any number of the symbols may stand.


def _key(node) -> str:
    return json.dumps(node, ensure_ascii=False)


def _symbols(nodes) -> list[str]:
    out: dict[str, None] = {}
    for kind, x in nodes:
        out |= dict.fromkeys([x] if kind == "t" else x if kind == "*" else _symbols(x))
    return list(out)


def _group(symbols) -> list:
    """A repeated group of optional tags. One of very many regions is one of any region of their elements."""
    out = sorted(set(symbols))
    return ["*", out if len(out) <= GROUP else sorted({s.partition(".")[0] + ".*" if "." in s else s for s in out})]


def repeated(nodes: list) -> list:
    """Runs of equal neighbours of up to 8 nodes become repeated groups."""
    for size in range(1, 9):
        if len(nodes) < 2 * size:
            break
        keys, out, i = [_key(n) for n in nodes], [], 0
        while i < len(nodes):
            unit, n = keys[i : i + size], 1
            while len(unit) == size and keys[i + n * size : i + (n + 1) * size] == unit:
                n += 1
            if n > 1 and not (size == 1 and nodes[i][0] in "+*?"):
                out.append(["+", nodes[i : i + size]])
                i += n * size
            elif n > 1:
                out.append(nodes[i])
                i += n
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def align(a: list, b: list) -> list:
    """The expression that accepts what a and b accept. Options that meet, or meet their own tags, become one group, so that
    it has no more nodes than twice the required ones of either side and one."""
    ka, kb, out = [_key(n) for n in a], [_key(n) for n in b], []
    for op, i, j, k, m in SequenceMatcher(None, ka, kb, autojunk=False).get_opcodes():
        x, y = a[i:j], b[k:m]
        if op == "equal":
            out += x
        elif len(x) == len(y) == 1 and x[0][0] in "t+" and y[0][0] in "t+" and _symbols(x) == _symbols(y):
            out.append(["+", [["t", s] for s in _symbols(x)]] if len(_symbols(x)) == 1 else _group(_symbols(x)))
        elif x and y:
            out.append(_group(_symbols(x) + _symbols(y)))
        else:
            out += [n if n[0] in "?*" else ["?", [n]] for n in x + y]
    merged: list = []
    for n in out:
        loose = merged and (merged[-1][0] in "?*" and n[0] in "?*" or "*" in (merged[-1][0], n[0]) and set(_symbols([n])) & set(_symbols(merged[-1:])))
        if loose:
            merged[-1] = _group(_symbols([merged[-1], n]))
        else:
            merged.append(n)
    return repeated(merged)


@lru_cache(4096)
def _compiled(expression: str):
    nodes = json.loads(expression)
    chars = {s: chr(0xE000 + i) if i < 6000 else chr(0xF0000 + i) for i, s in enumerate(_symbols(nodes))}

    def write(nodes):
        return "".join(chars[x] if kind == "t" else "[" + "".join(chars[s] for s in x) + "]*+" if kind == "*" else f"(?:{write(x)})" + ("++" if kind == "+" else "?") for kind, x in nodes)

    return chars, re.compile(write(nodes))


def accepts(nodes: list, tags: list[str]) -> bool:
    if not nodes:
        return not tags
    chars, pattern = _compiled(_key(nodes))
    found = [chars.get(t) or chars.get(t.partition(".")[0] + ".*") for t in tags]
    return None not in found and bool(pattern.fullmatch("".join(found)))


def _closed(x: list, y: list) -> bool:
    """Whether no text of one can be template of the other's between two places: equal expressions, or both of regions alone."""
    if x == y:
        return True
    if not all("." in s for s in _symbols(x + y)):
        return False
    return any(all(k == "t" for k, _ in v) and accepts(u, [s for _, s in v]) for u, v in ((x, y), (y, x)))


def anchors(ka: list, ga: list, kb: list, gb: list) -> list[tuple[int, int]]:
    """Which template texts of two streams are the same, in order. ka, kb: their keys; ga, gb: the expressions around them.

    Texts of one key are the same if only closed expressions part them from the ends or from others that are, or if each
    is the only one of its key between such others."""
    out, todo = [], [(0, len(ka), 0, len(kb))]
    while todo:
        a, a2, b, b2 = todo.pop()
        while a < a2 and b < b2 and ka[a] == kb[b] and _closed(ga[a], gb[b]):
            out.append((a, b))
            a, b = a + 1, b + 1
        while a < a2 and b < b2 and ka[a2 - 1] == kb[b2 - 1] and _closed(ga[a2], gb[b2]):
            a2, b2 = a2 - 1, b2 - 1
            out.append((a2, b2))
        if a >= a2 or b >= b2:
            continue
        na, nb = Counter(ka[a:a2]), Counter(kb[b:b2])
        at = {k: i for i, k in enumerate(kb[b:b2], b) if nb[k] == 1}
        pairs = [(i, at[k]) for i, k in enumerate(ka[a:a2], a) if na[k] == 1 and k in at]
        chain = _rising(pairs)
        if chain:
            out += chain
            ends = [(a - 1, b - 1), *chain, (a2, b2)]
            todo += [(i + 1, i2, j + 1, j2) for (i, j), (i2, j2) in zip(ends, ends[1:])]
    return sorted(out)


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, ascending in the first, that ascends in the second too."""
    tops: list[int] = []
    best: list[int] = []
    before: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tops, j)
        before.append(best[k - 1] if k else -1)
        if k == len(tops):
            tops.append(j)
            best.append(n)
        else:
            tops[k], best[k] = j, n
    out, n = [], best[-1] if best else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


class Region:
    """A region's expression: gaps[0], texts[0], gaps[1], ... texts are template (symbol, hash, characters); gaps are nodes, whose
    tags stand for slots or for regions. pages, chars and linked are sums; pages of different texts are told by `different`."""

    def __init__(self, texts: list, gaps: list, pages: int = 1, chars: int = 0, linked: int = 0, different: list | None = None, around: str = ""):
        self.texts, self.gaps, self.pages, self.chars, self.linked, self.different, self.around = texts, gaps, pages, chars, linked, different or [], around

    @classmethod
    def of(cls, page: Page, i: int, hashes: dict[int, str] | None = None) -> Region:
        texts, gaps = [], [[]]
        for symbol, block in page.regions[i][3]:
            if block < 0:
                gaps[-1].append(["t", symbol])
            else:
                texts.append([symbol, hashes[block] if hashes else _hash(page.blocks[block][0]), page.blocks[block][1]])
                gaps.append([])
        return cls(texts, gaps)

    def keys(self) -> list[tuple[str, str]]:
        return [(t[0], t[1]) for t in self.texts]

    def _nodes(self, i: int, j: int) -> list:
        """From after text i to before text j, texts between them as slots."""
        out = list(self.gaps[i + 1])
        for k in range(i + 1, j):
            out += [["t", self.texts[k][0]], *self.gaps[k + 1]]
        return out

    def align(self, other: Region) -> None:
        """Widen this expression to what other accepts."""
        ka, kb = self.keys(), other.keys()
        if ka == kb and self.gaps == other.gaps:
            return
        same = [(-1, -1), *anchors(ka, self.gaps, kb, other.gaps), (len(ka), len(kb))]
        gaps = []
        for (i, j), (i2, j2) in zip(same, same[1:]):
            x, y = self._nodes(i, i2), other._nodes(j, j2)
            if i2 > i + 1:
                x = repeated(x)
            if x != y:
                if not (all(k == "t" for k, _ in y) and accepts(x, [s for _, s in y])):
                    x = align(x, repeated(y))
            gaps.append(x)
        self.texts, self.gaps = [self.texts[i] for i, _ in same[1:-1]], gaps

    def merge(self, other: Region) -> None:
        self.align(other)
        self.pages, self.chars, self.linked = self.pages + other.pages, self.chars + other.chars, self.linked + other.linked
        self.different = sorted({*self.different, *other.different})[:EVIDENCE]  # as many as are needed to tell

    def to_json(self) -> str:
        return json.dumps([self.texts, self.gaps, self.pages, self.chars, self.linked, self.different, self.around], ensure_ascii=False)

    @classmethod
    def from_json(cls, s: str) -> Region:
        return cls(*json.loads(s))


class Wrapper:
    """The regions of a host's pages by path."""

    def __init__(self, regions: dict[str, Region] | None = None):
        self.regions = regions or {}

    def add_page(self, html: str) -> None:
        page = Page(html)
        kind = page.kinds()
        hashes = {i: _hash(b[0]) for i, b in enumerate(page.blocks)}
        mark = _hash("".join(hashes[i] for i, b in enumerate(page.blocks) if b[4] in kind))
        sums: dict[int, list[int]] = {}
        for _, n, linked, at, _ in page.blocks:
            s = sums.setdefault(at, [0, 0])
            s[0] += n
            s[1] += linked
        mine: dict[str, Region] = {}
        for i, (path, around, k, _) in enumerate(page.regions):
            if k == "f":
                continue
            r = Region.of(page, i, hashes)
            r.around, r.different = page.regions[around][0], [mark]
            r.chars, r.linked = sums.get(i, (0, 0))
            if path in mine:
                mine[path].merge(r)
                mine[path].pages = 1
            else:
                mine[path] = r
        for path, r in mine.items():
            if path in self.regions:
                self.regions[path].merge(r)
            else:
                self.regions[path] = r

    def digest(self) -> dict:
        """What a page needs of it: {path: [varying characters outside links on a page, whether that is sure, how many
        regions further out have it once each, template texts, the expressions around these]}."""
        out, ups = {}, {}
        once: dict[tuple[str, str], bool] = {}
        for path, r in self.regions.items():
            plain = Counter(n[1] for g in r.gaps for n in g if n[0] == "t")
            loose = {s for g in r.gaps for n in g if n[0] != "t" for s in _symbols([n])}
            for s, n in plain.items():
                once[(path, _region(path, s))] = n == 1 and s not in loose
        for path, r in self.regions.items():
            if r.pages < 2:  # its one page knows it itself
                continue
            chain, at = [], path
            while at not in ups and at and at in self.regions and once.get((self.regions[at].around, at)):
                chain.append(at)
                at = self.regions[at].around
            for n, p in enumerate(reversed(chain), ups.setdefault(at, 0) + 1):
                ups[p] = n
            sure = len(r.different) >= EVIDENCE
            fixed = sum(t[2] for t in r.texts) if sure else 0
            out[path] = [round((r.chars - 2 * r.linked) / r.pages - fixed, 3), sure, ups[path], r.texts if sure else [], r.gaps if sure and r.texts else []]
        return out


def _template(page: Page, far: dict[int, int], kind: str, known: dict) -> set[int]:
    """Blocks that the wrapper has as template. far: the page's regions in the main one, and how far in."""
    out: set[int] = set()
    mean = 0.0
    for i, n in far.items():
        value, _, up, texts, gaps = known.get(page.regions[i][0], (0.0, False, 0, (), ()))
        mean += value + sum(t[2] for t in texts)
        if texts and up >= n:
            r = Region.of(page, i)
            at = [b for _, b in page.regions[i][3] if b >= 0]
            out |= {at[j] for _, j in anchors([(t[0], t[1]) for t in texts], gaps, r.keys(), r.gaps)}
    out = {b for b in out if page.blocks[b][4] in kind}
    own = sum(b[1] for b in page.blocks if b[3] in far and b[4] in kind)
    return out if 2 * sum(page.blocks[b][1] for b in out) < max(own, mean) else set()


def extract(html: str, known: dict) -> str:
    """known: a wrapper's digest."""
    page = Page(html)
    kind = page.kinds()
    if kind != "cd":
        main = {i for i, (_, around, k, _) in enumerate(page.regions) if k in "mn" and page.regions[around][2] not in "mn"}
    else:
        own: dict[int, float] = {}
        for _, n, linked, at, _ in page.blocks:
            own[at] = own.get(at, 0.0) + n - 2 * linked
        by_path: dict[str, float] = {}
        for i, x in own.items():
            path, _, k, _ = page.regions[i]
            value, sure, *_ = known.get(path, (0.0, False))
            if k == "c":
                by_path[path] = value if path in known else by_path.get(path, 0.0) + x
            elif sure and value > 0:  # class words outweigh a quarter of what varies
                by_path[path] = value / 4
        if not by_path:
            return ""
        best = max(by_path, key=lambda p: (by_path[p], p))
        path = best if by_path[best] * 2 >= sum(max(x, 0) for x in by_path.values()) else ""
        main = {i for i, r in enumerate(page.regions) if r[0] == path}
        kind = next(page.regions[i][2] for i in main)
    far: dict[int, int] = {}
    for i, (_, around, _, _) in enumerate(page.regions):  # outer regions come first
        if i in main:
            far[i] = 0
        elif i and around in far:
            far[i] = far[around] + 1
    gone = _template(page, far, kind, known)
    return " ".join(b[0] for i, b in enumerate(page.blocks) if b[3] in far and b[4] in kind and i not in gone)


def host(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def infer(pages: DataFrame) -> DataFrame:
    """(host, path, region) of pages (url, html): each host's wrapper, a row for each region."""
    names = ["host", "path", "region"]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=names)

    def fold(batches):
        held: dict[str, Wrapper] = {}

        def out():
            return batch([(h, p, r.to_json()) for h, w in held.items() for p, r in w.regions.items()])

        for b in batches:
            for h, page in zip(b.column(0).to_pylist(), b.column(1)):
                held.setdefault(h, Wrapper()).add_page(page.as_py())
            if sum(len(w.regions) for w in held.values()) > 50_000:
                yield out()
                held.clear()
        if held:
            yield out()

    def merge(batches):
        """Rows sorted by host and path."""
        now, r = None, None
        for b in batches:
            done = []
            for h, p, x in zip(*(c.to_pylist() for c in b.columns)):
                if (h, p) == now:
                    r.merge(Region.from_json(x))
                    continue
                if now is not None:
                    done.append((*now, r.to_json()))
                now, r = (h, p), Region.from_json(x)
            if done:
                yield batch(done)
        if now is not None:
            yield batch([(*now, r.to_json())])

    schema = "host string, path string, region string"
    parts = pages.select(host().alias("host"), F.coalesce("html", F.lit("")).alias("html")).mapInArrow(fold, schema)
    return parts.repartition("host", "path").sortWithinPartitions(*names).mapInArrow(merge, schema)


def digests(wrappers: DataFrame) -> DataFrame:
    """(host, known): the digest of each host's wrapper."""

    def run(batches):
        for b in batches:
            known = [json.dumps(Wrapper({x["path"]: Region.from_json(x["region"]) for x in rs}).digest(), sort_keys=True) for rs in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(known, pa.string())], names=["host", "known"])

    # A region of one page is of no use to others; around a region of more pages there is none of one.
    held = wrappers.where(F.get_json_object("region", "$[2]").cast("long") > 1)
    return held.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("path", "region"))).alias("regions")).mapInArrow(run, "host string, known string")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars)"""
    known = materialise(digests(infer(pages)), "wrappers")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host().alias("host"), F.coalesce("html", F.lit("")).alias("html"))

    def run(batches):
        read: dict[str | None, dict] = {None: {}}
        for b in batches:
            texts = []
            for page, w in zip(b.column(2), b.column(3).to_pylist()):
                if w not in read:
                    if len(read) > 2000:
                        read.clear()
                        read[None] = {}
                    read[w] = json.loads(w)
                texts.append(extract(page.as_py(), read[w]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    joined = rows.join(known, "host", "left").select("page_id", "url", "html", "known")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
