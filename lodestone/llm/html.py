"""Main text of web pages by wrappers inferred for each host.

A wrapper is a union-free regular expression over a page's token stream, kept as a tree: elements, text slots, and marks for optional (?) and
repeated (+) parts. Inference is iterative alignment: a page is folded into an expression (equal neighbours become repeated groups, also runs of up to PERIOD
different elements), then aligned with the wrapper so far; where they differ, the part that one side lacks becomes optional, and texts that differ become slots, while
a text that all pages share stays a constant; each part counts the pages that hold it, each slot the characters outside links. Alignment runs inside each partition first, then over SALTS groups of a host, then over the host, so a host with
a third of all pages costs one small expression a partition.

A page is then read along its host's wrapper. The wrapper says where the main region is: from the body down, into the element that holds MAIN_SHARE of the characters of varying slots (those on
TEMPLATE_SHARE of the pages), as long as there is one that is not repeated and is made of blocks; with it go the headings that stand beside it on the way. Where the wrapper has article or main elements with NAMED_SHARE of those
characters, names settle it: the region is what lies in these. Hosts of fewer than TEMPLATE_PAGES pages show no variation to go by; there names decide, else the body is the region. From the region go
menus, headers, footers, sidebars, notices, adverts, forms and comments (by element and class names), constants of the wrapper (where other slots vary, and
TEMPLATE_PAGES pages or more and TEMPLATE_SHARE of the host's hold them), and, outside articles, blocks that are mostly links.

Defined cases: null html gives an empty text; null url is a host of its own; broken and cut-off markup is read as far as it goes (a cut tag is dropped, open elements end
with the page); elements nested deeper than DEPTH melt into their ancestor at that depth, and their text with them, but for those left out by name; a page without the region is read whole; repeated pages give a row each; very long pages are read whole; where a place has more than WIDE parts, those that may be held by one page in RARE or fewer fold into a wildcard beside the others, by
lossy counting: a part counts at most one page in RARE too few, so none that is template text or the main region goes, however wide the pages or large the host.
An empty table gives none.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import small_batches, staged, table

PERIOD, SALTS, WIDE, RARE, TEMPLATE_PAGES, TEMPLATE_SHARE, HOSTS = 4, 32, 64, 16, 5, 0.5, 2000
DEPTH, MAIN_SHARE, NAMED_SHARE = 100, 0.6, 0.25
#: Cells of an alignment table held at once.
CELLS = 1 << 24
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|[^<]+|<""", re.S)
CUT = re.compile(r"[a-zA-Z/!?]")
NAMES = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
# Element and class names of HTML practice.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "xmp"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
CLOSES = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
BLOCKS = {"p", "div", "ul", "ol", "dl", "table", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "header", "footer", "nav", "aside", "form", "main", "blockquote", "pre", "figure", "hr", "address"}
AWAY = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "object", "canvas", "audio", "video", "header"}
AWAY_NAMES = {
    "ad", "ads", "advert", "advertisement", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "dialog", "disqus", "footer", "header",
    "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pager", "pagination", "popup", "promo", "related", "replies", "respond", "search", "share", "sharing",
    "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget", "complementary", "contentinfo",
}
MAIN_NAMES = {"main", "articlebody"}
HEADINGS = {"h1", "h2", "h3"}


def label_of(tag: str, attributes: str) -> str:
    """tag and its names, digits dropped: 'div.ad'."""
    if not attributes:
        return tag
    names = [w for _, v in NAMES.findall(attributes) for w in re.split(r"[^a-z]+", v.strip("\"'").lower()) if w]
    return ".".join([tag, *dict.fromkeys(names)]) if names else tag


def parse(page: str) -> list:
    """The page as nested [label, children]; a text is ['#', text, characters inside links]. Inline elements melt into their text."""
    root = ["", [], "", False]  # of an open element also its tag, and whether it is in an article
    stack, opened, text, linked, links = [root], Counter(), [], 0, 0

    def flush() -> None:
        nonlocal linked
        if text:
            words = " ".join(entities.unescape("".join(text)).split())
            if words:
                stack[-1][1].append(["#", words, linked])
            text.clear()
        linked = 0

    def close(i: int) -> None:
        opened.subtract(n[2] for n in stack[i:])
        del stack[i:]

    at, end, last = 0, len(page), page.rfind(">")
    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            found = m[0]
            if found[0] != "<":
                text.append(found)
                linked += len(found) if links else 0
            elif found == "<":
                if last < at and CUT.match(page, at):
                    break  # a cut tag ends the page
                text.append(found)
            continue
        tag, closing = tag.lower(), bool(m[1])
        if tag in INLINE:
            links = max(0, links + (0 if tag != "a" else -1 if closing else 1))
            continue
        flush()
        if tag == "br":
            continue
        if closing:
            if opened[tag] > 0:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][2] == tag))
                links = 0
            continue
        if tag in RAW:
            ended = re.compile(f"</{tag}\\s*>", re.I).search(page, at)
            at = ended.end() if ended else end
            continue
        if tag in CLOSES or tag in BLOCKS:
            for i in range(len(stack) - 1, 0, -1):
                open_tag = stack[i][2]
                if open_tag == tag and tag in CLOSES or open_tag == "p" and tag in BLOCKS:
                    close(i)
                    break
                if open_tag not in ("p", "dt", "dd") or tag in ("li", "tr", "td", "th"):
                    break
        label, above = label_of(tag, m[3]), stack[-1]
        inside = above[3] or _main(label)
        if len(stack) <= DEPTH:
            node = [label, [], tag, inside]
            above[1].append(node)
        else:
            node = [label, [] if _away(label, above[3]) else above[1], tag, inside]
        if tag not in VOID:
            stack.append(node)
            opened[tag] += 1
    flush()
    return root


# An expression: [label, children, optional, repeated, text, pages, missed, chars]; text: of a constant slot, else None; pages: how many hold it; missed: at most
# so many more may have held it before it was counted; chars: of a slot, outside links, over all pages. Rare parts that are no longer told apart are one part "*", the last of its list,
# with a text that varies. A group of several repeated elements is labelled "()".


def _rest(chars: int) -> list:
    return ["*", [["#", [], 1, 1, None, 0, 0, chars]], 1, 1, None, 0, 0, 0]


def _chars(e: list) -> int:
    total = e[7]
    for c in e[1]:
        total += _chars(c)
    return total


def folded(node: list) -> list:
    if node[0] == "#":
        return ["#", [], 0, 0, node[1], 1, 0, max(0, len(node[1]) - node[2])]
    return [node[0], collapsed([folded(c) for c in node[1]]), 0, 0, None, 1, 0, 0]


def merged(a: list, b: list, across: bool = True) -> list:
    """The least expression of this form that covers both. across: a and b are of different pages, so their pages add up; parts of one page
    (or of pages that may be the same) count no page twice."""
    text = a[4] if a[4] == b[4] else None
    pages, missed = (a[5] + b[5], a[6] + b[6]) if across else (max(a[5], b[5]), max(a[6], b[6]))
    children = aligned(a[1], b[1], a[5] if across else 0, b[5] if across else 0)
    return [a[0], _rare_folded(children, pages) if across else children, a[2] | b[2], a[3] | b[3], text, pages, missed, a[7] + b[7]]


def _rare_folded(items: list, pages: int) -> list:
    """items of an element on so many pages, the rare ones as a wildcard where they are more than WIDE."""
    if len(items) <= WIDE:
        return items
    kept, gone = [], 0
    for e in items:
        if e[0] == "*" or (e[5] + e[6]) * RARE <= pages and not _holds_main(e):
            gone += _chars(e)
        else:
            kept.append(e)
    return items if len(kept) == len(items) - (items[-1][0] == "*") else [*kept, _rest(gone)]


def _holds_main(e: list) -> bool:
    if _main(e[0]):
        return True
    for c in e[1]:
        if _holds_main(c):
            return True
    return False


def _key(e: list) -> str:
    return e[0] if e[0] != "()" else "()" + ",".join(_key(c) for c in e[1])


def _group(items: list) -> list:
    return ["()", items, 0, 1, None, max(e[5] for e in items), max(e[6] for e in items), 0]


def collapsed(items: list) -> list:
    """Equal neighbours, and equal neighbouring runs, as repeated parts."""
    out: list = []
    for e in items:
        if out and _key(out[-1]) == _key(e):
            out[-1] = merged(out[-1], e, False)
            out[-1][3] = 1
        else:
            out.append(e)
    for period in range(2, PERIOD + 1):
        i = 0
        while i + 2 * period <= len(out):
            keys = [_key(e) for e in out[i : i + 2 * period]]
            if keys[:period] == keys[period:]:
                group = _group(out[i : i + period])
                j = i + period
                while [_key(e) for e in out[j : j + period]] == keys[:period]:
                    group = merged(group, _group(out[j : j + period]), False)
                    j += period
                out[i:j] = [group]
            i += 1
    return out


def _pairs(ka: np.ndarray, kb: np.ndarray) -> list[tuple[int, int]]:
    """Places of a longest common subsequence."""
    n, m = len(ka), len(kb)
    if n * m > CELLS and n > 1:  # halves of ka, with the split of kb that keeps the length
        half = n // 2
        head, tail = _lengths(ka[:half], kb)[-1], _lengths(ka[half:][::-1], kb[::-1])[-1][::-1]
        at = int(np.argmax(head.astype(np.int64) + tail))
        return _pairs(ka[:half], kb[:at]) + [(i + half, j + at) for i, j in _pairs(ka[half:], kb[at:])]
    best = _lengths(ka[::-1], kb[::-1], True)[::-1, ::-1]
    found, i, j = [], 0, 0
    while i < n and j < m:
        if ka[i] == kb[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return found


def _lengths(ka: np.ndarray, kb: np.ndarray, whole: bool = False) -> np.ndarray:
    """Lengths of longest common subsequences of the first i and first j keys, for all i or only the last."""
    table = np.zeros((len(ka) + 1 if whole else 2, len(kb) + 1), dtype=np.int32)
    for i, key in enumerate(ka):
        above, row = (table[i], table[i + 1]) if whole else (table[i % 2], table[(i + 1) % 2])
        np.maximum(above[1:], above[:-1] + (kb == key), out=row[1:])
        np.maximum.accumulate(row, out=row)
    return table if whole or len(ka) % 2 else table[::-1]


def aligned(a: list, b: list, pages_a: int = 0, pages_b: int = 0) -> list:
    """Two child lists as one: a longest common subsequence is merged, the rest becomes optional. pages: of their parents, where these are of different pages."""
    across = pages_a > 0
    rest_a, rest_b = (bool(x) and x[-1][0] == "*" for x in (a, b))
    rest = [_rest(sum(_chars(x[-1]) for x, r in ((a, rest_a), (b, rest_b)) if r))] if rest_a or rest_b else []
    a, b = a[:-1] if rest_a else a, b[:-1] if rest_b else b
    ka, kb = [_key(e) for e in a], [_key(e) for e in b]
    if ka == kb:
        out = [merged(x, y, across) for x, y in zip(a, b, strict=True)]
    else:
        number: dict[str, int] = {}
        same = _pairs(*(np.array([number.setdefault(k, len(number)) for k in keys], dtype=np.int64) for keys in (ka, kb)))
        # what one side lacks it may have had among its rare parts
        missed_a, missed_b = pages_a // RARE * rest_a, pages_b // RARE * rest_b
        out, i, j = [], 0, 0
        for x, y in [*same, (len(a), len(b))]:
            out += [[*e[:2], 1, *e[3:6], e[6] + missed_b, e[7]] for e in a[i:x]] + [[*e[:2], 1, *e[3:6], e[6] + missed_a, e[7]] for e in b[j:y]]
            if x < len(a):
                out.append(merged(a[x], b[y], across))
            i, j = x + 1, y + 1
        out = collapsed(out)
    return out + rest


def _short(text: str) -> str:
    if len(text) <= 48:
        return text
    import xxhash

    return "\0" + xxhash.xxh64_hexdigest(text.encode("utf-8", "surrogatepass"))


def _constants_shortened(e: list) -> list:
    """Long constant texts by digest, so that an expression stays small."""
    return [e[0], [_constants_shortened(c) for c in e[1]], e[2], e[3], None if e[4] is None else _short(e[4]), *e[5:]]


def _away(label: str, in_main: bool) -> bool:
    tag, *names = label.split(".")
    return (tag in AWAY and not (tag == "header" and in_main)) or any(n in AWAY_NAMES and not (n == "header" and in_main) for n in names)


def _main(label: str) -> bool:
    tag, *names = label.split(".")
    return tag in ("article", "main") or any(n in MAIN_NAMES for n in names)


def _survey(e: list, in_main: bool, found: dict) -> None:
    """Has the wrapper a main region, and slots that vary inside and outside it?"""
    if e[0] == "#":
        found["varies", in_main] = found.get(("varies", in_main), False) or e[4] is None
    elif e[0] == "()" or not _away(e[0], in_main):
        inside = in_main or _main(e[0])
        found["main"] = found.get("main", False) or inside
        for c in e[1]:
            _survey(c, inside, found)


class Wrapper:
    def __init__(self, expression: list | None, pages: int) -> None:
        self.expression = expression
        found: dict = {}
        if expression:
            _survey(expression, False, found)
        # constants are template text only where something else varies
        self.least = max(TEMPLATE_PAGES, TEMPLATE_SHARE * pages)
        self.drops = {inside: pages >= TEMPLATE_PAGES and found.get(("varies", inside), False) for inside in (True, False)}
        self.named, self.region, self.headings = found.get("main", False), None, set()
        if expression and pages >= TEMPLATE_PAGES:
            self._choose(expression)
        if self.region is not None:  # it was chosen for what varies in it
            self.drops[True] = True
        self.has_main = self.named or self.region is not None

    def _constant(self, e: list) -> bool:
        return e[4] is not None and not e[3] and e[5] >= self.least

    def _varying(self, e: list, named: bool = False) -> int:
        """Characters of the varying slots of a part that TEMPLATE_SHARE of the pages hold; named: of those in article or main elements."""
        if e[0] == "#":
            return 0 if named or self._constant(e) or e[5] + e[6] < self.least else e[7]
        if _away(e[0], False):
            return 0
        named, total = named and not _main(e[0]), 0
        for c in e[1]:
            total += self._varying(c, named)
        return total

    def _choose(self, e: list) -> None:
        """Names settle the region where it has most of the varying text, else its share of that does."""
        whole = self._varying(e)
        if not whole or self.named and self._varying(e, True) >= NAMED_SHARE * whole:
            return
        self.named, way = False, []
        while True:
            parts = [(self._varying(c), c) for c in e[1]]  # a repeated group is no region
            mass, best = max(parts, key=lambda x: x[0], default=(0, e))
            blocks = [c for c in best[1] if c[0] != "#"]
            if mass < MAIN_SHARE * sum(m for m, _ in parts) or best[0] in ("#", "*", "()") or best[3] or not blocks:
                break
            way += [c for c in e[1] if c[0].split(".")[0] in HEADINGS]
            e = best
            self.region = id(e)
        self.headings = {id(c) for c in way}

    def _begins(self, label: str, slot: list | None) -> bool:
        return _main(label) if self.named else slot is not None and (id(slot) == self.region or id(slot) in self.headings)

    def text(self, page: str | None) -> str:
        if not page:
            return ""
        root = parse(page)
        if self.has_main:
            blocks, entered = [], []
            self._read(root, self.expression, False, True, blocks, entered)
            if entered:
                return " ".join(blocks)
        blocks = []
        self._read(root, self.expression, False, False, blocks, [])
        return " ".join(blocks)

    def _read(self, node: list, e: list | None, in_main: bool, need_main: bool, blocks: list[str], entered: list) -> None:
        """Texts of node's children along e; entered: gets a mark where the main region begins."""
        slots = _flat(e[1]) if e else []
        labels = {x[0] for x in slots}
        at = 0
        for child in node[1]:
            slot = None
            for k in range(len(slots) if child[0] in labels else 0):  # the wrapper's next place of this label; repeated groups come round again
                if slots[(at + k) % len(slots)][0] == child[0]:
                    at = (at + k) % len(slots)
                    slot = slots[at]
                    break
            if child[0] == "#":
                if need_main and not in_main:
                    continue
                constant = slot is not None and self._constant(slot) and self.drops[in_main] and slot[4] == _short(child[1])
                if not constant and (in_main or 2 * child[2] < len(child[1])):
                    blocks.append(child[1])
            elif not _away(child[0], in_main):
                begins = self._begins(child[0], slot)
                if begins and id(slot) not in self.headings:
                    entered.append(True)
                self._read(child, slot, in_main or begins, need_main, blocks, entered)


def _flat(items: list) -> list:
    return [x for e in items for x in (_flat(e[1]) if e[0] == "()" else [e])]


PART = "host string, pages long, wrapper string"


def host_of() -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _pack(host: str, pages: int, e: list) -> tuple[str, int, str]:
    return host, pages, json.dumps(e, separators=(",", ":"))


def _infer(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A wrapper for each host of the partition; given out and begun anew beyond HOSTS hosts."""
    held: dict[str, list] = {}
    for b in batches:
        for host, page in zip(b["host"], b["html"], strict=True):
            if page:
                e = _constants_shortened(folded(parse(page)))
                if host in held:
                    held[host] = [held[host][0] + 1, merged(held[host][1], e)]
                else:
                    held[host] = [1, e]
        if len(held) > HOSTS:
            yield pd.DataFrame([_pack(h, *x) for h, x in held.items()], columns=["host", "pages", "wrapper"])
            held = {}
    yield pd.DataFrame([_pack(h, *x) for h, x in sorted(held.items())], columns=["host", "pages", "wrapper"])


def _merge(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Folds runs of rows of one host; rows come sorted."""
    host, pages, e = None, 0, None
    for b in batches:
        out = []
        for h, n, w in zip(b["host"], b["pages"], b["wrapper"], strict=True):
            if h == host:
                pages, e = pages + n, merged(e, json.loads(w))
            else:
                if host is not None:
                    out.append(_pack(host, pages, e))
                host, pages, e = h, n, json.loads(w)
        yield pd.DataFrame(out, columns=["host", "pages", "wrapper"])
    if host is not None:
        yield pd.DataFrame([_pack(host, pages, e)], columns=["host", "pages", "wrapper"])


def wrappers(pages: DataFrame) -> DataFrame:
    """One row per host: host, pages, wrapper (JSON)."""
    small_batches(pages.sparkSession)
    part = pages.select(host_of().alias("host"), F.col("html").cast("string").alias("html")).mapInPandas(_infer, PART)
    salted = part.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    once = salted.repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper").select("host", "pages", "wrapper").mapInPandas(_merge, PART)
    return once.repartition("host").sortWithinPartitions("host", "wrapper").mapInPandas(_merge, PART)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""
    found = staged(wrappers(pages), "wrappers").withColumnRenamed("pages", "host_pages")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_of().alias("host"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, Wrapper] = {}
        for b in batches:
            texts = []
            for host, n, w, page in zip(b["host"], b["host_pages"], b["wrapper"], b["html"], strict=True):
                if host not in known:
                    if len(known) > HOSTS:
                        known.clear()
                    known[host] = Wrapper(json.loads(w) if isinstance(w, str) else None, int(n) if n == n and n is not None else 0)
                texts.append(known[host].text(page))
            yield pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    # the wrappers' files tell their size: small, they are broadcast; else pages meet them by host, in splittable partitions
    return rows.join(found, "host", "left").select("page_id", "url", "html", "host", "host_pages", "wrapper").mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
