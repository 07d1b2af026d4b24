"""Main text of web pages by consensus host paths.

Pass 1 scores each page's containers: text that is not linked and not in believed furniture counts for every container
that holds it, and the page descends from its body to the smallest container that still holds most of it.  A container
is known by its path of tags and generalised classes (digits become ``#``).  Each page gives its choice one vote
(shared with the containers in it where none of them holds most and it has no text of its own); votes are summed per
(host, path) in Spark, map-side first, so a host with a third of all pages costs no more than any other.
Pass 2 takes from each page the blocks under the first of its host's winning paths, most votes first, that has text
there; a page that has none of them falls back to its own choice.  What lies outside that container is left out by the
vote alone, whatever it is called.

Furniture is looked for only below the container taken, so names of the container and of what holds it don't matter:
elements like ``nav`` and ``aside``, forms made of fields, elements with a furniture name that hold no heading and no
larger part of the text, and lists of links before the first or after the last block of text.  A heading ``h1`` that
stands above the container is the article's title if the container has none.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridia.llm.support import materialize, sized

# Element classes of HTML, and words that name page furniture.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "select", "video", "audio", "canvas", "button"}
FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "head"}
CONTAINER = {"article", "main", "section", "div", "td", "body", "center", "nav", "header", "footer", "aside", "form", "menu", "dialog"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "dialog"}
TEXT_ELEMENT = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "pre", "blockquote", "li", "dd"}
CLOSES_ITSELF = {"p", "li", "td", "tr", "dd", "dt"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar"}
FURNITURE_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "cookie", "cookies", "consent", "notice", "banner", "promo", "popup", "modal", "newsletter", "subscribe", "share", "sharing", "social", "related", "recommended", "widget", "pagination", "pager", "login", "search"}
COMMENT_WORDS = {"comment", "comments", "commentlist", "disqus", "replies", "respond"}
# Words that make a name a state of an element that is something else: has-sidebar, share-enabled.
STATE_FIRST = {"has", "with", "without", "no", "is", "not", "show", "hide", "js", "can", "use", "supports"}
STATE_LAST = {"enabled", "disabled", "supported", "active", "inactive", "open", "opened", "closed", "visible", "hidden", "on", "off", "ready", "loaded", "layout"}

_TOKEN = re.compile(
    r"<!--(?:.*?--!?>|.*\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z>][^>]*+>|<(?=[a-zA-Z/!?])[^>]*+\Z", re.S
)
_ATTR = re.compile(r"""(?:^|[\s/"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")
_WHITE = re.compile(r"[ \t\n\f\r]+")
_NAME, _COMMENT, _TAG = 1, 2, 3  # how firmly an element is marked as furniture


def _token_mark(token: str) -> int:
    words = [w.lower() for w in _WORDS.findall(token)]
    if not words or words[0] in STATE_FIRST or words[-1] in STATE_LAST:
        return 0
    ends = {words[0], words[-1]}
    return _COMMENT if ends & COMMENT_WORDS else _NAME if ends & FURNITURE_WORDS else 0


def _names(attrs: str) -> tuple[str, int]:
    """Generalised class (an id where there is none) and the firmest mark of class, id and role."""
    cls, ident, mark = "", "", 0
    for m in _ATTR.finditer(attrs):
        value, kind = m[2] or m[3] or m[4] or "", m[1].lower()
        if kind == "role":
            mark = max(mark, _TAG if value.strip().lower() in ROLES else 0)
            continue
        tokens = value.split()
        mark = max([mark, *map(_token_mark, tokens)])
        if kind == "class":
            cls = "." + ".".join(sorted(_DIGITS.sub("#", value).split())) if tokens else ""
        else:
            ident = "@" + _DIGITS.sub("#", tokens[0]) if tokens else ""
    return cls or ident, mark


class Page:
    """Elements in page order (parents first) and the blocks of text in them; element 0 is the page itself."""

    __slots__ = ("tag", "parent", "path", "steps", "ids", "mark", "within", "fields", "blocks", "text", "plain", "holds")

    def __init__(self, page: str):
        self.tag, self.parent, self.path, self.mark, self.within, self.fields = [""], [-1], [0], [0], [0], [0]
        self.steps: list[tuple[int, str]] = [(-1, "")]  # a path is its number: the path above and its last step
        self.ids: dict[tuple[int, str], int] = {}
        self.blocks: list[tuple[int, list[tuple[str, int]], int]] = []  # element, (raw text, element) pieces, linked characters
        self._parse(page)
        n = len(self.tag)
        self.text, self.plain, self.holds = [0] * n, [0] * n, [False] * n
        for at, pieces, linked in self.blocks:
            size = sum(len(t) for t, _ in pieces)
            self.text[at] += size
            self.plain[at] += max(0, size - 2 * linked)
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            self.text[p] += self.text[i]
            self.plain[p] += self.plain[i]
            self.fields[p] += self.fields[i]
            self.holds[p] |= self.holds[i] or self.tag[i] in ("h1", "article", "main") and self.mark[i] == 0
            if self.tag[i] == "form" and self.mark[i] < _TAG and self.fields[i] and self.plain[i] < 100 * self.fields[i]:
                self.mark[i] = _TAG  # a form made of fields; one that wraps a page is none

    def _open(self, tag: str, parent: int, attrs: str) -> int:
        cls, mark = _names(attrs) if "=" in attrs else ("", 0)
        if tag == "body":
            mark = 0
        elif tag in FURNITURE and tag != "form":
            inside, up = False, parent
            while tag == "header" and up > 0 and not inside:
                inside, up = self.tag[up] in ("article", "main"), self.parent[up]
            mark = mark if inside else _TAG  # a header inside an article holds its title
        i = len(self.tag)
        self.tag.append(tag)
        self.parent.append(parent)
        self.mark.append(mark)
        self.fields.append(0)
        self.within.append(i if tag in CONTAINER else self.within[parent])
        path = self.path[parent]
        if tag in CONTAINER:
            step = (path, tag + cls.replace(">", "_"))
            path = self.ids.setdefault(step, len(self.steps))
            if path == len(self.steps):
                self.steps.append(step)
        self.path.append(path)
        return i

    def path_of(self, i: int) -> str:
        """The path of an element's container, ``>`` before each step."""
        names, at = [], self.path[i]
        while at > 0:
            at, name = self.steps[at]
            names.append(name)
        return "".join(">" + n for n in reversed(names))

    def _number(self, path: str) -> int:
        at = 0
        for name in path.split(">")[1:]:
            at = self.ids.get((at, name), -1)
        return at

    def _parse(self, page: str) -> None:
        stack, parts = [0], []
        linked, in_link, at, n = 0, False, 0, len(page)
        tags = self.tag

        def flush() -> None:
            nonlocal linked
            if parts:
                if any(not t.isspace() for t, _ in parts):
                    here = next(i for i in reversed(stack) if i == 0 or tags[i] in BLOCK)
                    self.blocks.append((here, parts.copy(), linked))
                parts.clear()
            linked = 0

        while at < n:
            m = _TOKEN.search(page, at)
            stop = m.start() if m else n
            if stop > at:
                parts.append((page[at:stop], stack[-1]))
                linked += stop - at if in_link else 0
            if m is None:
                break
            at = m.end()
            if not m[2]:
                continue
            tag, closing = m[2].lower(), bool(m[1])
            if tag == "br":
                parts.append((" ", stack[-1]))
                continue
            if tag in ("input", "select", "textarea", "button") and not closing:
                self.fields[stack[-1]] += 1
            if tag in RAW:
                if not closing and not (m[3].endswith("/") and tag in ("svg", "math")):
                    end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                    if end or tag in ("script", "style"):
                        close = page.find(">", end.end() - 1) if end else -1
                        at = close + 1 if close >= 0 else n
                continue
            if tag == "a":
                in_link = not closing
                if "=" not in m[3] or closing or not _names(m[3])[1]:
                    continue
            if tag not in BLOCK:
                if tag in VOID:
                    continue
                if closing:
                    if tags[stack[-1]] == tag:
                        stack.pop()
                elif tags[stack[-1]] not in BLOCK and stack[-1] or tag != "a" and "=" in m[3] and _names(m[3])[1] or tag == "label":
                    stack.append(self._open(tag, stack[-1], m[3]))  # marked inline elements, and what they hold
                continue
            flush()
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == tag:
                        del stack[k:]
                        break
            elif tag == "body":
                if not any(tags[i] == "body" for i in stack):
                    stack = [0, self._open(tag, 0, m[3])]
            elif tag not in VOID:
                while stack[-1] and tags[stack[-1]] not in BLOCK:
                    stack.pop()  # an inline element left open ends with its block
                if tag in CLOSES_ITSELF and tags[stack[-1]] == tag:
                    stack.pop()
                stack.append(self._open(tag, stack[-1], m[3]))
        flush()

    def furniture(self, top: int, level: int = _NAME) -> list[bool]:
        """Per element whether it is, or lies in, furniture below ``top``; names weaker than ``level`` aren't believed."""
        half, out, inside = self.plain[top] / 2, [False] * len(self.tag), [False] * len(self.tag)
        inside[top] = True
        for i in range(top + 1, len(self.tag)):
            p = self.parent[i]
            if not inside[p]:
                continue
            inside[i], mark = True, self.mark[i]
            believed = mark == _TAG or mark == _COMMENT and level <= mark and not self.holds[i]
            believed |= mark == _NAME and level <= mark and not self.holds[i] and self.tag[i] != "h1" and self.plain[i] <= half
            out[i] = out[p] or believed or self.tag[i] == "label" and self._in_form(i)
        return out

    def _in_form(self, i: int) -> bool:
        while i > 0 and self.tag[i] != "form":
            i = self.parent[i]
        return i > 0

    def good(self, gone: list[bool]) -> list[int]:
        """Per element the text in it that is neither linked nor furniture."""
        out = [0] * len(self.tag)
        for at, pieces, linked in self.blocks:
            if not gone[at]:
                out[at] += max(0, sum(len(t) for t, e in pieces if not gone[e]) - 2 * linked)
        for i in range(len(out) - 1, 0, -1):
            out[self.parent[i]] += out[i]
        return out

    def choice(self) -> int:
        """The smallest container that holds most of the page's good text (-1: there is none)."""
        return self.ballot()[0]

    def ballot(self) -> tuple[int, dict[int, float]]:
        """The choice, and the page's vote: whole for a choice with text of its own, else shared with the containers in it."""
        for level in (_NAME, _COMMENT, _TAG):
            gone = self.furniture(0, level)
            good = self.good(gone)
            if good[0]:
                break
        else:
            return -1, {}
        kids, own = defaultdict(list), defaultdict(int)
        for i in range(1, len(self.tag)):
            if self.within[i] == i and good[i]:
                kids[self.within[self.parent[i]]].append(i)
            elif self.tag[i] in TEXT_ELEMENT and good[i] and not gone[i]:
                own[self.within[i]] += good[i]
        at = 0
        while kids[at]:
            named = [i for i in kids[at] if self.tag[i] in ("article", "main")]
            best = named[0] if len(named) == 1 else max(kids[at], key=lambda i: (good[i], -i))
            share, only = good[best] / good[at], len(named) == 1
            if own[at] and self.tag[at] not in ("body", "") and not (best in named and share >= 0.5):
                break  # a container with text of its own isn't split
            if share < (0.25 if only else 0.5 if named and best in named else 0.95 if self.tag[best] == "section" else 0.6):
                break
            at = best
        if own[at] and self.tag[at] not in ("body", "") or not kids[at]:
            return at, {at: 1.0}
        return at, {at: 0.25} | {i: 0.75 * good[i] / good[at] for i in kids[at]}

    def extract(self, winners: list[str]) -> str:
        taken: list[int] = []
        for path in map(self._number, winners):
            found = [i for i in range(len(self.tag)) if path > 0 and self.within[i] == i and self.path[i] == path and 2 * self.plain[i] > self.text[i]]
            if found:
                taken = found
                break
        if not taken:
            own = self.choice()
            taken = [own] if own >= 0 else []
        out: list[tuple[int, str]] = []
        for top in taken:
            if not any(self._under(top, t) for t in taken if t != top):
                out += self._below(top)
        if taken and not any(self.tag[i] == "h1" for i, _ in out):
            out = self._title(taken, out) + out
        return "\n".join(t for _, t in out)

    def _under(self, i: int, top: int) -> bool:
        while i > top:
            i = self.parent[i]
        return i == top

    def _below(self, top: int) -> list[tuple[int, str]]:
        for level in (_NAME, _COMMENT, _TAG):
            gone = self.furniture(top, level)
            kept = [(at, joined(p for p, e in pieces if not gone[e]), linked) for at, pieces, linked in self.blocks if not gone[at] and self._under(at, top)]
            kept = [b for b in kept if b[1]]
            if kept:
                break
        for end in (0, -1):  # lists of links at either end
            while kept and (lot := self._list(kept[end][0], top)):
                run = [b for b in kept if self._under(b[0], lot)]
                size, links = sum(len(b[1]) for b in run), sum(b[2] for b in run)
                if len(run) < 3 or links < 0.8 * size or len(run) == len(kept):
                    break
                kept = [b for b in kept if not self._under(b[0], lot)]
        return [b[:2] for b in kept]

    def _list(self, i: int, top: int) -> int:
        """The outermost list around an element below ``top`` (0: none)."""
        found = 0
        while i > top:
            if self.tag[i] in ("ul", "ol", "menu"):
                found = i
            i = self.parent[i]
        return found

    def _title(self, taken: list[int], out: list[tuple[int, str]]) -> list[tuple[int, str]]:
        gone, above, i = self.furniture(0), set(), taken[0]
        while i >= 0:
            above.add(i)
            i = self.parent[i]
        for at, pieces, _ in self.blocks:
            if at > taken[0]:
                break
            box = self.within[at]
            if self.tag[at] == "h1" and not gone[at] and (box in above or self.parent[box] in above and self.text[box] == self.text[at]):
                return [(at, joined(p for p, e in pieces if not gone[e]))]
        return []


def joined(pieces) -> str:
    text = "".join(pieces)
    return _WHITE.sub(" ", html.unescape(text) if "&" in text else text).strip(" ")


def main_text(page: str, winners: list[str] | None = None) -> str:
    return Page(page).extract(winners or [])


def _votes(batches):
    for batch in batches:
        total: dict[tuple[str, str], float] = defaultdict(float)
        for h, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            p = Page(page or "")
            for i, share in p.ballot()[1].items():
                if i:
                    total[h, p.path_of(i)] += share
        rows = sorted(total.items())
        columns = [pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, names=["host", "path", "votes"])


def _texts(batches):
    for batch in batches:
        texts = [main_text(p or "", w) for p, w in zip(batch.column("html").to_pylist(), batch.column("winners").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


#: Winning paths a host keeps: a page that has none of them goes by its own choice.
PATHS = 8


def winners(pages: DataFrame) -> DataFrame:
    """(host, winners): one row per host, its paths with at least a tenth of its votes, most votes first, ties to the
    lesser path."""
    votes = pages.mapInArrow(_votes, "host string, path string, votes double").groupBy("host", "path").agg(F.round(F.sum("votes"), 6).alias("votes"))
    votes = materialize(votes)
    total = votes.groupBy("host").agg(F.sum("votes").alias("all"))
    order = Window.partitionBy("host").orderBy(F.desc("votes"), "path")
    ranked = votes.withColumn("at", F.row_number().over(order)).where(F.col("at") <= PATHS).join(total, "host").where(F.col("votes") * 10 >= F.col("all"))
    lists = ranked.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("at", "path"))).alias("l"))
    return materialize(lists.select("host", F.col("l.path").alias("winners")))


def extract(pages: DataFrame, salts: int = 32) -> DataFrame:
    """page_id, url, text, n_chars: one row per input row, in whatever columns ``pages`` has besides.

    Null or empty html and pages without a text outside furniture give an empty text; a null url belongs to the host '';
    rows repeating a page_id are pages of their own.  A page is parsed whole, in memory of a small multiple of its size.
    Hosts' paths are broadcast when they are few, else joined by (host, salt), so that no host is one task.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/:?#]+)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("string").alias("html"), host.alias("host"))
    best = winners(rows.select("host", "html")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    few = best.where("salt = 0").drop("salt")
    small = sized(few)
    if small is few:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(salts)).cast("int"))
        joined_rows = rows.join(best, ["host", "salt"], "left")
    else:
        joined_rows = rows.join(small, "host", "left")
    return joined_rows.select("page_id", "url", "html", "winners").mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
