"""Main text of web pages by consensus of their host.

Every page scores its containers by the text they hold and votes for the best one. A vote names a
generalised path, the tags and classes from the root with every run of digits as "#". Votes are summed
per (host, path) with partial sums, so a host with any share of the pages is no hot group; paths with a tenth
of their host's votes win, ten at most. The pages are then read again and cut out by the first
winning path they have. A page without one, or where it holds less than a fifth of the page's own
best, goes by its own vote. Winners are joined by host; Catalyst picks the join by their written size.

Left out by tag, class, id or role: menus, headers (but not the headings of an article's own header),
footers, sidebars, notices, adverts, forms, scripts, styles and reader comments. A name does not drop an
element that holds a main heading, nor, as a part of a longer name, one with most of the page's text. ``br`` and cell borders are white space inside a
block. Null or empty pages give empty texts, a null or malformed URL the host "", repeated rows a row each, an
empty table no rows; other columns are not read. Work grows linearly with a page, unclosed tags included.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake.llm.common import release_memory, stage, with_fields

#: Winning paths hold at least one of so many votes of their host.
VOTES_SHARE = 10
#: A winning path is left for a page's own vote where it holds less than this part of its text.
LEAST_PART = 0.2
#: An unnamed container is worth a vote if it holds this part of the page's text.
TIGHT = 0.9

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody tfoot thead tr ul".split()
)
CELLS = frozenset(("td", "th"))
#: Tags that end an open paragraph.
ENDS_P = BLOCKS - frozenset("body caption head html legend optgroup option select tbody tfoot thead tr".split())
#: Elements that an end tag or an implied end does not reach through.
WALLS = frozenset("table td th caption button object template".split())
#: What a start tag closes, and what it does not look beyond.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "option": (("option",), ("select",)),
    "td": (CELLS, ("table",)), "th": (CELLS, ("table",)), "tr": (("tr",), ("table",)), "tbody": (("tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot"), ("table",)), "thead": (("tbody", "thead", "tfoot"), ("table",)),
}
TABLE_TAGS = frozenset("table tbody tfoot thead tr td th caption".split())
IN_HEAD = frozenset("base link meta title style script noscript template".split())

DROPPED_TAGS = frozenset("head noscript template nav footer aside form menu button select object canvas svg math audio video dialog search datalist".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
COMMENT_NAMES = frozenset("comment comments commentlist commentary disqus respond replies responses".split())
DROPPED_NAMES = COMMENT_NAMES | frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion banner nav navbar navigation menu "
    "menus submenu breadcrumb breadcrumbs sidebar sidebars rail footer foot copyright colophon cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "pagination pager widget widgets toolbar skip masthead topbar form".split()
)
#: A name behind one of these says what the element goes with, not what it is.
NEGATIONS = frozenset("has with no without not is".split())
HEADER_NAMES = frozenset(("header", "masthead"))
CONTENT_NAMES = frozenset("article content post entry story main body text".split())
FACTORS = {"article": 2.0, "main": 1.5}
CONTAINERS = frozenset("article main section div td body html center blockquote".split())

TOKEN = re.compile(
    r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>=]++|=\s*+(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?+)*+)(?:>|\Z)"
    r"|[!?/][^>]*(?:>|\Z))",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
NAMES = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
DIGITS = re.compile(r"[0-9]+")
RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


class Page:
    """Elements in page order (parents before children) and the pieces of text with their element and block."""

    def __init__(self, source: str):
        self.parent, self.tag, self.names, self.marks, self.path, self.plain = [-1], [""], [frozenset()], [""], [0], [False]
        self.paths: dict[tuple[int, str], int] = {}
        self.texts: list[tuple[int, int, str]] = []
        self._stack, self._open, self._block = [0], defaultdict(list), 0
        self._read(source)

    # reading

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            start = source.find("<", at)
            found = TOKEN.match(source, start) if start >= 0 else None
            while start >= 0 and not found:  # a bare "<" is text
                start = source.find("<", start + 1)
                found = TOKEN.match(source, start) if start >= 0 else None
            self._text(source[at : start if start >= 0 else size])
            if not found:
                return
            at, tag = found.end(), found["tag"]
            if not tag:
                continue
            tag = tag.lower()
            if found["end"]:
                self._end(tag)
            elif self._start(tag, found["rest"]) and tag in RAW:
                close = RAW_ENDS[tag].search(source, at)
                if not close:
                    return
                at = close.start()

    def _text(self, text: str) -> None:
        if text:
            self.texts.append((self._stack[-1], self._block, text))

    def _last(self, tags) -> int:
        """The place in the stack of the last open element among ``tags``, or -1."""
        return max((self._open[t][-1] for t in tags if self._open[t]), default=-1)

    def _cut(self, place: int) -> None:
        """Closes the element at this place of the stack and all inside it."""
        while len(self._stack) > place:
            tag = self.tag[self._stack.pop()]
            self._open[tag].pop()
            self._block += tag in BLOCKS

    def _start(self, tag: str, rest: str) -> bool:
        if tag in ("html", "body", "head") and self._open[tag]:
            return False
        if self._open["head"] and tag not in IN_HEAD:
            self._cut(self._last(("head",)))
        if tag in ENDS_P and (place := self._last(("p",))) > self._last(WALLS):
            self._cut(place)
        if tag in CLOSES:
            closed, walls = CLOSES[tag]
            if (place := self._last(closed)) > self._last(walls):
                self._cut(place)
        self._block += tag in BLOCKS
        if tag == "br" or tag in CELLS:
            self._text(" ")
        if tag in VOID:
            return False
        found: dict[str, str] = {}
        if rest.strip(" /\t\r\n\f"):
            for name, *values in ATTRIBUTE.findall(rest):
                found.setdefault(name.lower(), next(filter(None, values), ""))
        classes = sorted({DIGITS.sub("#", c) for c in found.get("class", "").split()})
        label = ".".join([tag, *classes])
        above = self._stack[-1]
        key = (self.path[above], label)
        self.path.append(self.paths.setdefault(key, len(self.paths) + 1))
        self.parent.append(above)
        self.tag.append(tag)
        words = [w.lower() for w in NAMES.findall(f"{found.get('class', '')} {found.get('id', '')}")] if "class" in found or "id" in found else []
        self.names.append(frozenset(w for i, w in enumerate(words) if not i or words[i - 1] not in NEGATIONS))
        self.plain.append(bool(words) and not DROPPED_NAMES.isdisjoint(f"{found.get('class', '')} {found.get('id', '')}".lower().split()))
        hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true"
        self.marks.append("hidden" if hidden else "articlebody" if found.get("itemprop", "").lower() == "articlebody" else found.get("role", "").lower())
        self._open[tag].append(len(self._stack))
        self._stack.append(len(self.parent) - 1)
        return True

    def _end(self, tag: str) -> None:
        if tag in ("html", "body"):  # what follows still belongs to the page
            return
        place = self._last(HEADINGS if tag in HEADINGS else (tag,))
        if place < 0 or tag not in TABLE_TAGS and place < self._last(WALLS - {tag}):
            return
        if tag in BLOCKS or tag in WALLS or all(self.tag[n] not in BLOCKS for n in self._stack[place + 1 :][-64:]):
            self._cut(place)

    # judging

    def judge(self) -> None:
        """Drops what is no main text; weighs the rest."""
        n = len(self.parent)
        own, inside = [0] * n, [0] * n
        self.last = list(range(n))
        for node, _, text in self.texts:
            own[node] += len(text)
        inside = own.copy()
        titled = [t in ("h1", "main") for t in self.tag]
        for node in range(n - 1, 0, -1):
            above = self.parent[node]
            inside[above] += inside[node]
            titled[above] |= titled[node]
            self.last[above] = max(self.last[above], self.last[node])
        self.dropped, linked, article, heading, header = [False] * n, [False] * n, [False] * n, [False] * n, [False] * n
        for node in range(1, n):
            above, tag, names, mark = self.parent[node], self.tag[node], self.names[node], self.marks[node]
            linked[node] = linked[above] or tag == "a"
            heading[node] = heading[above] or tag in HEADINGS
            core = titled[node] or not self.plain[node] and mark not in DROPPED_ROLES and 2 * inside[node] > inside[0]
            drop = self.dropped[above] or mark == "hidden" or tag in RAW
            if not drop and tag in DROPPED_TAGS:
                drop = not (tag == "form" and core)
            if not drop and tag not in ("html", "body"):
                drop = not names.isdisjoint(COMMENT_NAMES) and not titled[node] or not core and (not names.isdisjoint(DROPPED_NAMES) or mark in DROPPED_ROLES)
            article[node] = article[above] or tag in ("article", "main")
            is_header = tag == "header" or not names.isdisjoint(HEADER_NAMES) and tag not in HEADINGS and (self.plain[node] or 2 * inside[node] <= inside[0])
            header[node] = header[above] or is_header
            if is_header and not article[node] and not drop:
                drop = tag == "header" or not core
            self.dropped[node] = drop
        # of a header inside an article only the headings stay
        self.silent = [d or (header[i] and article[i] and not heading[i]) for i, d in enumerate(self.dropped)]
        weights = defaultdict(lambda: [0, 0, 0])
        for node, block, text in self.texts:
            if not self.silent[node] and (size := len(text.strip())):
                block = weights[block]
                block[0] += size
                block[1] += size if linked[node] else 0
                block[2] = node
        self.weight = [0] * n
        for size, links, node in weights.values():
            self.weight[node] += max(0, size - 2 * links)
        for node in range(n - 1, 0, -1):
            self.weight[self.parent[node]] += self.weight[node]

    def scores(self) -> dict[int, int]:
        """Thousandths by path, of the containers worth a vote."""
        whole = self.weight[0]
        if not whole:
            return {}
        sums, factors = defaultdict(int), {}
        for node in range(1, len(self.parent)):
            tag, path = self.tag[node], self.path[node]
            if self.dropped[node] or tag not in CONTAINERS or not self.weight[node] or path == self.path[self.parent[node]]:
                continue
            factor = FACTORS.get(tag, 0)
            if tag not in ("body", "html"):
                factor = max(factor, 1.5 if self.marks[node] in ("main", "articlebody") else 1.3 if not self.names[node].isdisjoint(CONTENT_NAMES) else 0)
            if factor or self.weight[node] >= TIGHT * whole:
                sums[path] += self.weight[node]
                factors[path] = max(factors.get(path, 0), factor)
        # unnamed containers hold nearly all; the tightest of them, that is the last, is best
        found = {path: int(1000 * min(1.0, total / whole) * factors[path]) or 1000 for path, total in sums.items()}
        return found or {0: 1000}

    def held(self, path: int) -> int:
        """The weight of the outermost elements with this path."""
        total, end = 0, -1
        for node, own in enumerate(self.path):
            if node > end and own == path and not self.dropped[node]:
                total, end = total + self.weight[node], self.last[node]
        return total

    def best(self) -> tuple[int, int] | None:
        """The path that the page votes for, and its score; ties go to the later, inner one."""
        return max(self.scores().items(), key=lambda x: (x[1], x[0]), default=None)

    def name(self, path: int) -> str:
        if not hasattr(self, "_keys"):
            self._keys = {number: key for key, number in self.paths.items()}
        labels = []
        while path:
            path, label = self._keys[path]
            labels.append(label)
        return ">".join(reversed(labels))

    def find(self, name: str) -> int | None:
        path = 0
        for label in name.split(">") if name else ():
            path = self.paths.get((path, label))
            if path is None:
                return None
        return path

    def cut_out(self, path: int) -> str:
        """The text of the outermost elements with this path, a line for each block."""
        chosen, end = [False] * len(self.parent), -1
        for node, own in enumerate(self.path):
            if node > end and own == path and not self.dropped[node]:
                end = self.last[node]
            chosen[node] = node <= end
        lines: dict[int, list[str]] = {}
        for node, block, text in self.texts:
            if chosen[node] and not self.silent[node]:
                lines.setdefault(block, []).append(html.unescape(text))
        return "\n".join(line for parts in lines.values() if (line := " ".join("".join(parts).split())))


def main_text(source: str | None, winners: list[str]) -> tuple[str, str | None]:
    """The text of a page, and the path it was cut out by."""
    page = Page(source or "")
    page.judge()
    own = page.best()
    if own is None:
        return "", None
    for name in winners:
        path = page.find(name)
        if path is not None and page.held(path) >= LEAST_PART * page.held(own[0]) and (text := page.cut_out(path)):
            return text, name
    return page.cut_out(own[0]), page.name(own[0])


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0])
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            page = Page(source.as_py() or "")
            page.judge()
            if best := page.best():
                cell = sums[host, page.name(best[0])]
                cell[0] += 1
                cell[1] += best[1]
        rows = [(*key, *value) for key, value in sums.items()]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["host", "path", "votes", "score"])
        release_memory()


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, used = [], []
        for source, winners in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
            text, path = main_text(source.as_py(), winners or [])
            texts.append(text)
            used.append(path)
        sizes = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes, pa.array(used, pa.string())], names=["page_id", "url", "text", "n_chars", "path"])
        release_memory()


def with_host(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", "html", F.coalesce(F.lower(F.try_parse_url("url", F.lit("HOST"))), F.lit("")).alias("host"))


def winning_paths(pages: DataFrame) -> DataFrame:
    """The winning paths of every host, most votes first."""
    votes = with_host(pages).select("host", "html").mapInArrow(_votes, "host string, path string, votes long, score long")
    sums = stage(votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("score").alias("score")), "extraction-votes")
    totals = sums.groupBy("host").agg(F.sum("votes").alias("total"))
    ahead = sums.join(totals, "host").where(F.col("votes") * VOTES_SHARE >= F.col("total"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("a"), (-F.col("score")).alias("b"), F.col("path"))))
    return stage(ahead.groupBy("host").agg(F.transform(ranked, lambda x: x["path"]).alias("winners")), "extraction-winners")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, main text, its code points and the path it was found by, for every page."""
    winners = winning_paths(pages)
    rows = with_host(pages).join(winners, "host", "left").select("page_id", "url", "html", "winners")
    schema = with_fields(T.StructType(rows.schema.fields[:2]), ("text", T.StringType()), ("n_chars", T.LongType()), ("path", T.StringType()))
    return rows.mapInArrow(_extracted, schema)
