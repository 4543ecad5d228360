"""HTML extraction by consensus host paths.

A page's containers are scored by the text they hold outside menus, notices and the like; the page votes
for its best container's generalised tag-class path. Votes are counted per host by Spark, and every page
of a host is extracted again from the elements on the winning path. A page without that path is extracted
from its own best container.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from covaria.llm.common import arrow_map, stored, table, utf8_rows

#: Bytes of hosts and paths that are broadcast to the pages; above, and over how many keys a host is dealt then.
BROADCAST, SALTS = 32 << 20, 64

#: Elements by what they do to the text around them.
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in ("script", "style", "title", "textarea", "iframe")}  # without an end tag, up to the page's end
_SKIPPED = frozenset("noscript template svg select button object canvas video audio".split())
_ALONE = frozenset("noscript select button".split())  # do not nest
_BLOCKS = frozenset(
    "html body main article section div header footer nav aside form ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address details summary fieldset legend hr center dialog menu hgroup".split()
)
_CONTAINERS = frozenset("body main article section div td center".split())
_DROPPED = frozenset("nav footer aside form menu dialog fieldset".split())
_CLOSES_P = _BLOCKS - {"html", "body"}
_VOID = frozenset("hr".split())
_ONE_OF = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: Words of class names and ids that mark what is not the article.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright discussion "
    "disqus footer footnav gdpr hidden login masthead menu modal nav navbar navigation newsletter notice overlay pager pagination popup promo promoted "
    "recommended related replies reply share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
#: "search" marks a form or box, not what is about a search.
_SEARCH = re.compile(r"search(?:[-_ ]?(?:box|bar|form|field|input|button|panel|widget|wrap|wrapper|container|block|area|toggle|results?))?(?=\s|$)", re.I)
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/][^a-zA-Z>][^>]*>|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")


def _tokens(source: str) -> list[tuple[int, int, str, bool, str]]:
    """(start, end, tag, end tag or not, attributes) of each piece of markup; tag '': comments and the like, and elements of raw text with their text."""
    out, at, drawing = [], 0, False
    while m := _TAG.search(source, at):
        at, tag, closing = m.end(), (m[2] or "").lower(), bool(m[1])
        if tag == "svg":
            drawing = not closing and not m[3].endswith("/")
        elif tag in _BLOCKS:
            drawing = False
        elif tag in _RAW and not closing and not drawing:
            end = _RAW[tag].search(source, at)
            at, tag = end.end() if end else len(source), ""
        out.append((m.start(), at, tag, closing, m[3] or ""))
    return out


def _skips(tokens: list[tuple[int, int, str, bool, str]], length: int) -> dict[int, tuple[int, int]]:
    """For each start tag of a skipped element, the token and the place where reading goes on.

    That is after its end tag; an element without one, or whose parent ends first, goes up to the next tag
    of a block only. One pass, whatever is left open.
    """
    stack: list[tuple[int, str]] = []
    count: dict[str, int] = defaultdict(int)
    out: dict[int, tuple[int, int]] = {}
    opened, until = [], {}
    for k, (_, end, tag, closing, attributes) in enumerate(tokens):
        skipped = tag in _SKIPPED
        if not skipped and tag not in _BLOCKS:
            continue
        if count[tag] and (closing or tag in _ALONE):
            while True:
                j, t = stack.pop()
                count[t] -= 1
                if t == tag:
                    break
            if skipped and closing:
                out[j] = (k + 1, end)
            elif skipped:
                until[j] = k
        if closing or tag in _VOID or tag == "svg" and attributes.endswith("/"):
            continue
        if tag in _CLOSES_P and stack and stack[-1][1] == "p":
            stack.pop()
            count["p"] -= 1
        stack.append((k, tag))
        count[tag] += 1
        if skipped:
            opened.append(k)
    block = len(tokens)
    left = [j for j in opened if j not in out]
    for k in range(len(tokens) - 1, left[0] - 1 if left else len(tokens), -1):
        if tokens[k][2] in _BLOCKS:
            block = k
        elif left and left[-1] == k:
            to = min(block, until.get(left.pop(), block))
            out[k] = (to, tokens[to][0] if to < len(tokens) else length)
    return out


class Page:
    """The blocks of a page: their texts, and for each element on the way to them its path and whether it is dropped."""

    def __init__(self, source: str):
        self.parent, self.tag, self.path, self.marked, self.sure = [-1], [""], [""], [False], [False]
        self.blocks: list[tuple[int, str, int]] = []  # (element, text, characters in links)
        self._parse(source)

    def _open(self, above: int, tag: str, attributes: str) -> int:
        classes, names, hidden = "", "", False
        if attributes and "=" in attributes or "hidden" in attributes:
            for m in _NAMES.finditer(attributes):
                key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if key == "class":
                    classes = value
                    names += " " + value
                elif key in ("id", "role"):
                    names += " " + value
                elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                    hidden = True
        names_above = self.path[above]
        inside = tag == "header" and (">article" in names_above or ">main" in names_above)
        sure = self.sure[above] or hidden or tag in _DROPPED or (tag == "header" and not inside)
        words = {w.lower() for w in _PART.findall(names)} if names else ()
        marked = tag not in ("html", "body", "main", "article") and bool(words and (_MARKS & words or "header" in words and not inside or _SEARCH.search(names)))
        marked |= inside and ">article" not in names_above  # a header of main stays if it holds the title
        self.parent.append(above)
        self.tag.append(tag)
        self.sure.append(sure)
        self.marked.append(marked)
        name = tag + "".join("." + c for c in sorted(_DIGITS.sub("#", classes).split())[:3])
        self.path.append(f"{self.path[above]}>{name}" if tag in _CONTAINERS else self.path[above])
        return len(self.parent) - 1

    def _parse(self, source: str) -> None:
        stack, text, links, in_link, at = [0], [], 0, False, 0

        def flush() -> None:
            nonlocal links
            if text:
                whole = "".join(text)
                clean = " ".join((html.unescape(whole) if "&" in whole else whole).split())
                if clean:
                    self.blocks.append((stack[-1], clean, min(links, len(clean))))
                text.clear()
            links = 0

        tokens, k = _tokens(source), 0
        skips = _skips(tokens, len(source))
        while k < len(tokens):
            start, end, tag, closing, attributes = tokens[k]
            if start > at:
                text.append(source[at:start])
                if in_link:
                    links += start - at
            k, at = skips.get(k, (k + 1, end))
            if tag == "a":
                in_link = not closing
            elif tag == "br" or tag == "wbr":
                if tag == "br":
                    text.append(" ")
            elif tag in _BLOCKS:
                flush()
                in_link = False
                tags = [self.tag[k] for k in stack]
                if closing:
                    if tag in tags:
                        del stack[len(tags) - 1 - tags[::-1].index(tag) :]
                    continue
                if tags[-1] == "p" and tag in _CLOSES_P:
                    stack.pop()
                elif tag in _ONE_OF:
                    for i in range(len(stack) - 1, 0, -1):
                        if tags[i] in _ONE_OF[tag]:
                            break
                        if tags[i] == tag or (tags[i] in ("dt", "dd") and tag in ("dt", "dd")) or (tags[i] in ("td", "th") and tag in ("td", "th")):
                            del stack[i:]
                            break
                if tag not in _VOID:
                    stack.append(self._open(stack[-1], tag, attributes))
        if at < len(source):
            text.append(source[at:])
        flush()
        self._settle()

    def _settle(self) -> None:
        """An element that only its names mark is kept if it holds an article or main, or an h1 and most of the text."""
        held, title = [0] * len(self.tag), [False] * len(self.tag)
        for k, text, _ in self.blocks:
            if not self.sure[k]:
                held[k] += len(text)
        total = sum(held)
        for k in range(len(self.tag) - 1, 0, -1):  # children come after their parents
            up = self.parent[k]
            held[up] += held[k]
            title[up] |= title[k] or self.tag[k] == "h1"
            self.marked[k] = self.marked[k] and not (title[k] and (held[k] > 0.6 * total or self.tag[k] == "header"))
        for k, tag in enumerate(self.tag):
            if tag in ("article", "main"):
                k = self.parent[k]
                while k > 0:
                    self.marked[k] = False
                    k = self.parent[k]
        self.dropped = [False]
        for k in range(1, len(self.parent)):
            self.dropped.append(self.sure[k] or self.marked[k] or self.dropped[self.parent[k]])

    def best(self) -> tuple[str, float]:
        """The deepest container that holds nearly all weighed text, an article or main before others; its share."""
        weight: dict[str, int] = defaultdict(int)
        title, total = None, 0
        for k, text, links in self.blocks:
            if self.dropped[k]:
                continue
            n = max(0, len(text) - 2 * links)
            total += n
            paths = self._paths(k)
            for p in paths:
                weight[p] += n
            if self.tag[k] == "h1" and title is None:
                title = paths
        if not total or not weight:
            return "", 0.0
        fit = [p for p, n in weight.items() if n >= 0.85 * total and (title is None or p in title)]
        own = [p for p, n in weight.items() if n >= 0.5 * total and p.rpartition(">")[2].partition(".")[0] in ("article", "main")]
        chosen = max(own or fit or weight, key=lambda p: (p.count(">"), weight[p], p))
        return chosen, weight[chosen] / total

    def _paths(self, k: int) -> set[str]:
        out = set()
        while k > 0:
            if self.tag[k] in _CONTAINERS:
                out.add(self.path[k])
            k = self.parent[k]
        return out

    def text(self, path: str) -> str:
        """The blocks below path that are not dropped; below the page's own best path if it has no such block."""
        for p in (path, None):
            p = self.best()[0] if p is None else p
            found = [t for k, t, _ in self.blocks if not self.dropped[k] and (not p or (self.path[k] + ">").startswith(p + ">"))]
            if found and p or p is None:
                break
        return "\n\n".join(found)


def _host(url: Column) -> Column:
    """What stands between :// (and user@) and the port or path, in lower case; '' if there is nothing."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?([^/?#:]*)", 1)), F.lit(""))


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, share): each page's vote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(u, *Page(h.decode()).best()) for u, h in zip(batch.column(0).to_pylist(), utf8_rows(batch.column(1)), strict=True)]
            rows = [r for r in rows if r[1]] or [("", "", 0.0)]
            a, b, c = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.float64())], ["host", "path", "share"])

    return pages.select(_host(F.col("url")).alias("host"), "html").transform(arrow_map, run, "host string, path string, share double")


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path): most votes, then most text, then the path that sorts first. Votes are combined before the shuffle."""
    counted = votes(pages).where("path <> ''").groupBy("host", "path").agg(F.count("*").alias("n"), F.round(F.sum("share"), 6).alias("share"))
    return counted.groupBy("host").agg(F.min_by("path", F.struct(-F.col("n"), -F.col("share"), "path")).alias("path"))


def _with_paths(rows: DataFrame, paths: DataFrame, most: int = BROADCAST, salts: int = SALTS) -> DataFrame:
    """rows with their hosts' paths. Pages stay where they are while all paths take at most `most` bytes; beyond,
    each host is dealt over `salts` keys, so that one host's pages never meet in one task."""
    size = paths.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 32).cast("long"), F.lit(0))).first()[0]
    if size <= most:
        found = rows.join(F.broadcast(paths), "host", "left")
    else:
        dealt = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(salts)).cast("int"))
        found = dealt.join(paths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["host", "salt"], "left")
    return found.select("page_id", "url", "html", "path")


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    Null html is empty and gives the empty text; a null url counts as host ''. Repeated rows give repeated
    results; other columns are ignored; an empty table gives an empty result. Pages of any length are
    read whole. Ties between paths go to the one that sorts first.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    found = _with_paths(rows.withColumn("host", _host(F.col("url"))), stored(winning_paths(rows), "paths"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(h.decode()).text(p or "") for h, p in zip(utf8_rows(batch.column(2)), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return found.transform(arrow_map, run, "page_id long, url string, text string, n_chars long")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
