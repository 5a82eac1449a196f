"""Main text of web pages: block lines by markup, then differencing against the pages of
the nearest URLs.

Markup gives each page's block lines and sorts them: *noise* (menus, page headers, footers,
sidebars, notices, adverts, forms, comments, by element, role or class) goes; *body* lines
stand inside an ``article`` or ``main`` element; the lines of a page without such an element
and body lines made mostly of links are *doubtful*. Pages are ordered by path within their
host, aligned with the nearest page before and after that has other lines by longest common
subsequence of lines, and doubtful lines that a neighbour shares are deleted. A neighbour
that shares nearly all of the page's text (characters, not lines, as menus have many short
lines) is a near copy of it and says nothing about boilerplate.

The ordering moves a 64-bit hash and a length per line, not the texts. Runs of pages with
equal lines get consecutive numbers from a range-partitioned sort, and a page of each run is
compared in overlapping blocks of ``BLOCK`` runs, so a host that holds a third of all pages
is spread like any other rows, and the verdict does not change with the number of copies.

Defined cases: null or empty html gives an empty text; pages of one host and path are
ordered by page id, then input order; a null URL counts as the empty host; a page alone in
its host loses nothing. An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemetra.llm.common import map_rows, with_row_id, written
from telemetra.llm.url_filter import host_of, path_of

BLOCK = 16
# Share of a page's text from which a neighbour counts as its copy; share of a line's
# characters inside links from which the line is doubtful.
COPY_SHARE, LINK_SHARE = 0.8, 0.6

# Elements whose content is never text.
SILENT = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "select", "button", "math", "canvas", "head"}
NOISE = {"nav", "footer", "aside", "form", "dialog", "menu"}
BODY = {"article", "main"}
BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "table", "tr", "caption", "section", "article",
          "main", "header", "footer", "aside", "nav", "form", "fieldset", "blockquote", "pre", "hr", "figure", "figcaption", "address",
          "details", "summary", "body", "html", "menu", "dialog", "center"}
SPACES = {"br", "td", "th", "img", "wbr"}
# Elements that are followed from start to end tag; all others may stay open.
NESTED = {"div", "section", "article", "main", "header", "footer", "aside", "nav", "form", "ul", "ol", "dl", "table", "figure", "fieldset",
          "details", "blockquote", "menu", "dialog", "address"}
HINTS = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "sponsor", "sponsored", "promo", "cookie", "cookies", "consent", "notice",
         "popup", "modal", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "masthead", "comment",
         "comments", "disqus", "reply", "replies", "share", "sharing", "social", "related", "newsletter", "subscribe", "toolbar", "pagination",
         "login", "signup"}
# Hints that an article inside does not lift.
FIRM = {"comment", "comments", "disqus", "reply", "replies", "related", "sidebar", "ad", "ads", "sponsored"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>?", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")


def _noisy(tag: str, attrs: str, in_body: bool) -> str:
    """'' for content, else 'noise', or 'firm' if an article inside changes nothing."""
    if tag in ("body", "html"):
        return ""
    kind = ""
    if tag in NOISE or (tag == "header" and not in_body):
        kind = "firm" if tag in ("aside", "form", "dialog") else "noise"
    if attrs:
        if re.search(r"(?:^|\s)hidden(?:\s|$|=)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", attrs):
            return "firm"
        for name, *values in _ATTR.findall(attrs):
            value, name = "".join(values), name.lower()
            if name == "role" and value.lower() in ROLES:
                kind = kind or "noise"
            elif name in ("class", "id"):
                parts = {x.lower() for x in _PART.findall(value)}
                if parts & FIRM:
                    return "firm"
                if parts & HINTS and tag not in BODY:
                    kind = kind or "noise"
    return kind


def block_lines(page: str | None) -> list[tuple[str, bool]]:
    """(line, doubtful) of a page in order, noise left out."""
    found: list[tuple[str, str, float]] = []
    stack: list[tuple[str, str, bool]] = []  # element, noise, body
    words: list[str] = []
    linked = [0, 0]
    in_link = False
    page = page or ""

    def close() -> None:
        line = " ".join("".join(words).split())
        if line:
            noise = any(n for _, n, _ in stack)
            body = any(b for _, _, b in stack)
            if not noise:
                found.append((line, "body" if body else "loose", linked[0] / max(1, linked[1])))
        words.clear()
        linked[:] = [0, 0]

    def say(text: str) -> None:
        text = entities.unescape(text)
        words.append(text)
        size = len(text.strip())
        linked[1] += size
        if in_link:
            linked[0] += size

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, ending, attrs = m[2].lower(), bool(m[1]), m[3] or ""
        if tag in SILENT and not ending:
            if not attrs.rstrip().endswith("/"):
                if tag == "head":  # ends with its end tag or where the body begins
                    end = re.compile(r"</head\s*>|(?=<body\b)", re.I).search(page, at)
                else:
                    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else (at if tag == "head" else n)
            continue
        if tag == "a":
            in_link = not ending
        if tag in SPACES:
            words.append(" ")
        if tag not in BLOCKS:
            continue
        close()
        if tag not in NESTED:
            continue
        if ending:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in BODY:  # an article ends what was left open around it, but for firm noise
            stack[:] = [(t, "" if x == "noise" else x, b) for t, x, b in stack]
        stack.append((tag, _noisy(tag, attrs, any(b for _, _, b in stack)), tag in BODY))
    close()
    if any(kind == "body" for _, kind, _ in found):
        return [(line, share >= LINK_SHARE) for line, kind, share in found if kind == "body"]
    return [(line, True) for line, _, _ in found]


def page_lines(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``_row, _id, _url, host, path, lines, doubtful`` per page."""
    rows = with_row_id(pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).cast("string").alias("_html")))
    rows = rows.select("_row", "_id", "_url", host_of(F.col("_url").cast("string")).alias("host"), path_of(F.col("_url").cast("string")).alias("path"), "_html")
    schema = T.StructType([*rows.schema.fields[:5], *T._parse_datatype_string("lines array<string>, doubtful array<boolean>").fields])

    def fn(cols: list[list]) -> list[list]:
        parsed = [block_lines(h) for h in cols[5]]
        return [*cols[:5], [[x for x, _ in p] for p in parsed], [[d for _, d in p] for p in parsed]]

    return map_rows(rows, schema, fn)


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """Positions of ``a`` in a longest common subsequence with ``b``.

    Lines only one side has are left out, equal ends are matched, and the rest goes by
    longest increasing runs over the positions of equal lines."""
    both = set(a) & set(b)
    ai = [i for i, x in enumerate(a) if x in both]
    bj = [j for j, x in enumerate(b) if x in both]
    found = set()
    while ai and bj and a[ai[0]] == b[bj[0]]:
        found.add(ai.pop(0))
        bj.pop(0)
    while ai and bj and a[ai[-1]] == b[bj[-1]]:
        found.add(ai.pop())
        bj.pop()
    places: dict[int, list[int]] = {}
    for k in range(len(bj) - 1, -1, -1):
        places.setdefault(b[bj[k]], []).append(k)
    tails: list[int] = []
    links: list[tuple[int, tuple | None]] = []
    for i in ai:
        for k in places.get(a[i], ()):
            at = bisect_left(tails, k)
            link = (i, links[at - 1] if at else None)
            if at == len(tails):
                tails.append(k)
                links.append(link)
            else:
                tails[at], links[at] = k, link
    node = links[-1] if links else None
    while node:
        found.add(node[0])
        node = node[1]
    return found


def numbered(lines: DataFrame) -> DataFrame:
    """``_row, host, hashes, sizes, part, run, head, number``: pages by host, path, id and row;
    a consecutive ``number`` per run of pages of a host with equal lines, of which ``run`` is
    the count within the partition and ``head`` the first page there."""
    keys = lines.select("_row", "_id", "host", "path", F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"), F.transform("lines", lambda x: F.length(x)).alias("sizes"))
    order = ["host", "path", "_id", "_row"]
    same = F.xxhash64("host", "hashes")
    spread = keys.repartitionByRange(*order).sortWithinPartitions(*order).select("_row", "host", "hashes", "sizes", same.alias("same"))
    added = T._parse_datatype_string("part int, run bigint, head boolean").fields
    schema = T.StructType([*spread.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, last = TaskContext.get().partitionId(), -1, None
        for batch in batches:
            runs, heads = [], []
            for same in batch.column(4).to_pylist():
                heads.append(same != last)
                at, last = at + (same != last), same
                runs.append(at)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * len(runs), pa.int32()), pa.array(runs, pa.int64()), pa.array(heads, pa.bool_())], names=schema.names)

    placed = written(spread.mapInArrow(run, schema), "page-order")
    edges = placed.groupBy("part").agg(F.max("run").alias("last"), F.min_by("same", "run").alias("opens"), F.max_by("same", "run").alias("ends"))  # a row per partition
    order_ = Window.orderBy("part")
    before = order_.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a run that goes on from the partition before keeps its number
    goes_on = F.coalesce((F.col("opens") == F.lag("ends").over(order_)).cast("bigint"), F.lit(0))
    edges = edges.withColumn("goes_on", goes_on)
    first = edges.select("part", (F.sum(F.col("last") + 1 - F.col("goes_on")).over(before) - F.col("last") - 1).alias("first"))
    return placed.join(first, "part").select("_row", "host", "hashes", "sizes", "part", "run", "head", (F.col("first") + F.col("run")).alias("number"))


def shared_lines(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """``_row, shared``: positions of lines that a page shares with a neighbour."""
    pages = numbered(lines)
    home = F.floor(F.col("number") / block)
    # each block also holds the run before its first and the run after its last
    blocks = pages.where("head").withColumn("block", F.explode(F.array_distinct(F.array(
        home, F.floor((F.col("number") - 1) / block), F.floor((F.col("number") + 1) / block)))))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("number")
        heads = [list(g) for _, g in part.groupby("number")[["part", "run"]].apply(lambda g: list(zip(g["part"], g["run"]))).items()]
        alone = part.drop_duplicates("number")
        own = list(zip(alone["host"], [list(h) for h in alone["hashes"]], [list(z) for z in alone["sizes"]], alone["number"], alone["block"]))
        out = []
        for i, (host, hashes, sizes, number, at) in enumerate(own):
            if number // block != at:
                continue
            shared: set[int] = set()
            for j in (i - 1, i + 1):
                if 0 <= j < len(own) and own[j][0] == host:
                    same = common_lines(hashes, own[j][1])
                    if sum(sizes[x] for x in same) < COPY_SHARE * max(sum(sizes), sum(own[j][2])):
                        shared |= same
            if shared:
                out += [(*head, sorted(shared)) for head in heads[i]]
        return pd.DataFrame(out, columns=["part", "run", "shared"])

    found = blocks.groupBy("block").applyInPandas(compare, "part int, run bigint, shared array<int>")
    return pages.select("_row", "part", "run").join(found, ["part", "run"]).select("_row", "shared")


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, URL, ``lines`` (kept) and ``deleted`` (number of lines that
    differencing took away)."""
    lines = written(page_lines(pages, id_col=id_col, url_col=url_col, html_col=html_col), "page-lines")
    sure = lines.where(~F.exists("doubtful", lambda d: d)).select("_id", "_url", "lines", F.lit(0).alias("deleted"))
    # only pages with doubtful lines meet their neighbours' verdict
    rest = lines.where(F.exists("doubtful", lambda d: d)).join(shared_lines(lines), "_row", "left")
    shared = F.coalesce("shared", F.array().cast("array<int>"))
    gone = lambda i: F.element_at("doubtful", i + 1) & F.array_contains(shared, i)
    kept = F.filter("lines", lambda x, i: ~gone(i))
    rest = rest.select("_id", "_url", kept.alias("lines"), (F.size("lines") - F.size(kept)).alias("deleted"))
    both = sure.unionByName(rest)
    return both.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "lines", "deleted")
