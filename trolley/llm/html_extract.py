"""Main text of web pages by differencing pages with near urls.

Each page becomes lines (one per block of its markup, in page order). Pages of a host are sorted by
url path, and each is paired with the neighbour whose path has the longer common start. The line
sequences of a pair are aligned by their longest common subsequence; shared lines are what the site
repeats and go. Markup decides first: menus, footers, forms and the like never become lines, and
lines inside an ``article`` (or ``main``) element stay, shared or not, because two urls may carry one
article. Differencing decides every other line.

Only line hashes are compared. Sorting is one range partitioning over all hosts; a page at the edge
of a range takes its neighbour from a table of range edges, so a large host is never one task.
"""

from __future__ import annotations

import html as htmllib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trolley.llm.common import ASCII_UPPER, broadcast_if_small, map_batches, materialize
from trolley.llm.urlfilter import with_host_path

MAX_BROADCAST_PAGES = 20_000
_LOWER = str.maketrans(ASCII_UPPER, ASCII_UPPER.lower())
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe"}   # their content is no text
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
             "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary "
             "table tbody td tfoot th thead tr ul".split())
_NOT_TEXT = {"nav", "aside", "form", "button", "select", "menu", "dialog", "head", "footer", "object", "canvas", "map"}
_MAIN = {"article", "main"}
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_MARKS = {"class", "id", "role", "aria-label"}
# fixed values: a class, id, role or label marks what is not content if each hyphened part of it is a word of
# one of these lists, one of the first at least ("cookie-banner", "site-footer", not "with-sidebar")
_SITE = set("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments complementary consent contentinfo "
            "cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices popup promo "
            "related replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
_FILLER = set("area bar block bottom box container form global header left list main page primary right section site slot top "
              "wrap wrapper".split())
MAX_MATCHES = 200_000    # matching places up to which an alignment keeps them all
LINE = "array<struct<text:string,main:boolean>>"


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, whether it closes, lower-case name, attributes) of each tag; comments, declarations and
    elements whose content is no text are one nameless item. One pass: what has no end is found out once."""
    low = page.translate(_LOWER)
    last = {q: page.rfind(q) for q in "\"'>"}
    at = page.find("<")
    while at >= 0:
        following = page[at + 1:at + 2]
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, False, "", ""
        elif at > last[">"]:
            return                       # no tag ends any more: the rest is text
        elif following in ("!", "?"):
            end = page.find(">", at) + 1
            yield at, end, False, "", ""
        else:
            closes = following == "/"
            m = _NAME.match(page, at + 1 + closes)
            if not m:
                end = at + 1
            else:
                name, end = low[m.start():m.end()], m.end()
                while True:              # the end of the tag, past quoted values; an unclosed quote is no quote
                    stop = _STOP.search(page, end)
                    if stop and stop[0] == ">":
                        end = stop.end()
                        break
                    if not stop or stop.start() >= last[stop[0]]:
                        end = page.find(">", m.end()) + 1
                        break
                    end = page.find(stop[0], stop.end()) + 1
                    if end > last[">"]:
                        end = page.find(">", m.end()) + 1
                        break
                attributes = page[m.end():end - 1]
                if name in _RAW and not closes:
                    close = low.find(f"</{name}", end)
                    close = low.find(">", close) if close >= 0 else -1
                    end = len(page) if close < 0 else close + 1
                    name = ""
                yield at, end, closes, name, attributes
        at = page.find("<", end)


def marked_off(attributes: str) -> bool:
    """Whether attributes hide an element or mark it as a menu, advert, comment or the like (see ``_SITE``)."""
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name in _MARKS:
            for token in value.split():
                parts = re.split("[-_]+", token)
                if any(p in _SITE for p in parts) and all(p in _SITE or p in _FILLER for p in parts):
                    return True
    return False


def lines_of(page: str) -> list[tuple[str, bool]]:
    """(text, inside article or main) of each block that may be content."""
    out: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool]] = []   # open elements: name, whether it hides its content
    buffer: list[str] = []
    open_at: dict[str, list[int]] = {}   # places in the stack of each open name, and of article and main
    main_at: list[int] = []
    hidden = 0
    at = 0

    def flush() -> None:
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            out.append((text, bool(main_at)))

    def pop(to: int) -> None:
        nonlocal hidden
        while len(stack) > to:
            name, hides = stack.pop()
            hidden -= hides
            open_at[name].pop()
            if name in _MAIN:
                main_at.pop()

    for start, end, closes, name, attributes in tags(page):
        if not hidden and start > at:
            buffer.append(htmllib.unescape(page[at:start]))
        at = end
        if not name:
            continue
        if name in _BLOCK:
            if not hidden:
                flush()
        elif name in ("br", "wbr"):
            buffer.append(" " if name == "br" else "")
        if closes:
            places = open_at.get(name)
            if places and (not main_at or places[-1] >= main_at[-1] or name in ("body", "html")):
                pop(places[-1])
            continue
        if name in _VOID:
            continue
        if name in _MAIN and hidden:   # an unclosed menu or advert does not swallow the article
            while hidden:
                pop(len(stack) - 1)
        if name in _BLOCK:   # a block ends an open paragraph, as browsers do
            for i in range(len(stack) - 1, max(-1, len(stack) - 9), -1):
                if stack[i][0] == "p":
                    pop(i)
                    break
                if stack[i][0] in _BLOCK:
                    break
        hides = name in _NOT_TEXT or (name == "header" and not main_at)
        if not hides and attributes and name not in _MAIN and name not in ("body", "html"):
            hides = marked_off(attributes)
        open_at.setdefault(name, []).append(len(stack))
        if name in _MAIN:
            main_at.append(len(stack))
        stack.append((name, hides))
        hidden += hides
    if not hidden and at < len(page):
        buffer.append(htmllib.unescape(page[at:]))
    if not hidden:
        flush()
    return out


def shared_lines(mine: list[int], other: list[int]) -> list[int]:
    """Places in ``mine`` of one longest common subsequence.

    Equal starts and ends are aligned first. Few matching places are chained; many (a line that repeats
    on both sides) are aligned by halving, in memory linear in the lines.
    """
    lo, most = 0, min(len(mine), len(other))
    while lo < most and mine[lo] == other[lo]:
        lo += 1
    end = 0
    while end < most - lo and mine[-1 - end] == other[-1 - end]:
        end += 1
    a, b = mine[lo:len(mine) - end], other[lo:len(other) - end]
    count = Counter(b)
    if sum(count[h] for h in a) <= MAX_MATCHES:
        inner = _chained(a, b)
    else:
        inner = _halved(np.array(a, np.int64), np.array(b, np.int64))
    return [*range(lo), *(lo + i for i in inner), *range(len(mine) - end, len(mine))]


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with each start of ``b``."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return row


def _halved(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places in ``a`` of one longest common subsequence: ``a`` is halved, ``b`` cut where both halves share most."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, left, right = todo.pop()
        if lo == hi or left == right:
            continue
        if hi - lo == 1:
            if (b[left:right] == a[lo]).any():
                out.append(lo)
            continue
        mid = (lo + hi) // 2
        cut = left + int((_lengths(a[lo:mid], b[left:right]) + _lengths(a[mid:hi][::-1], b[left:right][::-1])[::-1]).argmax())
        todo += [(mid, hi, cut, right), (lo, mid, left, cut)]
    return out


def _chained(mine: list[int], other: list[int]) -> list[int]:
    """The same by a longest chain over all matching places."""
    places: dict[int, list[int]] = {}
    for j, h in enumerate(other):
        places.setdefault(h, []).append(j)
    ends: list[int] = []                 # smallest end in other of a chain of each length
    chain: list[tuple[int, int]] = []    # (place in mine, chain before) of every link made
    last: list[int] = []
    for i, h in enumerate(mine):
        for j in reversed(places.get(h, ())):
            k = bisect_left(ends, j)
            chain.append((i, last[k - 1] if k else -1))
            if k == len(ends):
                ends.append(j)
                last.append(len(chain) - 1)
            else:
                ends[k] = j
                last[k] = len(chain) - 1
    out, at = [], last[-1] if last else -1
    while at >= 0:
        i, at = chain[at]
        out.append(i)
    return out[::-1]


def parse_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, page_key, lines)`` per input row; equal rows have equal keys. Null html has no lines."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("text"))
    rows = rows.withColumn("page_key", F.md5(F.concat_ws(
        "\n", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.md5(F.coalesce("url", F.lit(""))), F.md5("text"))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[["page_id", "url", "page_key"]].copy()
        out["page_id"] = out["page_id"].astype("Int64")
        out["lines"] = [[{"text": t, "main": m} for t, m in lines_of(x)] for x in pdf["text"]]
        return out

    return map_batches(rows, run, f"page_id long, url string, page_key string, lines {LINE}", max_chars=2_000_000)


def _common(a: Column, b: Column) -> Column:
    """Number of leading path segments that two paths share."""
    same = F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda x, y: x.eqNullSafe(y))
    first_other = F.array_position(same, False)
    return F.when(first_other == 0, F.size(same)).otherwise(first_other - 1)


def nearest(urls: DataFrame) -> DataFrame:
    """``(page_key, partner)`` of ``urls(page_key, host, path)``: the neighbour in path order within the host.

    Pages alone on their host and pages without a host have no partner.
    """
    order = ["host", "path", "page_key"]
    spread = materialize(urls.where("host <> ''").select(*order).distinct().repartitionByRange(*order)
                         .withColumn("part", F.spark_partition_id()), "url-order")
    row = F.struct(*order)
    edges = spread.groupBy("part").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    by_part = Window.orderBy("part")     # one row a range
    edges = edges.select("part", F.lag("last").over(by_part).alias("edge_before"),
                         F.lead("first").over(by_part).alias("edge_after"))
    within = Window.partitionBy("part").orderBy(*order)
    near = (spread.withColumn("before", F.lag(row).over(within)).withColumn("after", F.lead(row).over(within))
            .join(F.broadcast(edges), "part")   # at most one row a shuffle partition
            .withColumn("before", F.coalesce("before", "edge_before"))
            .withColumn("after", F.coalesce("after", "edge_after")))
    for side in ("before", "after"):
        near = near.withColumn(side, F.when(F.col(f"{side}.host") == F.col("host"), F.col(side)))
    back, ahead = _common(F.col("path"), F.col("before.path")), _common(F.col("path"), F.col("after.path"))
    return near.select("page_key", F.when(F.coalesce(back, F.lit(-2)) >= F.coalesce(ahead, F.lit(-2)), F.col("before.page_key"))
                       .otherwise(F.col("after.page_key")).alias("partner")).where("partner is not null")


def repeated_lines(parsed: DataFrame) -> DataFrame:
    """``(page_key, shared array<int>)``: places (from 0) of lines outside the article that the partner has too."""
    hashed = with_host_path(parsed.select(
        "url", "page_key", F.transform("lines", lambda x: F.xxhash64(x["text"])).alias("h"),
        F.transform("lines", lambda x: x["main"]).alias("main"))).dropDuplicates(["page_key"])
    hashed = materialize(hashed.select("page_key", "host", "path", "h", "main"), "line-hashes")
    pairs = nearest(hashed.select("page_key", "host", "path"))
    theirs = hashed.select(F.col("page_key").alias("partner"), F.col("h").alias("other"))
    open_pages = hashed.where(F.exists("main", lambda x: ~x)).select("page_key", "h", "main")
    both = open_pages.join(pairs, "page_key").join(theirs, "partner")

    def run(batches):
        for pdf in batches:
            places = [[i for i in shared_lines(list(a), list(b)) if not m[i]]
                      for a, b, m in zip(pdf["h"], pdf["other"], pdf["main"])]
            yield pd.DataFrame({"page_key": pdf["page_key"], "shared": places})

    return both.mapInPandas(run, "page_key string, shared array<int>").where("size(shared) > 0")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` per input row.

    Lines inside an article (or main) element stay; of all others, those that the nearest page does not share.
    Of two neighbours with equally long common starts the one before is the nearest. Null or empty html, and pages without content, give the empty text.
    Rows with a null url have no partner; repeated rows repeat their result.
    """
    parsed = materialize(parse_pages(pages, id_col, url_col, html_col), "page-lines")
    gone = broadcast_if_small(materialize(repeated_lines(parsed), "shared-lines"), MAX_BROADCAST_PAGES)
    rows = parsed.join(gone, "page_key", "left")
    kept = F.filter("lines", lambda x, i: x["main"] | ~F.coalesce(F.array_contains(F.col("shared"), i), F.lit(False)))
    text = F.array_join(F.transform(kept, lambda x: x["text"]), "\n")
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
