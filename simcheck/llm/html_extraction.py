"""Main text of web pages by differencing pages with the nearest URLs.

A page is cut into text lines: the blocks of its markup, character references
decoded, white space as one space.  Within each host the pages are ordered by
URL path, and every page is aligned with its nearest neighbours, ``NEAR`` on
either side, by the longest common subsequence of all their lines.  A line that
at least half of the neighbours share is template and is deleted.

What a line is compared by: text in a region that the markup itself names
(menu, header, footer, sidebar, form, notice, advert, reader comments) differs
from page to page though the slot is the same, so such a line is compared by
its region and block; every other line by its text, prose inside ``<article>``
with prose inside ``<article>``.  A check follows: prose of an article that
neighbours share is a copied passage and no template, so it stays and is
counted as quoted; lines of named regions that no neighbour shared (the only
page of a host, a slot that others lack) go as well, and if the page has an
``<article>``, only its lines are main text.

**Scale.**  The first pass reads the pages for keys only (a digest and 8 bytes
a line), which are ranked by (host, path) with a range sort, so a host with a
third of all pages is spread like any other; neighbours meet in blocks of
consecutive ranks with the few ranks beside them.  The second pass parses the
pages again beside the deleted line numbers, so page texts are neither stored
nor, while the numbers fit a measured broadcast, shuffled.  Alignment is exact
for any number of lines: 64 cells a machine step, memory linear in the lines.

Defined results: a null or empty html gives an empty text; a null URL, or one
without a host, has no neighbours; pages of a host with the same lines are one
page there, so copies do not delete each other, and get the same result; pages
of one path are ordered by their lines' digest; repeated rows and ids stay rows
of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simcheck.functions.ordering import global_row_number
from simcheck.llm.common import small_or_shuffled
from simcheck.session import materialize

#: Neighbours on either side; ranks that meet in one group.
NEAR, BLOCK = 2, 256
#: Cells of a kept alignment table in bytes; larger alignments are halved.
TABLE_BYTES = 1 << 24

# Fixed values of HTML: elements whose content is no text, elements that end a line, named regions.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "noembed", "noframes", "xmp"}
VOID = {"br", "hr", "img", "input", "meta", "link", "source", "col", "area", "base", "embed", "track", "wbr", "param"}
BLOCKS = set("""html head body article section main nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd
table caption thead tbody tfoot tr td th blockquote pre figure figcaption address form fieldset legend details summary
dialog menu select option button hr br center search svg math object video audio canvas""".split())
REGIONS = {"nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "sidebar", "form": "form",
           "button": "form", "select": "form", "fieldset": "form", "dialog": "notice", "search": "form", "svg": "picture",
           "math": "picture", "object": "picture", "video": "picture", "audio": "picture", "canvas": "picture"}
#: Words of class, id and role that name a region.
NAMED = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc",
    "header": "header masthead banner topbar",
    "footer": "footer contentinfo copyright",
    "sidebar": "sidebar aside complementary related widget widgets",
    "form": "form search login signup subscribe newsletter",
    "notice": "notice notices cookie cookies consent gdpr popup modal alert alertdialog dialog overlay",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted",
    "share": "share sharing social",
    "comments": "comment comments disqus replies respond",
}
REGION_OF = {word: region for region, words in NAMED.items() for word in words.split()}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.S)
HINT = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
WORD = re.compile(r"[a-z]+")


class Line(NamedTuple):
    region: str      # of the markup, or empty
    article: bool    # prose inside an article
    block: str
    text: str


def region_of(tag: str, attributes: str, inside: bool) -> str | None:
    """The region that an element names, if any; ``inside`` an article its header keeps its headings."""
    if tag in ("html", "body", "main"):
        return None
    if attributes and HIDDEN.search(attributes):
        return "hidden"
    named = [REGION_OF[w] for _, value in HINT.findall(attributes) for w in WORD.findall(value.lower())
             if w in REGION_OF] if attributes else []
    if tag == "article":
        return "comments" if "comments" in named else None
    return REGIONS.get(tag) or (named[0] if named else None)


def lines_of(page: str | None) -> list[Line]:
    """Text lines of a page in order, with what the markup says about them."""
    out: list[Line] = []
    stack: list[tuple[str, str, bool]] = [("", "", False)]      # tag, region, inside an article
    parts: list[str] = []
    linked = plain = False
    anchors = 0

    def flush() -> None:
        nonlocal linked, plain
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            tag, region, inside = stack[-1]
            if region == "header" and inside and re.fullmatch("h[1-6]", tag):
                region = ""
            elif not region and not inside and tag == "li" and linked and not plain:
                region = "links"
            out.append(Line(region, inside and not region, tag, text))
        linked = plain = False

    def add(text: str) -> None:
        nonlocal linked, plain
        if text:
            parts.append(text)
            if not text.isspace():
                linked, plain = linked or anchors > 0, plain or anchors == 0

    page = page or ""
    at = 0
    while token := TOKEN.search(page, at):
        add(page[at:token.start()])
        at = token.end()
        closing, tag, attributes = token.groups()
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW:
            if not closing:
                end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
        elif tag == "a":
            anchors = max(0, anchors + (-1 if closing else 1))
        elif tag in BLOCKS:
            flush()
            if tag in VOID:
                continue
            if closing:
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
                if depth:
                    del stack[depth:]
                continue
            if stack[-1][0] == "p" or stack[-1][0] == tag == "li":
                stack.pop()
            _, region, inside = stack[-1]
            region = region or region_of(tag, attributes, inside) or ""
            stack.append((tag, region, inside or (tag == "article" and not region)))
    add(page[at:])
    flush()
    return out


def _key(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "replace"), digest_size=8).digest(),
                          "little", signed=True)


def keys_of(lines: list[Line]) -> list[int]:
    """What each line is compared by; every line takes part in the alignment."""
    return [_key("slot", line.region, line.block) if line.region else _key("prose" if line.article else "text", line.text)
            for line in lines]


def digest_of(lines: list[Line]) -> bytes:
    whole = "\n".join(f"{line.region}\t{int(line.article)}\t{line.block}\t{line.text}" for line in lines)
    return hashlib.sha256(whole.encode("utf-8", "replace")).digest()


def _steps(a: list[int], b: list[int]) -> Iterator[int]:
    """Bit rows of the alignment table: bit j of the row after a[:i] is 0 where b[j] lengthens the subsequence."""
    masks: dict[int, int] = {}
    for j, key in enumerate(b):
        masks[key] = masks.get(key, 0) | 1 << j
    full = row = (1 << len(b)) - 1
    yield row
    for key in a:
        hit = row & masks.get(key, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of a and every prefix of b."""
    row = 0
    for row in _steps(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[:len(b)]
    return np.concatenate(([0], np.cumsum(bits == 0)))


def common_lines(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of places of one longest common subsequence."""
    in_a, in_b = set(a), set(b)
    ia, ib = [i for i, k in enumerate(a) if k in in_b], [j for j, k in enumerate(b) if k in in_a]
    return [(ia[i], ib[j]) for i, j in _align([a[i] for i in ia], [b[j] for j in ib], 0, 0)]


def _align(a: list[int], b: list[int], da: int, db: int) -> list[tuple[int, int]]:
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = [(da + i, db + i) for i in range(head)]
    x, y = a[head:len(a) - tail], b[head:len(b) - tail]
    if x and y:
        out += _middle(x, y, da + head, db + head)
    return out + [(da + len(a) - t, db + len(b) - t) for t in range(tail, 0, -1)]


def _middle(a: list[int], b: list[int], da: int, db: int) -> list[tuple[int, int]]:
    if len(a) == 1:
        return [(da, db + b.index(a[0]))] if a[0] in b else []
    if len(a) * (len(b) // 8 + 32) > TABLE_BYTES:
        half = len(a) // 2
        best = _lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]
        cut = int(best.argmax())
        return _align(a[:half], b[:cut], da, db) + _align(a[half:], b[cut:], da + half, db + cut)
    rows = list(_steps(a, b))
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i] >> (j - 1) & 1:                  # b[j-1] does not lengthen it
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:        # it did so before a[i-1] already
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((da + i, db + j))
    return out[::-1]


def page_keys(pages: DataFrame) -> DataFrame:
    """(host, path, page_sha, digest, keys) of each page with a host and a text to compare; written once."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [lines_of(p) for p in b["html"]]
            yield pd.DataFrame({"host": b["host"], "path": b["path"], "page_sha": b["page_sha"],
                                "digest": [digest_of(f) for f in found], "keys": [keys_of(f) for f in found]})
    located = pages.filter("host is not null and html is not null").select("host", "path", "page_sha", "html")
    return materialize(located.mapInPandas(
        parse, "host string, path string, page_sha binary, digest binary, keys array<long>"))


def located(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, host, path, page_sha); the host is null where the URL has none."""
    place = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", 1)
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(.*)$", 1)
    return pages.select("page_id", "url", "html", F.when(place != "", F.lower(place)).alias("host"),
                        F.coalesce(path, F.lit("")).alias("path"), F.unhex(F.sha2("html", 256)).alias("page_sha"))


def shared_lines(keys: DataFrame, near: int = NEAR) -> DataFrame:
    """(host, digest, gone): numbers of the lines that half of the neighbours share."""
    pages = keys.groupBy("host", "digest").agg(F.min("path").alias("path"), F.first("keys").alias("keys"))
    ranked = global_row_number(pages, ["host", "path", "digest"], "rank")
    block, place = F.expr(f"rank div {BLOCK}"), F.col("rank") % BLOCK
    blocks = F.array_compact(F.array(block, F.when(place < near, block - 1), F.when(place >= BLOCK - near, block + 1)))

    def difference(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("rank", ignore_index=True)
        hosts, lines, own = g["host"].to_list(), [list(k) for k in g["keys"]], g["rank"] // BLOCK == g["block"]
        votes = [np.zeros(len(k), np.int64) for k in lines]
        partners = np.zeros(len(g), np.int64)
        for i in range(len(g)):
            for j in range(i + 1, min(i + near, len(g) - 1) + 1):
                if hosts[i] != hosts[j]:
                    break
                partners[[i, j]] += 1
                for x, y in common_lines(lines[i], lines[j]):
                    votes[i][x] += 1
                    votes[j][y] += 1
        gone = [np.flatnonzero(2 * v >= max(p, 1)).astype(np.int32) for v, p in zip(votes, partners)]
        return pd.DataFrame({"host": g["host"], "digest": g["digest"], "gone": gone})[own]

    each = ranked.select("host", "digest", "keys", "rank", F.explode(blocks).alias("block"))
    return each.groupBy("block").applyInPandas(difference, "host string, digest binary, gone array<int>")


def template(lines: list[Line], gone) -> set[int]:
    """Numbers of the shared lines that are template: all but the prose of an article."""
    return {i for i in gone if not lines[i].article} if gone is not None else set()


def main_text(lines: list[Line], gone) -> str:
    """What is left: lines that are no template, then without named regions and, where there is an article, outside it."""
    deleted = template(lines, gone)
    left = [line for i, line in enumerate(lines) if i not in deleted and not line.region]
    if any(line.article for line in lines):
        left = [line for line in left if line.article]
    return " ".join(line.text for line in left)


def extract(pages: DataFrame, near: int = NEAR) -> DataFrame:
    """(page_id, url, text, n_chars, n_lines, n_shared, n_quoted) for every page.

    Of the lines that neighbours share, n_shared went as template and n_quoted stay as prose of the article.
    """
    rows = located(pages)
    keys = page_keys(rows)
    shared = materialize(shared_lines(keys, near).filter(F.size("gone") > 0))
    by_page = keys.select("host", "page_sha", "digest").distinct().join(
        small_or_shuffled(shared, F.size("gone") * 4 + 64), ["host", "digest"]).select("host", "page_sha", "gone")
    by_page = materialize(by_page)
    joined = rows.join(small_or_shuffled(by_page, F.size("gone") * 4 + 64), ["host", "page_sha"], "left")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [lines_of(p) for p in b["html"]]
            n_gone = np.array([0 if g is None else len(g) for g in b["gone"]], np.int64)
            n_shared = np.array([len(template(f, g)) for f, g in zip(found, b["gone"])], np.int64)
            yield pd.DataFrame({
                "page_id": b["page_id"], "url": b["url"],
                "text": [main_text(f, g) for f, g in zip(found, b["gone"])],
                "n_lines": [len(f) for f in found], "n_shared": n_shared, "n_quoted": n_gone - n_shared})
    done = joined.select("page_id", "url", "html", "gone").mapInPandas(
        cut, f"page_id {_type(pages, 'page_id')}, url string, text string, n_lines int, n_shared int, n_quoted int")
    return done.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_lines", "n_shared",
                       "n_quoted")


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()
