"""Main text of web pages: markup regions, and suffix arrays over the pages of a host for what markup leaves open.

A page is cut into blocks (text between block-level tags). Markup settles most blocks: those inside ``article`` or ``main`` are main text; menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments, known by tag, role, class or id, are not. Repeats alone
could not tell them apart: an advert that occurs once is unique, and an article that two pages of a host carry is a repeat.

For all other (open) blocks the pages of a host decide. The token streams outside the main regions are concatenated, sorted as a suffix
array (ranks doubled up to ``WINDOW`` tokens, one array for each host and batch of pages, merged by the substrings of that length). A substring of ``WINDOW``
tokens is repeated if it occurs on ``FEWEST`` distinct pages of the host or more and on ``SHARE`` of them. An open block is boilerplate if each of its tokens lies
in a repeated substring; it is removed whole, and all others stay whole: a phrase or sentence that pages share takes nothing out of a block, and an article that a few pages
carry stays. A page that is nothing but repeats has no text. Hosts of fewer than ``FEWEST`` pages show no repeats; there all open blocks stay.

An element is named boilerplate by a whole class name, id or role: each part of it must be a word for boilerplate or one for a place or shape (``PLACES``: top-ad, comment-list), so that
names which speak of something else too (no-sidebar, search-algorithms, share-price) mark nothing. Ids are often anchors: those of headings, paragraphs, figures and list items do not count, nor do those of sections in main text.
``article`` and ``main`` are main text whatever their names; names decide only about those inside another article or a marked element.
Text of a marked inline element goes, and the text around it stays one block.

Null html: empty text. Null url: one host of its own name (empty). Repeated rows count as one page and each get a row.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import mix, pieces, replace_column, table, written
from .jaccard import small

WINDOW = 8
FEWEST = 4
SHARE = 0.2

# Names from the HTML standard and common class names.
RAW = "script style template noscript iframe svg math object canvas textarea select title head"
BLOCK = set("address article aside blockquote body button caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
            "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE_TAGS = set("nav footer aside form menu dialog button".split())
BOILERPLATE_NAMES = set(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent contentinfo complementary cookie cookies dialog disqus "
    "footer gdpr login menu modal nav navbar navigation newsletter notice pager pagination popup promo recommended related reply respond search share "
    "sharing sidebar signup social sponsor sponsored subscribe teaser toolbar widget".split())
HEADER_NAMES = set("header masthead".split())
#: Parts of a name that say where or in what shape something stands.
PLACES = set("top bottom left right upper lower first last fixed floating sticky wide narrow small large mobile desktop global site page primary secondary main list "
             "lists item items box bar row wrap wrapper container area block inner outer holder slot unit panel pane tray button buttons link links form thread message messages policy "
             "col column section div leaderboard skyscraper a b c x".split())
ANCHORED = set("h1 h2 h3 h4 h5 h6 p figure figcaption li dt dd blockquote pre table tr td th caption".split())

_markup = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_attribute = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_raw_end = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in RAW.split()}
_name = re.compile(r"[a-z]+")
_none = re.compile(r"display\s*:\s*none")
_spaces = re.compile(r"\s+")

MAIN, OPEN, MARKED = 0, 1, 2


def _hidden(attributes: str) -> bool:
    for name, a, b, c in _attribute.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _none.search(value):
            return True
    return False


def _named(tag: str, attributes: str, in_main: bool) -> bool:
    """Does a class, id or role name boilerplate?"""
    words = BOILERPLATE_NAMES if in_main else BOILERPLATE_NAMES | HEADER_NAMES
    asked = ("class", "role") if tag in ANCHORED or in_main and tag == "section" else ("class", "id", "role")
    for name, a, b, c in _attribute.findall(attributes):
        if name.lower() in asked:
            for whole in (a or b or c).lower().split():
                parts = set(_name.findall(whole))
                if parts & words and parts <= words | PLACES:
                    return True
    return False


def blocks(page: str) -> list[tuple[int, str]]:
    """(region, text) of each block that is not empty, in page order; character references are decoded and white space is one space."""
    out: list[tuple[int, str]] = []
    # Open block-level elements and those that change the region, with the region before and, for inline ones, the text that goes on behind them.
    stack: list[tuple[str, int, list[str] | None]] = []
    region, text, at, n = OPEN, [], 0, len(page)

    def close() -> None:
        if text:
            whole = _spaces.sub(" ", entities.unescape("".join(text))).strip()
            text.clear()
            if whole:
                out.append((region, whole))

    def leave() -> str:
        """End of the innermost open element; its tag."""
        nonlocal region, text
        tag, before, rest = stack.pop()
        if rest is not None:
            close()
            text = rest
        region = before
        return tag

    while at < n:
        m = _markup.search(page, at)
        text.append(page[at:m.start() if m else n])
        if not m:
            break
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCK:
                close()
            if any(t == tag for t, *_ in stack):
                while leave() != tag:
                    pass
            continue
        if tag in _raw_end:
            close() if tag in BLOCK or tag == "head" else text.append(" ")
            if tag == "head":  # ends with its own end or where the body begins
                body = re.compile(r"</head\b[^>]*>|<body\b", re.I).search(page, at)
                at = n if not body else body.end() if body[0][1] == "/" else body.start()
            elif not m[3].endswith("/"):
                end = _raw_end[tag].search(page, at)
                at = end.end() if end else n
            continue
        if tag in VOID:
            if tag in BLOCK:
                close()
            else:
                text.append(" ")
            continue
        in_main = region == MAIN
        hidden = bool(m[3]) and tag not in ("html", "body") and _hidden(m[3])
        decides = tag in ("article", "main") and region != MARKED and not any(t == "article" for t, *_ in stack)
        marked = hidden or bool(m[3]) and tag not in ("html", "body") and not decides and _named(tag, m[3], in_main)
        to = region
        if tag in BOILERPLATE_TAGS or marked or tag == "header" and not in_main:
            to = MARKED
        elif tag in ("article", "main"):
            to = MARKED if any(t in ("aside", "form") or b == MAIN and region == MARKED for t, b, _ in stack) else MAIN
        if tag in BLOCK:
            close()
            while stack and stack[-1][0] == "p":  # a paragraph ends where another block begins
                leave()
                to = region if to not in (MAIN, MARKED) else to
            stack.append((tag, region, None))
            region = to
        elif to != region or any(t == tag and rest is not None for t, _, rest in stack):
            stack.append((tag, region, text))
            region, text = to, []
    while stack:
        close()
        leave()
    close()
    return out


def suffix_runs(tokens: np.ndarray, page: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of one concatenated stream, sorted to ``width`` tokens: (positions in suffix order, starts of the runs of equal prefixes).

    Only suffixes with ``width`` tokens left on their own page are listed. Ranks of 1, 2, 4, ... tokens are doubled; the last step overlaps.
    """
    n = len(tokens) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    have = 1
    while have < width:
        step = min(have, width - have)
        left, right = rank[:len(rank) - step], rank[step:]
        rank = np.unique(left * (int(rank.max()) + 1) + right, return_inverse=True)[1].astype(np.int64)
        have += step
    at = np.flatnonzero(page[:n] == page[width - 1:])
    order = at[np.argsort(rank[at], kind="stable")]
    sorted_rank = rank[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_rank[1:] != sorted_rank[:-1]])) if len(order) else np.zeros(0, np.int64)
    return order, starts


def window_hashes(tokens: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` tokens from each position."""
    h = np.zeros(len(at), np.uint64)
    for i in range(width):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + tokens[at + i])
    return h.view(np.int64)


def _streams(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all pages of a batch, mixed with the page's host, and the row of each."""
    column = batch.column("__stream")
    n = np.array([len(x) for x in column.to_pylist()], np.int64)
    row = np.repeat(np.arange(len(n)), n)
    tokens = np.asarray(column.flatten(), np.int64).view(np.uint64)
    host = np.array([xxh64_intdigest(h) for h in batch.column("__host").to_pylist()], np.uint64)
    return mix(tokens ^ host[row]), row


def _strip(texts: list[str], begin: list[int], covered: set[int], width: int) -> list[str]:
    """Blocks of a page without the open blocks that are covered from end to end."""
    hit = {p + i for p in covered for i in range(width)}
    return [t for t, b in zip(texts, begin) if b < 0 or not all(b + i in hit for i in range(t.count(" ") + 1))]


def extract(pages: DataFrame, html_col: str = "html", url_col: str = "url", width: int = WINDOW, fewest: int = FEWEST,
            share: float = SHARE) -> DataFrame:
    """``pages`` without its html, plus ``text``: the main blocks in page order, joined by a line feed."""
    keep = [c for c in replace_column(pages, "text") if c != html_col]
    cols = [F.col(f"`{c}`") for c in keep]
    host = F.coalesce(F.lower(F.regexp_extract(F.col(f"`{url_col}`"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    page = F.col(f"`{html_col}`")
    rows = pages.select(*cols, host.alias("__host"), F.xxhash64(*cols, page).alias("__page"),
                        F.monotonically_increasing_id().alias("__row"), page.alias("__html"))
    more = ["__begin", "__blocks", "__stream"]
    fields = rows.drop("__html").schema
    for name, kind in zip(more, (T.IntegerType(), T.StringType(), T.LongType())):
        fields = fields.add(name, T.ArrayType(kind))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "__html", 1 << 20):
            begins, texts, streams = [], [], []
            for page_html in b.column("__html").to_pylist():
                begin, text, stream = [], [], []
                for region, block in blocks(page_html or ""):
                    if region != MARKED:
                        begin.append(len(stream) if region == OPEN else -1)
                        text.append(block)
                    if region != MAIN:
                        stream += [xxh64_intdigest(w) for w in block.split(" ")]
                begins.append(begin)
                texts.append(text)
                streams.append(np.array(stream, np.uint64).view(np.int64))
            cols = [b.column(i) for i, c in enumerate(b.schema.names) if c != "__html"]
            made = [pa.array(begins, pa.list_(pa.int32())), pa.array(texts, pa.list_(pa.string())), pa.array(streams, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*cols, *made], names=[c for c in b.schema.names if c != "__html"] + more)

    parsed = written(rows.mapInArrow(parse, fields), "pages")

    def substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each substring of ``width`` tokens of a batch: its host and the number of pages that it is on."""
        for b in batches:
            tokens, row = _streams(b)
            order, starts = suffix_runs(tokens, row, width)
            if len(order):
                on = row[order]  # ascending within a run
                new = np.concatenate([[True], on[1:] != on[:-1]])
                new[starts] = True
                yield pa.RecordBatch.from_arrays([pa.array(window_hashes(tokens, order[starts], width)), b.column("__key").take(pa.array(on[starts])),
                                                  pa.array(np.add.reduceat(new, starts, dtype=np.int32))], names=["win", "__key", "n"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The substrings of each page with an open block, with their positions."""
        for b in batches:
            tokens, row = _streams(b)
            at, _ = suffix_runs(tokens, row, width)
            if len(at):
                first = np.searchsorted(row, np.arange(b.num_rows))
                yield pa.RecordBatch.from_arrays([pa.array(window_hashes(tokens, at, width)), pa.array(b.column("__page").to_numpy()[row[at]]),
                                                  pa.array((at - first[row[at]]).astype(np.int32))], names=["win", "__page", "at"])

    # Of repeated rows the first one speaks for the page.
    first = parsed.groupBy("__page").agg(F.min("__row").alias("__first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = parsed.select("__page", "__row").join(small(first, 24), "__page").filter("__row > __first").select("__row")
    stream = parsed.withColumn("__key", F.xxhash64("__host")).select("__row", "__host", "__key", "__stream").join(small(written(again, "again"), 16), "__row", "left_anti")
    least = parsed.groupBy(F.xxhash64("__host").alias("__key")).agg(F.countDistinct("__page").alias("pages")).select(
        "__key", F.greatest(F.lit(fewest), F.ceil(F.col("pages") * share)).alias("least"))
    counted = (stream.mapInArrow(substrings, "win bigint, __key bigint, n int").groupBy("win", "__key").agg(F.sum("n").alias("n")).filter(F.col("n") >= fewest))
    repeated = counted.join(small(written(least, "least"), 24), "__key").filter("n >= least").select("win")
    is_open = F.exists("__begin", lambda x: x >= 0)
    covered = (parsed.filter(is_open).select("__host", "__page", "__stream").mapInArrow(windows, "win bigint, __page bigint, at int")
               .join(repeated, "win", "left_semi").groupBy("__page").agg(F.collect_set("at").alias("__covered")))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [b.column(c).to_pylist() for c in ("__blocks", "__begin", "__covered")]
            text = ["\n".join(_strip(t, begin, set(c or ()), width)) for t, begin, c in zip(*lists)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(text, pa.string())], names=[*keep, "text"])

    kept = parsed.drop("__host", "__stream")
    settled = kept.filter(~is_open).select(*cols, F.array_join("__blocks", "\n").alias("text"))
    return settled.unionByName(kept.filter(is_open).join(covered, "__page", "left").mapInArrow(strip, settled.schema))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
