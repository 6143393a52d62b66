"""Main text of web pages: nearest-URL page differencing, and the regions of the markup as the check on what it deletes.

A page becomes text lines, one for each block element, in page order. The different urls are sorted by host, path and url, and
every page is held against the one of the urls beside its own on that host whose path shares the longest beginning (the one
before, where both share the same). Lines are aligned by longest common subsequences, those of ruled-out regions (menus,
footers, sidebars, forms, notices, adverts, comments, hidden elements: by the element or by the words of its class, id and role)
among themselves. Lines shared with the nearest page are deleted, and the markup checks the rest:

* lines of ruled-out regions go, also where they differ from the nearest page's (menus and adverts rotate within a host);
* where the page marks an article (else a main element), lines outside it go, and its shared lines come back: pages of a host
  share whole paragraphs of articles (see README). A list of two or more items that is nothing but links and wholly shared does
  not come back: a menu inside the article. It does where the nearest page holds half of the article's other characters or
  more, as a copy or an edition of it shares its lists of links too.

A page whose url is the only one of its host has nothing to be held against: its unmarked lines stay. Urls are sorted in ranges,
and the urls at the ends of ranges are carried over, so the result does not depend on the partitions.

Nulls and empty pages give an empty text; a null url counts as an empty host and path. Repeated rows are kept; copies (rows of
the same url) have the same neighbours, and as a neighbour the copy of the least page_id stands for them. An empty table
gives an empty result. Other columns than page_id, url and html are neither read nor returned. A hot host is spread over
many partitions by the range of its paths. Between pages lines are compared by fingerprints of 61 bits. Very long pages are
aligned in memory that grows with their lines, in time that grows with the product of the numbers of lines both hold, over 64.
Of several longest common subsequences (a line repeated in a page) one is taken, always the same.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import lean, partitions, stored

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WHITE = re.compile(r"\s+")
RAW = frozenset("script style noscript template textarea title iframe object svg math select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr input button".split())
OUT_TAGS = frozenset("nav footer aside form button menu dialog head".split())
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side-bar comment comments "
    "disqus cookie cookies consent gdpr notice notices notification alert popup modal overlay menu nav navbar navigation breadcrumb "
    "breadcrumbs footer masthead topbar toolbar share sharing social related recommended newsletter subscribe subscription "
    "signup login search pagination pager widget copyright disclaimer".split()
)
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = frozenset("ul ol dl table div section article main body".split())
#: Lowest bits of a line's fingerprint: in a ruled-out region, in the text of `lines`, list item of links only.
OUT, HELD, LINK = 1, 2, 4


def _out(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in OUT_TAGS or tag in RAW or (tag == "header" and not in_article):
        return True
    if not attributes:
        return False
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
    if tag not in ("html", "body", "article", "main"):
        words = re.split(r"[\s_]+|(?<=[a-z])(?=[A-Z])", f"{found.get('class', '')} {found.get('id', '')}")
        for w in words:
            w = w.lower()
            if w in OUT_WORDS or ("-" in w and not OUT_WORDS.isdisjoint(w.split("-"))):
                return True
    return found.get("role", "").lower() in OUT_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()


def blocks(page: str) -> list[tuple[str, int, bool, bool]]:
    """All lines of a page: text, mark (2 article, 1 main, 0 neither), in a ruled-out region, list item of links only."""
    found: list[tuple[str, int, bool, bool]] = []
    stack: list[tuple[str, bool, int, int]] = []
    text: list[str] = []
    beside: list[str] = []  # text of ruled-out regions
    at, out, mark, raw = 0, False, 0, ""
    link, plain = 0, False  # link: 1 inside a, 2 inside li, 3 both; plain: the line has text outside links of list items

    def add(piece: str) -> None:
        nonlocal plain
        (beside if out else text).append(piece)
        plain = plain or not out and link != 3 and not piece.isspace()

    def flush() -> None:
        nonlocal plain
        for own, pieces in ((True, text), (False, beside)):
            if pieces:
                line = WHITE.sub(" ", entities.unescape("".join(pieces))).strip()
                if line:
                    found.append((line, mark if own else 0, not own, own and not plain))
                pieces.clear()
        plain = False

    def pop(k: int) -> None:
        nonlocal out, mark, link
        del stack[k:]
        out, mark, link = stack[-1][1:] if stack else (False, 0, 0)

    for m in TOKEN.finditer(page):
        tag = (m[2] or "").lower()
        if raw:  # the text of such an element ends with its own end tag only
            if not (m[1] and tag == raw):
                continue
            raw, at = "", m.end()
            pop(len(stack) - 1)
            continue
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if not tag:
            continue
        if tag not in INLINE:
            flush()
        elif tag == "br":
            for pieces in (text, beside):
                if pieces:
                    pieces.append(" ")
        if m[1]:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if k is not None:
                pop(k)
            continue
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "math"):
            continue
        if tag in CLOSES or tag not in INLINE and stack and stack[-1][0] == "p":
            ends = CLOSES.get(tag, {"p"})
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in ends or stack[i][0] in STOPS), None)
            if k is not None and stack[k][0] in ends:
                pop(k)
        inner = max(mark, {"article": 2, "main": 1}.get(tag, 0) if not out else 0)
        out = out or _out(tag, m[3], inner > 0)
        mark = inner
        link |= {"a": 1, "li": 2}.get(tag, 0)
        stack.append((tag, out, mark, link))
        if tag in RAW:
            raw = tag
    if not raw and at < len(page):
        add(page[at:])
    flush()
    return found


def _best(found: list[tuple[str, int, bool, bool]]) -> int:
    return max((mark for _, mark, out, _ in found if not out), default=0)


def lines(page: str) -> tuple[list[str], bool]:
    """(text lines of the article or main element where one is marked, else all that no region rules out; whether it is marked)."""
    found = blocks(page)
    best = _best(found)
    return [line for line, mark, out, _ in found if not out and mark >= best], best > 0


def fingerprints(page: str) -> tuple[str, list[int], bool]:
    """(text of `lines`, fingerprints of all lines of the page with the bits OUT, HELD and LINK, whether it is marked)."""
    found = blocks(page)
    best, text, prints = _best(found), [], []
    for line, mark, out, linked in found:
        held = not out and mark >= best
        if held:
            text.append(line)
        bits = int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
        prints.append(bits & ~7 | OUT * out | HELD * held | LINK * linked)
    return "\n".join(text), prints, best > 0


def _lengths(a: Sequence, b: Sequence) -> list[int]:
    """Lengths of the longest common subsequences of a and each beginning of b; a row of the table is one integer."""
    where: dict[object, list[int]] = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)

    def places(x: object) -> int:
        room = bytearray(len(b) // 8 + 1)
        for j in where[x]:
            room[j >> 3] |= 1 << (j & 7)
        return int.from_bytes(room, "little")

    hot = {x: places(x) for x, at in where.items() if 64 * len(at) > len(b)}  # 64 at most
    row = full = (1 << len(b)) - 1
    for x in a:
        if x in where:
            hit = row & (hot[x] if x in hot else places(x))
            row = (row + hit | row - hit) & full
    out = [0]
    for bit in reversed(f"{row:0{len(b)}b}"):
        out.append(out[-1] + (bit == "0"))
    return out


def common_lines(a: Sequence, b: Sequence) -> set[int]:
    """Positions in a of one longest common subsequence of a and b (Hirschberg's halves)."""
    in_a, in_b = set(a), set(b)
    at = [i for i, x in enumerate(a) if x in in_b]
    a, b = [a[i] for i in at], [x for x in b if x in in_a]
    out: set[int] = set()
    left = [(0, len(a), 0, len(b))]
    while left:
        i, end, j, last = left.pop()
        while i < end and j < last and a[i] == b[j]:
            out.add(at[i])
            i, j = i + 1, j + 1
        while i < end and j < last and a[end - 1] == b[last - 1]:
            end, last = end - 1, last - 1
            out.add(at[end])
        if i == end or j == last:
            continue
        if end - i == 1:
            if a[i] in b[j:last]:
                out.add(at[i])
            continue
        half = (i + end) // 2
        fore, back = _lengths(a[i:half], b[j:last]), _lengths(a[half:end][::-1], b[j:last][::-1])
        cut = max(range(last - j + 1), key=lambda k: fore[k] + back[last - j - k])
        left += [(i, half, j, j + cut), (half, end, j + cut, last)]
    return out


def settled(text: str, own: list[int], other: list[int], marked: bool) -> tuple[str, int]:
    """(text of a page after its differencing and the check, number of its lines shared): own and other of `fingerprints`."""
    shared: set[int] = set()
    for side in (0, OUT):
        at = [i for i, x in enumerate(own) if x & OUT == side]
        shared |= {at[k] for k in common_lines([own[i] >> 3 for i in at], [x >> 3 for x in other if x & OUT == side])}
    held = dict(zip((i for i, x in enumerate(own) if x & HELD), text.split("\n")))
    gone = shared
    if marked:
        size = lambda some: sum(len(held[i]) for i in some)
        prose = [i for i in held if not own[i] & LINK]
        runs = [list(run) for link, run in groupby(held, lambda i: own[i] & LINK) if link]
        gone = {i for run in runs if len(run) > 1 and shared.issuperset(run) for i in run} if 2 * size(shared.intersection(prose)) < size(prose) else set()
    return "\n".join(line for i, line in held.items() if i not in gone), len(shared)


def _shared(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, key (of the url), and text, lines and marked of `fingerprints`. Not stored: texts are parsed again instead."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts, prints, marked = zip(*map(fingerprints, part.column(3).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(texts, pa.string()), pa.array(prints, pa.list_(pa.int64())), pa.array(marked, pa.bool_())], names=["page_id", "url", "key", "text", "lines", "marked"])

    key = F.coalesce(F.concat(F.lit("="), F.col("url")), F.lit(""))  # a null url is not an empty one
    rows = pages.select("page_id", "url", key.alias("key"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(lean(run), f"page_id {kind}, url string, key string, text string, lines array<bigint>, marked boolean")


def nearest(keys: DataFrame) -> DataFrame:
    """(key, near) of each url that has another one on its host: near is the key of the nearest one."""
    spark = keys.sparkSession
    host = F.lower(F.regexp_extract("key", r"^=[a-zA-Z][\w+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract("key", r"^=[a-zA-Z][\w+.-]*://[^/?#]*([^?#]*)", 1)
    names = ("host", "path", "key")
    urls = keys.select("key").distinct().select(host.alias("host"), path.alias("path"), "key")

    def chosen(row: tuple, before: tuple | None, after: tuple | None) -> str | None:
        beside = [n for n in (before, after) if n and n[0] == row[0]]
        return max(beside, key=lambda n: _shared(n[1], row[1]))[2] if beside else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(out: list[tuple]) -> pa.RecordBatch:
            # the ends of a range come with themselves and the url beside them (side -1: first, 1: last, 2: both), others with near
            return pa.RecordBatch.from_pylist([dict(zip(fields, r, strict=True)) for r in out], schema=shape)

        shape = pa.schema([("key", pa.string()), ("near", pa.string()), ("side", pa.int32()), ("part", pa.int32()), ("host", pa.string()), ("path", pa.string()), ("inner_path", pa.string()), ("inner_host", pa.string())])
        fields, part = shape.names, TaskContext.get().partitionId()

        def end(row: tuple, inner: tuple | None, side: int) -> tuple:
            return row[2], inner and inner[2], side, part, row[0], row[1], inner and inner[1], inner and inner[0]

        before: tuple | None = None
        row: tuple | None = None
        done: list[tuple] = []
        for batch in batches:
            for following in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row is not None:
                    if before is None:
                        done.append(end(row, following, -1))
                    elif (near := chosen(row, before, following)) is not None:
                        done.append((row[2], near, 0, part, None, None, None, None))
                before, row = row, following
                if len(done) >= 1024:
                    yield made(done)
                    done = []
        if row is not None:
            done.append(end(row, before, 1 if before else 2))
        if done:
            yield made(done)

    ranged = urls.repartitionByRange(partitions(spark), *names).sortWithinPartitions(*names).select(*names)
    found = stored(ranged.mapInArrow(run, "key string, near string, side int, part int, host string, path string, inner_path string, inner_host string"), "html-nearest")
    # two rows of a range at most
    ends = sorted(found.where("side != 0").collect(), key=lambda r: (r["part"], r["side"]))
    joined = []
    for at, r in enumerate(ends):
        row, inner = (r["host"], r["path"], r["key"]), (r["inner_host"], r["inner_path"], r["near"]) if r["near"] is not None else None
        other = lambda k: (ends[k]["host"], ends[k]["path"], ends[k]["key"]) if 0 <= k < len(ends) else None
        before, after = other(at - 1) if r["side"] != 1 else inner, other(at + 1) if r["side"] != -1 else inner
        if (near := chosen(row, before, after)) is not None:
            joined.append((r["key"], near))
    return found.where("side = 0").select("key", "near").unionByName(spark.createDataFrame(joined, "key string, near string"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page, and of its differencing near_url, n_lines of the whole page and n_shared of them
    (null where the host has no other url; near_url also where the nearest url is null)."""
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = parsed(pages)
    prints = stored(rows.select("page_id", "key", "lines"), "html-lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for text, own, marked, other in zip(*(c.to_pylist() for c in batch.columns[3:]), strict=True):
                text, shared = (text, None) if other is None else settled(text, own, other, marked)
                texts.append(text)
                counts.append((len(own), shared))
            n_lines, n_shared = zip(*counts) if counts else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_shared, pa.int64())], names=["page_id", "url", "near", "text", "n_lines", "n_shared"])

    first = prints.groupBy(F.col("key").alias("near")).agg(F.min(F.struct("page_id", "lines"))["lines"].alias("other"))
    held = nearest(prints).join(first.hint("merge"), "near")
    both = rows.join(held.hint("merge"), "key", "left").select("page_id", "url", "near", "text", "lines", "marked", "other")
    out = both.mapInArrow(lean(run), f"page_id {kind}, url string, near string, text string, n_lines bigint, n_shared bigint")
    near = F.when(F.col("near") != "", F.expr("substring(near, 2)"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), near.alias("near_url"), "n_lines", "n_shared")
