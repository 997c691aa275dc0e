"""Main text of web pages by differencing pages with near URLs.

A page becomes text lines, one for each block of its markup, each with the zone it stands in: ``article`` inside
article or main, ``frame`` inside navigation, headers, footers, sidebars, forms, adverts, notices and comments, hidden, or
outside the article of a page that has one, ``open`` where the markup doesn't tell or a name only hints at a frame
(``share-price``, ``article-header``), and ``title`` for an h1 in the header of a page whose article has none.
Pages of a host are sorted by URL path over range partitions,
and each page is paired with the neighbour whose path shares the longer prefix; copies, with the same lines, are no neighbours
but look for the next different page on either side.  Pages at the edge of a range get the neighbours that lie in other ranges
afterwards, so that the number of ranges changes nothing.  The lines of the two are
aligned by longest common subsequence; lines that both have come from the site's template and are deleted.  The markup
is the exact check that follows: lines of an article are kept when they are shared (reprints, quotations), lines of a frame
go also when they are not shared, and a title needs a neighbour without it.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourloom.durable import scratch_path

ARTICLE, FRAME, OPEN, TITLE = 0, 1, 2, 3
_OUTSIDE = 4  # open, if the page has no article
_TAG = r"""<[!?/]?[a-zA-Z](?:=\s*"[^"]*"|=\s*'[^']*'|[^>=]|=)*+(?:>|$)"""
_PARTS = re.compile(rf"<!--.*?(?:-->|$)|<(script|style|noscript|template|svg|iframe|textarea|select|title)\b.*?(?:</\1\s*>|$)|{_TAG}|<![^>]*>|[^<]+|<", re.S | re.I)
_NAME = re.compile(r"</?\s*([a-zA-Z][a-zA-Z0-9]*)")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FRAMES = frozenset("nav header footer aside form menu dialog button head".split())
_TELLING = re.compile(r"class|id|role|hidden|style", re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_ADVERT = re.compile(r"ads?|advert\w*|sponsor\w*|promo\w*")
_FRAME_WORD = re.compile(
    _ADVERT.pattern
    + r"|banner|cookies?|consent|notice|popup|modal|newsletter|subscribe|share|social|sidebar|widget|nav|navbar|navigation|menu|breadcrumbs?|header|footer|comments?|replies|related|pagination|complementary|contentinfo|search"
)
#: Words that say where or how a frame stands, not what else it might be.
_PLACE_WORD = re.compile(r"\d*|site|page|main|top|bottom|left|right|global|primary|secondary|box|block|bar|list|container|wrapper|section|area|slot|unit|form|links?|user|reader|posts?")
_SPACE = re.compile(r"\s+")
_PLAIN, _HINT, _NAMED, _AD = 0, 1, 2, 3


def _role(token: str) -> int:
    """What the attributes of a tag say: nothing, a frame among other words, a frame, or an advert or hidden."""
    found = _PLAIN
    start = _NAME.match(token).end()
    for name, *values in _ATTRIBUTE.findall(token, start):
        name, value = name.lower(), next(filter(None, values), "")
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _UNSEEN.search(value)):
            return _AD
        if name not in ("class", "id", "role"):
            continue
        for word in value.lower().split():
            parts = re.split(r"[-_]+", word)
            frames = [x for x in parts if _FRAME_WORD.fullmatch(x)]
            if frames:
                whole = all(x in frames or _PLACE_WORD.fullmatch(x) for x in parts)
                found = max(found, (_AD if any(map(_ADVERT.fullmatch, frames)) else _NAMED) if whole else _HINT)
    return found


def page_lines(source: str | None) -> list[tuple[str, int]]:
    """(text, zone) of all blocks that have text, in page order."""
    lines: list[tuple[str, int]] = []
    words: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements that are not inline, and the zone before them
    titles: list[int] = []  # lines of an h1 in a header, or outside
    headed = False  # by an h1 of the article
    left_out: list[str] = []  # the inline element that is left out, and those of its name inside it
    zone = _OUTSIDE

    def close() -> None:
        nonlocal headed
        left_out.clear()
        text = _SPACE.sub(" ", html.unescape("".join(words))).strip()
        words.clear()
        if not text:
            return
        names = {t for t, _ in stack}
        if "h1" in names:
            headed |= zone in (ARTICLE, OPEN)
            if zone == _OUTSIDE or (zone == FRAME and "header" in names and len(names & _FRAMES) == 1):
                titles.append(len(lines))
        lines.append((text, zone))

    for m in _PARTS.finditer(source or ""):
        token = m.group()
        if token[0] != "<" or len(token) == 1:
            if not left_out:
                words.append(token)
            continue
        name = _NAME.match(token)
        if not name or m.group(1):
            continue
        tag = name.group(1).lower()
        if tag == "br":
            words.append(" ")
            continue
        said = _role(token) if token[1] != "/" and _TELLING.search(token, name.end()) else _PLAIN
        if tag in _INLINE:
            if left_out and tag == left_out[0] and token[1] == "/":
                left_out.pop()
            elif tag not in _VOID and token[1] != "/" and (tag == left_out[0] if left_out else said == _AD):
                left_out.append(tag)
            continue
        close()
        if tag in _VOID or token.endswith("/>"):
            continue
        if token[1] == "/":
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    zone = stack[k][1]
                    del stack[k:]
                    break
            continue
        if tag == "p" and stack and stack[-1][0] == "p":
            zone = stack.pop()[1]
        inside = zone in (ARTICLE, OPEN)
        stack.append((tag, zone))
        if tag in ("body", "html", "article", "main") and said != _AD:
            zone = ARTICLE if zone != FRAME and tag in ("article", "main") else zone
        elif zone == FRAME or (tag in _FRAMES and not (tag == "header" and inside)) or said >= _NAMED:
            zone = FRAME
        elif said == _HINT and inside:
            zone = OPEN
    close()
    own = any(z in (ARTICLE, OPEN) for _, z in lines)
    kinds = [z if z != _OUTSIDE else FRAME if own else OPEN for _, z in lines]
    for k in [] if headed else titles:
        kinds[k] = TITLE if kinds[k] == FRAME else OPEN
    return [(text, kind) for (text, _), kind in zip(lines, kinds)]


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Numbers of the lines of ``a`` in a longest common subsequence with ``b``."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    tail = 0
    while tail < min(len(a), len(b)) - low and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = {*range(low), *range(len(a) - tail, len(a))}
    places: dict[str, list[int]] = {}
    for j in range(len(b) - tail - 1, low - 1, -1):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []  # smallest last place in b of a common subsequence of each length
    links: list[tuple] = []  # and its chain of lines of a
    for i in range(low, len(a) - tail):
        for j in places.get(a[i], ()):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            ends[k : k + 1] = [j]
            links[k : k + 1] = [link]
    link = links[-1] if links else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


_PAGE = "page_id bigint, url string, host string, path string, tie bigint, payload binary"
_RESULT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("paired_with", pa.int64()), ("n_shared_lines", pa.int64()), ("n_open_lines", pa.int64())])
_RESULT_COLUMNS = "page_id bigint, url string, text string, n_chars bigint, paired_with bigint, n_shared_lines bigint, n_open_lines bigint"
_PLACED = pa.schema([("kind", pa.int32()), ("part", pa.int32()), *_RESULT, ("host", pa.string()), ("path", pa.string()), ("digest", pa.binary()), ("payload", pa.binary())])
#: Kinds of rows: results, pages of the first and last run of a range, and the pages that other ranges may need.
_DONE, _FIRST_RUN, _LAST_RUN, _FIRST, _SECOND, _LAST_BUT_ONE, _LAST = range(7)


def _packed(lines: list[tuple[str, int]]) -> bytes:
    """Zones as digits, then the lines, which hold no line break, compressed."""
    return zstandard.compress("\n".join(["".join(str(z) for _, z in lines), *(t for t, _ in lines)]).encode(), 3)


def _unpacked(payload: bytes) -> tuple[list[str], list[int]]:
    zones, *lines = zstandard.decompress(payload).decode().split("\n")
    return lines, [int(z) for z in zones]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for start in range(0, b.num_rows, 256):
            part = b.slice(start, 256)
            found = pa.array([_packed(page_lines(x.as_py())) for x in part.column(5)], pa.binary())
            yield pa.record_batch([*[part.column(k) for k in range(5)], found], names=["page_id", "url", "host", "path", "tie", "payload"])


def _clean(page: tuple, *others: tuple | None) -> tuple:
    """The result row of a page (page_id, url, host, path, payload, lines, zones) between its neighbours."""
    near = [o for o in others if o is not None and o[2] == page[2]]
    best = max(near, key=lambda o: _prefix(o[3], page[3]), default=None)
    shared = common_lines(page[5], best[5]) if best else set()
    kept = [t for i, (t, z) in enumerate(zip(page[5], page[6])) if z == ARTICLE or (i not in shared and (z == OPEN or (z == TITLE and best)))]
    text = " ".join(kept)
    return page[0], page[1], text, len(text), best[0] if best else None, len(shared), sum(z in (OPEN, TITLE) for z in page[6])


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == 256:
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)


def _sorted_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for start in range(0, b.num_rows, 256):
            for row in zip(*[b.column(k).slice(start, 256).to_pylist() for k in (0, 1, 2, 3, 5)]):
                yield (*row, *_unpacked(row[4]))


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages arrive sorted by host and path; a run of copies is held with the different pages before and after it.

    Pages of the first and last run of a range may have neighbours elsewhere and go on as they are, with the pages that other ranges may need.
    """
    part = TaskContext.get().partitionId()

    def as_is(kind: int, page: tuple, digest: bytes | None = None) -> tuple:
        return (kind, part, page[0], page[1], None, None, None, None, None, page[2], page[3], digest, page[4])

    def mark(kind: int, page: tuple) -> tuple:
        return as_is(kind, page, hashlib.blake2b("\n".join(page[5]).encode(), digest_size=16).digest())

    def placed() -> Iterator[tuple]:
        before = None
        run: list[tuple] = []  # pages of one host with equal lines, which they hold in common
        for following in _sorted_pages(batches):
            if run and following[2] == run[0][2] and following[5] == run[0][5]:
                same = following[6] == run[0][6]
                run.append((*following[:4], run[0][4] if same else following[4], run[0][5], run[0][6] if same else following[6]))
                continue
            if run and before is None:
                yield mark(_FIRST, run[0])
                yield mark(_SECOND, following)
                yield from (as_is(_FIRST_RUN, page) for page in run)
            elif run:
                yield from ((_DONE, part, *_clean(page, before, following), None, None, None, None) for page in run)
            before = run[-1] if run else None
            run = [following]
        if not run:
            return
        if before is None:
            yield mark(_FIRST, run[0])
        else:
            yield mark(_LAST_BUT_ONE, before)
        yield mark(_LAST, run[-1])
        yield from (as_is(_FIRST_RUN if before is None else _LAST_RUN, page) for page in run)

    yield from _batches(placed(), _PLACED)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages of an edge, each with the page before and the page after its run."""

    def page(row: dict | None) -> tuple | None:
        return row and (*row.values(), *_unpacked(row["payload"]))

    def settled() -> Iterator[tuple]:
        for b in batches:
            for start in range(0, b.num_rows, 64):
                for row in zip(*[c.to_pylist() for c in b.slice(start, 64).columns]):
                    yield _clean(*map(page, row))

    yield from _batches(settled(), _RESULT)


def _page():
    return F.struct("page_id", "url", "host", "path", "payload")


def _neighbours(marks: DataFrame) -> DataFrame:
    """(part, kind, before, after): the pages on either side of the first and last run of each range.

    Runs of copies may go on through many ranges, so what a run finds is carried over ranges that hold nothing else.
    """
    run = F.struct("host", "digest")
    per = marks.groupBy("part").agg(
        F.max(F.when(F.col("kind") == _FIRST, run)).alias("first"), F.max(F.when(F.col("kind") == _LAST, run)).alias("last"),
        F.max(F.col("kind") == _SECOND).alias("more"),
    )
    # One row for each range.
    order = Window.partitionBy(F.lit(0)).orderBy("part")
    place = lambda part, kind: F.struct(part.alias("part"), F.lit(kind).alias("kind"))
    beside = {"before": (F.lag, "last", "first", _LAST, _LAST_BUT_ONE), "after": (F.lead, "first", "last", _FIRST, _SECOND)}
    for name, (step, theirs, own, near, further) in beside.items():
        other = step("part").over(order)
        found = F.when(step(theirs).over(order) != F.col(own), place(other, near)).when(step("more").over(order), place(other, further))
        per = per.withColumn(f"seen_{name}", found)
    so_far, from_here = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("before", F.last("seen_before", True).over(so_far)).withColumn("after", F.first("seen_after", True).over(from_here))
    here = F.col("part")
    firsts = per.select("part", F.lit(_FIRST_RUN).alias("kind"), "before", F.when(F.col("more"), place(here, _SECOND)).otherwise(F.col("after")).alias("after"))
    lasts = per.where("more").select("part", F.lit(_LAST_RUN).alias("kind"), place(here, _LAST_BUT_ONE).alias("before"), "after")
    both = firsts.unionByName(lasts)
    for name in beside:
        pages = marks.select(F.struct("part", "kind").alias(name), _page().alias(f"{name}_page"))
        both = both.join(pages, name, "left")
    return both.select("part", "kind", "before_page", "after_page")


def extract_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", ranges: int | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, paired_with, n_shared_lines, n_open_lines (those that differencing decides).

    A null or empty html, or one without text, gives an empty text.  A null URL has host and path "". Host and path are compared in
    lower case without scheme, query and fragment.  Ties in the path go by identifier, then by a hash of the html.
    Repeated rows are pages each, and pages with the same lines aren't paired with each other.  Other columns are not looked at.
    The pages are read at once, in ``ranges`` range partitions (as many as shuffles have, if not given).
    """
    spark = pages.sparkSession
    url = F.coalesce(F.col(url_column), F.lit(""))
    bare = F.lower(F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[?#].*$", ""))
    rows = pages.select(
        F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("url"), F.substring_index(bare, "/", 1).alias("host"),
        F.regexp_replace(F.regexp_replace(bare, r"^[^/]*", ""), r"(\.html?)?/*$", "").alias("path"), F.xxhash64(html_column).alias("tie"), F.col(html_column).alias("html"),
    )
    # The identifier is part of the order, so that one host or path may fill many ranges.
    order = ["host", "path", "page_id", "tie"]
    dealt = rows.mapInArrow(_read, _PAGE).repartitionByRange(ranges or int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    path = scratch_path(spark, "placed-pages")
    columns = f"kind int, part int, {_RESULT_COLUMNS}, host string, path string, digest binary, payload binary"
    dealt.mapInArrow(_difference, columns).write.option("compression", "zstd").parquet(path)
    placed = spark.read.schema(columns).parquet(path)
    done = placed.where(F.col("kind") == _DONE).select(*_RESULT.names)
    edges = placed.where(F.col("kind").isin(_FIRST_RUN, _LAST_RUN)).join(_neighbours(placed.where(F.col("kind") >= _FIRST)), ["part", "kind"])
    settled = edges.select(_page().alias("page"), "before_page", "after_page").mapInArrow(_settle, _RESULT_COLUMNS)
    return done.unionByName(settled)
