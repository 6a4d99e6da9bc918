"""Main text of web pages by nearest-URL page differencing.

Pages are sorted by host and path over range partitions, so a host of any size spreads over tasks, and each page is
paired with the neighbour in that order whose path shares more leading parts. The first and last page of a partition
meet their neighbours of other partitions in a second step, over a table of at most two pages for each. Text lines of the two are aligned by
their longest common subsequence and the shared ones deleted: what two near pages of a site share is its frame.

Two kinds of lines aren't left to that alone. Lines in elements that can't be main text (navigation, footers, forms,
adverts, comments, ...) are deleted even where they differ from page to page, and lines inside a marked article stay
even where another page has them, since sites carry the same article, or the same paragraph, more than once. Inside an
article an element is of the frame by its own name or by a whole class or id; where a word of the frame is only a part of
one ("related-work", "social-history"), the difference decides: its lines go if the nearest page has them too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltbed.llm.shared import cut, text_or_empty

#: Names of elements by their part in a page.
RAW = "script style title textarea noscript iframe xmp template noembed noframes svg math select object canvas".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
INLINE = (
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var "
    "br wbr img picture source audio video map area"
).split()
CHROME = "head nav footer aside form menu dialog button fieldset search datalist".split()
ARTICLE = "article main".split()
HEADINGS = "h1 h2 h3 h4 h5 h6".split()
CHROME_WORDS = (
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "newsletter subscribe subscription signup login sidebar menu menus nav navbar navigation breadcrumb breadcrumbs footer pagination pager comment comments disqus replies "
    "share sharing social related popup modal overlay widget toolbar skip masthead"
).split()
ARTICLE_WORDS = "main article articlebody".split()
#: An element that one of these starts is at its end.
CLOSED_BY = {"p": set("p div ul ol dl table h1 h2 h3 h4 h5 h6 section article main aside nav footer header form blockquote pre figure address hr fieldset details".split()), "li": {"li"}, "tr": {"tr", "tbody"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z)""", re.DOTALL)
_ATTR = re.compile(r"""([^\s=>/"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))|([^\s=>/"']+)""")
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Where a line stands: outside an article, inside one, or there in an element whose name may be the frame's.
OTHER, MAIN, DOUBTFUL = 1, 2, 3
#: Parts of a name that may follow a word of the frame in it: "ad-slot-1", "comment-list".
_TAIL = re.compile(r"(?:slot|box|unit|list|section|bar|block|area|container|wrapper|inner|[0-9]+)")


def _of_frame(name: str) -> bool:
    """Whether a whole class or id is a word of the frame, but for parts like "slot" or numbers after it."""
    words = [w for w in re.findall(r"[a-z]+|[0-9]+", _CAMEL.sub(" ", name).lower())]
    return bool(words) and words[0] in CHROME_WORDS and all(w in CHROME_WORDS or _TAIL.fullmatch(w) for w in words[1:])


def _kind(name: str, rest: str, in_main: bool) -> str:
    """'chrome', 'article', 'header', 'doubtful' or ''."""
    if name in CHROME:
        return "chrome"
    kind = "article" if name in ARTICLE else "header" if name == "header" else ""
    if "=" in rest or "hidden" in rest:
        for m in _ATTR.finditer(rest):
            key, value = (m[1] or m[5] or "").lower(), m[2] or m[3] or m[4] or ""
            if key == "hidden" or key == "aria-hidden" and value.strip() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return "chrome"
            if key in ("class", "id", "role"):
                words = _WORDS.findall(_CAMEL.sub(" ", value).lower())
                if name not in ("html", "body") and any(w in CHROME_WORDS for w in words):
                    if not in_main or any(_of_frame(x) for x in value.split()):
                        return "chrome"
                    kind = kind or "doubtful"
                if "header" in words or "contentinfo" in words:
                    kind = kind or "header"
                if not kind and not in_main and (key == "role" and value == "main" or key == "itemprop" or any(w in ARTICLE_WORDS for w in words)):
                    kind = "article"
    return kind


def lines(html: str) -> list[tuple[int, str]]:
    """The text blocks of a page that aren't inside an element of its frame, each with the zone it stands in."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, str]] = []  # open elements: name, kind
    held: list[str] = []
    chrome = article = header = heading = doubtful = 0
    zone = OTHER

    def flush() -> None:
        if held:
            text = _SPACE.sub(" ", unescape("".join(held))).strip()
            if text:
                out.append((zone, text))
            held.clear()

    def pop() -> None:
        nonlocal chrome, article, header, heading, doubtful
        name, kind = stack.pop()
        if name not in INLINE:
            flush()
        chrome -= kind == "chrome"
        article -= kind == "article"
        doubtful -= kind == "doubtful"
        header -= kind == "header"
        heading -= name in HEADINGS

    def take(text: str) -> None:
        nonlocal zone
        if chrome or header and not (article and heading):
            return
        now = OTHER if not article else DOUBTFUL if doubtful else MAIN
        if now != zone:
            flush()
            zone = now
        held.append(text)

    at = 0
    for m in iter(lambda: _TOKEN.search(html, at), None):
        if m.start() > at:
            take(html[at : m.start()])
        at = m.end()
        if m.end() == m.start():
            break
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name in ("br", "p") and not any(n == name for n, _ in stack):
                held.append(" ") if name == "br" else flush()
            elif any(n == name for n, _ in stack):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*[^>]*>", re.IGNORECASE).search(html, at)
                at = end.end() if end else len(html)
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        while stack and name in CLOSED_BY.get(stack[-1][0], ()):
            pop()
        if name not in INLINE and stack and any(n == "p" for n, _ in stack) and name in CLOSED_BY["p"]:
            while stack and stack[-1][0] in INLINE:
                pop()
            while stack and name in CLOSED_BY.get(stack[-1][0], ()):
                pop()
        if name not in INLINE:
            flush()
        kind = _kind(name, m[3], article > 0)
        stack.append((name, kind))
        chrome += kind == "chrome"
        article += kind == "article"
        doubtful += kind == "doubtful"
        header += kind == "header"
        heading += name in HEADINGS
    if at < len(html):
        take(html[at:])
    flush()
    return out


def shared(a: list[str], b: list[str]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence of the two, by bit vectors: one integer of len(b) bits for
    each line of ``a``."""
    left = 0
    while left < min(len(a), len(b)) and a[left] == b[left]:
        left += 1
    right = 0
    while right < min(len(a), len(b)) - left and a[-1 - right] == b[-1 - right]:
        right += 1
    found = {*range(left), *range(len(a) - right, len(a))}
    a_mid, b_mid = a[left : len(a) - right], b[left : len(b) - right]
    if not a_mid or not b_mid:
        return found
    where: dict[str, int] = {}
    for j, x in enumerate(b_mid):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b_mid)) - 1
    row, rows = full, []
    for x in a_mid:  # a zero bit j: the length of the subsequence grows at column j
        match = where.get(x, 0)
        both = row & match
        row = ((row + both) | (row - both)) & full
        rows.append(row)
    i, j = len(a_mid) - 1, len(b_mid) - 1
    while i >= 0 and j >= 0:
        before = rows[i - 1] if i else full
        low = (1 << (j + 1)) - 1
        here = (~rows[i] & low).bit_count()
        if here == (~before & low).bit_count():
            i -= 1
        elif here == (~rows[i] & (low >> 1)).bit_count():
            j -= 1
        else:
            found.add(left + i)
            i, j = i - 1, j - 1
    return found


def main_text(page: list[tuple[int, str]], near: list[tuple[int, str]] | None) -> str:
    """The lines of a marked article but for doubtful ones that the nearest page shares; where there is no article, the
    lines that it doesn't share."""
    marked = any(zone != OTHER for zone, _ in page)
    gone = shared([t for _, t in page], [t for _, t in near]) if near else set()
    return "\n".join(t for i, (zone, t) in enumerate(page) if zone == MAIN or (zone == DOUBTFUL or not marked) and i not in gone)


def _near(path: str, other: str) -> int:
    n = 0
    for x, y in zip(path.split("/"), other.split("/"), strict=False):
        if x != y:
            break
        n += 1
    return n


def _coded(page: list[tuple[int, str]]) -> str:
    """A page's lines as one string; white space in them is single spaces already."""
    return "\n".join(f"{zone}{text}" for zone, text in page)


def _decoded(coded: str) -> list[tuple[int, str]]:
    return [(int(x[0]), x[1:]) for x in coded.split("\n")] if coded else []


def _packed(coded: str) -> bytes:
    """A page's string compressed: its length, then what the codec makes of it."""
    raw = coded.encode()
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def _unpacked(data: bytes) -> str:
    size = int.from_bytes(data[:4], "little")
    return pa.decompress(data[4:], decompressed_size=size, codec="zstd", asbytes=True).decode() if data else ""


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Html as coded lines: without markup and frame they take less room than pages where they are dealt. They are
    compressed here, page by page, as the codec of Spark's shuffle leaves half as much again."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 200):
            part = batch.slice(begin, 200)
            pages = [_packed(_coded(lines(x or ""))) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(pages, pa.binary())], [*part.schema.names[:2], "page"])


#: part and place (0 the first page, 1 the last one or only one) order the pages at borders; score and before tell the
#: neighbour in the partition, if there is one; page is the page's own lines.
_BORDER = "border struct<part: int, place: int, host: string, path: string, score: int, before: boolean, page: string>"
_BORDER_TYPE = pa.struct([("part", pa.int32()), ("place", pa.int32()), ("host", pa.string()), ("path", pa.string()), ("score", pa.int32()), ("before", pa.bool_()), ("page", pa.string())])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by host and path: each page stands between its two neighbours. The first and last page have a border."""
    context = TaskContext.get()
    number = context.partitionId() if context else 0

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def near(me: tuple, *others: tuple | None) -> tuple | None:
        fit = [(_near(me[1], o[1]), -k, o[4]) for k, o in enumerate(others) if o is not None and o[0] == me[0]]
        return max(fit, key=lambda x: x[:2]) if fit else None

    done: list[tuple] = []
    size = 0

    def add(last: tuple | None, now: tuple, following: tuple | None) -> None:
        nonlocal size
        found = near(now, last, following)
        text = main_text(now[4], found[2] if found else None)
        border = None
        if last is None or following is None:
            border = (number, int(following is None), now[0], now[1], found[0] if found else None, found[1] == 0 and last is not None if found else None, _coded(now[4]))
            border = dict(zip((f.name for f in _BORDER_TYPE), border, strict=True))
        done.append((now[2], now[3], text, border))
        size += len(text)

    def out() -> pa.RecordBatch:
        ids, urls, texts, borders = zip(*done, strict=True) if done else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(borders, _BORDER_TYPE)], ["page_id", "url", "text", "border"])

    last = now = None
    for row in rows():
        following = (*row[:4], _decoded(_unpacked(row[4])))
        if now is not None:
            add(last, now, following)
        last, now = now, following
        if size > 4_000_000:
            yield out()
            done, size = [], 0
    if now is not None:
        add(last, now, None)
    yield out()


def _at_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages at borders beside those before and after them in the order of all borders."""
    for batch in batches:
        texts = []
        for text, me, before, after in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
            best = (me["score"], me["before"]) if me["score"] is not None else None
            # only what lies in another partition: the neighbour in the same one was compared already
            for other, is_before in ((before, True), (after, False)):
                if other is not None and other["part"] != me["part"] and other["host"] == me["host"]:
                    here = (_near(me["path"], other["path"]), is_before)
                    if best is None or here > best:
                        best = here
                        text = main_text(_decoded(me["page"]), _decoded(other["page"]))
            texts.append(text)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and text of every page.

    Null and empty html give an empty text. A null url is a host of its own. Repeated rows are pages of their own, and
    near each other. A page that is the only one of its host is not compared. Markup that is cut off is read as far as
    it goes. Other columns are not read. An empty table gives no rows.
    """
    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    parsed = plain.mapInArrow(_parse, "page_id long, url string, page binary")
    url = F.lower(text_or_empty("url"))
    host = F.regexp_extract(url, r"^(?:[a-z][a-z0-9+.-]*:)?//(?:www\.)?([^/?#]*)", 1)
    path = F.regexp_extract(url, r"^(?:[a-z][a-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)
    # host and path are made again after pages are dealt, so that they aren't dealt beside the url
    dealt = parsed.repartitionByRange(host, path, "page_id").sortWithinPartitions(host, path, "page_id")
    dealt = dealt.select(host.alias("host"), path.alias("path"), "page_id", "url", "page")
    texts = cut(dealt.mapInArrow(_extract, f"page_id long, url string, text string, {_BORDER}"), "texts")
    borders = texts.where("border IS NOT NULL")
    # numbers of two rows for each partition; their pages are joined to them
    rank = F.row_number().over(Window.orderBy("part", "place"))
    order = F.broadcast(borders.select("border.part", "border.place").withColumn("k", rank))
    numbered = borders.join(order, (F.col("border.part") == F.col("part")) & (F.col("border.place") == F.col("place"))).drop("part", "place")
    before = numbered.select((F.col("k") + 1).alias("k"), F.col("border").alias("before"))
    after = numbered.select((F.col("k") - 1).alias("k"), F.col("border").alias("after"))
    joined = numbered.join(before, "k", "left").join(after, "k", "left").select("page_id", "url", "text", "border", "before", "after")
    met = joined.mapInArrow(_at_borders, "page_id long, url string, text string")
    return texts.where("border IS NULL").drop("border").unionByName(met)
