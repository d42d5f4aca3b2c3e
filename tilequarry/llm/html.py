"""Main text of web pages: differencing against the page of the nearest URL on the same host, checked by the structure."""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from hashlib import blake2b
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import need

# Element names of the HTML standard by role.
SKIPPED = {"script", "style", "noscript", "template", "head", "nav", "header", "footer", "aside", "form", "button", "select", "textarea", "iframe", "object", "svg", "canvas", "video", "audio", "dialog", "menu"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "dfn", "em", "font", "i", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "ins", "del", "big"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
ROOTS = {"article", "main"}
#: Words of class, id and role values that mark what is not the article.
MARKS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu|breadcrumbs?|header|masthead|footer|sidebar|side|widget|related|share|social|cookies?|consent|notice|notification|alert|popup|modal|newsletter|subscribe|comments?|reply|replies|disqus|login|search|pagination|pager|complementary|contentinfo)(?:$|[\s_-])", re.I)
#: Inside the article a name must be one of these as a whole, or with the word for a part of a page after it.
INSIDE = re.compile(r"(?:ads?|banner|complementary|contentinfo|advert\w*|sponsor\w*|promo\w*|nav\w*|menu|breadcrumbs?|sidebar|widget|related|share|social|cookies?|consent|notice|notification|newsletter|subscribe|comments?|reply|replies|disqus|login|pagination|pager)(?:[_-](?:box|bar|list|form|area|section|block|slot|banner|buttons?|links?|posts?|articles?|wrapper|container|unit|\d+))*", re.I)
TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)", re.I)


def _marked(attributes: str, inside: bool) -> bool:
    """Whether an element is marked as not being the article; inside says that it stands in an article or main element."""
    if not attributes:
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value = a or b or c
        key = name.lower()
        if key in ("class", "id", "role") and (any(map(INSIDE.fullmatch, value.split())) if inside else MARKS.search(value)):
            return True
        if key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
            return True
    return bool(HIDDEN.search(re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)))


def page_lines(html: str | None) -> list[tuple[str, bool]]:
    """Blocks of text in page order, each with whether it stands in an article or main element.

    Elements whose name or whose class, id or role says that they are not the article are left out with all they hold;
    an article or main element so marked is read, but its blocks count as outside. An unclosed element ends with its
    parent.
    """
    out: list[tuple[str, bool]] = []
    words: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, skipped, in a root
    html = html or ""

    def flush() -> None:
        text = " ".join("".join(words).split())
        words.clear()
        if text:
            out.append((text, bool(stack) and stack[-1][2]))

    def state() -> tuple[bool, bool]:
        return stack[-1][1:] if stack else (False, False)

    def pop(to: int) -> None:
        while len(stack) > to:
            if stack[-1][0] not in INLINE:
                flush()
            stack.pop()

    at = 0
    while at < len(html):
        m = TAG.search(html, at)
        stop = m.start() if m else len(html)
        if stop > at and not state()[0]:
            words.append(entities.unescape(html[at:stop]))
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if name not in INLINE:
                        flush()
                    pop(i)
                    break
            else:
                if name in ("p", "br"):
                    flush()
            continue
        if name == "br":
            words.append("\n")
            continue
        skipped, root = state()
        if name not in INLINE:
            flush()
        if name in CLOSES_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    pop(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        elif name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            same = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}[name]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in same:
                    pop(i)
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table", "select", "article", "main", "body", "div"):
                    break
        skipped, root = state()
        if name in VOID or m[0].endswith("/>") and name not in RAW:
            continue
        marked = name not in ("html", "body") and _marked(m[3], root)
        drop = skipped or (name in SKIPPED and not (name == "header" and root)) or (marked and name not in ROOTS)
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            if name == "title" or drop:
                at = close.end() if close else len(html)
                continue
        stack.append((name, drop, not marked if name in ROOTS else root))
    flush()
    return out


def shared_lines(mine: list[str], other: list[str]) -> set[int]:
    """Positions in mine of a longest common subsequence of lines with other."""
    number: dict[str, int] = {}
    a = [number.setdefault(x, len(number)) for x in mine]
    b = [number.setdefault(x, len(number)) for x in other]
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = {*range(head), *range(len(a) - tail, len(a))}
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    # Lines that the other side lacks cannot be part of it; what is left is usually short.
    keep_y = set(y)
    rows = [i for i, v in enumerate(x) if v in keep_y]
    keep_x = {x[i] for i in rows}
    y = [v for v in y if v in keep_x]
    # Hunt-Szymanski: the ends of increasing chains of matching positions, with back links.
    places: dict[int, list[int]] = {}
    for j, v in enumerate(y):
        places.setdefault(v, []).append(j)
    ends: list[int] = []
    links: list[tuple] = []
    for i in rows:
        for j in reversed(places[x[i]]):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            elif j < ends[k]:
                ends[k], links[k] = j, link
    link = links[-1] if links else None
    while link:
        out.add(link[0] + head)
        link = link[1]
    return out


def main_text(lines: list[str], roots: list[bool], other: list[str] | None) -> str:
    """Lines without those shared with the paired page, but for what stands in an article or main element; if all lines
    are shared, the page is part of the other and nothing goes."""
    gone = shared_lines(lines, other) if other and not all(roots) else set()
    if len(gone) == len(lines):
        gone = set()
    return " ".join(x for i, x in enumerate(lines) if roots[i] or i not in gone)


def split_url(url):
    """Host (lower case, without user and port) and path (without query and fragment) as Spark columns."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://|^//", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^[^@]*@|:\d*$", ""))
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), r"/+$|\.html?$", "")
    return host, path


def page_mark(host: str, lines: list[tuple[str, bool]]) -> int:
    """64-bit hash of host and lines: pages of one mark are copies."""
    return int.from_bytes(blake2b("\n".join([host, *(f"{r:d}{x}" for x, r in lines)]).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _end(ends: list, key: tuple, mark: int, sign: int) -> None:
    """Take a page into ends: the outermost page so far, and the outermost one of another mark."""
    if not ends:
        ends.append((key, mark))
    elif key != ends[0][0] and (key < ends[0][0]) == (sign < 0):
        ends[:] = [(key, mark), *(ends[:1] if ends[0][1] != mark else ends[1:])]
    elif mark != ends[0][1] and (len(ends) == 1 or (key != ends[1][0] and (key < ends[1][0]) == (sign < 0))):
        ends[1:] = [(key, mark)]


def carried(ends: dict[int, tuple[list, list]]) -> dict[tuple, list[int]]:
    """For the keys of pages that other ranges need, those ranges: for each range the nearest page before and after it
    that differs from its first or last page, on the same host. ends: range to its first and last pages, see _end."""
    out: dict[tuple, list[int]] = {}
    order = sorted(ends)
    for side, ranges in ((0, order), (1, order[::-1])):
        for i, r in enumerate(ranges):
            key, mark = ends[r][side][0]
            for j in range(i - 1, -1, -1):
                found = next((k for k, m in ends[ranges[j]][1 - side] if m != mark), None)
                if found is not None:
                    if found[0] == key[0]:
                        out.setdefault(found, []).append(r)
                    break
    return out


def _pair(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows (keep..., range, carried, host, path, lines, roots) in URL order, those of the range itself with the text that
    is left against the nearest differing page before or after. A run of copies is held without their lines."""
    before, run, mine = None, [], None  # (path, lines) of the last page of another run; rows; (range, host, lines, roots)

    def settle(after: tuple | None) -> Iterator[tuple]:
        texts: dict[bool, str] = {}
        for keep, path, ghost in run:
            if ghost:
                continue
            near = [(-1 if x is None else len(commonprefix([x[0], path]))) for x in (before, after)]
            late = near[1] > near[0]
            if late not in texts:
                other = after if late else before
                texts[late] = main_text(mine[2], mine[3], None if other is None else other[1])
            yield (*keep, texts[late], len(texts[late]))

    for *keep, block, ghost, host, path, lines, roots in rows:
        if mine is None or mine != (block, host, lines, roots):
            same = mine is not None and mine[:2] == (block, host)
            if mine is not None:
                yield from settle((path, lines) if same else None)
            before = (run[-1][1], mine[2]) if same else None
            run, mine = [], (block, host, lines, roots)
        run.append((keep, path, ghost))
    if mine is not None:
        yield from settle(None)


#: Pages of the sample a range; it only places the bounds.
SAMPLE = 20
_KEY = ("_host", "_path", "_url", "_salt")
_END = "range int, side int, host string, path string, url string, salt long, mark long"


def _ends_of(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """First and last pages (two of each at most) of the ranges of rows (range, side, key..., mark); side None: either."""
    ends: dict[int, tuple[list, list]] = {}
    for block, side, *key, mark in rows:
        for s in (0, 1) if side is None else (side,):
            _end(ends.setdefault(block, ([], []))[s], tuple(key), mark, (-1, 1)[s])
    out = [(b, s, *key, mark) for b, both in ends.items() for s in (0, 1) for key, mark in both[s]]
    names = ["range", "side", "host", "path", "url", "salt", "mark"]
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def extract_text(pages: DataFrame) -> DataFrame:
    """pages without html, with text (main text of the whole html) and n_chars (its code points).

    Pages are put in the order of host, path and url, by ranges over all pages, so that a host with a third of all pages
    is spread over many tasks. Each is paired with the nearest page before or after it on the same host whose lines
    differ, the one that shares the longer start of the path (ties: the one before); copies in between are passed over,
    and pages that a range needs of others are carried to it, so the result does not depend on the ranges. The pair's
    text lines are aligned by a longest common subsequence and shared lines go, but for two kinds of lines that the
    markup settles: what stands in an article or main element stays, and what stands in a menu, header, footer, sidebar,
    notice, advert, form or comment is never text. A page all whose lines stand in a differing neighbour, in order,
    keeps them.

    A null html or one without text gives an empty text; a null url counts as empty (such pages are one host);
    repeated rows stay; other columns stay, and columns named text or n_chars are replaced; an empty table gives an
    empty table. Three passes: a sample for the bounds, the ends of each range, and the texts.
    """
    need(pages, "url", "html")
    pages = pages.drop("text", "n_chars", *_KEY, "_range", "_carried", "_lines", "_roots")
    keep = [f for f in pages.schema.fields if f.name != "html"]
    names = [f.name for f in keep]
    host, path = split_url(F.col("url"))
    hashed = [c for c, kind in pages.dtypes if "map<" not in kind and "variant" not in kind]
    placed = pages.select(*names, host.alias("_host"), path.alias("_path"), F.coalesce("url", F.lit("")).alias("_url"), F.xxhash64(*hashed).alias("_salt"), "html")
    spark = pages.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = sorted(tuple(r) for r in placed.select(*_KEY).orderBy(F.xxhash64("_salt")).limit(SAMPLE * parts).collect())  # by hash: of no order
    bounds = sample[:: max(1, -(-len(sample) // parts))][1:]

    def keys(batch: pa.RecordBatch) -> Iterator[tuple]:
        return zip(*(batch.column(c).to_pylist() for c in _KEY), strict=True)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _ends_of((bisect_right(bounds, key), None, *key, page_mark(key[0], page_lines(h.as_py()))) for batch in batches for key, h in zip(keys(batch), batch.column("html"), strict=True))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _ends_of(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))

    found: dict[int, tuple[list, list]] = {}
    if bounds:
        for block, side, *key, mark in placed.select(*_KEY, "html").mapInArrow(ends, _END).repartition(parts, "range").mapInArrow(merge, _END).collect():  # four rows a range at most
            _end(found.setdefault(block, ([], []))[side], tuple(key), mark, (-1, 1)[side])
    wanted = carried(found)
    more = [T.StructField("_range", T.IntegerType()), T.StructField("_carried", T.BooleanType()), *(T.StructField(c, T.LongType() if c == "_salt" else T.StringType()) for c in _KEY), T.StructField("_lines", T.ArrayType(T.StringType())), T.StructField("_roots", T.ArrayType(T.BooleanType()))]
    parsed_schema = T.StructType([*keep, *more])
    out_schema = T.StructType([*keep, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, blocks, extra, lines, roots = [], [], [], [], []
            for i, (key, h) in enumerate(zip(keys(batch), batch.column("html"), strict=True)):
                found = page_lines(h.as_py())
                own = bisect_right(bounds, key)
                for block in (own, *wanted.get(key, ())):
                    at.append(i)
                    blocks.append(block)
                    extra.append(block != own)
                    lines.append([x for x, _ in found])
                    roots.append([r for _, r in found])
            rows = batch if len(at) == batch.num_rows else batch.take(pa.array(at, pa.int32()))
            columns = [*(rows.column(c) for c in names), pa.array(blocks, pa.int32()), pa.array(extra, pa.bool_()), *(rows.column(c) for c in _KEY), pa.array(lines, pa.list_(pa.string())), pa.array(roots, pa.list_(pa.bool_()))]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in parsed_schema.fields])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list = []

        def rows() -> Iterator[tuple]:
            for batch in batches:
                types[:] = [batch.schema.field(c).type for c in names]
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True))
            held.clear()
            kinds = [*types, pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*names, "text", "n_chars"])

        for row in _pair(rows()):
            held.append(row)
            if len(held) >= 1000:
                yield flush()
        if held:
            yield flush()

    parsed = placed.mapInArrow(parse, parsed_schema)
    ranged = parsed.repartitionById(parts, F.col("_range")).sortWithinPartitions("_range", *_KEY).drop("_url", "_salt")
    return ranged.mapInArrow(pair, out_schema)
