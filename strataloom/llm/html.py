"""Main text of web pages, by differencing each page with the page whose URL is nearest.

A page is read into lines (blocks of text), menus, adverts and footers included, each with its place: what its tags say of it.
Pages are paired by URL path within their host, and the lines of a pair are aligned by longest common subsequence. Shared lines come from the
host's template and are deleted. Tags are the prior beside it, since text that two articles share is their own, and furniture can differ from
page to page:

* A line in an article (or main) that nothing names as furniture stays: pages may quote one another.
* A line that tags mark for certain (nav, footer, aside, form, a class like "ad" or "comments") goes even where the neighbour doesn't share it.
* A line whose class only suggests furniture ("related work", "share-price", "search-results") goes if the neighbour shares it, and stays otherwise.
* Of a page that marks an article or main, only lines in it are text. Of others, all lines that are left.

A neighbour that shares over half of the unmarked text of a page without an article is a copy, not a template; then the page's other neighbour is taken,
and if that is a copy too, nothing is shared.

Neighbours are those in the order of host and path. The order is made on URLs and sizes alone, by a range-partitioned sort, and cut into
chunks of some CHUNK_BYTES, so that a host of any size spreads over all tasks and no task grows with the table. Of each chunk only the first and
last URL come to the driver. Pages are then read into lines where they are, and their lines move once, to their chunk; a chunk's end
pages also go to the chunk beside it, as neighbours. So the results don't depend on the cuts or on how rows are partitioned.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_type, small_batches

#: HTML of one chunk, beyond which the next begins.
CHUNK_BYTES = 128 << 20
#: A neighbour with more than this share of the page's characters is a copy.
COPY_SHARE = 0.5
#: Places of lines: outside of any article, in one (or in main); plain, suggested furniture, marked furniture.
IN, MAYBE, MARKED = 1, 2, 4

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
RAW_END = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "noscript", "template", "iframe", "svg", "math", "textarea", "select", "object", "canvas", "audio", "video")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are furniture; head isn't shown at all.
DROPPED = frozenset("nav footer aside form menu dialog button fieldset".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Words of a class, id or role. An attribute's token made of SURE words (and of FRAME words around them) marks furniture; one with a SURE or MAYBE word in it suggests it.
SURE = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr notice notices sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist disqus complementary contentinfo newsletter masthead".split())
SUGGESTED = frozenset("sponsors promo promotion banner alert alerts popup modal overlay subscribe subscription signup login aside replies respond share sharing social related recommended recommendations widget widgets toolbar pagination pager skip search dialog".split())
FRAME = frozenset("area bar block body bottom box container content global group holder inner item items left list main outer page panel primary reader readers region right row secondary section site slot thread top unit user wrap wrapper".split())
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|aria-hidden|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"']+))?(?=\s|/|$)""", re.I)
SPLIT = re.compile(r"[^a-z]+")
LIKE = frozenset("p li tr td th dt dd option".split())
HOLDS = frozenset("ul ol table tr dl div section article blockquote body".split())


def named(tokens: str) -> int:
    """What an attribute's tokens say of an element."""
    out = 0
    for token in tokens.split():
        words = [w for w in SPLIT.split(token) if w]
        sure = [w in SURE for w in words]
        if any(sure) and all(s or w in FRAME for s, w in zip(sure, words, strict=True)):
            return MARKED
        if any(sure) or any(w in SUGGESTED for w in words):
            out = MAYBE
    return out


def kind_of(name: str, attrs: str, inside: bool) -> int:
    """What an element begins: bits of its place. A header in an article is the article's own."""
    if name in DROPPED or name == "header" and not inside:
        return MARKED
    said = role = 0
    if attrs and ("=" in attrs or "hidden" in attrs):
        for key, value in ATTRIBUTE.findall(attrs):
            key, value = key.lower(), value.strip("\"'").lower()
            if key == "hidden" or key == "aria-hidden" and value == "true":
                return MARKED
            if key == "role" and value in ("article", "main"):
                role = IN
            elif name not in ("html", "body", "main"):
                said |= named(value)
                if not inside and name in ("div", "section") and "header" in SPLIT.split(value):
                    return MARKED
    if name == "article" and said & MAYBE:
        return MARKED  # an entry of a list of further articles, or an advert among them
    return said & MARKED or said | (IN if name in ("article", "main") else role)


def lines_of(html: str) -> list[tuple[str, int]]:
    """The page's lines, in order: (text, place). A line may be of any length and lie at any depth."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    open_names: Counter = Counter()
    inside = maybe = marked = hidden = 0
    at = 0

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((text, (IN if inside else 0) | (MAYBE if maybe else 0) | (MARKED if marked else 0)))

    def leave(k: int) -> None:
        nonlocal inside, maybe, marked, hidden
        for name, kind in stack[k:]:
            inside -= kind & IN
            maybe -= kind & MAYBE and 1
            marked -= kind & MARKED and 1
            hidden -= name == "head"
            open_names[name] -= 1
        del stack[k:]

    while True:
        m = TAG.search(html, at)
        if not hidden:
            parts.append(html[at : m.start() if m else len(html)])
        if not m:
            break
        at = m.end()
        if m["name"] is None:
            if m["cdata"] and not hidden:
                parts.append(m["cdata"])
            continue
        name = m["name"].lower()
        if m["close"]:
            if name in VOID and name != "br":
                continue
            if name not in INLINE:
                flush()
            if open_names[name]:
                leave(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            continue
        if name in RAW_END and name not in ("object", "audio", "video", "canvas"):
            if not hidden and name not in INLINE:
                parts.append(" ")
            end = RAW_END[name].search(html, at)
            at = end.end() if end else len(html)
            continue
        if name not in INLINE:
            flush()
        if name in VOID:
            continue
        if name == "body" and open_names["head"]:
            leave(next(k for k, x in enumerate(stack) if x[0] == "head"))
        if name in LIKE and open_names[name]:  # these end their like
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    leave(k)
                    break
                if stack[k][0] in HOLDS:
                    break
        if m["attrs"].endswith("/") and name not in INLINE:
            continue
        kind = kind_of(name, m["attrs"], bool(inside))
        stack.append((name, kind))
        open_names[name] += 1
        inside += kind & IN
        maybe += kind & MAYBE and 1
        marked += kind & MARKED and 1
        hidden += name == "head"
    flush()
    return out


def shared_lines(a: list[str], b: list[str]) -> dict[int, int]:
    """Place in a -> place in b of a longest common subsequence of a and b.

    Lines that only one of them has are left out beforehand, and common ends are matched first.
    """
    both = set(a) & set(b)
    x, y = [k for k, t in enumerate(a) if t in both], [k for k, t in enumerate(b) if t in both]
    lo, hi = 0, 0
    least = min(len(x), len(y))
    while lo < least and a[x[lo]] == b[y[lo]]:
        lo += 1
    while hi < least - lo and a[x[-1 - hi]] == b[y[-1 - hi]]:
        hi += 1
    pairs = list(zip(x[:lo], y[:lo], strict=True)) + list(zip(x[len(x) - hi :], y[len(y) - hi :], strict=True))
    x, y = x[lo : len(x) - hi], y[lo : len(y) - hi]
    return dict(pairs) | {x[i]: y[j] for i, j in _lcs([a[k] for k in x], [b[k] for k in y])}


def prefix_lengths(p: list[str], q: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequence of p and each prefix of q: a row of bits for each line of p, as one long number."""
    where: dict[str, int] = {}
    for j, t in enumerate(q):
        where[t] = where.get(t, 0) | 1 << j
    full = (1 << len(q)) - 1
    v = full
    for s in p:
        u = v & where.get(s, 0)
        v = (v + u | v - u) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(q) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(q)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _lcs(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places, by halving a: linear space for pages of any length."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        if i == j or k == m:
            continue
        if j - i == 1:
            if a[i] in (part := b[k:m]):
                out.append((i, k + part.index(a[i])))
            continue
        half = (i + j) // 2
        ahead, behind = prefix_lengths(a[i:half], b[k:m]), prefix_lengths(a[half:j][::-1], b[k:m][::-1])[::-1]
        cut = k + int((ahead + behind).argmax())
        todo += [(i, half, k, cut), (half, j, cut, m)]
    return out


def nearness(a: str, b: str) -> int:
    """Characters that two paths begin with in common."""
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def differenced(lines: list[tuple[str, int]], neighbours: list[list[tuple[str, int]]]) -> tuple[str, int, int, int]:
    """(main text, number of lines, of those that differencing deleted, of those that only their marks did), given the neighbours' lines, nearest first."""
    own, places = [t for t, _ in lines], [w for _, w in lines]
    has_place = any(w & IN and not w & MARKED for w in places)
    gone: set[int] = set()
    total = sum(len(t) for t, w in lines if not w & MARKED)
    for other in neighbours:
        shared = shared_lines(own, [t for t, _ in other])
        if not has_place and sum(len(own[k]) for k in shared if not places[k] & MARKED) > COPY_SHARE * total:
            continue
        gone = {k for k in shared if places[k] != IN}  # what nothing names as furniture in an article is its own, whoever quotes it
        break
    kept = [k for k, w in enumerate(places) if k not in gone and not w & MARKED and (w & IN or not has_place)]
    return "\n".join([own[k] for k in kept]), len(own), len(gone), len(own) - len(gone) - len(kept)


def main_text(lines: list[tuple[str, int]], neighbours: list[list[tuple[str, int]]]) -> str:
    return differenced(lines, neighbours)[0]


KEY = ["host", "path", "key_id", "key_url"]


def _chunks(keys: DataFrame, chunk_bytes: int) -> tuple[list[tuple], set[tuple]]:
    """The first keys of all chunks, in order, and the last keys. keys: distinct rows of KEY, with their bytes; each range of the sort cuts itself."""
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: list[tuple] = []
        first = last = None
        size = 0
        for batch in batches:
            for *key, b in zip(*(batch.column(c).to_pylist() for c in (*KEY, "bytes")), strict=True):
                if first is None or size >= chunk_bytes:
                    if first is not None:
                        ends.append((*first, *last))
                    first, size = key, 0
                last, size = key, size + b
        if first is not None:
            ends.append((*first, *last))
        columns = list(zip(*ends, strict=True)) or [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=[f"c{k}" for k in range(8)])

    cuts = keys.repartitionByRange(n, *KEY).sortWithinPartitions(*KEY).mapInArrow(cut, ", ".join(f"c{k} string" for k in range(8)))
    found = [tuple(r) for r in cuts.collect()]  # a row for each chunk
    return sorted(r[:4] for r in found), {r[4:] for r in found}


FIELDS = "text string, n_chars long, n_lines long, n_shared long, n_marked long"


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """id_col, url_col, text, n_chars (code points), n_lines, n_shared and n_marked for each row of pages.

    n_lines counts the lines of the whole page, n_shared those that differencing deleted, and n_marked those that it left and tags deleted.
    A null or empty html has the empty text and no lines; a page of any length is read whole, and its alignment takes memory in proportion to its lines.
    Pages without a URL are of one nameless host, a host's only page has no neighbour and goes by its tags. Rows with the same id and URL
    are one page to their neighbours (the html whose checksum is least); each gets its own text. An empty table gives none.
    """
    spark = pages.sparkSession
    small_batches(spark)
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_replace(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", "")
    key = [host.alias("host"), path.alias("path"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key_id"), url.alias("key_url")]
    sizes = pages.select(*key, F.coalesce(F.octet_length(F.col(html_col).cast("string")), F.lit(0)).alias("b")).groupBy(*KEY).agg(F.sum("b").alias("bytes"))
    shared = spark.sparkContext.broadcast(_chunks(sizes, chunk_bytes))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(shared.value[0]))
    rows = pages.select(*key, F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = {f.name: f.dataType for f in rows.schema.fields}
    fixed = [*[T.StructField(c, T.StringType()) for c in KEY], T.StructField("id", kind["id"]), T.StructField("url", kind["url"])]
    read = T.StructType([*fixed, *T.StructType.fromDDL("mark long, texts array<string>, places array<tinyint>, chunk int, own boolean").fields])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lasts = shared.value
        for batch in batches:
            take, texts, places, marks, chunks, own = [], [], [], [], [], []
            columns = [batch.column(c).to_pylist() for c in (*KEY, "html")]
            for k, (*parts, page) in enumerate(zip(*columns, strict=True)):
                where = tuple(parts)
                chunk = bisect_right(firsts, where) - 1
                lines = lines_of(page or "")
                to = [chunk, *([chunk - 1] if chunk and firsts[chunk] == where else []), *([chunk + 1] if chunk + 1 < len(firsts) and where in lasts else [])]
                for c in to:
                    take.append(k)
                    texts.append([t for t, _ in lines])
                    places.append([w for _, w in lines])
                    marks.append(zlib.crc32((page or "").encode()))
                    chunks.append(c)
                    own.append(c == chunk)
            kept = [batch.column(f.name).take(pa.array(take, pa.int64())) for f in fixed]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(marks, pa.int64()), pa.array(texts, pa.list_(pa.string())), pa.array(places, pa.list_(pa.int8())), pa.array(chunks, pa.int32()), pa.array(own, pa.bool_())], names=read.names)

    dealt = rows.mapInArrow(parse, read).repartition(n, "chunk").sortWithinPartitions("chunk", *KEY, "mark")
    out = T.StructType([T.StructField(id_col, kind["id"]), T.StructField(url_col, kind["url"]), *T.StructType.fromDDL(FIELDS).fields])

    def finish(before: tuple | None, now: tuple, after: tuple | None) -> Iterator[tuple]:
        """Of the rows with one key: each of the three is (key, lines, rows that are the chunk's own)."""
        both = [x for x in (before, after) if x and x[0][0] == now[0][0]]
        both.sort(key=lambda x: -nearness(x[0][1], now[0][1]))
        for i, url, lines in now[2]:
            text, *counts = differenced(lines, [x[1] for x in both])
            yield i, url, text, len(text), *counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order; only the rows of three keys are held."""
        before = now = last = None
        for batch in batches:
            done: list[tuple] = []
            keys = zip(*(batch.column(c).to_pylist() for c in KEY), strict=True)
            for key, i, url, texts, places, chunk, own in zip(keys, *(batch.column(c).to_pylist() for c in ("id", "url", "texts", "places", "chunk", "own")), strict=True):
                lines = list(zip(texts, places, strict=True))
                if now is None or chunk != last or key != now[0]:
                    after = key, lines, []
                    if now is not None:
                        done += finish(before, now, after if chunk == last else None)
                    before, now, last = now if chunk == last else None, after, chunk
                if own:
                    now[2].append((i, url, lines))
            yield batch_of(done)
        if now is not None:
            yield batch_of(list(finish(before, now, None)))

    arrow = [arrow_type(f.dataType) for f in out.fields]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow, strict=True)], names=out.names)

    return dealt.mapInArrow(run, out)
