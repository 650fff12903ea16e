"""Main text of web pages by differencing each page with the one of the nearest address.

1. A page's markup gives its lines (blocks of text) and, for each, what stands around it: an element that says
   it is no article (menus, adverts, forms), an article or main element, or neither.
2. Pages are paired by the path of their address within each host: in the order of paths, the neighbour that
   shares the longer beginning. Addresses that differ only in scheme, query, fragment or a closing slash are
   one path and are not paired, as they show the same page.
3. The lines of the two are aligned by a longest common subsequence, and shared lines go.

Two things are settled by the markup, as differencing can't: a menu or advert that differs from page to page
goes although it is not shared, and where a page has an article or main element, its text is the text. Within an
article, lines at its beginning or end go that both pages beside it share (the nearest and the one on the other
side), unless one of the two shares half of the article or more, which is then a copy. A line in the midst of an
article stays: sentences and licence lines recur there. A page without an article of which the nearest has every
line is a copy too, and keeps them.

Only hashes of lines are sent to partners; the texts are shuffled once.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import shuffle_partitions, stored, text_of

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|<[/a-zA-Z!?][^>]*\Z|[^<]+|<", re.S)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=$|[\s=/])|aria-hidden\s*=\s*[\"']?true", re.I)
_FORM_END, _ARTICLE_START = re.compile(r"</form\s*>", re.I), re.compile(r"<(?:article|main)(?=[\s>/])", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_SPACED = frozenset("br td th".split())
_NO_ARTICLE = frozenset("nav aside footer form button select dialog menu head script style noscript template iframe svg math object canvas audio video textarea title xmp noembed noframes".split())
_ARTICLE = frozenset(("article", "main"))
_NO_ARTICLE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_NO_ARTICLE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar footer masthead cookie cookies consent gdpr notice notices disclaimer popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social comment comments respond disqus reply related recommended pagination pager widget toolbar skip".split()
)

#: What stands around a line.
MARKED, PLAIN, ARTICLE = 0, 1, 2


def _marks(name: str, attributes: str, within_article: bool = False) -> bool:
    """Whether an element says that it holds no article text. Names of classes say nothing of an article itself, only of
    one within another, such as a comment's; and a header within an article is its own."""
    if name in _NO_ARTICLE:
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    if _HIDDEN.search(attributes):
        return True
    named = name != "article" or within_article
    for kind, value in _ATTRIBUTE.findall(attributes):
        words = re.findall(r"[a-z0-9]+", value.lower())
        # A page "with-sidebar" or "no-comments" is no sidebar.
        words = [w for k, w in enumerate(words) if not k or words[k - 1] not in ("no", "has", "with", "without", "is", "can", "allow")]
        if kind.lower() == "role":
            if _NO_ARTICLE_ROLES.intersection(words):
                return True
        elif named and (_NO_ARTICLE_NAMES.intersection(words) or "header" in words and not within_article and name not in ("h1", "h2", "h3", "h4", "h5", "h6")):
            return True
    return False


def page_lines(markup: str) -> list[tuple[int, str]]:
    """(what stands around it, text) of each non-empty block in order. Broken markup is read as far as it
    goes: an end tag closes what is open within its element, one without a start is passed over."""
    lines: list[tuple[int, str]] = []
    held: list[str] = []
    # Open elements: name, and the state within; how many there are of a name; the places of those not inline.
    names, states = [""], [PLAIN]
    opened: Counter[str] = Counter()
    blocks = [0]

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                lines.append((states[-1], text))

    def close() -> str:
        states.pop()
        name = names.pop()
        opened[name] -= 1
        if blocks[-1] == len(names):
            blocks.pop()
        return name

    forms_end = True

    def form_around_article(begin: int) -> bool:
        """Whether a form that begins here holds an article, as where a page's whole body is one form."""
        nonlocal forms_end
        closing = _FORM_END.search(markup, begin) if forms_end else None
        forms_end = closing is not None
        return closing is not None and _ARTICLE_START.search(markup, begin, closing.start()) is not None

    at, end = 0, len(markup)
    while at < end:
        token = _TOKEN.match(markup, at)
        at = token.end()
        name = token[2]
        if name is None:
            if token[0][0] != "<" or token[0] == "<":
                held.append(token[0])
            continue
        name = name.lower()
        if token[1]:
            if name not in _INLINE:
                if name in _SPACED:
                    held.append(" ")
                else:
                    flush()
            if opened[name]:
                while names[-1] != name:
                    close()
                if states[-1] != states[-2]:
                    flush()
                close()
            continue
        if name in _SPACED:
            held.append(" ")
        elif name not in _INLINE:
            flush()
            # A paragraph ends where another block begins, an item where another does.
            k = blocks[-1]
            if names[k] == "p" or names[k] == name == "li":
                while len(names) > k:
                    close()
        if name in _VOID:
            continue
        if name in _RAW_END:
            closing = _RAW_END[name].search(markup, at)
            at = closing.end() if closing else end
            continue
        if token[3].endswith("/") and name not in _ARTICLE and (name in _INLINE or name in ("svg", "object")):
            continue
        state = states[-1]
        if state != MARKED:
            page_header = name == "header" and state != ARTICLE
            around = name == "form" and form_around_article(at)
            if page_header or not around and _marks(name, token[3], state == ARTICLE):
                if held:
                    flush()
                state = MARKED
            elif name in _ARTICLE:
                state = ARTICLE
        if name not in _INLINE:
            blocks.append(len(names))
        opened[name] += 1
        names.append(name)
        states.append(state)
    flush()
    return lines


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence of ``a`` and ``b``.

    Equal ends are cut off and lines of one side only left out first. What is left is aligned by rows of bits, one
    row a line of ``a``; a long pair is halved until its rows take some megabytes at most.
    """
    begin = 0
    while begin < min(len(a), len(b)) and a[begin] == b[begin]:
        begin += 1
    back = 0
    while back < min(len(a), len(b)) - begin and a[-1 - back] == b[-1 - back]:
        back += 1
    in_a, in_b = set(a[begin : len(a) - back]), set(b[begin : len(b) - back])
    x = [k for k in range(begin, len(a) - back) if a[k] in in_b]
    y = [v for v in b[begin : len(b) - back] if v in in_a]
    middle = [x[k] for k in _aligned([a[k] for k in x], y)]
    return [*range(begin), *middle, *range(len(a) - back, len(a))]


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """After each line of ``a``, the bits of ``b``: a zero where the length of the common subsequence grows."""
    places: dict[int, int] = {}
    for k, v in enumerate(b):
        places[v] = places.get(v, 0) | 1 << k
    full = row = (1 << len(b)) - 1
    for v in a:
        hit = row & places.get(v, 0)
        row = (row + hit | row - hit) & full
        yield row


def _aligned(a: list[int], b: list[int], most: int = 1 << 25) -> list[int]:
    if not a or not b:
        return []
    if len(a) == 1:
        return [0] if a[0] in b else []
    if len(a) * len(b) > most:
        half = len(a) // 2
        down = up = (1 << len(b)) - 1
        for down in _rows(a[:half], b):  # noqa: B007
            pass
        for up in _rows(a[half:][::-1], b[::-1]):  # noqa: B007
            pass
        best, left, right = -1, 0, len(b) - up.bit_count()
        split = 0
        for k in range(len(b) + 1):
            if left + right > best:
                best, split = left + right, k
            if k < len(b):
                left += not down >> k & 1
                right -= not up >> (len(b) - 1 - k) & 1
        return _aligned(a[:half], b[:split], most) + [half + k for k in _aligned(a[half:], b[split:], most)]
    rows = [(1 << len(b)) - 1, *_rows(a, b)]
    found, j = [], len(b) - 1
    for i in range(len(a), 0, -1):
        while j >= 0 and rows[i] >> j & 1:
            j -= 1
        if j < 0:
            break
        if rows[i - 1] >> j & 1:
            found.append(i - 1)
            j -= 1
    return found[::-1]


def _host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path without scheme, query, fragment and closing slash; empty for null."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*:(?=//)", "")
    host = F.lower(F.regexp_extract(bare, r"^//(?:[^/?#]*@)?([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_replace(bare, r"^//[^/?#]*|[?#].*$", ""), r"/+$", "")
    return host, path


def _shared_length(a: Column, b: Column) -> Column:
    """How many code points two strings have in common at their beginnings, by binary search."""
    least = F.least(F.length(a), F.length(b))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(30))])
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when((n + step <= least) & (F.left(a, n + step) == F.left(b, n + step)), n + step).otherwise(n))


def nearest_paths(paths: DataFrame) -> DataFrame:
    """Of ``paths`` (host, path, hashes; one row each) the rows with ``near``, the hashes of the nearest one, and
    ``other``, those of the one on the other side.

    The rows are sorted into ranges, and each range also gets the last row of the one before it and the
    first of the one after, so a host that holds a third of all pages is many ranges. The table of
    those edges has a row per range.
    """
    spark = paths.sparkSession
    ranged = stored(paths.repartitionByRange(shuffle_partitions(spark), "host", "path").withColumn("range", F.spark_partition_id()), "ranged-paths")
    row = F.struct("host", "path", "hashes")
    ends = ranged.groupBy("range").agg(F.min_by(row, F.struct("host", "path")).alias("head"), F.max_by(row, F.struct("host", "path")).alias("tail"))
    order = Window.orderBy("range")  # as many rows as ranges
    edges = ends.select("range", F.lag("tail").over(order).alias("before"), F.lead("head").over(order).alias("after"))
    halo = edges.select("range", F.explode(F.array("before", "after")).alias("r")).where("r is not null").select("r.*", "range", F.lit(True).alias("halo"))
    all_rows = ranged.select("host", "path", "hashes", "range", F.lit(False).alias("halo")).unionByName(halo)
    beside = Window.partitionBy("range").orderBy("host", "path")
    seen = all_rows.withColumns({"before": F.lag(row).over(beside), "after": F.lead(row).over(beside)}).where("not halo")
    n_before = F.when(F.col("before.host") == F.col("host"), _shared_length(F.col("before.path"), F.col("path"))).otherwise(-1)
    n_after = F.when(F.col("after.host") == F.col("host"), _shared_length(F.col("after.path"), F.col("path"))).otherwise(-1)
    after_first = F.col("na") > F.col("nb")
    near = F.when(F.greatest("nb", "na") < 0, F.lit(None)).when(after_first, F.col("after.hashes")).otherwise(F.col("before.hashes"))
    other = F.when(F.least("nb", "na") < 0, F.lit(None)).when(after_first, F.col("before.hashes")).otherwise(F.col("after.hashes"))
    return seen.withColumns({"nb": n_before, "na": n_after}).select("host", "path", near.alias("near"), other.alias("other"))


def shared_article_lines(article: list[int], sizes: list[int], near: set[int], other: set[int]) -> set[int]:
    """Of an article's lines (places on the page, with their lengths) those that both pages beside it share
    (``near``, ``other``: places on the page) and that stand at its beginning or end without a break. None if
    either of the two shares half of it: that one is a copy."""
    for shared in (near, other):
        if 2 * sum(n for k, n in zip(article, sizes) if k in shared) >= sum(sizes):
            return set()
    gone: set[int] = set()
    for places in (article, article[::-1]):
        for k in places:
            if k not in near or k not in other:
                break
            gone.add(k)
    return gone


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, text, n_chars, n_shared (lines that went as pages beside this one have
    them too), n_marked (others that went for the elements around them).

    Null counts as an empty page, which has no text. Pages without an address form one host of their own. A
    page that is alone on its host has no partner. Where paths of equal nearness stand on both sides, the one
    before is taken; of pages with one path, that with the smallest id stands for it. Repeated rows get equal
    results; an empty table gives an empty one; other columns are ignored.
    """
    host, path = _host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text_of(text_col).alias("html")).withColumns({"host": host, "path": path})

    kind = dict(rows.dtypes)["id"]

    def split(with_texts: bool) -> DataFrame:
        def lined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for begin in range(0, whole.num_rows, 128):
                    batch = whole.slice(begin, 128)
                    pages_lines = [page_lines(markup.as_py()) for markup in batch.column(0)]
                    hashes = [[xxhash.xxh64_intdigest(t.encode()) - (1 << 63) for _, t in lines] for lines in pages_lines]
                    columns = [*(batch.column(k) for k in range(1, batch.num_columns)), pa.array(hashes, pa.list_(pa.int64()))]
                    names = [*batch.schema.names[1:], "hashes"]
                    if with_texts:
                        columns.append(pa.array([bytes(s for s, _ in lines) for lines in pages_lines], pa.binary()))
                        columns.append(pa.array([[None if s == MARKED else t for s, t in lines] for lines in pages_lines], pa.list_(pa.string())))
                        names += ["around", "texts"]
                    yield pa.RecordBatch.from_arrays(columns, names)

        if with_texts:
            return rows.select("html", "id", "url", "host", "path").mapInArrow(lined, f"id {kind}, url string, host string, path string, hashes array<bigint>, around binary, texts array<string>")
        return rows.select("html", "id", "host", "path").mapInArrow(lined, f"id {kind}, host string, path string, hashes array<bigint>")

    paths = split(False).groupBy("host", "path").agg(F.min_by("hashes", F.struct("id", "hashes")).alias("hashes"))
    near = stored(nearest_paths(paths), "nearest-paths").where("near is not null")
    joined = split(True).join(near, ["host", "path"], "left").select("id", "url", "hashes", "around", "texts", "near", "other")

    def differed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, shared, marked = [], [], []
            for hashes, around, lines, near, other in zip(*(batch.column(k) for k in range(2, 7))):
                state, own = around.as_py(), hashes.as_py()
                lines = lines.as_py()
                gone = set()
                if near.is_valid:
                    common = set(common_lines(own, near.as_py()))
                    gone = {k for k in common if state[k] != ARTICLE}
                    article = [k for k, s in enumerate(state) if s == ARTICLE]
                    if other.is_valid and any(k in common for k in article[:1] + article[-1:]):
                        gone |= shared_article_lines(article, [len(lines[k]) for k in article], common, set(common_lines(own, other.as_py())))
                least = ARTICLE if ARTICLE in state else PLAIN
                if least == PLAIN and gone.issuperset(k for k, s in enumerate(state) if s == PLAIN):
                    gone = set()  # the nearest page has all of this one: a copy
                texts.append("\n\n".join(t for k, (s, t) in enumerate(zip(state, lines)) if s >= least and k not in gone))
                shared.append(len(gone))
                marked.append(sum(s < least for k, s in enumerate(state) if k not in gone))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(shared, pa.int64()), pa.array(marked, pa.int64())], ["id", "url", "text", "n_shared", "n_marked"])

    out = joined.mapInArrow(differed, f"id {kind}, url string, text string, n_shared bigint, n_marked bigint")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"), "n_shared", "n_marked")
