"""Main text of web pages: block extraction, then nearest-URL page differencing.

A page's text is cut into lines at block elements. Regions that HTML itself marks as something else than the article
go: scripts, styles, forms, navigation, page headers, footers, sidebars, and elements whose class, id or role names
them as adverts, notices, menus, comments and the like; an article or main element in one that its class or id names
counts all the same (in adverts, comments and related items: if the page has nothing else). If the page marks its
article (an article element; else main; else a content container by class or id) and at least half of the characters
are in it, lines elsewhere go too, but for headings in a main element.

Differencing: pages are ordered by host and URL path; of its neighbours on the same host, NEAR on each side, a page is
paired with the one that shares most of the path and isn't a near copy. The longest common subsequence of the lines of
both is what the site repeats: these lines are deleted, inside articles too. A near copy, with which a page has most
lines and characters of either in common, shows no template; beside such ones only, all lines stay.

Defined cases: a null or empty html has an empty text; a null url is one of host '' and path ''; rows that repeat
get an answer each; an empty table gives an empty result; extra columns are ignored; null page_ids stay null; a very long
page is cut whole, its lines are held by one task beside those of its neighbours; of equally near pages the one tried
first is the nearer in order, of two as near the one before.
"""

from __future__ import annotations

import bisect
from collections import deque
import html as entities
import math
import re
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, range_number, to_ranges

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""", re.S)
ATTR = re.compile(r"""([\w:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea xmp noscript iframe template title svg math".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
SKIP = frozenset("head nav aside footer form button select dialog menu object canvas audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promos promotion promoted banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar comment comments reply replies respond disqus discussion share sharing social related recommended pagination pager login search skip widget".split()
)
#: Such elements hold articles of others.
FOREIGN = frozenset("comment comments reply replies ad ads sponsored promo promoted related".split())
#: Classes and ids, in full, of content containers.
CONTENT = frozenset("article content post entry story main-content article-content article-body post-content post-body entry-content story-body".split())
#: A table in an article is content, whatever its class names it, unless that is others' content.
TABLE = frozenset("table thead tbody tfoot tr td th caption".split())
#: A class that tells what an element has or hasn't beside it, not what it is.
BESIDE = re.compile(r"(?:has|with|no|without)(?=[-_A-Z])")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an element is: NAMED and OTHERS are skipped by class or id, OUT for good.
PLAIN, NAMED, OTHERS, OUT = range(4)
#: So many pages on each side are tried for one that isn't a near copy.
NEAR = 8
SAME = frozenset("li td th tr dd dt option".split())


def _kind(tag: str, attrs: str, inside: bool) -> tuple[int, int]:
    """(PLAIN or why the element isn't part of the article, how surely it holds it: 3 article, 2 main, 1 by name)."""
    a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(attrs)} if "=" in attrs else {}
    tokens = [t for k in ("class", "id") for t in a.get(k, "").split()]
    words = {w.lower() for t in tokens if not BESIDE.match(t) for w in NAME.findall(t)}
    role = a.get("role", "").lower()
    level = 3 if tag == "article" or a.get("itemprop") == "articleBody" else 2 if tag == "main" or role == "main" else 1 if tag in ("div", "section", "td") and any(t.lower() in CONTENT for t in tokens) else 0
    if tag in ("body", "html"):
        return PLAIN, 0
    if tag in SKIP or role in ROLES or tag == "header" and not inside or re.search(r"(?i)(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", attrs):
        return OUT, 0
    bad = words & (FOREIGN if inside and tag in TABLE else NAMES) or "header" in words and not inside
    if bad and (level < 2 or words & FOREIGN):
        return OTHERS if words & FOREIGN else NAMED, 0
    return PLAIN, level


def lines(page: str | None) -> tuple[list[str], bool]:
    """(the lines that may be the article's, whether an article or main element holds them)."""
    page = page or ""
    out: list[tuple[int, bool, str]] = []  # level, -1 in an article of others; whether it is a heading; line
    buffer: list[str] = []
    stack: list[tuple[str, int, int]] = []
    at, end = 0, len(page)

    def flush():
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            if text:
                heading = any(x[0] in HEADINGS for x in stack[-4:])
                out.append((stack[-1][2] if stack else 0, heading, text))
            buffer.clear()

    while at < end:
        m = TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at and not (stack and stack[-1][1]):
            buffer.append(page[at:stop])
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            flush()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if any(x[0] in BLOCK or x[1] for x in stack[i:]):
                        flush()
                    del stack[i:]
                    break
            continue
        if tag in RAW and not m[3].endswith("/"):
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag == "body":
            stack.clear()
        elif tag in BLOCK:
            while stack and (stack[-1][0] not in BLOCK or stack[-1][0] == "p") and not stack[-1][1]:
                stack.pop()
            if tag in SAME and stack and stack[-1][0] == tag and not stack[-1][1]:
                stack.pop()
        _, skip, level = stack[-1] if stack else ("", PLAIN, 0)
        bad, own = (PLAIN, 0) if skip == OUT else _kind(tag, m[3], level >= 2)
        if (bad or own > level) and buffer:
            flush()
        if skip in (NAMED, OTHERS) and own >= 2:
            stack.append((tag, PLAIN, own if skip == NAMED and level >= 0 else -1))
        elif level < 0:
            stack.append((tag, max(skip, bad), level))
        else:
            stack.append((tag, max(skip, bad), max(level, own)))
    if not (stack and stack[-1][1]):
        flush()
    if any(k >= 0 for k, _, _ in out):
        out = [x for x in out if x[0] >= 0]
    # the surest mark that holds at least half of the characters
    size = lambda best: sum(len(t) for k, _, t in out if k >= best)
    best = next((k for k in (3, 2, 1, 0) if 2 * size(k) >= size(-1) and any(x[0] >= k for x in out)), -1)
    return [t for k, heading, t in out if k >= best or heading and k == 2], best >= 2


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in a of a longest common subsequence with b: bit-parallel rows, kept at every root of n-th row only."""
    both = set(a) & set(b)
    ia, ib = [i for i, x in enumerate(a) if x in both], [x for x in b if x in both]
    if not ia:
        return set()
    where: dict[str, int] = {}
    for j, x in enumerate(ib):
        where[x] = where.get(x, 0) | 1 << j
    full, step = (1 << len(ib)) - 1, max(1, math.isqrt(len(ia)))

    def row(v: int, i: int) -> int:
        u = v & where[a[ia[i]]]
        return ((v + u) | (v - u)) & full

    v, saved = full, [full]
    for i in range(len(ia)):
        v = row(v, i)
        if (i + 1) % step == 0:
            saved.append(v)
    found: set[int] = set()
    i, j = len(ia), len(ib)
    base, rows = len(ia) + 1, []  # rows[k]: the row behind the first base + k lines
    while i and j:
        if i - 1 < base:
            base = max(0, i - 1) // step * step
            rows = [saved[base // step]]
            for k in range(base, i):
                rows.append(row(rows[-1], k))
        if rows[i - base] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if i and not rows[i - base] >> (j - 1) & 1:
            continue
        j -= 1
        found.add(ia[i])
    return found


def place(url: str | None) -> tuple[str, str]:
    try:
        u = urlsplit(url or "")
        return (u.netloc.lower(), u.path)
    except ValueError:
        return ("", url or "")


def _shared(p: str, q: str) -> tuple[int, int]:
    """How much of the path two pages share: segments, then characters."""
    a, b = p.split("/"), q.split("/")
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return k, next((i for i, (x, y) in enumerate(zip(p, q)) if x != y), min(len(p), len(q)))


def _keys(batches):
    for pdf in batches:
        where = [place(u) for u in pdf.url]
        yield pd.DataFrame({"host": [h for h, _ in where], "path": [p for _, p in where], "k": pdf.k})


def _ends(batches):
    """The first and the last NEAR keys of a range, in order."""
    head, tail = [], deque(maxlen=NEAR)
    for pdf in batches:
        for key in zip(pdf.pid, pdf.host, pdf.path, pdf.k):
            if len(head) < NEAR:
                head.append(key)
            else:
                tail.append(key)
    yield pd.DataFrame([(*key, i) for i, key in enumerate([*head, *tail])], columns=["pid", "host", "path", "k", "i"])


def ranges(keys: DataFrame, rows_per_bucket: int = 50_000) -> list[tuple]:
    """(first key, the key NEAR places before or the first of all, last key, the key NEAR places behind) of each of
    some ranges that split keys by order. What reaches the driver is 2 * NEAR keys a range, of which there are
    common.MAX_RANGES at most."""
    dealt = keys.repartitionByRange(range_number(keys, rows_per_bucket), *KEY).withColumn("pid", F.spark_partition_id()).sortWithinPartitions(*KEY)
    parts: dict[int, list] = {}
    for r in sorted(dealt.mapInPandas(_ends, "pid int, host string, path string, k long, i int").collect(), key=lambda r: (r.pid, r.i)):
        parts.setdefault(r.pid, []).append((r.host, r.path, r.k))
    ends = sorted(parts.values())
    flat = [key for x in ends for key in x]
    out, at = [], 0
    for x in ends:
        out.append((x[0], flat[max(0, at - NEAR)], x[-1], flat[min(len(flat), at + len(x) + NEAR) - 1]))
        at += len(x)
    return out


def _deal(sent):
    """Pages' lines to the range of their key; pages near the ends of other ranges also there, as guests."""

    def run(batches):
        cuts = sent.value
        firsts = [x[0] for x in cuts]
        for pdf in batches:
            out = []
            for page, null, url, src, k in zip(pdf.page_id, pdf.null_id, pdf.url, pdf.html, pdf.k):
                key = (*place(url), k)
                own = bisect.bisect_right(firsts, key) - 1
                text, _ = lines(src)
                out.append((page, null, url, *key, text, own, False))
                b = own + 1
                while b < len(cuts) and key >= cuts[b][1]:
                    out.append((page, null, url, *key, text, b, True))
                    b += 1
                b = own - 1
                while b >= 0 and key <= cuts[b][3]:
                    out.append((page, null, url, *key, text, b, True))
                    b -= 1
            yield pd.DataFrame(out, columns=DEALT)

    return run


KEY = ["host", "path", "k"]
DEALT = ["page_id", "null_id", "url", *KEY, "lines", "bucket", "guest"]


def near_copy(a: list[str], b: list[str], shared: set[int]) -> bool:
    """Whether the lines of a with numbers shared, which b has too, are most lines and characters of either."""
    chars = sum(len(a[i]) for i in shared)
    return any(2 * len(shared) > len(x) and 2 * chars > sum(map(len, x)) for x in (a, b))


def _difference(row, near) -> str:
    """The text of row; near: pages around it, nearest first."""
    mine = list(row.lines)
    near = [x for x in near if x.bucket == row.bucket and x.host == row.host]
    for pair in sorted(near, key=lambda x: _shared(row.path, x.path), reverse=True):
        theirs = list(pair.lines)
        if not theirs or theirs == mine:
            continue
        gone = common_lines(mine, theirs)
        if not near_copy(mine, theirs, gone):
            return " ".join(t for i, t in enumerate(mine) if i not in gone)
    return " ".join(mine)


def _texts(batches):
    rows, at = [], 0  # the rows around rows[at], the next to answer

    def answer():
        row = rows[at]
        near = [rows[i] for d in range(1, NEAR + 1) for i in (at - d, at + d) if 0 <= i < len(rows)]
        text = _difference(row, near)
        return (None if row.null_id else row.page_id, row.url, text, len(text))

    cols = ["page_id", "url", "text", "n_chars"]
    for pdf in batches:
        out = []
        for new in pdf.itertuples(index=False):
            rows.append(new)
            if len(rows) - at > NEAR:
                if not rows[at].guest:
                    out.append(answer())
                at += 1
                if at > NEAR:
                    del rows[0]
                    at -= 1
        yield pd.DataFrame(out, columns=cols).astype({"page_id": "Int64"})
    out = []
    while at < len(rows):
        if not rows[at].guest:
            out.append(answer())
        at += 1
    yield pd.DataFrame(out, columns=cols).astype({"page_id": "Int64"})


SCHEMA = "page_id long, url string, text string, n_chars long"


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages (page_id, url, html).

    Only keys are ordered to find the ranges; then a page's lines are shuffled once, to its range."""
    prepare(pages.sparkSession)
    rows = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(0)).alias("page_id"), F.col("page_id").isNull().alias("null_id"), "url", "html", F.xxhash64("page_id", "html").alias("k"))
    cuts = ranges(rows.select("url", "k").mapInPandas(_keys, "host string, path string, k long"))
    if not cuts:
        return pages.sparkSession.createDataFrame([], SCHEMA)
    sent = pages.sparkSession.sparkContext.broadcast(cuts)
    dealt = rows.mapInPandas(_deal(sent), "page_id long, null_id boolean, url string, host string, path string, k long, lines array<string>, bucket long, guest boolean")
    return to_ranges(dealt, "bucket", len(cuts), *KEY).mapInPandas(_texts, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    """op6 over all pages."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
