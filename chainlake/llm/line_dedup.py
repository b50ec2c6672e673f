"""Line deduplication by site-relative frequency.

A line is boilerplate of its host when more than ``max_ratio`` of the host's pages hold it, and
at least ``min_pages`` do. Lines are compared without outer spaces; blank lines never count.

First only hashes of lines are counted, so the shuffle moves no text. Since a hash counts at
least as often as its line, the few hashes above the limit hold every line above it; a second
pass counts those lines themselves. A host has at most (mean distinct lines of a page) /
``max_ratio`` boilerplate lines, so one array of a host holds them, and that array is applied to
each page of the host without cutting pages apart.

Null hosts form one host. Null and empty texts stay as they are. Repeated rows are pages of
their own. Other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainlake.llm.common import unused
from chainlake.session import materialize

MAX_RATIO = 0.1
MIN_PAGES = 5
#: Line hashes, and characters of boilerplate, that may be broadcast; beyond it the planner
#: picks a shuffle join.
BROADCAST_HASHES = 500_000
BROADCAST_CHARS = 16_000_000
#: Bytes of a page, and openers of a longer one, that can't cost much even if nothing closes them.
SHORT_PAGE = 8_000
FEW_OPENERS = 32
_UNSEEN = r"(?is)<(?:script[^>]*>.*?</script>|style[^>]*>.*?</style>|!--.*?-->)"
_OPENER = r"(?i)<(?:script|style|!--)"
_TAG = r"<[^>]*>"
_BLANKS = r"[ \t]*\n[ \t\n]*"
#: The same matches, with no run of blanks looked at again from each of its blanks.
_BLANKS_ONCE = r"(?<![ \t])[ \t]*+\n[ \t\n]*+"
#: The mark of an opener that nothing closes, and what a U+0001 of the page becomes beside such marks.
_MARK, _OWN = "\x01\x03", "\x01\x02"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def boilerplate(
    pages: DataFrame, host: Column, text_col: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """Boilerplate lines of each host: (host, lines, pages)."""
    base = pages.select(
        F.coalesce(host.cast("string"), F.lit("")).alias("host"),
        host.isNull().alias("nohost"),
        lines_of(F.col(text_col)).alias("lines"),
    )
    trimmed = F.array_distinct(F.transform("lines", lambda x: F.trim(x)))
    single = base.select("host", "nohost", F.explode(trimmed).alias("line")).filter("line <> ''")
    totals = base.groupBy("host", "nohost").agg(F.count("*").alias("pages"))
    keys = ["host", "nohost"]
    least = F.greatest(F.col("pages") * F.lit(max_ratio), F.lit(float(min_pages - 1)))
    hashes = single.groupBy(*keys, F.xxhash64("line").alias("h")).agg(F.count("*").alias("n"))
    hashes = hashes.filter(F.col("n") >= min_pages)
    often = hashes.join(totals, keys).filter(F.col("n") > least).select(*keys, "h")
    # Few hashes pass; with their number known, the second pass moves no text either.
    often = materialize(often, "line-hashes")
    if often.count() <= BROADCAST_HASHES:
        often = F.broadcast(often)
    lines = (
        single.withColumn("h", F.xxhash64("line"))
        .join(often, [*keys, "h"], "left_semi")
        .groupBy(*keys, "line")
        .agg(F.count("*").alias("n"))
    )
    return (
        lines.join(totals, keys)
        .filter(F.col("n") > least)
        .groupBy(*keys)
        .agg(F.collect_set("line").alias("lines"), F.max("pages").alias("pages"))
    )


def dedup(
    pages: DataFrame,
    host: Column,
    text_col: str = "text",
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    counts: bool = False,
) -> DataFrame:
    """The pages with the boilerplate lines of their host taken out of ``text_col``.

    With ``counts`` two columns follow: __n_lines (not blank) and __n_dropped.
    """
    h, hnull, of, nohost, bp = [unused(c, pages.columns) for c in ("__h", "__hnull", "__host", "__nohost", "__bp")]
    found = boilerplate(pages, host, text_col, max_ratio, min_pages).select(
        F.col("host").alias(of), F.col("nohost").alias(nohost), F.col("lines").alias(bp)
    )
    found = materialize(found, "boilerplate")
    size = found.agg(F.sum(F.length(of) + F.length(F.array_join(bp, "\n")) + 64)).first()[0]
    if (size or 0) <= BROADCAST_CHARS:
        found = F.broadcast(found)
    joined = pages.withColumns(
        {h: F.coalesce(host.cast("string"), F.lit("")), hnull: host.isNull()}
    ).join(found, (F.col(h) == F.col(of)) & (F.col(hnull) == F.col(nohost)), "left")
    lines = lines_of(F.col(text_col))
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(bp, F.trim(x)), F.lit(False)))
    full = lambda a: F.size(F.filter(a, lambda x: F.trim(x) != ""))
    text = F.when(F.col(bp).isNull() | F.col(text_col).isNull(), F.col(text_col)).otherwise(
        F.array_join(kept, "\n")
    )
    more = []
    if counts:
        dropped = F.when(F.col(bp).isNull(), 0).otherwise(F.size(lines) - F.size(kept))
        more = [full(lines).cast("long").alias("__n_lines"), dropped.cast("long").alias("__n_dropped")]
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in pages.columns], *more)


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _openers_set_apart(page: Column) -> Column:
    """The page with a mark in every opener of a script, style or comment that nothing closes.

    A pattern that meets such an opener looks for its end in all the rest of the page, again for each.
    """
    for opener, closer, inner in (("script", "</script>", ".*>"), ("style", "</style>", ".*>"), ("!--", "-->", ".*")):

        def set_apart(page: Column) -> Column:
            # What can be closed begins before the last closer, and a tag has its own end before it.
            head = F.regexp_extract(F.regexp_extract(page, rf"(?is)\A(.*){closer}", 1), rf"(?s)\A({inner})", 1)
            tail = lambda h: F.substr(page, F.length(h) + 1)
            return _with(head, lambda h: F.concat(h, F.regexp_replace(tail(h), f"(?i)<(?={opener})", f"<{_MARK}")))

        page = _with(page, set_apart)
    return page


def _without_tags(page: Column) -> Column:
    # After the last end of a tag there is none to look for.
    tail = F.substring_index(page, ">", -1)
    head = F.substr(page, F.lit(1), F.length(page) - F.length(tail))
    return F.concat(F.regexp_replace(head, _TAG, "\n"), tail)


def html_lines(html: Column) -> Column:
    """Text of a page, one line for each run between tags; scripts, styles and comments go.

    Time is in proportion to a page of over ``SHORT_PAGE`` bytes; it takes more passes for that, with the same text.
    """
    short = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, _UNSEEN, "\n"), _TAG, "\n"), _BLANKS, "\n")
    many = F.regexp_count(html, F.lit(_OPENER)) > FEW_OPENERS
    marked = F.when(many, _openers_set_apart(F.replace(html, F.lit("\x01"), F.lit(_OWN)))).otherwise(html)
    bare = _with(F.regexp_replace(marked, _UNSEEN, "\n"), _without_tags)
    unmarked = F.replace(F.replace(bare, F.lit(_MARK), F.lit("")), F.lit(_OWN), F.lit("\x01"))
    long = F.regexp_replace(F.when(many, unmarked).otherwise(bare), _BLANKS_ONCE, "\n")
    return F.trim(F.when(F.octet_length(html) > SHORT_PAGE, long).otherwise(short))
