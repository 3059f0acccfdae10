"""Line dedup by site-relative frequency.

A page's lines are its visible text cut at line ends and block tags. Per host, the share of
its pages that hold a line decides: lines above ``ratio`` are boilerplate and are dropped
from every page of the host. (Host, line) counts are summed in the map tasks before they are
shuffled, so a host or line with a third of all rows is a few rows per task. A host has at
most ``mean lines per page / ratio`` lines above the ratio, so its boilerplate is one small
table, hashed into buckets so that a look-up does not go over all of it; pages are joined to it by host,
and lines are dropped inside the row. It is broadcast only where its lines are counted and few.

Defined results: null html has no lines and an empty text; null URLs and URLs without
``://`` belong to the empty host; a line counts once per page; the ratio alone decides, so a host with one
page loses all its lines (``support`` asks for more pages, 1 by default); repeated rows are pages of
their own; an empty table gives no rows; only page_id, url and html are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

RATIO = 0.3
#: Least pages of a host that hold a line of boilerplate; 1 leaves the ratio alone to decide.
SUPPORT = 1
#: Lines of boilerplate (8 bytes each) that may be broadcast, over all hosts.
BROADCAST_LINES = 2_000_000
#: Elements that end a line.
BLOCKS = "address article aside blockquote body br dd div dl dt footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table td th title tr ul".split()
HIDDEN = r"(?is)<script\b.*?</script[ \t\n\x0B\f\r]*>|<style\b.*?</style[ \t\n\x0B\f\r]*>|<!--.*?-->"
CUT = rf"(?i)</?(?:{'|'.join(BLOCKS)})\b[^>]*>|[\r\n]+"
TAG = r"<[^>\n]*>"


def lines_of(html: Column) -> Column:
    """Visible lines, trimmed, blanks collapsed, empty ones left out."""
    shown = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " ")
    bare = F.regexp_replace(F.regexp_replace(shown, CUT, "\n"), TAG, " ")
    even = F.regexp_replace(bare, r"[ \t]+", " ")
    return F.filter(F.transform(F.split(even, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _buckets(hashes: Column) -> Column:
    """Hashes dealt to about as many buckets as each of them then holds."""
    count = F.ceil(F.sqrt(F.size(hashes)))
    return F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: F.filter(hashes, lambda h: F.pmod(h, count) == i))


def _bucket_has(buckets: Column, h: Column) -> Column:
    return F.array_contains(F.get(buckets, F.pmod(h, F.size(buckets).cast("long")).cast("int")), h)


def drop_boilerplate(pages: DataFrame, *, ratio: float = RATIO, support: int = SUPPORT) -> DataFrame:
    """page_id, host, n_lines, n_dropped and text (the lines that stay) for every page."""
    host = shared.host_of(F.col("url"))
    counted = (
        pages.select(host.alias("host"), F.explode(F.array_distinct(F.transform(lines_of(F.col("html")), lambda x: F.xxhash64(x)))).alias("line"))
        .groupBy("host", "line")
        .agg(F.count("*").alias("n"))
    )
    totals = pages.select(host.alias("host")).groupBy("host").agg(F.count("*").alias("pages"))
    above = counted.where(F.col("n") >= support).join(totals, "host").where(F.col("n") > ratio * F.col("pages"))
    listed = above.groupBy("host").agg(F.collect_list("line").alias("lines_gone"))
    common = shared.materialize(listed.select("host", _buckets(F.col("lines_gone")).alias("common"), F.size("lines_gone").alias("gone")), "boilerplate")
    hosts, lines = common.agg(F.count("*"), F.coalesce(F.sum("gone"), F.lit(0))).first()
    common = common.drop("gone")
    if hosts <= shared.BROADCAST_ROWS and lines <= BROADCAST_LINES:
        common = F.broadcast(common)
    named = pages.select("page_id", host.alias("host"), lines_of(F.col("html")).alias("lines")).join(common, "host", "left")
    gone = lambda x: _bucket_has(F.col("common"), F.xxhash64(x))
    kept = F.when(F.col("common").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~gone(x)))
    return named.withColumn("kept", kept).select(
        "page_id",
        "host",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.array_join("kept", "\n").alias("text"),
    )
