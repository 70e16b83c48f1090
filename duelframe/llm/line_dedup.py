"""Site-relative line removal: lines that stand on too large a share of their host's pages.

Pages are grouped by host. For each line the pages of the host that contain it
are counted (once a page) and divided by the host's number of pages; lines above
``RATIO`` that stand on at least ``MIN_PAGES`` pages are boilerplate and dropped
wherever they occur on that host.

Counts are partly summed in every task before they are shuffled, so neither a
host nor a line with a third of all rows meets in one task; lines travel as two
64-bit hashes. The dropped places come back to the pages by a join on the page.

Defined results: pages without host (null url too) are one site, named "";
null html has no lines; blank lines don't count and are not kept; repeated rows
are pages of their own; an empty table gives an empty result; other columns are
carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATIO = 0.1
MIN_PAGES = 3
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
HIDDEN = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"
TAG = r"<[^>]*>"
SPACE = " \t\r\x0b\x0c"


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def visible_lines(html: Column) -> Column:
    """Trimmed lines between tags, scripts, styles and comments left out."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "\n"), TAG, "\n")
    trimmed = F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)))
    return F.filter(trimmed, lambda x: x != "")


def drop_site_lines(pages: DataFrame, url_col: str = "url", html_col: str = "html", ratio: float = RATIO,
                    min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per input row: row (all input columns), host, lines, kept."""
    whole = [F.col(f"`{c}`") for c in pages.columns]
    rows = pages.select(F.struct(*whole).alias("row"), host_of(F.col(f"`{url_col}`")).alias("host"),
                        visible_lines(F.col(f"`{html_col}`")).alias("lines"))
    # equal rows have equal keys and equal lines, so one answer serves them all
    key = F.struct(F.xxhash64("host", "lines").alias("a"), F.xxhash64(F.lit(1), "lines", "host").alias("b"))
    rows = rows.withColumn("page", key)
    line = F.posexplode(F.array_distinct("lines")).alias("at", "line")
    lines = rows.select("page", "host", line).select(
        "page", "host", F.struct(F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b")).alias("line"), "at")
    totals = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    often = counts.join(totals, "host").where(F.col("n") > F.lit(ratio) * F.col("pages")).select("host", "line")
    dropped = lines.join(often, ["host", "line"], "left_semi").groupBy("page").agg(F.collect_set("at").alias("places"))
    rows = rows.join(dropped, "page", "left")
    gone = F.transform("places", lambda i: F.get(F.array_distinct("lines"), i))
    kept = F.when(F.col("places").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x: ~F.array_contains(F.col("gone"), x)))
    return rows.withColumn("gone", gone).select("row", "host", "lines", kept.alias("kept"))
