"""Not-modified revisits of a web archive: each is resolved to the full response it repeats.

A revisit belongs to the latest earlier full response with its canonical URL.
If its validators agree (ETag, compared weakly as not-modified answers do;
Last-Modified where an ETag is missing) the record is completed: payload of the response, its headers, and of the revisit's
headers those that a not-modified answer may replace.

The as-of join needs no window over a whole URL. Records are written once in
sampled ranges of (URL, time), which hold about equally many rows whatever a URL's
share, the unit of time or a burst; inside (URL, range) a window carries the last
response on, and one row per (URL, range), its last response, carries it to later
ranges. A URL with a third of all records is thus spread over many ranges.

Defined results: a revisit without URL or time, or without an earlier response,
is "unresolved"; validators that differ give "mismatch" with the response it
was held against, no payload and no merged headers; none to compare gives
"unverified", resolved all the same; a response at the very time of a revisit
is not earlier; of responses at one time the largest id counts; null headers
are no headers; repeated revisits are each answered; an empty table gives an
empty result. Header names are in lower case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sequence import in_ranges

#: Headers that a not-modified answer replaces.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query names that only track the visitor, or begin like one.
TRACKING = r"^(utm_[^=]*|gclid|fbclid)(=|$)"
_URL = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def canonical_url(url: Column) -> Column:
    """Host in lower case without "www." and the scheme's default port, path, and sorted query without tracking names.

    Scheme and fragment are dropped; an empty path is "/"; null where there is no host.
    """
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 1)), r"^www\.", "")
    host = (F.when(url.rlike("^(?i)http://"), F.regexp_replace(host, ":80$", ""))
            .when(url.rlike("^(?i)https://"), F.regexp_replace(host, ":443$", "")).otherwise(host))
    path = F.regexp_extract(url, _URL, 2)
    query = F.array_sort(F.filter(F.split(F.regexp_extract(url, _URL, 3), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    full = F.concat(host, F.when(path == "", "/").otherwise(path),
                    F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))
    return F.when(host != "", full)


def _headers(name: str) -> Column:
    return F.coalesce(F.col(name), F.create_map().cast("map<string,string>"))


def merge_headers(old: Column, new: Column) -> Column:
    """Headers of the response, replaced by the permitted ones of the revisit."""
    allowed = F.map_filter(new, lambda k, v: k.isin(*PERMITTED))
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(allowed, k)), allowed)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit: id, ts, url (canonical), state, response_id, response_ts, payload, headers.

    ``records``: id, type ("response" or "revisit"), ts (number), url, headers (map), payload (of a response: its digest or place).
    """
    rows = records.where(F.col("type").isin("response", "revisit")).select(
        "id", "ts", canonical_url(F.col("url")).alias("url"), (F.col("type") == "response").alias("full"),
        _headers("headers").alias("headers"), "payload")
    known = F.col("url").isNotNull() & F.col("ts").isNotNull()
    lost = rows.where(~known & ~F.col("full")).withColumn("old", F.lit(None).cast("struct<id:bigint,ts:bigint,headers:map<string,string>,payload:string>"))
    # equal URLs share a hash, and only hashes and times are sampled
    rows = in_ranges(rows.where(known).withColumn("key", F.xxhash64("url")), ["key"], ["ts", "full", "id"])
    response = F.when(F.col("full"), F.struct("id", "ts", "headers", "payload"))
    line = Window.partitionBy("url", "_range").orderBy("ts", F.col("full"), F.col("id").asc_nulls_first())
    near = F.last(response, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    last = rows.groupBy("url", "_range").agg(F.max_by(response, F.when(F.col("full"), F.struct("ts", "id"))).alias("last"))
    earlier = Window.partitionBy("url").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("far", F.last("last", ignorenulls=True).over(earlier)).select("url", "_range", "far")
    found = (rows.withColumn("near", near).where(~F.col("full")).join(carried, ["url", "_range"], "left")
             .withColumn("old", F.coalesce("near", "far")))
    found = found.select(*lost.columns).unionAll(lost)

    def validator(name: str) -> tuple[Column, Column]:
        return F.col("headers")[name], F.col("old.headers")[name]

    tag, old_tag = (F.regexp_replace(v, "^W/", "") for v in validator("etag"))
    date, old_date = validator("last-modified")
    same = F.when(tag.isNotNull() & old_tag.isNotNull(), tag == old_tag).when(
        date.isNotNull() & old_date.isNotNull(), date == old_date)
    state = (F.when(F.col("old").isNull(), "unresolved").when(same.isNull(), "unverified")
             .when(same, "resolved").otherwise("mismatch"))
    found = found.withColumn("state", state)
    good = F.col("state").isin("resolved", "unverified")
    return found.select("id", "ts", "url", "state", F.col("old.id").alias("response_id"), F.col("old.ts").alias("response_ts"),
                        F.when(good, F.col("old.payload")).alias("payload"),
                        F.when(good, merge_headers(F.col("old.headers"), F.col("headers"))).alias("headers"))


def header_lines(headers: Column) -> Column:
    """Headers as text, a line each, by name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda h: F.concat(h["key"], F.lit(": "), h["value"])), "\n")


def crawl_records(pages: DataFrame) -> DataFrame:
    """A crawl derived from pages (page_id, url, html): versions of every page, mirrors, and four revisits of each.

    Page n has 1 + n % 4 full responses at different times (two of them at one time where n % 8 is 7). Pages that
    follow a page whose number 3 divides have a full response at that page's URL too, between its own versions. Revisits ask by other
    spellings of the URL (tracking names, fragment, default port, capitals): before any response, at the very time
    of the third one, shortly after, and long after. Their validators are those of version (n + j) % 4; every
    seventh has no ETag, every eleventh none at all; every third page's responses have weak ETags.
    """
    n = F.col("page_id")
    html = F.coalesce("html", F.lit(""))
    seen = pages.select("page_id", "url", F.length(html).cast("string").alias("size"), F.md5(html).alias("h"), F.sha2(html, 256).alias("p"))

    def headers(pairs: dict[str, Column]) -> Column:
        return F.map_filter(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())

    def tag(version: Column) -> Column:
        return F.concat(F.lit('"'), F.md5(F.concat("h", F.lit("#"), version.cast("string"))), F.lit('"'))

    def response(rows: DataFrame, number: Column, version: Column, ts: Column, url: str) -> DataFrame:
        weak = F.when(n % 3 == 1, "W/").otherwise("")
        return rows.select((16 * n + number).alias("id"), F.lit("response").alias("type"), ts.alias("ts"), F.col(url).alias("url"), headers({
            "content-type": F.lit("text/html"), "content-length": F.col("size"), "etag": F.concat(weak, tag(version)),
            "last-modified": F.concat(F.lit("day "), version.cast("string")), "cache-control": F.lit("max-age=60"), "date": ts.cast("string")}).alias("headers"),
            F.sha2(F.concat("p", F.lit("#"), version.cast("string")), 256).alias("payload"))

    v, j = F.col("v"), F.col("j")
    versions = seen.withColumn("v", F.explode(F.sequence(F.lit(0), (n % 4).cast("int"))))
    own = response(versions, v, v, 100 * n + F.when((n % 8 == 7) & (v == 1), 74).otherwise(37 * v), "url")
    heads = seen.where(n % 3 == 0).select(F.col("page_id").alias("head"), F.col("url").alias("head_url"))
    mirrors = seen.where(n % 3 != 0).join(heads, F.col("head") == n - n % 3)
    mirrored = response(mirrors, F.lit(4), F.lit("m"), 100 * (n - n % 3) + 60 + 5 * (n % 3), "head_url")
    asked = seen.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(3))))
    ts = 100 * n + F.element_at(F.array(F.lit(-5), F.lit(74), F.lit(90), F.lit(1000)), j + 1)
    plain = F.regexp_replace("url", "#.*$", "")
    spelt = (F.when(j == 1, F.regexp_replace(F.regexp_replace(plain, "^(https://)([^/?#:]+)", "$1$2:443"), "^(http://)([^/?#:]+)", "$1$2:80"))
             .when(j == 2, F.concat(F.upper(F.regexp_extract(plain, "^([A-Za-z]+://)?([^/?#]*)", 0)), F.regexp_replace(plain, "^([A-Za-z]+://)?([^/?#]*)", "")))
             .otherwise(plain))
    url = F.concat(spelt, F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("utm_medium=again#part"))
    turn = n + j
    none = F.lit(None).cast("string")
    again = asked.select((16 * n + 8 + j).alias("id"), F.lit("revisit").alias("type"), ts.alias("ts"), url.alias("url"), headers({
        "etag": F.when((turn % 11 == 0) | (turn % 7 == 0), none).otherwise(tag(turn % 4)),
        "last-modified": F.when(turn % 11 == 0, none).otherwise(F.concat(F.lit("day "), (turn % 4).cast("string"))),
        "cache-control": F.lit("max-age=600"), "date": ts.cast("string"), "set-cookie": F.lit("a=b")}).alias("headers"), none.alias("payload"))
    return own.unionAll(mirrored).unionAll(again)
