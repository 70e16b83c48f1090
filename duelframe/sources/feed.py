"""Nested provider feed -> flat enrichment rows.

A feed document holds a list of match objects and a map of team objects,
each team with a ``history`` list. Leaves are read as strings and converted
with ``try_cast`` (feeds send numbers as text, T6). Documents of ordinary size are
one row each and flattened by ``explode``/``posexplode`` inside it (``parse_feed``);
documents of any size are cut at the borders of their objects while they are read,
so that one file is many tasks and never one row (``cut_feed``). Both give the same
elements, and everything after works on elements.

Semantics kept from the reference:
- only finished matches (``isResult`` true) are kept (P3);
- a match with a missing key or a bad number is skipped, not fatal (P4) —
  skipped rows keep ``_ok = false`` in ``finished_match_rows``;
- forecast: missing or empty object -> NULL; a key missing inside a present
  object -> 0 (P19);
- pressing ratio ``att / def`` when def > 0 else 0; missing att -> 0,
  missing def -> 1 (P17);
- team history keyed (date, team): a later entry in the document overwrites
  an earlier one (S5), i.e. keep-last by (team position, history position);
- provider names are standardised before any lookup (P7).
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import standardize_names
from ..session import stored

_S = T.StringType()
FEED_SCHEMA = T.StructType([
    T.StructField("matches", T.ArrayType(T.StructType([
        T.StructField("isResult", T.BooleanType()),
        T.StructField("datetime", _S),
        T.StructField("h", T.StructType([T.StructField("title", _S)])),
        T.StructField("a", T.StructType([T.StructField("title", _S)])),
        T.StructField("xG", T.StructType([T.StructField("h", _S), T.StructField("a", _S)])),
        T.StructField("forecast", T.StructType([T.StructField("w", _S), T.StructField("d", _S),
                                                T.StructField("l", _S)])),
    ]))),
    T.StructField("teams", T.MapType(_S, T.StructType([
        T.StructField("title", _S),
        T.StructField("history", T.ArrayType(T.StructType([
            T.StructField("date", _S),
            T.StructField("ppda", T.StructType([T.StructField("att", _S), T.StructField("def", _S)])),
            T.StructField("xpts", _S),
            T.StructField("npxG", _S),
            T.StructField("deep", _S),
        ]))),
    ]))),
])

# The provider's column names.
ENRICHMENT_COLUMNS = ["date", "home_team", "away_team", "us_home_xg", "us_away_xg",
                      "us_home_npxg", "us_away_npxg", "us_home_ppda", "us_away_ppda",
                      "us_home_deep", "us_away_deep", "us_home_xpts", "us_away_xpts",
                      "us_forecast_w", "us_forecast_d", "us_forecast_l"]


def _num(c: Column) -> Column:
    return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))


def _day(text: Column) -> Column:
    return F.to_date(F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))))


def parse_feed(docs: DataFrame, text_col: str = "doc") -> DataFrame:
    """Parse JSON text into the feed struct ``_f`` (strings at the leaves)."""
    return docs.withColumn("_f", F.from_json(text_col, FEED_SCHEMA)).drop(text_col)


def read_feed_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One JSON document per file, all seasons in one multi-path read.

    ``doc_id`` is the file name (the season page).
    """
    docs = spark.read.option("wholetext", True).text(list(paths))
    return docs.select(F.col("_metadata.file_name").alias("doc_id"), F.col("value").alias("doc"))


class FeedElements(NamedTuple):
    """Objects of feed documents: matches (keys, pos, m) and team history entries (keys, team, o, h) in the order of ``o``."""

    matches: DataFrame
    history: DataFrame


def _elements(feed: DataFrame | FeedElements, keys: Sequence[str]) -> FeedElements:
    if isinstance(feed, FeedElements):
        return feed
    t = feed.select(*keys, F.posexplode("_f.teams").alias("tpos", "team_id", "t"))
    h = t.select(*keys, "tpos", F.col("t.title").alias("team"), F.posexplode("t.history").alias("hpos", "h"))
    return FeedElements(feed.select(*keys, F.posexplode("_f.matches").alias("pos", "m")),
                        h.select(*keys, "team", F.struct("tpos", "hpos").alias("o"), "h"))


_MATCH, _ENTRY = FEED_SCHEMA["matches"].dataType.elementType, FEED_SCHEMA["teams"].dataType.valueType["history"].dataType.elementType
_OPENS = r'"(?:history|matches)"\s*:\s*\['
_TITLE = r'"title"\s*:\s*"((?:[^"\\]|\\.)*)"[^{}\[\]]*$'


def cut_feed(spark: SparkSession, paths: Sequence[str], separator: str = "},{") -> FeedElements:
    """Elements of feed documents of any size, one document a file; ``doc_id`` is the file name.

    Files are read as text cut at ``separator``, which stands only between the objects of a list (with the
    producer's own spacing), so a piece holds few objects and a file is read by as many tasks as it has splits. A
    history entry's team is the last title that opened a list before it: carried along inside a split by a window,
    and over splits by one row a split. Titles must not hold ``]`` or the separator, and a team's title comes before
    its history.
    """
    pieces = spark.read.option("lineSep", separator).text(list(paths)).select(
        F.col("_metadata.file_name").alias("doc_id"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), F.split("value", _OPENS).alias("parts"))
    titles = F.transform(F.col("parts"), lambda p: F.regexp_extract(p, _TITLE, 1))
    # part i > 0 belongs to the title that ends part i - 1; the first goes on with a list opened earlier
    opened = F.slice(titles, 1, F.size("parts") - 1)
    pieces = pieces.withColumn("titles", opened).withColumn("last", F.when(F.size("titles") > 0, F.element_at("titles", -1)))
    line = Window.partitionBy("doc_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("near", F.last("last", ignorenulls=True).over(line))
    per = pieces.groupBy("doc_id", "block").agg(F.max_by("last", F.when(F.col("last").isNotNull(), F.col("place"))).alias("block_last"))
    earlier = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    far = per.select("doc_id", "block", F.last("block_last", ignorenulls=True).over(earlier).alias("far"))
    each = (pieces.join(far, ["doc_id", "block"])
            .select("doc_id", "block", "place", F.coalesce("near", "far").alias("carried"), "titles", F.posexplode("parts").alias("j", "part")))
    title = F.when(F.col("j") == 0, F.col("carried")).otherwise(F.get("titles", F.col("j") - 1))
    body = F.trim(F.regexp_extract("part", r"^[^\]]*", 0))
    body = F.concat(F.when(body.startswith("{"), "").otherwise("{"), body, F.when(F.col("part").contains("]"), "").otherwise("}"))
    each = each.withColumns({"title": title, "body": body}).where(F.col("body").rlike(r'^\{\s*"'))
    each = each.withColumns({"m": F.from_json("body", _MATCH), "h": F.from_json("body", _ENTRY)})
    is_match = F.col("m.isResult").isNotNull() | F.col("m.xG").isNotNull() | F.col("m.h").isNotNull() | F.col("m.a").isNotNull()
    is_entry = ~is_match & (F.coalesce("title", F.lit("")) != "") & F.col("h").isNotNull()
    order = F.struct("block", "place", "j")
    text = F.get(F.from_json(F.concat(F.lit('["'), "title", F.lit('"]')), "array<string>"), F.lit(0))  # escapes read as JSON does
    return FeedElements(each.where(is_match).select("doc_id", order.alias("pos"), "m"),
                        each.where(is_entry).select("doc_id", text.alias("team"), order.alias("o"), "h"))


def _match_rows(feed: DataFrame | FeedElements, keys: Sequence[str]) -> DataFrame:
    m = _elements(feed, keys).matches
    m = m.where(F.col("m.isResult"))  # NULL / false -> not finished (P3)
    fc = F.col("m.forecast")
    present = fc.isNotNull() & (fc.w.isNotNull() | fc.d.isNotNull() | fc.l.isNotNull())

    def fval(k):
        return F.when(present, F.coalesce(_num(fc[k]), F.lit(0.0)))

    bad_fc = present & ((fc.w.isNotNull() & _num(fc.w).isNull()) | (fc.d.isNotNull() & _num(fc.d).isNull())
                        | (fc.l.isNotNull() & _num(fc.l).isNull()))
    out = m.select(
        *keys, "pos",
        _day(F.col("m.datetime")).alias("date"),
        F.col("m.h.title").alias("home_team"), F.col("m.a.title").alias("away_team"),
        _num(F.col("m.xG.h")).alias("us_home_xg"), _num(F.col("m.xG.a")).alias("us_away_xg"),
        fval("w").alias("us_forecast_w"), fval("d").alias("us_forecast_d"), fval("l").alias("us_forecast_l"),
        bad_fc.alias("_bad_fc"))
    ok = (F.col("date").isNotNull() & F.col("home_team").isNotNull() & F.col("away_team").isNotNull()
          & F.col("us_home_xg").isNotNull() & F.col("us_away_xg").isNotNull() & ~F.col("_bad_fc"))
    return out.withColumn("_ok", ok).drop("_bad_fc")


def finished_match_rows(parsed: DataFrame | FeedElements, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """All finished match objects with an ``_ok`` flag (well-formed or not)."""
    return _match_rows(parsed, keys)


def flatten_matches(parsed: DataFrame | FeedElements, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Finished, well-formed match rows."""
    return _match_rows(parsed, keys).where("_ok").drop("_ok")


def flatten_team_history(parsed: DataFrame | FeedElements, keys: Sequence[str] = ("doc_id",),
                         name_map: DataFrame | None = None) -> DataFrame:
    """(keys, date, team) -> ppda, xpts, npxg, deep; later entries overwrite.

    Names are standardised before the key is formed, so two provider
    spellings of one entity overwrite each other as they would in a dict.
    """
    h = _elements(parsed, keys).history
    att = F.coalesce(_num(F.col("h.ppda.att")), F.lit(0.0))
    de = F.coalesce(_num(F.col("h.ppda.def")), F.lit(1.0))
    stats = F.struct(
        F.when(de > 0, att / de).otherwise(F.lit(0.0)).alias("ppda"),
        F.coalesce(_num(F.col("h.xpts")), F.lit(0.0)).alias("xpts"),
        F.coalesce(_num(F.col("h.npxG")), F.lit(0.0)).alias("npxg"),
        F.coalesce(_num(F.col("h.deep")), F.lit(0.0)).alias("deep"))
    rows = h.select(*keys, _day(F.col("h.date")).alias("date"), "team", stats.alias("s"), "o")
    if name_map is not None:
        rows = standardize_names(rows, "team", name_map)
    last = rows.groupBy(*keys, "date", "team").agg(F.max_by("s", "o").alias("s"))
    return last.select(*keys, "date", "team", "s.ppda", "s.xpts", "s.npxg", "s.deep")


def feed_enrichment(parsed: DataFrame | FeedElements, keys: Sequence[str] = ("doc_id",),
                    name_map: DataFrame | None = None) -> DataFrame:
    """The 16-column enrichment table: each match with both sides' team stats.

    Names are standardised first (P7); lookups stay inside the document
    (``keys``) as in the reference, where each season page has its own table.
    """
    keys = list(keys)
    m = flatten_matches(parsed, keys)
    ts = flatten_team_history(parsed, keys, name_map)
    if name_map is not None:
        m = standardize_names(m, "home_team", name_map)
        m = standardize_names(m, "away_team", name_map)
    side = {}
    for s in ("home", "away"):
        side[s] = ts.select(*[F.col(k).alias(f"_{s}_{k}") for k in keys], F.col("date").alias(f"_{s}_d"),
                            F.col("team").alias(f"_{s}_t"),
                            *[F.col(c).alias(f"us_{s}_{c}") for c in ("npxg", "ppda", "deep", "xpts")])
    out = m
    for s in ("home", "away"):
        r = side[s]
        cond = [out[k] == r[f"_{s}_{k}"] for k in keys] + [out["date"] == r[f"_{s}_d"],
                                                           out[f"{s}_team"] == r[f"_{s}_t"]]
        out = out.join(r, cond, "left")
    return out.select(*keys, *ENRICHMENT_COLUMNS)


def write_enrichment(df: DataFrame, path: str, fmt: str = "parquet") -> bool:
    """Date-sorted enrichment sink; nothing is written when there are no rows."""
    df = stored(df)  # looked at, then sorted: made once
    if df.isEmpty():
        return False
    df.orderBy("date", "home_team", "away_team").write.mode("overwrite").format(fmt) \
        .options(**({"header": "true"} if fmt == "csv" else {})).save(path)
    return True
