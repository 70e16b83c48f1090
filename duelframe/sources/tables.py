"""Contest tables derived from the driver's TPC-H-style parquet tables.

``contest_view`` turns orders into two-sided contests (home = customer nation,
away = lowest supplier nation other than home, pool = market segment) so the
feature operators run on data whose size grows with the scale factor.
``enrichment_view`` derives a second-provider table keyed by
(pool, ts, home, away) with the nullable statistics an enrichment feed brings.

The same derivations are given as DuckDB SQL (``CONTEST_SQL``,
``ENRICH_SQL``) for the oracle checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored


def read_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Parquet scan with the projection stated up front (column pruning)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def _cnt(cond) -> F.Column:
    return F.count(F.when(cond, 1)).cast("int")


def _isum(cond, value) -> F.Column:
    return F.sum(F.when(cond, value)).cast("bigint")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their order, customer and supplier attributes."""
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate",
                   "o_orderpriority")
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    s = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_partkey",
                    "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag",
                    "l_linestatus")
    oc = o.join(c, o.o_custkey == c.c_custkey)
    ls = li.join(s, li.l_suppkey == s.s_suppkey)
    return ls.join(oc, ls.l_orderkey == oc.o_orderkey)


def order_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-order aggregates both views read, in one pass over the line items.

    Line items are joined to their supplier nation and to the order's
    customer, then aggregated per order (partial aggregation map-side, one
    shuffle by order key). ``contest_view`` and ``enrichment_view`` both
    select from this one plan, so a query using both computes it once
    (the shuffle is reused).
    """
    j = _lines(spark, sf_dir)
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    disc = F.round(F.col("l_discount") * 100).cast("int")
    tax = F.round(F.col("l_tax") * 100).cast("int")
    return (j.groupBy("o_orderkey", "o_orderdate", "o_orderpriority", "c_nationkey", "c_mktsegment")
            .agg(F.min(F.when(F.col("s_nationkey") != F.col("c_nationkey"), F.col("s_nationkey")))
                 .alias("away"),
                 _cnt(flag == "A").alias("hg"), _cnt(flag == "R").alias("ag"),
                 _cnt(status == "O").alias("hs"), _cnt(status == "F").alias("as_"),
                 _cnt((status == "O") & (flag == "N")).alias("hst"),
                 _cnt((status == "F") & (flag == "N")).alias("ast_"),
                 F.coalesce(_isum(flag == "A", disc), F.lit(0)).alias("_xh"),
                 F.coalesce(_isum(flag == "R", disc), F.lit(0)).alias("_xa"),
                 F.sum(F.col("l_quantity").cast("int")).cast("bigint").alias("_q"),
                 F.sum("l_linenumber").cast("bigint").alias("_n"),
                 F.sum("l_partkey").cast("bigint").alias("_p"),
                 F.coalesce(_isum(flag == "A", tax), F.lit(0)).alias("_th"),
                 F.coalesce(_isum(flag == "R", tax), F.lit(0)).alias("_ta"),
                 F.coalesce(_isum(flag == "A", F.col("l_linenumber")), F.lit(0)).alias("_att_h"),
                 F.coalesce(_isum(flag == "R", F.col("l_linenumber")), F.lit(0)).alias("_att_a"),
                 _cnt((flag == "N") & (status == "O")).alias("_def_h"),
                 _cnt((flag == "N") & (status == "F")).alias("_def_a"),
                 _cnt(F.col("l_linenumber") <= 2).alias("_deep_h"),
                 _cnt(F.col("l_linenumber") > 4).alias("_deep_a"),
                 F.count(F.lit(1)).cast("int").alias("_lines"))
            .where(F.col("away").isNotNull()))


def contest_view(spark: SparkSession, sf_dir: str, stats: DataFrame | None = None) -> DataFrame:
    """One row per order that has a supplier nation other than the customer's."""
    agg = stats if stats is not None else order_stats(spark, sf_dir)
    low = F.col("o_orderpriority") == "5-LOW"
    household = F.col("c_mktsegment") == "HOUSEHOLD"

    def odd(x):
        return F.when(household, None).otherwise(F.lit(1.1) + (F.col(x) % 40) / F.lit(10.0))

    def mean_odd(x):
        return F.lit(1.2) + (F.col(x) % 30) / F.lit(10.0)

    medium = F.col("o_orderpriority") == "3-MEDIUM"
    # the second book also holds zero and negative odds
    book = {"avg_h": mean_odd("_p"), "avg_a": mean_odd("_q"),
            "avg_d": F.when(F.col("_n") % 9 == 0, 0.0).when(F.col("_n") % 9 == 1, -2.0).otherwise(mean_odd("_n"))}
    return agg.select(
        F.col("o_orderkey").alias("match_id"),
        F.col("o_orderdate").alias("ts"),
        F.year("o_orderdate").cast("int").alias("season"),
        F.col("c_mktsegment").alias("pool"),
        F.col("c_nationkey").alias("home"),
        "away", "hg", "ag",
        F.when(F.col("hg") > F.col("ag"), "H").when(F.col("hg") < F.col("ag"), "A")
        .otherwise("D").alias("ftr"),
        "hs", "as_", "hst", "ast_",
        F.when(low, None).otherwise(F.col("_xh") / F.lit(100.0)).alias("xg_h"),
        F.when(low, None).otherwise(F.col("_xa") / F.lit(100.0)).alias("xg_a"),
        odd("_q").alias("odd_h"), odd("_n").alias("odd_d"), odd("_p").alias("odd_a"),
        F.when(medium, None).otherwise(F.col("_deep_h")).cast("int").alias("hc"),
        F.when(medium, None).otherwise(F.col("_deep_a")).cast("int").alias("ac"),
        (F.col("_n") % 13).cast("int").alias("hf"), (F.col("_p") % 13).cast("int").alias("af"),
        (F.col("_th") % 4).cast("int").alias("hy"), (F.col("_ta") % 4).cast("int").alias("ay"),
        (F.col("_th") % 5 == 0).cast("int").alias("hr"), (F.col("_ta") % 5 == 0).cast("int").alias("ar"),
        *[F.when(F.col("c_mktsegment") == "MACHINERY", None).otherwise(x).alias(n) for n, x in book.items()],
    )


def enrichment_view(spark: SparkSession, sf_dir: str, stats: DataFrame | None = None) -> DataFrame:
    """Second-provider statistics keyed by (pool, ts, home, away); keys repeat.

    ``src_id`` names the order a row came from and serves as the
    deterministic tie-break when duplicate keys are collapsed.
    """
    agg = stats if stats is not None else order_stats(spark, sf_dir)
    prio = F.col("o_orderpriority")
    urgent = prio == "1-URGENT"
    high = prio == "2-HIGH"
    unspecified = prio == "4-NOT SPECIFIED"

    def ppda(att, de):
        return F.when(high, None).when(F.col(de) > 0, F.col(att) / F.col(de)).otherwise(F.lit(0.0))

    return agg.select(
        F.col("o_orderkey").alias("src_id"),
        F.col("c_mktsegment").alias("pool"),
        F.col("o_orderdate").alias("ts"),
        F.col("c_nationkey").alias("home"),
        "away",
        F.when(urgent, None).otherwise(F.col("_th") / F.lit(100.0)).alias("npxg_h"),
        F.when(urgent, None).otherwise(F.col("_ta") / F.lit(100.0)).alias("npxg_a"),
        ppda("_att_h", "_def_h").alias("ppda_h"),
        ppda("_att_a", "_def_a").alias("ppda_a"),
        F.col("_deep_h").cast("double").alias("deep_h"),
        F.col("_deep_a").cast("double").alias("deep_a"),
        ((F.col("_n") % 7) / F.lit(2.0)).alias("xpts_h"),
        ((F.col("_p") % 7) / F.lit(2.0)).alias("xpts_a"),
        F.when(unspecified, None).otherwise(F.col("hg") / F.col("_lines")).alias("fc_w"),
        F.when(unspecified, None).otherwise(
            (F.col("_lines") - F.col("hg") - F.col("ag")) / F.col("_lines")).alias("fc_d"),
        F.when(unspecified, None).otherwise(F.col("ag") / F.col("_lines")).alias("fc_l"),
    )


# ---------------------------------------------------------------------------
# DuckDB forms of the two derivations (oracle side). Decimal literals are
# written as doubles (1.1e0) and sums cast to BIGINT so both engines agree.
# ---------------------------------------------------------------------------
_LINES_SQL = """
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN lineitem l ON l.l_orderkey = o.o_orderkey
  JOIN supplier s ON s.s_suppkey = l.l_suppkey
  GROUP BY o.o_orderkey, o.o_orderdate, o.o_orderpriority, c.c_nationkey, c.c_mktsegment
  HAVING min(s.s_nationkey) FILTER (WHERE s.s_nationkey <> c.c_nationkey) IS NOT NULL
"""

CONTEST_SQL = """
contest_raw AS (
  SELECT o.o_orderkey AS match_id,
         CAST(o.o_orderdate AS TIMESTAMP) AS ts,
         CAST(year(o.o_orderdate) AS INTEGER) AS season,
         c.c_mktsegment AS pool,
         CAST(c.c_nationkey AS INTEGER) AS home,
         CAST(min(s.s_nationkey) FILTER (WHERE s.s_nationkey <> c.c_nationkey) AS INTEGER) AS away,
         CAST(count(*) FILTER (WHERE l.l_returnflag = 'A') AS INTEGER) AS hg,
         CAST(count(*) FILTER (WHERE l.l_returnflag = 'R') AS INTEGER) AS ag,
         CAST(count(*) FILTER (WHERE l.l_linestatus = 'O') AS INTEGER) AS hs,
         CAST(count(*) FILTER (WHERE l.l_linestatus = 'F') AS INTEGER) AS as_,
         CAST(count(*) FILTER (WHERE l.l_linestatus = 'O' AND l.l_returnflag = 'N') AS INTEGER) AS hst,
         CAST(count(*) FILTER (WHERE l.l_linestatus = 'F' AND l.l_returnflag = 'N') AS INTEGER) AS ast_,
         CASE WHEN o.o_orderpriority = '5-LOW' THEN NULL ELSE
           CAST(coalesce(sum(CAST(round(l.l_discount * 100) AS INTEGER)) FILTER (WHERE l.l_returnflag = 'A'), 0) AS BIGINT) / 100.0e0 END AS xg_h,
         CASE WHEN o.o_orderpriority = '5-LOW' THEN NULL ELSE
           CAST(coalesce(sum(CAST(round(l.l_discount * 100) AS INTEGER)) FILTER (WHERE l.l_returnflag = 'R'), 0) AS BIGINT) / 100.0e0 END AS xg_a,
         CASE WHEN c.c_mktsegment = 'HOUSEHOLD' THEN NULL ELSE
           1.1e0 + (CAST(sum(CAST(l.l_quantity AS INTEGER)) AS BIGINT) % 40) / 10.0e0 END AS odd_h,
         CASE WHEN c.c_mktsegment = 'HOUSEHOLD' THEN NULL ELSE
           1.1e0 + (CAST(sum(l.l_linenumber) AS BIGINT) % 40) / 10.0e0 END AS odd_d,
         CASE WHEN c.c_mktsegment = 'HOUSEHOLD' THEN NULL ELSE
           1.1e0 + (CAST(sum(l.l_partkey) AS BIGINT) % 40) / 10.0e0 END AS odd_a,
         CASE WHEN o.o_orderpriority = '3-MEDIUM' THEN NULL ELSE CAST(count(*) FILTER (WHERE l.l_linenumber <= 2) AS INTEGER) END AS hc,
         CASE WHEN o.o_orderpriority = '3-MEDIUM' THEN NULL ELSE CAST(count(*) FILTER (WHERE l.l_linenumber > 4) AS INTEGER) END AS ac,
         CAST(CAST(sum(l.l_linenumber) AS BIGINT) % 13 AS INTEGER) AS hf, CAST(CAST(sum(l.l_partkey) AS BIGINT) % 13 AS INTEGER) AS af,
         CAST(CAST(coalesce(sum(CAST(round(l.l_tax * 100) AS INTEGER)) FILTER (WHERE l.l_returnflag = 'A'), 0) AS BIGINT) % 4 AS INTEGER) AS hy,
         CAST(CAST(coalesce(sum(CAST(round(l.l_tax * 100) AS INTEGER)) FILTER (WHERE l.l_returnflag = 'R'), 0) AS BIGINT) % 4 AS INTEGER) AS ay,
         CASE WHEN CAST(coalesce(sum(CAST(round(l.l_tax * 100) AS INTEGER)) FILTER (WHERE l.l_returnflag = 'A'), 0) AS BIGINT) % 5 = 0 THEN 1 ELSE 0 END AS hr,
         CASE WHEN CAST(coalesce(sum(CAST(round(l.l_tax * 100) AS INTEGER)) FILTER (WHERE l.l_returnflag = 'R'), 0) AS BIGINT) % 5 = 0 THEN 1 ELSE 0 END AS ar,
         CASE WHEN c.c_mktsegment = 'MACHINERY' THEN NULL ELSE 1.2e0 + (CAST(sum(l.l_partkey) AS BIGINT) % 30) / 10.0e0 END AS avg_h,
         CASE WHEN c.c_mktsegment = 'MACHINERY' THEN NULL WHEN CAST(sum(l.l_linenumber) AS BIGINT) % 9 = 0 THEN 0.0e0
              WHEN CAST(sum(l.l_linenumber) AS BIGINT) % 9 = 1 THEN -2.0e0 ELSE 1.2e0 + (CAST(sum(l.l_linenumber) AS BIGINT) % 30) / 10.0e0 END AS avg_d,
         CASE WHEN c.c_mktsegment = 'MACHINERY' THEN NULL ELSE 1.2e0 + (CAST(sum(CAST(l.l_quantity AS INTEGER)) AS BIGINT) % 30) / 10.0e0 END AS avg_a
""" + _LINES_SQL + """),
contest AS (
  SELECT match_id, ts, season, pool, home, away, hg, ag,
         CASE WHEN hg > ag THEN 'H' WHEN hg < ag THEN 'A' ELSE 'D' END AS ftr,
         hs, as_, hst, ast_, xg_h, xg_a, odd_h, odd_d, odd_a, hc, ac, hf, af, hy, ay, hr, ar, avg_h, avg_d, avg_a
  FROM contest_raw
)"""

ENRICH_SQL = """
enrich_raw AS (
  SELECT o.o_orderkey AS src_id, c.c_mktsegment AS pool,
         CAST(o.o_orderdate AS TIMESTAMP) AS ts,
         CAST(c.c_nationkey AS INTEGER) AS home,
         CAST(min(s.s_nationkey) FILTER (WHERE s.s_nationkey <> c.c_nationkey) AS INTEGER) AS away,
         o.o_orderpriority AS prio,
         CAST(coalesce(sum(CAST(round(l.l_tax * 100) AS INTEGER)) FILTER (WHERE l.l_returnflag = 'A'), 0) AS BIGINT) AS th,
         CAST(coalesce(sum(CAST(round(l.l_tax * 100) AS INTEGER)) FILTER (WHERE l.l_returnflag = 'R'), 0) AS BIGINT) AS ta,
         CAST(coalesce(sum(l.l_linenumber) FILTER (WHERE l.l_returnflag = 'A'), 0) AS BIGINT) AS att_h,
         CAST(coalesce(sum(l.l_linenumber) FILTER (WHERE l.l_returnflag = 'R'), 0) AS BIGINT) AS att_a,
         count(*) FILTER (WHERE l.l_returnflag = 'N' AND l.l_linestatus = 'O') AS def_h,
         count(*) FILTER (WHERE l.l_returnflag = 'N' AND l.l_linestatus = 'F') AS def_a,
         count(*) FILTER (WHERE l.l_linenumber <= 2) AS deep_h,
         count(*) FILTER (WHERE l.l_linenumber > 4) AS deep_a,
         CAST(sum(l.l_linenumber) AS BIGINT) AS n,
         CAST(sum(l.l_partkey) AS BIGINT) AS p,
         count(*) FILTER (WHERE l.l_returnflag = 'A') AS fa,
         count(*) FILTER (WHERE l.l_returnflag = 'N') AS fn,
         count(*) FILTER (WHERE l.l_returnflag = 'R') AS fr,
         count(*) AS nl
""" + _LINES_SQL + """),
enrich AS (
  SELECT src_id, pool, ts, home, away,
         CASE WHEN prio = '1-URGENT' THEN NULL ELSE th / 100.0e0 END AS npxg_h,
         CASE WHEN prio = '1-URGENT' THEN NULL ELSE ta / 100.0e0 END AS npxg_a,
         CASE WHEN prio = '2-HIGH' THEN NULL WHEN def_h > 0 THEN att_h / CAST(def_h AS DOUBLE) ELSE 0.0e0 END AS ppda_h,
         CASE WHEN prio = '2-HIGH' THEN NULL WHEN def_a > 0 THEN att_a / CAST(def_a AS DOUBLE) ELSE 0.0e0 END AS ppda_a,
         CAST(deep_h AS DOUBLE) AS deep_h, CAST(deep_a AS DOUBLE) AS deep_a,
         (n % 7) / 2.0e0 AS xpts_h, (p % 7) / 2.0e0 AS xpts_a,
         CASE WHEN prio = '4-NOT SPECIFIED' THEN NULL ELSE fa / CAST(nl AS DOUBLE) END AS fc_w,
         CASE WHEN prio = '4-NOT SPECIFIED' THEN NULL ELSE fn / CAST(nl AS DOUBLE) END AS fc_d,
         CASE WHEN prio = '4-NOT SPECIFIED' THEN NULL ELSE fr / CAST(nl AS DOUBLE) END AS fc_l
  FROM enrich_raw
)"""


def team_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider spelling of each entity: lower-case nation name, except regions 'A*'."""
    n = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    r = read_table(spark, sf_dir, "region", "r_regionkey", "r_name")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").alias("k"), F.lower("n_name").alias("provider_title"), F.col("n_name"),
        F.col("r_name"))


def feed_name_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider -> house spelling, known only for regions whose name starts with 'A'."""
    t = team_titles(spark, sf_dir)
    return t.where(F.col("r_name").startswith("A")).select(
        F.col("provider_title").alias("from_name"), F.col("n_name").alias("to_name"))


def feed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested provider documents derived from the contest and enrichment views.

    One JSON document per (pool, day, match-id block of 100,000), holding a
    ``matches`` list and a ``teams`` map whose ``history`` lists carry each
    team's per-match statistics, numbers as text. Unplayed contests
    (``isResult`` false), malformed xG ("n/a"), absent forecast objects,
    absent keys inside objects all occur, so every flatten rule is exercised.
    Documents stay small at any scale (bounded by the id block).

    Line items are aggregated once for both views, and a document's contests are collected once, as plain
    numbers; its objects and texts are made of them in the row.
    """
    stats = stored(order_stats(spark, sf_dir))
    c = contest_view(spark, sf_dir, stats)
    e = enrichment_view(spark, sf_dir, stats)
    t = team_titles(spark, sf_dir).select("k", "provider_title")
    m = c.join(e.drop("pool", "ts", "home", "away"), c.match_id == e.src_id)
    m = (m.join(t.select(F.col("k").alias("hk"), F.col("provider_title").alias("h_title")), m.home == F.col("hk"))
          .join(t.select(F.col("k").alias("ak"), F.col("provider_title").alias("a_title")), m.away == F.col("ak")))
    doc_id = F.concat_ws("/", F.col("pool"), F.date_format("ts", "yyyy-MM-dd"),
                         F.floor(F.col("match_id") / 100000).cast("string"))
    played = ~((F.col("hg") == F.col("ag")) & (F.col("hs") == F.col("as_")))
    contest = F.struct("match_id", "ts", "home", "away", "h_title", "a_title", played.alias("played"), "xg_h", "xg_a", "fc_w", "fc_d", "fc_l",
                       *[f"{x}_{s}" for s in "ha" for x in ("ppda", "deep", "xpts", "npxg")])
    docs = m.select(doc_id.alias("doc_id"), contest.alias("r")).groupBy("doc_id").agg(F.collect_list("r").alias("rows"))

    def txt(c):
        return c.cast("string")

    def match_obj(r):
        return F.struct(
            r["played"].alias("isResult"),
            F.date_format(r["ts"], "yyyy-MM-dd HH:mm:ss").alias("datetime"),
            F.struct(r["h_title"].alias("title")).alias("h"),
            F.struct(r["a_title"].alias("title")).alias("a"),
            F.struct(F.coalesce(txt(r["xg_h"]), F.lit("n/a")).alias("h"),
                     F.coalesce(txt(r["xg_a"]), F.lit("n/a")).alias("a")).alias("xG"),
            F.when(r["fc_w"].isNotNull(), F.struct(
                txt(r["fc_w"]).alias("w"), F.when(r["fc_d"] != 0, txt(r["fc_d"])).alias("d"),
                txt(r["fc_l"]).alias("l"))).alias("forecast"))

    def entry(r, team, s):
        e = F.struct(
            F.date_format(r["ts"], "yyyy-MM-dd").alias("date"),
            F.when(r[f"ppda_{s}"].isNotNull(), F.struct(
                txt(r[f"ppda_{s}"]).alias("att"),
                F.when(r[f"deep_{s}"] != 0, F.lit("1")).alias("def"))).alias("ppda"),
            txt(r[f"xpts_{s}"]).alias("xpts"), txt(r[f"npxg_{s}"]).alias("npxG"),
            txt(r[f"deep_{s}"]).alias("deep"))
        return F.struct(txt(r[team]).alias("k"), r[f"{s}_title"].alias("title"), r["match_id"].alias("match_id"), e.alias("e"))

    objects = F.array_sort(F.transform("rows", lambda r: F.struct(r["match_id"].alias("match_id"), match_obj(r).alias("o"))))
    sides = F.array_sort(F.flatten(F.transform("rows", lambda r: F.array(entry(r, "home", "h"), entry(r, "away", "a")))))
    docs = docs.select("doc_id", F.transform(objects, lambda x: x["o"]).alias("matches"), sides.alias("sides"))
    names = F.array_distinct(F.transform("sides", lambda x: F.struct(x["k"].alias("k"), x["title"].alias("title"))))

    def history(n):
        own = F.filter("sides", lambda x: (x["k"] == n["k"]) & x["title"].eqNullSafe(n["title"]))
        return F.transform(own, lambda x: x["e"])

    teams = F.map_from_entries(F.transform(names, lambda n: F.struct(
        n["k"].alias("k"), F.struct(n["title"].alias("title"), history(n).alias("history")).alias("v"))))
    docs = docs.select("doc_id", "matches", teams.alias("teams"))
    return docs.select("doc_id", F.to_json(F.struct("matches", "teams")).alias("doc"))
