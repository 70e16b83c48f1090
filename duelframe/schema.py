"""Canonical column names of a contest table and its per-side counterpart.

Sources map their own names (season CSV headers, feed fields, driver tables)
onto these once; every operator downstream reads only canonical names.
"""

from __future__ import annotations

from pyspark.sql import types as T

# identity / order
MATCH_ID, TS, SEASON, POOL, HOME, AWAY = "match_id", "ts", "season", "pool", "home", "away"
ORDER = (TS, MATCH_ID)  # total order of contests inside a pool

# result
HG, AG, FTR = "hg", "ag", "ftr"

# optional count statistics, home/away mirror (null or absent -> 0)
COUNT_STATS = {
    "shots": ("hs", "as_"),
    "sot": ("hst", "ast_"),
    "corners": ("hc", "ac"),
    "fouls": ("hf", "af"),
    "yellows": ("hy", "ay"),
    "reds": ("hr", "ar"),
}

# optional enrichment statistics (null kept)
XG = ("xg_h", "xg_a")
ENRICH_SIDE = {
    "npxg": ("npxg_h", "npxg_a"),
    "ppda": ("ppda_h", "ppda_a"),
    "deep": ("deep_h", "deep_a"),
    "xpts": ("xpts_h", "xpts_a"),
}
FORECAST = ("fc_w", "fc_d", "fc_l")

# optional odds, two books
ODDS_BOOKS = {
    "b365": ("odd_h", "odd_d", "odd_a"),
    "avg": ("avg_h", "avg_d", "avg_a"),
}

OPTIONAL_TYPES: dict[str, T.DataType] = {
    **{c: T.IntegerType() for pair in COUNT_STATS.values() for c in pair},
    **{c: T.DoubleType() for c in XG},
    **{c: T.DoubleType() for pair in ENRICH_SIDE.values() for c in pair},
    **{c: T.DoubleType() for c in FORECAST},
    **{c: T.DoubleType() for book in ODDS_BOOKS.values() for c in book},
}

REQUIRED = (MATCH_ID, TS, SEASON, POOL, HOME, AWAY, HG, AG, FTR)
