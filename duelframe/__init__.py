"""duelframe: leakage-free pre-contest features for two-sided contest tables on Spark.

A contest table has one row per contest: ``match_id, ts, season, pool, home,
away, hg, ag, ftr`` plus optional per-side statistics. Every operator is a
``DataFrame -> DataFrame`` function built from Spark windows, aggregations,
joins and (for Elo) one ordered stateful fold.
"""

__all__ = ["schema"]
