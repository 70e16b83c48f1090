"""Outcome encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's.
POINTS_WIN, POINTS_DRAW, POINTS_LOSS = 3, 1, 0
OUTCOME_LABELS = {"H": "Home Win", "D": "Draw", "A": "Away Win"}


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def points(ftr: Column | str, side: str) -> Column:
    """League points for one side; an unknown outcome gives 0 to both."""
    win = "H" if side == "h" else "A"
    r = _c(ftr)
    return (F.when(r == win, POINTS_WIN).when(r == "D", POINTS_DRAW)
            .otherwise(POINTS_LOSS).cast("int"))


def elo_score(ftr: Column | str, side: str) -> Column:
    """Elo actual score: win 1, loss 0, anything else (draw or unknown) 0.5."""
    r = _c(ftr)
    win, loss = ("H", "A") if side == "h" else ("A", "H")
    return F.when(r == win, 1.0).when(r == loss, 0.0).otherwise(0.5)


def home_won(ftr: Column | str) -> Column:
    return (_c(ftr) == "H").cast("int")


def drawn(ftr: Column | str) -> Column:
    return (_c(ftr) == "D").cast("int")


def decode_outcome(code: Column | str) -> Column:
    """Outcome code -> label text; unknown codes pass through."""
    m = F.create_map(*[x for k, v in OUTCOME_LABELS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[_c(code)], _c(code))
