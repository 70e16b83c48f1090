"""Rolling pre-contest form over the last ``w`` entries of an entity.

Every metric follows the reference's three cases: an empty frame gives 0; a
frame whose values of a measured statistic are all missing gives that
metric's fallback; otherwise the mean of the non-missing values. ``avg``
skips NULL, which is exactly "mean of the values that are present".

Frames are ``ROWS BETWEEN w PRECEDING AND 1 PRECEDING`` in the entity's order,
inside ``partitionBy(keys, _range)`` with a halo (see ``sequence``): the
current row never sees itself, so no result leaks into its own features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequence import ORDER, in_ranges, with_halo

# Fixed fallback values that must equal the reference's.
FALLBACK_PPDA = 10.0
FALLBACK_DEEP = 5.0
FALLBACK_XPTS_AHEAD = 1.3
FALLBACK_XPTS_ELSE = 1.0
FALLBACK_FORECAST = 0.33

ALL_METRICS = (
    "form_points", "avg_scored", "avg_conceded", "avg_shots", "avg_shots_on_target",
    "avg_corners", "avg_fouls", "avg_yellows", "avg_reds", "clean_sheet_pct", "scoring_pct",
    "avg_goal_diff", "shot_conversion", "xg_proxy", "streak", "avg_real_xg", "avg_real_xga",
    "avg_xg_overperf", "avg_npxg", "avg_ppda", "avg_deep", "avg_xpts", "avg_forecast_win",
    "avg_forecast_draw", "avg_forecast_loss",
)
MULTI_WINDOW_METRICS = ("form_points", "avg_real_xg", "avg_ppda")
VENUE_METRICS = ("form_points", "avg_scored", "avg_conceded", "xg_proxy")

_MEASURED = ("xg", "xga", "xg_op", "npxg", "ppda", "deep", "xpts", "fw", "fd", "fl")

# base window aggregates, by name
_BASE: dict[str, Callable[[], Column]] = {
    "n": lambda: F.count(F.lit(1)),
    "s_pts": lambda: F.sum("points"),
    "a_sc": lambda: F.avg("scored"), "c_sc": lambda: F.count("scored"),
    "s_sc": lambda: F.sum("scored"),
    "a_co": lambda: F.avg("conceded"), "c_co": lambda: F.count("conceded"),
    "a_shots": lambda: F.avg("shots"), "s_sot": lambda: F.sum("sot"),
    "a_corners": lambda: F.avg("corners"), "a_fouls": lambda: F.avg("fouls"),
    "a_yellows": lambda: F.avg("yellows"), "a_reds": lambda: F.avg("reds"),
    "a_cs": lambda: F.avg("clean_sheet"), "a_sa": lambda: F.avg("scored_any"),
    "a_gd": lambda: F.avg("goal_diff"), "c_gd": lambda: F.count("goal_diff"),
    "codes": lambda: F.collect_list("res"),
    **{f"a_{m}": (lambda m=m: F.avg(m)) for m in _MEASURED},
    **{f"c_{m}": (lambda m=m: F.count(m)) for m in _MEASURED},
}


# the entry column that a base aggregate reads, where its name doesn't end in it
_READS = {"n": None, "s_pts": "points", "codes": "res", **{f"{p}_{short}": c for short, c in (
    ("sc", "scored"), ("co", "conceded"), ("cs", "clean_sheet"), ("sa", "scored_any"), ("gd", "goal_diff")) for p in "acs"}}


class _Deps:
    """Records which base aggregates a set of metrics reads."""

    def __init__(self, suffix: str):
        self.suffix, self.used = suffix, []

    def __call__(self, name: str) -> Column:
        if name not in self.used:
            self.used.append(name)
        return F.col(f"_b_{name}{self.suffix}")


def _metric_exprs(b: _Deps) -> dict[str, Callable[[], Column]]:
    n = lambda: b("n")
    empty = lambda: n() == 0

    def guarded_mean(a, c):
        # a NULL goal makes the reference mean NaN: emit NULL when any is missing
        return F.when(empty(), F.lit(0.0)).when(b(c) < n(), F.lit(None)).otherwise(b(a))

    def plain_mean(a):
        return F.when(empty(), F.lit(0.0)).otherwise(b(a))

    def conv_raw():
        return F.when(b("s_sot") > 0,
                      F.when(b("c_sc") < n(), F.lit(None)).otherwise(b("s_sc") / b("s_sot"))) \
            .otherwise(F.lit(0.0))

    def proxy_raw():
        return (b("s_sot") / n()) * conv_raw()

    def real(a, c, fallback):
        return F.when(empty(), F.lit(0.0)).when(b(c) > 0, b(a)).otherwise(fallback)

    def real_xg_raw():
        return F.when(b("c_xg") > 0, b("a_xg")).otherwise(proxy_raw())

    def real_xga_raw():
        return F.when(b("c_xga") > 0, b("a_xga")).otherwise(proxy_raw())

    def streak():
        rev = F.reverse(b("codes"))
        first = F.element_at(rev, 1)
        pos = F.array_position(F.transform(rev, lambda x: x != first), True)
        run = F.when(pos == 0, F.size(rev)).otherwise(pos - 1)
        return F.when(empty(), F.lit(0)).when(first == 0, F.lit(0)).otherwise(first * run).cast("int")

    return {
        "form_points": lambda: F.when(empty(), F.lit(0)).otherwise(b("s_pts")).cast("int"),
        "avg_scored": lambda: guarded_mean("a_sc", "c_sc"),
        "avg_conceded": lambda: guarded_mean("a_co", "c_co"),
        "avg_shots": lambda: plain_mean("a_shots"),
        "avg_shots_on_target": lambda: F.when(empty(), F.lit(0.0)).otherwise(b("s_sot") / n()),
        "avg_corners": lambda: plain_mean("a_corners"),
        "avg_fouls": lambda: plain_mean("a_fouls"),
        "avg_yellows": lambda: plain_mean("a_yellows"),
        "avg_reds": lambda: plain_mean("a_reds"),
        "clean_sheet_pct": lambda: plain_mean("a_cs"),
        "scoring_pct": lambda: plain_mean("a_sa"),
        "avg_goal_diff": lambda: guarded_mean("a_gd", "c_gd"),
        "shot_conversion": lambda: F.when(empty(), F.lit(0.0)).otherwise(conv_raw()),
        "xg_proxy": lambda: F.when(empty(), F.lit(0.0)).otherwise(proxy_raw()),
        "streak": streak,
        "avg_real_xg": lambda: F.when(empty(), F.lit(0.0)).otherwise(real_xg_raw()),
        "avg_real_xga": lambda: F.when(empty(), F.lit(0.0)).otherwise(real_xga_raw()),
        "avg_xg_overperf": lambda: real("a_xg_op", "c_xg_op", F.lit(0.0)),
        "avg_npxg": lambda: real("a_npxg", "c_npxg", real_xg_raw()),
        "avg_ppda": lambda: real("a_ppda", "c_ppda", F.lit(FALLBACK_PPDA)),
        "avg_deep": lambda: real("a_deep", "c_deep", F.lit(FALLBACK_DEEP)),
        "avg_xpts": lambda: real("a_xpts", "c_xpts",
                                 F.when(real_xg_raw() > real_xga_raw(), F.lit(FALLBACK_XPTS_AHEAD))
                                 .otherwise(F.lit(FALLBACK_XPTS_ELSE))),
        "avg_forecast_win": lambda: real("a_fw", "c_fw", F.lit(FALLBACK_FORECAST)),
        "avg_forecast_draw": lambda: real("a_fd", "c_fd", F.lit(FALLBACK_FORECAST)),
        "avg_forecast_loss": lambda: real("a_fl", "c_fl", F.lit(FALLBACK_FORECAST)),
    }


def read_columns(metrics: Iterable[str]) -> list[str]:
    """Entry columns that the metrics are made of; ranges written for them need hold no others."""
    deps = _Deps("")
    exprs = _metric_exprs(deps)
    for m in metrics:
        exprs[m]()
    return sorted({c for d in deps.used if (c := _READS.get(d, d.partition("_")[2]))})


def rolling_columns(windows: dict[int, Iterable[str]], keys: Sequence[str],
                    name: Callable[[str, int], str] | None = None
                    ) -> tuple[list[Column], list[Column], list[str]]:
    """Window aggregates, derived metric columns and helper names to drop.

    ``windows`` maps a frame length to the metrics wanted over it.
    """
    name = name or (lambda m, w: m)
    base_cols, derived, helpers = [], [], []
    for w, metrics in windows.items():
        suffix = f"_{w}"
        deps = _Deps(suffix)
        exprs = _metric_exprs(deps)
        derived += [exprs[m]().alias(name(m, w)) for m in metrics]
        frame = Window.partitionBy(*keys, "_range").orderBy(*ORDER).rowsBetween(-w, -1)
        for d in deps.used:
            base_cols.append(_BASE[d]().over(frame).alias(f"_b_{d}{suffix}"))
            helpers.append(f"_b_{d}{suffix}")
    return base_cols, derived, helpers


def rolling(tm: DataFrame, windows: dict[int, Iterable[str]], keys: Sequence[str] = ("pool", "team"),
            name: Callable[[str, int], str] | None = None) -> DataFrame:
    """Add rolling metrics of the earlier rows of ``keys`` groups, by ranges with a halo."""
    keys = list(keys)
    c = with_halo(in_ranges(tm, keys, counted=True), [(keys, max(windows))])
    base_cols, derived, helpers = rolling_columns(windows, keys, name=name)
    out = c.select("*", *base_cols).where(~F.col("_halo"))
    return out.select("*", *derived).drop(*helpers, "_range", "_halo")
