"""The transforms of a daily series that no feature uses, each on a column of the daily bars."""

from __future__ import annotations

from tidemark.plans.daily import D
from tidemark.plans.feature import Feature


def transform(name: str, description: str, *steps: tuple) -> Feature:
    return Feature(name, "transform", description, (D,), steps, ("daily",))


FEATURES = [
    transform("t_rolling_min", "least close of 20 days", ("x", "rolling_min", "close", 20, 5)),
    transform("t_rolling_median", "median close of 20 days", ("x", "rolling_quantile", "close", 20, 10, 0.5)),
    transform("t_rolling_quantile", "a fifth of 20 days' volumes are below", ("x", "rolling_quantile", "volume_k", 20, 10, 0.2)),
    transform("t_rolling_skew", "skew of 20 days' returns", ("x", "rolling_skew", "ret_pct", 20, 10)),
    transform("t_rolling_corr", "correlation of return and volume over 20 days", ("x", "rolling_corr", "ret_pct", "volume_k", 20, 5)),
    transform("t_rolling_slope", "slope of 5 days' closes, a day late", ("s", "rolling_slope", "close", 5), ("x", "shift", "s")),
    transform("t_rolling_slope_20", "slope of 20 days' volumes", ("x", "rolling_slope", "volume_k", 20)),
    transform("t_zscore_transform", "z-score of the volume within 3 deviations", ("x", "zscore_transform", "volume_k", 20)),
    transform("t_mad_zscore", "distance of the volume from its median in median distances", ("med", "rolling_quantile", "volume_k", 20, 5, 0.5), ("x", "mad_zscore", "volume_k", "med", 20, 5)),
    transform("t_pct_change_zscore", "z-score of the change over five days", ("r", "pct_change", "close", 5), ("x", "zscore_population", "r", 42, 10)),
    transform("t_rank_by_date", "rank of the volume among the date's stocks", ("x", "rank_by_date", "volume_k")),
]
