"""Features of daily bars."""

from __future__ import annotations

from tidemark.plans.feature import Feature
from tidemark.plans.ticks import c0, c5

D = ("d", "SELECT * FROM {daily}")


def daily(name: str, description: str, steps: tuple) -> Feature:
    return Feature(name, "single_stock_daily", description, (D,), steps, ("daily",))


RANGE = (("before", "shift", "close"), ("tr", "sql", "greatest(high - low, coalesce(abs(high - before), high - low), coalesce(abs(low - before), high - low))"))

FEATURES = [
    daily("f_alpha_accel", "change of the change of the daily return", (
        ("r", "pct_change", "close"), ("d1", "diff", "r"), ("d2", "diff", "d1"), ("x", "filled", "d2"), ("z", "zscore", "x", 20, 1), *c0("z"))),
    daily("f_be_asymmetric_confidence_spillover", "day trading against its mean after falls", (
        ("dt", "sql", "coalesce(daytrade_pct, 0.0) / 100"), ("dt_mean", "rolling_mean", "dt", 20, 5), ("r3", "pct_change", "close", 3),
        ("x", "sql", "dt / (dt_mean + 0.00001) * CASE WHEN r3 < -0.03 THEN 1 ELSE 0 END"), ("z", "zscore", "x", 20), *c5("z"))),
    daily("f_be_frustration_driven_turnover", "turnover on days of a new high that close below the open", (
        ("top", "rolling_max", "high", 20, 20), ("top_before", "shift", "top"),
        ("x", "sql", "CASE WHEN high > top_before AND close < open THEN volume_k / (shares_out_k + 0.00001) ELSE 0.0 END"), ("z", "zscore", "x", 20), *c5("z"))),
    daily("f_chip_large_holder_pct", "share of large holders, as last published", (("x", "ffill", "holder_gt1000_pct"), *c0("x"))),
    daily("f_turnover_rate", "volume over shares", (("x", "sql", "volume_k / nullif(shares_out_k, 0)"), ("y", "ffill", "x"), *c0("y"))),
    daily("f_value_composite", "valuation against its own past", (
        ("a", "zscore", "pe", 120, 20), ("b", "zscore", "pb", 120, 20), ("c", "zscore", "ps", 120, 20), ("e", "zscore", "div_yield", 120, 20),
        ("x", "sql", "-0.30 * a - 0.25 * b - 0.25 * c + 0.20 * e"), ("y", "ffill", "x"), *c5("y"))),
    daily("f_vol_cv", "variation of volume", (
        ("s", "rolling_std", "volume_k", 20, 20), ("m", "rolling_mean", "volume_k", 20, 20), ("x", "sql", "s / (m + 0.000000001)"), ("y", "ffill", "x"), ("filled_", "filled", "y"), ("value", "clipped", "filled_", 0.0, 10.0))),
    daily("f_contraction_tension", "long range over short range, by volume", (
        *RANGE, ("atr5", "rolling_mean", "tr", 5, 1), ("atr60", "rolling_mean", "tr", 60, 1), ("m", "rolling_mean", "volume_k", 60, 20),
        ("x", "sql", "atr60 / (atr5 + 0.00000001) * ln(1 + greatest(volume_k / (m + 0.00000001), 0))"), ("filled_", "filled", "x"), ("value", "clipped", "filled_", 0.0, 50.0))),
]
