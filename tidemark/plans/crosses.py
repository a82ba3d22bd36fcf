"""Features of ticks with daily bars."""

from __future__ import annotations

from tidemark.plans.feature import Feature
from tidemark.plans.ticks import BY_DAY, IN_DAY, T, c5


def cross(name: str, description: str, queries: tuple, steps: tuple) -> Feature:
    return Feature(name, "cross_tick_daily", description, (T, *queries), steps, ("ticks", "daily"))


def joined(columns: str) -> tuple[str, str]:
    return ("j", f"SELECT a.StockId, a.Date, {columns} FROM {{daily}} AS a LEFT JOIN d ON a.StockId = d.StockId AND a.Date = d.Date")


Z20, ROLL42 = (("z", "zscore", "x", 20),), (("z", "zscore", "x", 42, 5, 1e-9),)
#: Full bins of 50 ticks: what is left over at the end of a day is in none.
BINS = ("bin", "SELECT StockId, Date, floor(pos / 50) AS bin, max_by(p, pos) AS last, min_by(p, pos) AS first, max(p) AS high, min(p) AS low, sum(q) AS vol, sum(sell) AS sell, sum(p * q) / sum(q) AS vwap FROM t WHERE pos < floor(n / 50) * 50 GROUP BY StockId, Date, floor(pos / 50)")

FEATURES = [
    cross("f_afd_storm_relative_helicity", "mean price off the vwap times five days' return", (
        ("d", f"SELECT StockId, Date, avg(p) - sum(p * q) / sum(q) AS off FROM t {BY_DAY}"), joined("off, ret_pct")), (
        ("s", "rolling_sum", "ret_pct", 5, 5), ("y", "sql", "off * coalesce(s, 0.0)"), ("x", "sql", "abs(y) * sign(y)"), ("z", "zscore", "x", 42, 21, 1e-10), *c5("z"))),
    cross("f_be_salience_misallocation", "the widest bin for its volume", (
        BINS, ("m", "SELECT *, avg(vol) OVER (PARTITION BY StockId, Date) AS mean_vol FROM bin"),
        ("d", f"SELECT StockId, Date, max((high - low) / (first + 0.00000001) / (vol / (mean_vol + 0.00000001) + 0.00000001)) AS x FROM m {BY_DAY}"), joined("x")), (("e", "ewm", "x", 5), ("z", "zscore", "e", 20), *c5("z"))),
    cross("f_be_task_confidence_contagion", "small buys at the open after a good day and a gap down", (
        ("d", f"SELECT StockId, Date, 1.0 * sum(CASE WHEN pos < 500 AND q <= 1 THEN buy ELSE 0 END) AS small FROM t {BY_DAY}"), joined("open, close, coalesce(small, 0.0) AS small")), (
        ("r", "pct_change", "close"), ("r1", "shift", "r"), ("before", "shift", "close"),
        ("x", "sql", "CASE WHEN r1 > 0.05 AND open < 0.98 * before THEN small ELSE 0.0 END"), *Z20, *c5("z"))),
    cross("f_cumulative_dose_exhaustion", "days of rise and their volume over active selling", (
        ("d", f"SELECT StockId, Date, 1.0 * sum(sell) AS sold FROM t {BY_DAY}"),
        ("u", """SELECT a.StockId, a.Date, volume_k * 1000 AS vol, sold, CASE WHEN close > lag(close) OVER (PARTITION BY a.StockId ORDER BY a.Date) THEN 1 ELSE 0 END AS up
              FROM {daily} AS a LEFT JOIN d ON a.StockId = d.StockId AND a.Date = d.Date"""),
        ("g", "SELECT *, sum(1 - up) OVER (PARTITION BY StockId ORDER BY Date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM u"),
        ("j", """SELECT StockId, Date, sold, up * sum(up) OVER w AS days, CASE WHEN up = 1 THEN sum(up * vol) OVER w / nullif(sum(up) OVER w, 0) ELSE 0.0 END AS mean_vol
              FROM g WINDOW w AS (PARTITION BY StockId, run ORDER BY Date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")), (
        ("x", "sql", "days * mean_vol / (sold + 0.00000001)"), *ROLL42, *c5("z"))),
    cross("f_gt_excuse_driven_risk_taking", "the most sold in a wide bin below the open", (
        BINS, ("o", "SELECT bin.*, open FROM bin JOIN {daily} AS a ON bin.StockId = a.StockId AND bin.Date = a.Date"),
        ("d", f"SELECT StockId, Date, max(CASE WHEN vwap < 0.98 * open THEN (high - low) / (first + 0.00000001) * sell ELSE 0.0 END) AS most FROM o {BY_DAY}"), joined("coalesce(most, 0.0) AS x")), (*Z20, *c5("z"))),
    cross("f_limit_cycle_exhaustion_trap", "crossings of the vwap times volume, over the day's move", (
        ("v", "SELECT StockId, Date, pos, q, CASE WHEN p >= vwap THEN 1 ELSE 0 END AS above FROM t"),
        ("c", f"SELECT StockId, Date, q, CASE WHEN above <> coalesce(lag(above) {IN_DAY}, 0) THEN 1 ELSE 0 END AS crossed FROM v"),
        ("d", f"SELECT StockId, Date, 1.0 * sum(crossed) AS crossings, 1.0 * sum(q) AS vol FROM c {BY_DAY}"), joined("open, close, coalesce(crossings, 0.0) AS crossings, vol")), (
        ("x", "sql", "ln(1 + crossings * vol / (abs(close - open) / (open + 0.00000001) + 0.00000001))"), *ROLL42, *c5("z"))),
    cross("f_shifting_habitat_patch_deficit", "the vwap's distance from the open over the volume near the modal price", (
        ("v", f"SELECT StockId, Date, p, sum(q) AS vol FROM t GROUP BY StockId, Date, p"),
        ("h", "SELECT *, first_value(p) OVER (PARTITION BY StockId, Date ORDER BY vol DESC, p) AS modal, sum(vol) OVER (PARTITION BY StockId, Date) AS tot FROM v"),
        ("d", f"SELECT StockId, Date, 1.0 * sum(CASE WHEN p >= modal * 0.995 AND p <= modal * 1.005 THEN vol ELSE 0 END) / max(tot) AS patch, sum(p * vol) / sum(vol) AS vwap FROM h {BY_DAY}"),
        joined("(vwap - open) / nullif(open, 0) / (patch + 0.00000001) AS x")), (*ROLL42, *c5("z"))),
]
