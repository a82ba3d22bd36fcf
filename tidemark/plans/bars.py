"""Bars of a day by volume, by value and by number of ticks. A bar's return is that to the bar before; the first has none and counts as zero."""

from __future__ import annotations

from tidemark.plans.columns import csum
from tidemark.plans.feature import Columns
from tidemark.plans.ticks import T
from tidemark.plans.wide import D

AT = "OVER (PARTITION BY StockId, Date ORDER BY bin)"


def bars(by: str) -> tuple[tuple[str, str], ...]:
    return (
        ("bins", f"""SELECT StockId, Date, {by} AS bin, max_by(p, pos) AS last, sum(q) AS vol, sum(buy) AS buy, sum(sell) AS sell, sum(p * q) / nullif(sum(q), 0) AS mean, 1.0 * (max_by(sec, pos) - min_by(sec, pos)) AS lasted, count(*) AS ticks, max(q) AS most, max(tot) AS tot, max(sum_pq) AS sum_pq
                 FROM t GROUP BY StockId, Date, {by}"""),
        ("r", f"SELECT *, coalesce(last / nullif(lag(last) {AT}, 0) - 1, 0.0) AS ret, last - lag(last) {AT} AS moved, row_number() {AT} - 1 AS i, count(*) OVER {D} AS bars, 1.0 * (buy - sell) AS ofi FROM bins"),
    )


def skewed(x: str) -> str:
    """The skew corrected for bias, 0 where nothing varies or there are fewer than three, by the sums of powers about the mean."""
    n, m2, m3 = "count(*)", f"sum(power({x}_c, 2)) / count(*)", f"sum(power({x}_c, 3)) / count(*)"
    return f"CASE WHEN {n} >= 3 AND {m2} > 0.00000000000001 THEN sqrt(1.0 * {n} * ({n} - 1)) / ({n} - 2) * ({m3}) / power({m2}, 1.5) ELSE 0.0 END"


def fitted(x: str, y: str) -> tuple[str, str]:
    """Slope of a line through the points, and the square of their correlation (null where one does not vary)."""
    n, sx, sy, sxy, sxx, syy = "count(*)", f"sum(1.0 * {x})", f"sum({y})", f"sum({x} * {y})", f"sum(1.0 * {x} * {x})", f"sum({y} * {y})"
    vx, vy, cov = f"({n} * {sxx} - {sx} * {sx})", f"({n} * {syy} - {sy} * {sy})", f"({n} * {sxy} - {sx} * {sy})"
    return f"{cov} / nullif({vx}, 0)", f"CASE WHEN {vx} > 0 AND {vy} > 0.000000000001 * {n} * {syy} THEN {cov} * {cov} / ({vx} * {vy}) END"


VWAP = "(max(sum_pq) * 1000 / (max(tot) * 1000 + 0.00001))"
EXTREME = "ret >= high5 OR ret <= low5"
VOLUME_BARS = Columns("raw_volume_bar_columns", "bars of 500 lots", (T, *bars("floor(cum_q / 500)"), ("k", f"SELECT *, QUANTILE(ret, 0.05) OVER {D} AS low5, QUANTILE(ret, 0.95) OVER {D} AS high5, ofi - avg(ofi) OVER {D} AS ofi_c FROM r")), (
    ("raw_ofi_skew", skewed("ofi")), ("raw_vwap_trend", f"CASE WHEN count(*) > 2 THEN {fitted('i', 'mean')[0]} / (avg(mean) + 0.00000001) ELSE 0.0 END"),
    ("raw_vb_large_domination", "avg(CASE WHEN most / (vol + 0.00001) > 0.3 THEN 1.0 ELSE 0.0 END)"), ("raw_vb_sell_intensity_var", "coalesce(var_samp(sell), 0.0)"), ("raw_vb_pinning_prob", "avg(CASE WHEN ret = 0 THEN 1.0 ELSE 0.0 END)"),
    ("raw_vb_ofi_vol", "coalesce(stddev_samp(ofi), 0.0)"), ("raw_vb_vwap_twap_dev", f"{VWAP} / (avg(last) + 0.00001) - 1"), ("raw_vb_close_vwap_dev", f"max_by(last, bin) / ({VWAP} + 0.00001) - 1"),
    ("raw_vb_ext_dur_ratio", f"CASE WHEN max(bars) > 10 THEN coalesce(avg(CASE WHEN {EXTREME} THEN lasted END) / (avg(CASE WHEN NOT ({EXTREME}) THEN lasted END) + 0.00001), 0.0) ELSE 0.0 END"),
    ("raw_vb_trade_dispersion", "coalesce(stddev_samp(ticks) / (avg(ticks) + 0.00001), 0.0)"), ("raw_vb_absorption_ratio", f"{csum('ret = 0', 'vol')} / (max(tot) + 0.00001)"),
), "k")

DOLLAR_BARS = Columns("raw_dollar_bar_columns", "bars of 30 million", (T, *bars("floor(cum_pq * 1000 / 30000000)"), ("k", f"SELECT *, 1.0 / (lasted + 0.00001) AS speed, sum(vol) OVER (PARTITION BY StockId, Date ORDER BY bin ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS vol5 FROM r"), ("e", f"SELECT *, QUANTILE(speed, 0.9) OVER {D} AS fast FROM k")), (
    ("raw_db_trend_r2", f"CASE WHEN count(*) > 5 THEN coalesce({fitted('i', 'last')[1]}, 0.0) ELSE 0.0 END"), ("raw_db_vpin", "abs(sum(buy) - sum(sell)) / (sum(buy) + sum(sell) + 0.00001)"), ("raw_db_downside_dev", "coalesce(sqrt(avg(CASE WHEN ret < 0 THEN ret * ret END)), 0.0)"),
    ("raw_db_peak_vel_ratio", "max(vol5) / (avg(vol) + 0.00001)"), ("raw_db_high_vel_vol", "CASE WHEN max(bars) > 10 THEN sum(CASE WHEN speed >= fast THEN abs(ret) ELSE 0.0 END) ELSE 0.0 END"),
), "e")
LARGER_BARS = Columns("raw_larger_bar_columns", "bars of 50 million", (T, *bars("floor(cum_pq * 1000 / 50000000)")), (("raw_dbar_vol", "coalesce(stddev_samp(ret), 0.0)"),), "r")

#: Runs of rising bars as islands; blocks of ten bars.
RISING = "CASE WHEN ret > 0 THEN 1 ELSE 0 END"
TICK_BARS = Columns("raw_tick_bar_columns", "bars of 50 ticks", (
    T, *bars("floor(pos / 50)"), ("k", f"SELECT *, i - row_number() OVER (PARTITION BY StockId, Date, {RISING} ORDER BY bin) AS island, sign(moved) AS s, lag(sign(moved)) {AT} AS s1, CASE WHEN i % 10 = 9 OR i = bars - 1 THEN sum(ret) OVER (PARTITION BY StockId, Date, floor(i / 10)) END AS block FROM r"),
    ("e", f"SELECT *, count(*) OVER (PARTITION BY StockId, Date, island, {RISING}) AS run FROM k")), (
    ("raw_tkb_var_ratio", "CASE WHEN max(bars) > 10 AND var_samp(ret) > 0 THEN coalesce(var_samp(block) / 10 / var_samp(ret), 0.0) ELSE 0.0 END"), ("raw_tkb_run_length", "max(CASE WHEN ret > 0 THEN run ELSE 0 END)"),
    ("raw_tkb_reversal_freq", "coalesce(1.0 * count(CASE WHEN s <> coalesce(s1, 2) THEN 1 END) / nullif(count(s), 0), 0.0)"), ("raw_total_vol_50bin", "sum(CASE WHEN ticks = 50 THEN vol ELSE 0 END)"),
), "e")

TABLES = (VOLUME_BARS, DOLLAR_BARS, LARGER_BARS, TICK_BARS)
