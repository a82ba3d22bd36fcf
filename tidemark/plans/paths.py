"""Intermediate columns of a day's path: distributions, sequences and the dynamics of ticks and minutes."""

from __future__ import annotations

from tidemark.plans.columns import V, csum, ratio
from tidemark.plans.feature import Columns
from tidemark.plans.ticks import BY_DAY, IN_DAY, WHOLE_DAY, T
from tidemark.plans.wide import D, over, slope


def corr(x: str, y: str, least: int, otherwise: str = "0.0") -> str:
    """Pearson's correlation of the rows that have both, where there are enough of them and both vary."""
    both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    n, sx, sy, sxy, sxx, syy = (f"sum(CASE WHEN {both} THEN {v} END)" for v in ("1.0", f"1.0 * {x}", f"1.0 * {y}", f"1.0 * {x} * {y}", f"1.0 * {x} * {x}", f"1.0 * {y} * {y}"))
    vx, vy = f"({n} * {sxx} - {sx} * {sx})", f"({n} * {syy} - {sy} * {sy})"
    return f"CASE WHEN {n} >= {least} AND {vx} > 0.0000000001 * {n} * {sxx} AND {vy} > 0.0000000001 * {n} * {syy} THEN ({n} * {sxy} - {sx} * {sy}) / sqrt({vx} * {vy}) ELSE {otherwise} END"


def slots(width: int, count: int, what: str) -> list[str]:
    """A sum for each of so many equal slots of the day; earlier and later ticks count to the first and the last."""
    at = f"greatest(0, least({count - 1}, floor((sec - 32400) / {width})))"
    return [f"sum(CASE WHEN {at} = {k} THEN {what} ELSE 0 END)" for k in range(count)]


#: Ticks with gaps, running deviations, runs of buying that does not fall, and what came within the next minute.
X_SQL = f"""SELECT *, sec - lag(sec) {IN_DAY} AS gap, abs(dp) / (pp + 0.0000000001) AS ar, cum_pq / cum_q AS rv, lag(cum_pq / cum_q) {IN_DAY} AS rv1, min(sec) OVER {D} AS t0, max(sec) OVER {D} AS t1, QUANTILE(q, 0.95) OVER {D} AS q95, QUANTILE(q, 0.9) OVER {D} AS q90,
       first_value(p) {IN_DAY} AS open, avg(1.0 * q) OVER {D} AS mean_q, buy - sell AS nf, sum(buy - sell) OVER (PARTITION BY StockId, Date ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ofi,
       max_by(p, pos) OVER (PARTITION BY StockId, Date ORDER BY sec RANGE BETWEEN 1 FOLLOWING AND 60 FOLLOWING) AS later, CASE WHEN f = 1 AND dp >= 0 THEN 1 ELSE 0 END AS push, CASE WHEN f = 1 AND coalesce(dp, 0) >= 0 THEN 1 ELSE 0 END AS push0,
       count(*) OVER (PARTITION BY StockId, Date, sec) AS in_second, max(p) OVER (PARTITION BY StockId, Date, sec) - min(p) OVER (PARTITION BY StockId, Date, sec) AS second_range, sum(q) OVER (PARTITION BY StockId, Date, p) AS at_price,
       CASE WHEN f = 1 AND sec <= 36000 THEN 1 WHEN f = 1 AND sec >= 45000 THEN 2 ELSE 0 END AS part, CASE WHEN pp < 10 THEN 0.01 WHEN pp < 50 THEN 0.05 WHEN pp < 100 THEN 0.1 WHEN pp < 500 THEN 0.5 WHEN pp < 1000 THEN 1.0 ELSE 5.0 END AS step FROM t"""
SO_FAR = "OVER (PARTITION BY StockId, Date ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
PUSH, PUSH0 = "CASE WHEN f = 1 AND dp >= 0 THEN 1 ELSE 0 END", "CASE WHEN f = 1 AND coalesce(dp, 0) >= 0 THEN 1 ELSE 0 END"
#: For Spark, what has one order shares one pass: first all along the day, then by second, by part and by price.
X = (
    "x",
    f"""SELECT *, sec - lag(sec) {IN_DAY} AS gap, abs(dp) / (pp + 0.0000000001) AS ar, lag(abs(dp) / (pp + 0.0000000001)) {IN_DAY} AS ar1, cum_pq / cum_q AS rv, lag(cum_pq / cum_q) {IN_DAY} AS rv1, min(sec) OVER {WHOLE_DAY} AS t0, max(sec) OVER {WHOLE_DAY} AS t1,
       QUANTILE(q, 0.95) OVER {WHOLE_DAY} AS q95, QUANTILE(q, 0.9) OVER {WHOLE_DAY} AS q90, QUANTILE(ask - bid, 0.5) OVER {WHOLE_DAY} AS spread50, QUANTILE(ref, 0.5) OVER {WHOLE_DAY} AS ref50, first_value(p) {IN_DAY} AS open, buy - sell AS nf, sum(buy - sell) {SO_FAR} AS ofi,
       {PUSH} AS push, {PUSH0} AS push0, lead({PUSH}) {IN_DAY} AS push_next, lead({PUSH0}) {IN_DAY} AS push0_next, sum(q * {PUSH}) {SO_FAR} AS pushed, sum(q * {PUSH0}) {SO_FAR} AS pushed0,
       CASE WHEN f = 1 AND sec <= 36000 THEN 1 WHEN f = 1 AND sec >= 45000 THEN 2 ELSE 0 END AS part, CASE WHEN pp < 10 THEN 0.01 WHEN pp < 50 THEN 0.05 WHEN pp < 100 THEN 0.1 WHEN pp < 500 THEN 0.5 WHEN pp < 1000 THEN 1.0 ELSE 5.0 END AS step FROM t""",
    X_SQL,
)
BY_SECOND = "OVER (PARTITION BY StockId, Date ORDER BY sec)"
#: One tick of each second stands for it: a count of distinct seconds would write every tick once more and group by second what is summed by day.
OF_SECOND = f"CASE WHEN sec IS DISTINCT FROM lag(sec) {BY_SECOND} THEN 1 ELSE 0 END AS of_second"


def seconds(condition: str = "") -> str:
    """How many seconds of the rows' group have a tick, of those for which the condition is true."""
    return f"count(CASE WHEN of_second = 1 AND sec IS NOT NULL{condition and f' AND {condition}'} THEN 1 END)"


#: What was pushed in a run, at its last tick: the sum so far less that at the tick before the run, which is none's.
RUNS = (
    "y",
    "SELECT *, " + ", ".join(f"CASE WHEN coalesce(push{k}_next, 0) = 0 THEN pushed{k} - coalesce(last_value(CASE WHEN push{k} = 0 THEN pushed{k} END IGNORE NULLS) {SO_FAR}, 0) END AS run_q{k}" for k in ("", "0")) + " FROM x",
    f"SELECT *, lag(ar) {IN_DAY} AS ar1, sum(1 - push) OVER w AS streak, sum(1 - push0) OVER w AS streak0, row_number() OVER (PARTITION BY StockId, Date, part ORDER BY q, pos) AS i, count(*) OVER (PARTITION BY StockId, Date, part) AS of_part FROM x WINDOW w AS (PARTITION BY StockId, Date ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
)
_PEERS = "OVER (PARTITION BY StockId, Date ORDER BY sec RANGE BETWEEN CURRENT ROW AND CURRENT ROW)"
_PART = "(PARTITION BY StockId, Date, part ORDER BY q, pos"
SUMS = (
    "u",
    f"""SELECT *, sum(q) OVER (PARTITION BY StockId, Date, p) AS at_price FROM (
          SELECT *, row_number() OVER {_PART}) AS i, count(*) OVER {_PART} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS of_part FROM (
            SELECT *, max_by(p, pos) OVER (PARTITION BY StockId, Date ORDER BY sec RANGE BETWEEN 1 FOLLOWING AND 60 FOLLOWING) AS later, {OF_SECOND}, count(*) {_PEERS} AS in_second, max(p) {_PEERS} - min(p) {_PEERS} AS second_range FROM y) AS by_second) AS by_part""",
    "SELECT *, sum(q * push) OVER (PARTITION BY StockId, Date, streak) AS run_q, sum(q * push0) OVER (PARTITION BY StockId, Date, streak0) AS run_q0 FROM y",
)
#: The largest trade of the 20 days before.
TOP20 = ("top", f"SELECT StockId, Date, coalesce(max(m) {over(20, '1 PRECEDING')}, 0) AS top20 FROM (SELECT StockId, Date, max(q) AS m FROM {{ticks}} {BY_DAY}) AS own")
ALL = ("v", "SELECT u.*, top20 FROM u JOIN top ON u.StockId = top.StockId AND u.Date = top.Date")

M2, M3, M4 = (f"(sum(q * power(p - vwap, {k})) / {V})" for k in (2, 3, 4))
EARLY, LATE = "sec < t0 + (t1 - t0) * 0.8", "sec >= t0 + (t1 - t0) * 0.8"
UP, DOWN = "avg(CASE WHEN dp / pp > 0.00000001 THEN 1.0 * least(gap, 300) END)", "avg(CASE WHEN dp / pp < -0.00000001 THEN 1.0 * least(gap, 300) END)"
HALF_HOURS, LARGE_SLOTS = slots(1800, 9, "q"), slots(1620, 10, "CASE WHEN q >= greatest(q90, 1) THEN 1 ELSE 0 END")
LARGE = "count(CASE WHEN q >= greatest(q90, 1) THEN 1 END)"
SHOCKED = "count(CASE WHEN q >= q95 AND f <> 2 AND later IS NOT NULL AND (f = 1 AND later < p OR f = 0 AND later > p) THEN 1 END)"
GINI = {k: f"coalesce(sum(CASE WHEN part = {k} THEN (2.0 * i - of_part - 1) * q END) / nullif(max(CASE WHEN part = {k} THEN of_part END) * sum(CASE WHEN part = {k} THEN q END), 0), 0.0)" for k in (1, 2)}
TAIL = "CASE WHEN sec >= 46800 THEN sec - 46800 END"


def mutual() -> str:
    """Mutual information of the direction of a tick's price and the class of its size, from its nine counts."""
    ways, sizes = ("coalesce(dp, 0) < 0", "coalesce(dp, 0) = 0", "coalesce(dp, 0) > 0"), ("q <= 2", "q > 2 AND q <= 10", "q > 10")
    count = lambda c: f"count(CASE WHEN {c} THEN 1 END)"
    return " + ".join(f"coalesce({count(f'{a} AND {b}')} * 1.0 / count(*) * ln(nullif({count(f'{a} AND {b}')}, 0) * 1.0 * count(*) / ({count(a)} * 1.0 * {count(b)})), 0.0)" for a in ways for b in sizes)


TICK_PATHS = Columns("raw_tick_path_columns", "distributions, runs and responses along a day's ticks", (T, X, RUNS, SUMS, TOP20, ALL), (
    ("raw_price_bimodality", f"CASE WHEN count(*) >= 10 AND {M2} >= 0.000000000001 THEN ({M3} * {M3} / ({M2} * {M2} * {M2}) + 1) / ({M4} / ({M2} * {M2}) + 0.0000000001) END"),
    ("raw_collapse_direction", f"CASE WHEN count(*) >= 10 AND count(CASE WHEN {EARLY} THEN 1 END) >= 5 AND count(CASE WHEN {LATE} THEN 1 END) >= 3 THEN {csum(LATE, 'p * q')} / {csum(LATE)} / ({csum(EARLY, 'p * q')} / {csum(EARLY)}) - 1 END"),
    ("raw_belief_shock", f"CASE WHEN count(*) >= 20 THEN {SHOCKED} * 1.0 / nullif(count(CASE WHEN q >= q95 AND f <> 2 AND later IS NOT NULL THEN 1 END), 0) END"),
    ("raw_volume_acceleration", f"CASE WHEN count(*) >= 20 AND {' + '.join(f'CASE WHEN {s} > 0 THEN 1 ELSE 0 END' for s in HALF_HOURS)} >= 3 AND {V} >= 9 THEN ({HALF_HOURS[8]} - {HALF_HOURS[7]} - {HALF_HOURS[6]} + {HALF_HOURS[5]}) / 2.0 / ({V} / 9.0) END"),
    ("raw_price_return_asymmetry", f"CASE WHEN count(*) >= 20 AND count(CASE WHEN dp / pp > 0.00000001 THEN 1 END) >= 5 AND count(CASE WHEN dp / pp < -0.00000001 THEN 1 END) >= 5 AND {DOWN} >= 0.01 AND {UP} > 0 THEN ln({UP} / ({DOWN} + 0.0000000001)) END"),
    ("raw_order_flow_momentum", f"CASE WHEN count(*) >= 20 AND count({TAIL}) >= 10 AND max({TAIL}) > min({TAIL}) THEN ({slope(f'({TAIL})', 'ofi', 10)}) / {V} * 1800 END"),
    ("raw_intraday_reversal_depth", "CASE WHEN count(*) >= 10 AND max(p) > min(p) THEN (max(p) - min(p)) / min(p) * CASE WHEN min(CASE WHEN p = low THEN sec END) < min(CASE WHEN p = high THEN sec END) THEN 1 ELSE -1 END END"),
    ("raw_large_trade_timing", f"CASE WHEN count(*) >= 20 AND {LARGE} >= 3 THEN ({' + '.join(f'power({s}, 2)' for s in LARGE_SLOTS)}) / (1.0 * {LARGE} * {LARGE}) END"),
    ("raw_intraday_volatility_clustering", f"CASE WHEN count(*) >= 30 THEN {corr('ar1', 'ar', 19, 'NULL')} END"),
    ("raw_eth_nonadiabatic_entropy_rate", f"{csum('abs(rv - rv1) / rv1 > 0.001')} * 1.0 / {V}"), ("raw_eth_active_translational_dissipation", f"{csum('abs(dp) >= 2 * step - 0.00001')} * 1.0 / {V}"),
    ("raw_flu_instanton_escape_likelihood", f"max(run_q) * 1.0 / {V}"), ("raw_qit_lyapunov_ballistic_duration", "max(run_q0)"),
    ("raw_flu_detailed_balance_breaking", f"{csum('p >= ref * 0.99 AND p <= ref * 1.01', 'buy')} / ({csum('p >= ref * 0.99 AND p <= ref * 1.01', 'sell')} + 1.0)"),
    ("raw_dpt_surprisal_derivative", csum("sec >= 45000 AND q > 0.8 * top20 AND top20 > 0")), ("raw_qit_subadditivity_entropy_gap", f"CASE WHEN count(*) >= 5 THEN {mutual()} ELSE 0.0 END"),
    ("raw_qit_quantum_zeno_freezing", f"{seconds('in_second >= 3 AND second_range = 0')} * 1.0 / {seconds()}", "count(DISTINCT CASE WHEN in_second >= 3 AND second_range = 0 THEN sec END) * 1.0 / count(DISTINCT sec)"), ("raw_qit_majorization_deficit", f"{GINI[2]} - {GINI[1]}"),
    ("raw_qit_arnold_web_resonance", f"max(at_price) * 1.0 / {V}"), ("raw_mode_share", f"max(at_price) * 1.0 / {V}"), ("raw_qit_virasoro_worldsheet_area", f"coalesce(sum((p - low + coalesce(pp, p) - low) / 2 * q) / nullif({V} * (max(p) - min(p)), 0), 0.0)"),
    ("raw_mhd_magnetic_helicity", "CASE WHEN count(*) >= 30 THEN coalesce(sum(ofi * tanh(10 * coalesce(dp, 0.0))) / nullif(1.0 * count(*) * max(abs(ofi)), 0), 0.0) END"), ("raw_pvg_negative_temperature_corr", corr("abs(p - open)", "nf", 30)),
    ("raw_tick_spread_median", "max(spread50)", "QUANTILE(ask - bid, 0.5)"), ("raw_spread_compression", "max(spread50) / max(ref50)", "QUANTILE(ask - bid, 0.5) / QUANTILE(ref, 0.5)"),
), "v")

#: Minutes of a day with their neighbours.
_MINUTE = f"""SELECT StockId, Date, floor(sec / 60) AS minute, min_by(p, pos) AS first, max_by(p, pos) AS last, avg(p) AS mean, coalesce(stddev_samp(p), 0.0) AS dev, sum(q) AS vol, sum(buy) AS buy, max(p) AS high, min(p) AS low, count(DISTINCT sec) AS secs,
       sum(ask - bid) AS spread, max_by(cum_pq / cum_q, pos) AS rv, max(vwap) AS vwap, max(tot) AS tot, count(CASE WHEN q > 3 * mean_q THEN 1 END) AS bursts FROM (SELECT *, avg(1.0 * q) OVER {D} AS mean_q FROM t) AS k GROUP BY StockId, Date, floor(sec / 60)"""
MINUTE = ("m", _MINUTE.replace("count(DISTINCT sec)", seconds()).replace(f"(SELECT *, avg(1.0 * q) OVER {D}", f"(SELECT *, {OF_SECOND}, avg(1.0 * q) OVER (PARTITION BY StockId, Date ORDER BY sec ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", 1), _MINUTE)
AT = "OVER (PARTITION BY StockId, Date ORDER BY minute)"
NEXT = ("k", f"SELECT *, lag(last) {AT} AS prev, coalesce(last / nullif(lag(last) {AT}, 0) - 1, 0.0) AS ret, last / nullif(lag(last) {AT}, 0) - 1 AS chg, greatest(lead(last, 1) {AT}, lead(last, 2) {AT}, lead(last, 3) {AT}) AS best3, lag(vol) {AT} AS vol1, max(mean) OVER {D} AS top, min(mean) OVER {D} AS bottom, row_number() OVER (PARTITION BY StockId, Date ORDER BY round(dev * vol, 6), minute) AS calm, avg(1.0 * vol) OVER {D} AS mean_vol FROM m")
LAGS = ("n", f"SELECT *, lag(ret) {AT} AS ret1, lag(chg) {AT} AS chg1, lag(abs(ret)) {AT} AS ra1 FROM k")
MINUTE_PATHS = Columns("raw_minute_path_columns", "returns, volumes and echoes of minutes", (T, MINUTE, NEXT, LAGS), (
    ("raw_eth_adiabatic_maintenance", f"{csum('mean >= bottom + 0.9 * (top - bottom) AND dev <= (top - bottom) * 0.05', 'vol')} * 1.0 / sum(vol)"), ("raw_eth_limit_cycle_dissipation", f"greatest(0.0, -({corr('ret1', 'ret', 2)})) * sum(vol)"),
    ("raw_att_min_entropy_deviation", "abs(max_by(last, minute) - max(CASE WHEN calm = 1 THEN mean END)) / max(CASE WHEN calm = 1 THEN mean END)"),
    ("raw_att_phase_space_contraction", "coalesce(avg(CASE WHEN minute >= 750 THEN spread END), 0.0) / (coalesce(avg(CASE WHEN minute < 600 THEN spread END), 0.0) + 0.00000001)"),
    ("raw_dpt_nonreciprocal_interaction", f"CASE WHEN count(vol1) >= 10 THEN {corr('vol1', 'abs(ret)', 2)} ELSE 0.0 END - CASE WHEN count(vol1) >= 10 THEN {corr('ra1', 'vol', 2)} ELSE 0.0 END"),
    ("raw_mac_temperature_mobility", "coalesce(avg(CASE WHEN minute >= 750 THEN (high - low) / (vol + 1) END), 0.0) / (avg(dev) + 0.00000001)"), ("raw_qit_otoc_scrambling_rate", f"CASE WHEN count(*) >= 5 THEN {corr('chg1', 'chg', 2)} ELSE 0.0 END"),
    ("raw_qit_gravito_magnetic_induction", "max(1.0 * buy / secs * (last - vwap) / vwap)"), ("raw_qit_gie_entanglement_witness", corr("vol", "((last - rv) / rv)", 5)),
    ("raw_qit_decoherence_spin_echo", "count(CASE WHEN (last - first) / first < -0.005 AND best3 > first THEN 1 END)"), ("raw_burst_freq", "count(CASE WHEN bursts >= 2 THEN 1 END)"),
), "n")


def parts(width: int) -> tuple[tuple[str, str], ...]:
    """The last prices of equal parts of the day, with the one before and the thirds they lie in."""
    return (
        ("c", f"SELECT StockId, Date, greatest(0, floor((sec - 32400) / {width})) AS part, max_by(p, pos) AS last FROM t GROUP BY StockId, Date, greatest(0, floor((sec - 32400) / {width}))"),
        ("th", f"SELECT *, QUANTILE(last, 0.33) OVER {D} AS q33, QUANTILE(last, 0.67) OVER {D} AS q67, coalesce(last / nullif(lag(last) OVER (PARTITION BY StockId, Date ORDER BY part), 0) - 1, 0.0) AS ret FROM c"),
        ("st", "SELECT *, CASE WHEN last <= q33 THEN 0 WHEN last > q67 THEN 2 ELSE 1 END AS state FROM th"),
        ("tr", "SELECT *, lag(state) OVER (PARTITION BY StockId, Date ORDER BY part) AS state1 FROM st"),
    )


FIVE_MINUTES = Columns("raw_five_minute_columns", "states of five-minute closes", (T, *parts(300)), (("raw_att_attractor_transition_rate", "count(CASE WHEN state <> state1 THEN 1 END) * 1.0 / count(*)"),), "tr")
NINE_MINUTES = Columns("raw_nine_minute_columns", "returns of nine-minute closes", (T, *parts(540)), (("raw_flu_tur_bound_saturation", "power(sum(ret), 2) / (coalesce(var_samp(ret), 0.0) + 0.00000001)"),), "tr")

TABLES = (TICK_PATHS, MINUTE_PATHS, FIVE_MINUTES, NINE_MINUTES)
