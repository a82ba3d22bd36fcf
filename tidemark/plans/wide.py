"""More intermediate columns of a stock and day: daily bars, broker fills, ticks and what joins them.

Each table is one plan over its inputs, so that its columns cost one scan together.
"""

from __future__ import annotations

from tidemark.plans.brokers import B
from tidemark.plans.columns import V, csum, ratio
from tidemark.plans.feature import Columns
from tidemark.plans.ladder import CENTS
from tidemark.plans.ticks import BY_DAY, IN_DAY, T

S = "PARTITION BY StockId ORDER BY Date"
D = "(PARTITION BY StockId, Date)"


def over(w: int | None, upto: str = "CURRENT ROW") -> str:
    """The stock's last w days up to today, or up to another day; None: all of them."""
    return f"OVER ({S} ROWS BETWEEN {'UNBOUNDED' if w is None else w - (upto == 'CURRENT ROW')} PRECEDING AND {upto})"


def roll(f: str, x: str, w: int, m: int | None = None, upto: str = "CURRENT ROW") -> str:
    return f"CASE WHEN count({x}) {over(w, upto)} >= {w if m is None else m} THEN {f}({x}) {over(w, upto)} END"


def z(x: str, w: int, m: int, eps: str = "0.000000001") -> str:
    return f"CASE WHEN count({x}) {over(w)} >= {m} THEN ({x} - avg({x}) {over(w)}) / (stddev_samp({x}) {over(w)} + {eps}) END"


def before(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({S})"


def change(x: str, k: int = 1) -> str:
    return f"{x} / nullif({before(x, k)}, 0) - 1"


def ffill(x: str) -> str:
    return f"last_value({x} IGNORE NULLS) {over(None)}"


def share(condition: str, what: str, of: str) -> str:
    return ratio(csum(condition, what), of)


YESTERDAY = "1 PRECEDING"

DAILY_COLUMNS = Columns("raw_daily_columns", "returns, ranges, volumes and balances of daily bars", (
    ("a", f"SELECT *, {before('close')} AS prev, {ffill('short_balance_k')} AS short_bal, {ffill('lending_short_k')} AS lent, {ffill('margin_balance_k')} AS margin, {ffill('holder_gt1000_pct')} AS large, {ffill('rev_m1_k')} AS rev1, {ffill('rev_m13_k')} AS rev13, {ffill('holder_lt400_count')} AS small FROM {{daily}}"),
    ("k", """SELECT *, close / nullif(prev, 0) - 1 AS ret1, greatest(high - low, coalesce(abs(high - prev), high - low), coalesce(abs(low - prev), high - low)) AS tr, volume_k / (shares_out_k + 0.000000001) AS turn,
             coalesce(daytrade_pct, 0.0) / 100 AS dt, coalesce(short_bal, 0.0) + coalesce(lent, 0.0) AS shorts, coalesce(margin, 0.0) AS owed,
             coalesce(inst_foreign, 0.0) + coalesce(inst_trust, 0.0) + coalesce(inst_dealer_self, 0.0) + coalesce(inst_dealer_hedge, 0.0) AS inst FROM a""")), (
    ("_vol_ma20", roll("avg", "volume_k", 20, 10)), ("_vol_ma10", roll("avg", "volume_k", 10, 5)), ("_vol_ma20_orig", roll("avg", "volume_k", 20)), ("_vol_ma60", roll("avg", "volume_k", 60, 20)),
    ("_prev_close", "prev"), ("_ret_1d", "ret1"), ("_ret_3d", change("close", 3)), ("_ret_5d", change("close", 5)), ("_turnover_rate", "turn"), ("_dt_pct", "dt"), ("_dt_mean_20", roll("avg", "dt", 20, 5)),
    ("_short_bal", "short_bal"), ("_short_total", "shorts"), ("_short_change_5d", f"shorts - {before('shorts', 5)}"), ("_intra_ret", "(close - open) / (open + 0.000000001)"),
    ("_atr_5", roll("avg", "tr", 5, 1)), ("_atr_20", roll("avg", "tr", 20, 1)), ("_atr_60", roll("avg", "tr", 60, 1)), ("_tr_z", z("turn", 10, 5)), ("_dt_z", z("dt", 10, 5)),
    ("_inst_net", "inst"), ("_inst_net_change", f"inst - {before('inst')}"), ("_vol_20d", roll("stddev_samp", "ret1", 20, 10)), ("_sma_20", roll("avg", "close", 20, 10)),
    ("_margin_bal", "owed"), ("_margin_change_3", change("owed", 3)), ("_margin_usage", "owed / (coalesce(shares_out_k, 0.0) + 0.00000001)"), ("_large_holder_pct", "coalesce(large, 50.0) / 100"),
    ("_rev_yoy", "(rev1 - rev13) / (abs(rev13) + 0.00000001)"), ("_retail_count", "small"),
    ("raw_phy_bic_radiationless_momentum", f"coalesce(volume_k / coalesce(nullif({roll('avg', 'volume_k', 20, 1)}, 0), 1) / ((high - low) / (open + 0.000001) + 0.0001) * (close - open) / (open + 0.000001), 0.0)"),
), "k", ("daily",), False)

#: Returns of daily bars that the tick and broker crosses read beside their own columns.
DAILY_SIGNS = Columns("raw_daily_signals", "gaps, new highs and lows, earlier returns", (
    ("a", f"SELECT *, {before('close')} AS prev, {before('high')} AS prev_high, {change('close')} AS ret1, {change('close', 3)} AS ret3, {change('close', 5)} AS ret5, {before('close', 20)} AS close20 FROM {{daily}}"),
    ("k", f"SELECT *, {roll('stddev_samp', 'ret1', 20, 10)} AS vol20 FROM a")), (
    ("raw_is_dump_day", "CASE WHEN close < open THEN 1 ELSE 0 END"), ("raw_is_founder_day", f"CASE WHEN close > {roll('max', 'close', 10, 1, YESTERDAY)} THEN 1 ELSE 0 END"),
    ("raw_is_new_low_5d", f"CASE WHEN close = {roll('min', 'close', 5, 1)} THEN 1 ELSE 0 END"), ("raw_is_new_low_20d", f"CASE WHEN close = {roll('min', 'close', 20, 1)} THEN 1 ELSE 0 END"),
    ("past_success", f"CASE WHEN {before('ret5')} > 0.05 THEN 1 ELSE 0 END"), ("today_shock", "CASE WHEN open < 0.98 * prev THEN 1 ELSE 0 END"), ("price_stability", f"CASE WHEN {before('ret3')} > -0.01 THEN 1 ELSE 0 END"),
    ("vol_surge", f"CASE WHEN volume_k > 1.5 * ({roll('avg', 'volume_k', 20, 5, YESTERDAY)}) THEN 1 ELSE 0 END"),
    ("raw_ret1", "ret1"), ("raw_vol20", "vol20"), ("raw_vol20_q20", f"CASE WHEN count(vol20) {over(20)} >= 10 THEN QUANTILE(vol20, 0.2) {over(20)} END"), ("raw_high_shift1", "coalesce(prev_high, 0.0)"), ("raw_ret1_shift1", f"coalesce({before('ret1')}, 0.0)"),
    ("raw_gap_down", "CASE WHEN open < 0.98 * prev THEN 1 ELSE 0 END"), ("raw_ret5", "coalesce(ret5, 0.0)"), ("raw_screening_premium", "CASE WHEN prev_high > 0 THEN (open - prev_high) / (prev_high + 0.00000001) ELSE 0.0 END"),
    ("raw_prior_pessimism", "CASE WHEN open < 0.99 * prev THEN 1 ELSE 0 END"), ("raw_neg_mood", "CASE WHEN open < 0.97 * prev THEN 1 ELSE 0 END"), ("raw_high_prior", "CASE WHEN close / nullif(close20, 0) - 1 > 0.15 THEN 1 ELSE 0 END"),
    ("_daily_return", "ret_pct"),
), "k", ("daily",), False)

N_ACTIVE = "count(CASE WHEN net <> 0 THEN 1 END)"
FILL_COLUMNS = Columns("raw_fill_columns", "flow, entropy and round prices of broker fills", (
    ("r", f"SELECT *, BuyQtm + SellQtm AS vol, BuyQtm - SellQtm AS net, sum(BuyQtm + SellQtm) OVER {D} AS day_vol, sum(greatest(BuyQtm - SellQtm, 0)) OVER {D} AS day_pos FROM {{brokers}}"),), (
    ("raw_flow_diverg", ratio("count(CASE WHEN net > 0 THEN 1 END)", N_ACTIVE, "0.5")), ("_n_active", N_ACTIVE), ("_total_net", "sum(net)"),
    ("raw_broker_entropy", "-sum(CASE WHEN vol > 0 THEN 1.0 * vol / day_vol * ln(1.0 * vol / day_vol) ELSE 0.0 END)"),
    ("raw_mac_field_current_divergence", "sum(CASE WHEN net > 0 THEN power(1.0 * net / day_pos, 2) ELSE 0.0 END)"),
    ("raw_qit_information_causality_bound", f"coalesce((max(Price) - min(Price)) / nullif(min(Price), 0) / nullif({N_ACTIVE}, 0), 0.0)"),
    ("raw_is_focal", "count(CASE WHEN Price % 10 = 0 THEN 1 END)"), ("raw_focal_distinct_brokers", "count(DISTINCT CASE WHEN Price % 10 = 0 THEN BrokerId END)"), ("raw_focal_buy_vol", csum("Price % 10 = 0", "BuyQtm")),
), "r", ("brokers",))

#: A broker's day with what it did on the stock's days before. Days are numbered by stock; a missing day counts as none.
_HISTORY = f"""SELECT *, max(avg_buy) OVER {D} AS top_price, (sum(pq_buy) OVER {D} + sum(pq_sell) OVER {D}) / (sum(vol) OVER {D} + 0.00000001) AS vwap, sum(pq_buy) OVER {D} AS day_pq, sum(buy) OVER {D} AS day_buy, avg(1.0 * vol) OVER {D} AS mean_vol,
       QUANTILE(vol, 0.8) OVER {D} AS q80, QUANTILE(CASE WHEN net > 0 THEN vol END, 0.9) OVER {D} AS q90_buyers,
       row_number() OVER (PARTITION BY StockId, Date ORDER BY sell DESC, BrokerId) AS by_sell,
       (rank() OVER (PARTITION BY StockId, Date ORDER BY vol) + (count(*) OVER (PARTITION BY StockId, Date, vol) - 1) / 2.0) / brokers AS size_rank,
       sum(CASE WHEN net > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY StockId, BrokerId ORDER BY day RANGE BETWEEN 4 PRECEDING AND CURRENT ROW) AS bought5, sum(CASE WHEN net < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY StockId, BrokerId ORDER BY day RANGE BETWEEN 4 PRECEDING AND CURRENT ROW) AS sold5,
       sum(CASE WHEN net > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY StockId, BrokerId ORDER BY day RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS bought3, sum(net) OVER (PARTITION BY StockId, BrokerId ORDER BY day RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING) AS past10,
       CASE WHEN count(net) OVER w20 >= 5 THEN sum(net) OVER w20 END AS net20, CASE WHEN count(net) OVER w5 >= 2 THEN sum(net) OVER w5 END AS net5, CASE WHEN count(net) OVER w10 >= 3 THEN sum(net) OVER w10 END AS net10
FROM (SELECT *, dense_rank() OVER (PARTITION BY StockId ORDER BY Date) AS day FROM b) AS numbered
WINDOW w20 AS (PARTITION BY StockId, BrokerId ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), w5 AS (PARTITION BY StockId, BrokerId ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), w10 AS (PARTITION BY StockId, BrokerId ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"""
#: Broker days are dealt by stock to as many tasks as their number asks for, before they get columns: all windows here lie within a stock.
HISTORY = ("h", _HISTORY.replace("FROM b) AS numbered", "FROM (SELECT /*+ REPARTITION({parts}, StockId) */ * FROM b) AS dealt) AS numbered"), _HISTORY)
LEADERS = ("g", "SELECT *, " + ", ".join(f"CASE WHEN net{k} IS NOT NULL THEN row_number() OVER (PARTITION BY StockId, Date ORDER BY CASE WHEN net{k} IS NULL THEN 1 ELSE 0 END, net{k} DESC, BrokerId) END AS lead{k}" for k in (5, 10, 20)) + " FROM h")
WITH, AGAINST = csum("past10 * net > 0", "abs(net)"), csum("past10 * net < 0", "abs(net)")
TOPS, LOWS = csum("by_net <= 5", "net"), csum("by_net_low <= 5", "net")

BROKER_MORE = Columns("raw_broker_history_columns", "leading brokers, followers and persistence", (B, HISTORY, LEADERS), (
    ("raw_hhi_diff", f"{ratio('sum(1.0 * buy * buy)', '1.0 * sum(buy) * sum(buy)')} - {ratio('sum(1.0 * sell * sell)', '1.0 * sum(sell) * sum(sell)')}"), ("raw_retail_part", "count(*)"), ("_broker_count", "count(*)"),
    ("raw_broker_persist", ratio("(count(CASE WHEN bought5 = 5 THEN 1 END) - count(CASE WHEN sold5 = 5 THEN 1 END))", N_ACTIVE)),
    ("_conviction_buyer_ratio", share("by_buy <= 5", "buy", "sum(buy)")), ("_conviction_seller_ratio", share("by_sell <= 5", "sell", "sum(sell)")), ("_top10_net_buy_concentration", share("by_net <= 10", "net", "sum(vol)")),
    ("_loyal_inflow", csum("net > 0.1 * vol", "net")), ("_polarization_index", "CASE WHEN count(*) >= 3 THEN stddev_pop(1.0 * net / nullif(vol, 0)) END"),
    ("raw_bot80_buy_vwap", f"{csum('net > 0 AND vol <= q80', 'pq_buy')} / nullif({csum('net > 0 AND vol <= q80', 'buy')}, 0)"), ("raw_top10_buy_vwap", f"{csum('net > 0 AND vol >= q90_buyers', 'pq_buy')} / nullif({csum('net > 0 AND vol >= q90_buyers', 'buy')}, 0)"),
    ("raw_broker_herding", "abs(2.0 * count(CASE WHEN net > 0 THEN 1 END) / count(*) - 1)"),
    ("raw_consensus_fracture", f"CASE WHEN max(day) > 1 AND {N_ACTIVE} > 0 THEN coalesce(1.0 * least({WITH}, {AGAINST}) / nullif(greatest({WITH}, {AGAINST}), 0), 0.0) END"),
    ("raw_qit_topological_volume_defects", share("net > 0 AND (pq_buy - pq_sell) / net < day_pq / day_buy", "vol", "sum(vol)")), ("raw_qit_liquidity_catalysis_ratio", share("abs(net) * 1.0 / vol < 0.05 AND vol > mean_vol", "vol", "sum(vol)")),
    ("raw_qit_dilution_factor_inverse", "sum(1.0 * vol / day_vol * vol / day_vol)"),
    ("raw_net_antiferro_broker_interaction", f"CASE WHEN count(*) >= 10 THEN ({csum('by_net <= 5', 'buy')} / (sum(vol) + 0.0000000001) - {csum('by_net_low <= 5', 'sell')} / (sum(vol) + 0.0000000001)) * {TOPS} / (abs({TOPS}) + abs({LOWS}) + 0.0000000001) END"),
    ("raw_top10_low_buy", csum("by_buy <= 10 AND avg_buy <= vwap", "buy")), ("raw_top10_high_buy", csum("by_buy <= 10 AND avg_buy > vwap", "buy")), ("raw_top10_net_buy", csum("by_buy <= 10", "net")),
    ("raw_infected_net_buy", csum("bought3 = 3", "net")), ("raw_retail_vwap", f"{csum('vol > q80', 'pq_buy')} / ({csum('vol > q80', 'buy')} + 0.00000001)"),
    ("raw_rest_participation", "count(CASE WHEN by_buy > 5 AND buy > 0 THEN 1 END) / (count(*) + 0.00000001)"), ("raw_rest_vwap", f"{csum('by_buy > 1', 'pq_buy')} / ({csum('by_buy > 1', 'buy')} + 0.00000001)"),
    ("raw_pioneer_buy", csum("avg_buy = top_price", "buy")), ("raw_daily_total_buy", "sum(buy)"), ("raw_price_range_5d", "max(avg_buy) / (min(avg_buy) + 0.00000001) - 1"),
    ("raw_buyer_count", "count(CASE WHEN net > 0 THEN 1 END)"), ("raw_top10_net_sell_qtm", f"abs({csum('by_sell <= 10 AND net < 0', 'net')})"), ("raw_top5_sell", csum("by_sell <= 5", "sell")), ("raw_top5_buy", csum("by_buy <= 5", "buy")),
    ("raw_small_buyers_cnt", "count(CASE WHEN net > 0 AND size_rank <= 0.5 THEN 1 END)"), ("raw_large_sellers_cnt", "count(CASE WHEN net < 0 AND size_rank >= 0.8 THEN 1 END)"),
    ("raw_top10_total_buy", csum("by_vol <= 10", "buy")), ("raw_total_broker_vol", "sum(vol)"), ("raw_top5_net_buy_nlargest", TOPS),
    ("top5_20d_netbuy", csum("lead20 <= 5", "net")), ("top5_20d_positive_days", "count(CASE WHEN lead20 <= 5 AND net > 0 THEN 1 END)"), ("top5_5d_netbuy", csum("lead5 <= 5", "net")), ("top1_10d_netbuy", csum("lead10 = 1", "net")), ("top1_10d_incumbent_buy", csum("lead10 = 1", "buy")),
    ("NB_BuyBrokers", "count(CASE WHEN net > 0 THEN 1 END)"), ("raw_retail_net_buy", csum("by_buy > 10", "net")), ("raw_total_buy_broker", "sum(buy)"),
), "g", ("brokers",))

#: Series over days of what brokers do in a day.
DAY_NETS = ("d", f"SELECT StockId, Date, 1.0 * sum(net) AS net, 1.0 * {N_ACTIVE} AS active, 1.0 * sum(vol) AS vol, {csum('by_buy <= 5 AND net > 0', 'net')} AS top5, 1.0 * sum(buy) AS buy, 1.0 * {csum('by_buy <= 10', 'net')} AS top10 FROM b {BY_DAY}")
BROKER_SERIES = Columns("raw_broker_series", "a day's broker flows against the days before", (B, DAY_NETS), (
    ("raw_net_reversal", f"(net - ({roll('avg', 'net', 5, 1)})) / nullif({roll('stddev_samp', 'net', 20, 5)}, 0)"), ("raw_activity_surprise", f"active / nullif({roll('avg', 'active', 20, 5)}, 0)"),
    ("raw_top5_ratio", "top5 / (buy + 0.00000001)"), ("raw_vol_jump", f"coalesce(vol / ({roll('avg', 'vol', 5, 1, YESTERDAY)} + 0.00000001), 1.0)"), ("raw_sum5_top5_buy", roll("sum", "top5", 5, 1)),
), "d", ("brokers",), False)

RANKED = ("n", f"SELECT StockId, Date, {csum('by_vol <= 0.1 * brokers', 'net')} AS top10, {csum('by_vol >= 0.2 * brokers', 'net')} AS bot80, {csum('by_vol <= 5', 'net')} AS top5, {csum('by_buy <= 5', 'buy')} AS bought, {csum('by_net_sell <= 5', '-net')} AS sold, {csum('by_sold <= 5', 'sell')} AS sells FROM (SELECT *, row_number() OVER (PARTITION BY StockId, Date ORDER BY sell DESC, BrokerId) AS by_sold FROM b) AS s {BY_DAY}")
ON_BARS = (
    "j",
    f"""SELECT a.*, coalesce(1000.0 * top10 / coalesce(nullif(volume_k * 1000, 0), 1), 0.0) AS t10, coalesce(1000.0 * bot80 / coalesce(nullif(volume_k * 1000, 0), 1), 0.0) AS b80, coalesce(1000.0 * top5 / coalesce(nullif(volume_k * 1000, 0), 1), 0.0) AS t5,
       coalesce(1000.0 * bought / coalesce(nullif(volume_k * 1000, 0), 1), 0.0) AS t5_buy, coalesce(1000.0 * sells / coalesce(nullif(volume_k * 1000, 0), 1), 0.0) AS t5_sell, greatest(0.0, least(1.0, (close - low) / (high - low + 0.000001))) AS pos
FROM {{daily}} AS a LEFT JOIN n ON a.StockId = n.StockId AND a.Date = n.Date""",
)


def corr(x: str, y: str) -> str:
    """Of the last 20 days, 0 where one of them does not vary or days are fewer than five."""
    mean = lambda v: f"avg({v}) {over(20)}"
    var = lambda v: f"({mean(f'{v} * {v}')} - {mean(v)} * {mean(v)})"
    return f"CASE WHEN count(*) {over(20)} >= 5 AND {var(x)} > 0.000000000001 AND {var(y)} > 0.000000000001 THEN ({mean(f'{x} * {y}')} - {mean(x)} * {mean(y)}) / sqrt({var(x)} * {var(y)}) ELSE 0.0 END"


BROKER_DAILY = Columns("raw_broker_daily_columns", "leading brokers' flows against daily prices", (B, RANKED, ON_BARS), (
    ("raw_phy_bright_dark_mode_covariance", f"-1.0 * ({corr('t10', 'b80')}) * t10"), ("raw_phy_entanglement_generation_trajectory", f"({corr('t5', 'ret_pct')}) * t5"),
    ("raw_phy_dark_em_repulsive_force", "-1.0 * (b80 - t10) * abs(ret_pct)"), ("raw_phy_supernova_core_collapse_vector", "-1.0 * (b80 - t10) * abs(close / (coalesce(nullif(turnover_value / (volume_k * 1000 + 0.000001), 0), close) + 0.000001) - 1)"),
    ("raw_phy_multiplex_coherence_alignment", "t10 * abs(" + " + ".join(f"coalesce({change('close', k)}, 0.0) / {k}" for k in (1, 5, 10, 20)) + ")"),
    ("raw_phy_geometric_torque_scattering", f"t5 / (abs(close - {roll('max', 'high', 20, 1)}) / ({roll('max', 'high', 20, 1)} + 0.000001) + abs(close - {roll('min', 'low', 20, 1)}) / ({roll('min', 'low', 20, 1)} + 0.000001) + 0.01)"),
    ("raw_phy_interstitial_topological_stress", "t5_buy * (1 - pos) - t5_sell * pos"), ("raw_phy_geodesic_jacobi_convergence", "t5 * ret_pct"),
    ("raw_top10_net_buy_share", "t10"), ("raw_bot80_net_buy", "b80"), ("raw_top5_net_share", "t5"),
), "j", ("ticks", "daily", "brokers"), False)

#: Tick sizes against the day's own quantiles; cold: below the vwap.
SIZES = ("s", f"SELECT *, QUANTILE(q, 0.85) OVER {D} AS q85, QUANTILE(q, 0.3) OVER {D} AS q30, QUANTILE(q, 0.8) OVER {D} AS q80, QUANTILE(q, 0.75) OVER {D} AS q75, QUANTILE(q, 0.25) OVER {D} AS q25, dp - lag(dp) {IN_DAY} AS ddp, CASE WHEN p < vwap THEN row_number() OVER (PARTITION BY StockId, Date, CASE WHEN p < vwap THEN 1 ELSE 0 END ORDER BY pos) END AS cold, count(*) OVER (PARTITION BY StockId, Date, sec) AS in_second FROM t")


def slope(x: str, y: str, least: int) -> str:
    """Of a line through (x, y), 0 for fewer than `least` points."""
    n, sx, sy, sxy, sxx = (f"sum(CASE WHEN {x} IS NOT NULL THEN {v} END)" for v in ("1.0", f"1.0 * {x}", f"1.0 * {y}", f"1.0 * {x} * {y}", f"1.0 * {x} * {x}"))
    return f"CASE WHEN count({x}) >= {least} THEN ({n} * {sxy} - {sx} * {sy}) / ({n} * {sxx} - {sx} * {sx}) ELSE 0.0 END"


TICK_COLUMNS = Columns("raw_tick_columns", "volumes, prices and slopes of a day's ticks", (T, SIZES), (
    ("total_vol", V), ("buy_vol", "sum(buy)"), ("sell_vol", "sum(sell)"), ("total_value", "sum(p * q) * 1000"), ("low_pr", "min(p)"), ("tick_count", "count(*)"), ("intensity_max", "max(in_second)"), ("raw_intensity_max", "max(in_second)"),
    ("raw_prev_price", "max_by(pp, pos)"), ("raw_jump_pct", "max_by(dp / nullif(pp, 0), pos)"), ("raw_is_active_buy", "count(CASE WHEN f = 1 THEN 1 END)"), ("raw_is_fat_tail_jump", "count(CASE WHEN f = 1 AND pp > 0 AND dp / pp >= 0.003 THEN 1 END)"),
    ("raw_is_gaussian_jump", "count(CASE WHEN f = 1 AND pp > 0 AND dp > 0 AND dp / pp <= 0.001 THEN 1 END)"), ("raw_is_levy_jump", "count(CASE WHEN f = 1 AND pp > 0 AND dp / pp >= 0.003 THEN 1 END)"),
    ("raw_am_pm_div", f"{ratio(csum('sec < 36000', 'buy'), csum('sec < 36000'), '0.5')} - {ratio(csum('sec > 45000', 'buy'), csum('sec > 45000'), '0.5')}"),
    ("raw_intraday_momentum_decay", "CASE WHEN max(p) > max_by(p, pos) AND max_by(p, pos) > min(p) THEN ln((max(p) - max_by(p, pos)) / (max_by(p, pos) - min(p))) ELSE 0.0 END"),
    ("raw_tail_session_ofi", f"CASE WHEN count(CASE WHEN sec >= 46800 THEN 1 END) >= 5 THEN {ratio(csum('sec >= 46800', 'buy - sell'), csum('sec >= 46800'))} ELSE 0.0 END"),
    ("raw_cold_zone_buy", csum("p < vwap", "buy")), ("raw_cold_slope", slope("cold", "p", 6)), ("raw_tick_mean_price", "avg(p)"), ("above_vwap_buy", csum("p > vwap * 0.98", "buy")), ("above_vwap_high_buy", csum("p > vwap * 1.02", "buy")),
    ("tick_slope", slope("pos", "p", 3)), ("raw_tick_slope", slope("pos", "p", 3)), ("q85_large_buy", csum("q >= q85", "buy")), ("q85_small_buy", csum("q < q85", "buy")),
    ("raw_active_sell", "sum(sell)"), ("raw_total_active_buy", "sum(buy)"), ("raw_first500_sell_ratio", f"{csum('pos < 500', 'sell')} / ({csum('pos < 500')} + 0.00000001)"), ("raw_small_buy_ticks", "count(CASE WHEN q = 1 AND f = 1 THEN 1 END)"),
    ("raw_drag_ratio", f"avg(ask - bid) / ({V} + 0.00000001)"), ("raw_open_p", "min_by(p, pos)"), ("raw_close_p", "max_by(p, pos)"), ("raw_delta_p", "max_by(p, pos) - min_by(p, pos)"), ("raw_tick_ret", "(max_by(p, pos) - min_by(p, pos)) / (min_by(p, pos) + 0.00000001)"),
    ("raw_buy_vol", "sum(buy)"), ("raw_sell_vol", "sum(sell)"), ("raw_total_vol_tick", V), ("raw_large_buy", csum("q >= q85", "buy")), ("raw_small_buy", csum("q < q85", "buy")), ("raw_large_sell_q85", csum("q >= q85", "sell")), ("raw_small_sell", csum("q < q85", "sell")),
    ("raw_spread_mean", "avg(ask - bid)"), ("raw_a_price", "coalesce(sum(coalesce(ddp, dp, 0.0)) / count(*), 0.0)"), ("raw_p_active_up", "count(CASE WHEN f = 1 THEN 1 END) * 1.0 / count(*)"), ("raw_p_large_buy", ratio("count(CASE WHEN q >= q75 AND f = 1 THEN 1 END)", "count(CASE WHEN q >= q75 THEN 1 END)", "0.5")),
    ("raw_p_small_buy", ratio("count(CASE WHEN q <= q25 AND f = 1 THEN 1 END)", "count(CASE WHEN q <= q25 THEN 1 END)", "0.5")), ("raw_p_public_buy", "count(CASE WHEN bid > ref THEN 1 END) * 1.0 / count(*)"), ("raw_qm_tick_active_buy_ratio", ratio("sum(buy)", V, "0.5") + " - 0.5"), ("raw_tick_vwap", "max(vwap)"),
    ("Small_Thresh", "greatest(1.0, max(q30))"), ("Large_Thresh", "greatest(1.0, max(q80))"), ("vwap", "max(vwap)"),
), "s")

#: The ladder of a day's prices with what share of each was active, in the morning or late, and each broker's estimate by it.
PRICES = (
    "l",
    f"""SELECT *, coalesce(1.0 * buy / nullif(buy + sell, 0), 0.5) AS up, coalesce(1.0 * sell / nullif(buy + sell, 0), 0.5) AS down, low + 0.8 * (high - low) AS top_zone, low + 0.2 * (high - low) AS low_zone
FROM (SELECT StockId, Date, {CENTS.format('p')} AS cents, p, max(high) AS high, max(low) AS low, max(vwap) AS vwap, sum(q) AS vol, sum(buy) AS buy, sum(sell) AS sell, sum(CASE WHEN sec <= 34200 THEN q ELSE 0 END) AS early, sum(CASE WHEN sec <= 34200 THEN buy ELSE 0 END) AS early_buy,
             sum(CASE WHEN sec >= 46800 AND sec < 48300 THEN buy ELSE 0 END) AS late_buy FROM t GROUP BY StockId, Date, p) AS own""",
)
SPLIT = (
    "e",
    f"""SELECT f.StockId, f.Date, f.BrokerId, sum(f.BuyQtm) AS buy, sum(f.SellQtm) AS sell, sum(f.BuyQtm * up) AS active_buy, sum(f.BuyQtm * down) AS passive_buy, sum(f.SellQtm * down) AS active_sell, sum(f.SellQtm * up) AS passive_sell,
       sum(f.BuyQtm * 1.0 * early / l.vol) AS morning_buy, sum(f.SellQtm * 1.0 * early / l.vol) AS morning_sell, sum(f.BuyQtm * 1.0 * early_buy / l.vol) AS morning_active, sum(f.BuyQtm * 1.0 * late_buy / l.vol) AS late_active,
       sum(CASE WHEN l.p >= top_zone THEN f.BuyQtm * up ELSE 0.0 END) AS buy_high, sum(CASE WHEN l.p <= low_zone THEN f.BuyQtm * up ELSE 0.0 END) AS buy_low, sum(CASE WHEN l.p < l.vwap THEN f.BuyQtm * down ELSE 0.0 END) AS passive_below
FROM {{brokers}} AS f JOIN l ON f.StockId = l.StockId AND f.Date = l.Date AND {CENTS.format('f.Price')} = l.cents GROUP BY f.StockId, f.Date, f.BrokerId""",
)
SIZED = ("o", f"SELECT *, buy - sell AS net, buy + sell AS vol, row_number() OVER (PARTITION BY StockId, Date ORDER BY buy + sell, BrokerId) * 1.0 / count(*) OVER {D} AS rank, sum(passive_buy) OVER {D} AS day_passive, sum(active_buy) OVER {D} AS day_up, sum(active_sell) OVER {D} AS day_down FROM e")
PER = "(sum(vol) + 1)"
LADDER_COLUMNS = Columns("raw_ladder_columns", "active, passive, early and late volumes of brokers by size", (T, PRICES, SPLIT, SIZED), (
    ("r_smart_accumulation_blwVWAP", f"{csum('rank >= 0.9', 'passive_below')} / {PER}"), ("r_retail_trapped_top20", f"{csum('rank < 0.8', 'buy_high')} / {PER}"), ("r_retail_falling_knife_bot20", f"{csum('rank < 0.8', 'buy_low')} / {PER}"),
    ("r_lateday_conviction_excl", f"{csum('rank >= 0.8', 'late_active')} / {PER}"), ("r_smart_breakout_top20", f"{csum('rank >= 0.9', 'buy_high')} / {PER}"), ("r_morning_retail_sel_bot_80_pct", f"{csum('rank < 0.8', 'morning_sell')} / {PER}"),
    ("r_morning_smart_buy_top_10_pct", f"{csum('rank >= 0.9', 'morning_buy')} / {PER}"), ("r_large_psell_wall_top_5_pct_conc", f"{csum('rank >= 0.95', 'passive_sell')} / (sum(passive_sell) + 0.00001)"),
    ("r_aggressor_concentration", "sum(power(active_buy / coalesce(nullif(day_up, 0), 1), 2)) - sum(power(active_sell / coalesce(nullif(day_down, 0), 1), 2))"),
    ("f_morning_smart_active_buy", f"{csum('rank >= 0.9', 'morning_active')} / {PER}"), ("f_large_passive_sell_wall", f"{csum('rank >= 0.9', 'passive_sell')} / {PER}"), ("f_large_broker_active_buy", f"{csum('rank >= 0.9', 'active_buy')} / {PER}"),
    ("f_large_broker_passive_buying_pressure", f"{csum('rank >= 0.9', 'passive_buy')} / {PER}"), ("f_concentrated_passive_buy", "sum(power(passive_buy / coalesce(nullif(day_passive, 0), 1), 2))"),
    ("raw_top10_net_sell_ratio", f"{csum('rank >= 0.9', '-net')} * 1.0 / {PER}"), ("raw_passive_buy_vol", "sum(passive_buy)"), ("raw_top5_sell_vol", csum("rank >= 0.95", "sell")),
    ("raw_qm_large_broker_net_ratio", ratio(csum("rank >= 0.9", "active_buy - active_sell"), "sum(vol)")), ("raw_big_net_ratio", ratio(csum("rank >= 0.8", "net"), "sum(vol)")), ("raw_small_net_ratio", ratio(csum("rank < 0.8", "net"), "sum(vol)")),
), "o", ("ticks", "brokers"))

#: Small and large trades in bins of ticks, by the median of the days before of the day's quantiles.
SIZE_OF_DAY = ("sz", f"SELECT StockId, Date, greatest(1.0, coalesce(QUANTILE(a, 0.5) {over(20, YESTERDAY)}, a)) AS small, greatest(1.0, coalesce(QUANTILE(c, 0.5) {over(20, YESTERDAY)}, c)) AS large FROM (SELECT StockId, Date, QUANTILE(q, 0.3) AS a, QUANTILE(q, 0.8) AS c FROM {{ticks}} {BY_DAY}) AS own")
SMALL = ("m", "SELECT t.*, CASE WHEN q <= small THEN sell ELSE 0 END AS small_sell, CASE WHEN q <= small THEN buy ELSE 0 END AS small_buy, CASE WHEN q >= large THEN buy ELSE 0 END AS large_buy, open FROM t JOIN sz ON t.StockId = sz.StockId AND t.Date = sz.Date JOIN {daily} AS a ON t.StockId = a.StockId AND t.Date = a.Date")


def small_bins(k: int) -> str:
    return f"SELECT StockId, Date, floor(pos / {k}) AS bin, min_by(p, pos) AS first, max_by(p, pos) AS last, sum(q) AS vol, sum(small_sell) AS small_sell, sum(large_buy) AS large_buy, sum(buy) AS buy, sum(sell) AS sell, sum(p * q) / sum(q) AS vwap, max(p) - min(p) AS wide, max(open) AS open, stddev_samp(CASE WHEN small_sell > 0 THEN p END) AS sp_dev, avg(CASE WHEN small_sell > 0 THEN p END) AS sp_mean FROM m WHERE pos < floor(n / {k}) * {k} GROUP BY StockId, Date, floor(pos / {k})"


CROSS_TICKS = Columns("raw_small_trade_columns", "small and large trades of a day's first and last ticks", (T, SIZE_OF_DAY, SMALL), (
    ("raw_first500_small_buy", csum("pos < 500", "small_buy")), ("raw_last500_small_sell", csum("pos >= n - 500", "small_sell")), ("raw_push_speed", "CASE WHEN max(open) > 0 THEN (max(vwap) - max(open)) / max(open) ELSE 0.0 END"),
), "m", ("ticks", "daily"))
CROSS_50 = Columns("raw_bin50_columns", "bins of 50 ticks with small and large trades", (T, SIZE_OF_DAY, SMALL, ("bin", small_bins(50)), ("w", f"SELECT *, avg(1.0 * vol) OVER {D} AS mean_vol FROM bin")), (
    ("raw_ignorant_selling", csum("last > first", "small_sell")), ("raw_bin50_bin1_large_buy", csum("bin = 0", "large_buy")), ("raw_bin50_total_large_buy", "sum(large_buy)"),
    ("raw_salience_trap_max", "max(wide / (first + 0.00000001) / (vol / (mean_vol + 0.00000001) + 0.00000001))"), ("raw_loss_domain_vol_max", "max(CASE WHEN vwap < 0.98 * open THEN wide / (first + 0.00000001) * sell ELSE 0.0 END)"),
), "w", ("ticks", "daily"))
CROSS_100 = Columns("raw_bin100_columns", "bins of 100 ticks with small and large trades", (T, SIZE_OF_DAY, SMALL, ("bin", small_bins(100))), (
    ("raw_mood_sell", csum("last > first", "small_sell")), ("raw_instant_exit", csum("bin < 5", "small_sell")), ("raw_bin1_large_buy", csum("bin = 0", "large_buy")),
    ("raw_loss_domain_max", "max(CASE WHEN vwap < 0.98 * open THEN coalesce(sp_dev, 0.0) / (coalesce(sp_mean, 1.0) + 0.00000001) ELSE 0.0 END)"),
), "bin", ("ticks", "daily"))

TABLES = (DAILY_COLUMNS, DAILY_SIGNS, FILL_COLUMNS, BROKER_MORE, BROKER_SERIES, BROKER_DAILY, TICK_COLUMNS, LADDER_COLUMNS, CROSS_TICKS, CROSS_50, CROSS_100)
