"""Features of broker fills, alone and with daily bars or ticks.

Ties in ranks go to the smaller broker id, so that no result depends on the order of rows.
"""

from __future__ import annotations

from tidemark.plans.feature import Feature
from tidemark.plans.ticks import BY_DAY, T, c0, c5, day

#: A broker's day, with its ranks and the day's totals.
B = (
    "b",
    """
SELECT *, buy - sell AS net, buy + sell AS vol, pq_buy / (buy + 0.00000001) AS avg_buy,
       row_number() OVER (PARTITION BY StockId, Date ORDER BY buy DESC, entries DESC, BrokerId) AS by_buy,
       row_number() OVER (PARTITION BY StockId, Date ORDER BY buy + sell DESC, BrokerId) AS by_vol,
       row_number() OVER (PARTITION BY StockId, Date ORDER BY buy - sell DESC, BrokerId) AS by_net,
       row_number() OVER (PARTITION BY StockId, Date ORDER BY sell - buy DESC, BrokerId) AS by_net_sell,
       row_number() OVER (PARTITION BY StockId, Date ORDER BY buy - sell, BrokerId DESC) AS by_net_low,
       (rank() OVER (PARTITION BY StockId, Date ORDER BY sell) + (count(*) OVER (PARTITION BY StockId, Date, sell) - 1) / 2.0) / count(*) OVER (PARTITION BY StockId, Date) AS sell_rank,
       sum(buy + sell) OVER (PARTITION BY StockId, Date) AS day_vol, count(*) OVER (PARTITION BY StockId, Date) AS brokers
FROM (SELECT StockId, Date, BrokerId, sum(BuyQtm) AS buy, sum(SellQtm) AS sell, sum(Price * BuyQtm) AS pq_buy, sum(Price * SellQtm) AS pq_sell,
             sum(CASE WHEN BuyQtm > 0 THEN 1 ELSE 0 END) AS entries, count(*) AS fills
      FROM {brokers} GROUP BY StockId, Date, BrokerId) AS own""",
)
TOP5_BUY = "sum(CASE WHEN by_buy <= 5 AND net > 0 THEN net ELSE 0 END)"
HHI = "sum(1.0 * vol / day_vol * vol / day_vol)"
VWAP = "(sum(pq_buy) + sum(pq_sell)) / (sum(buy) + sum(sell) + 0.00000001)"


def broker(name: str, description: str, queries: tuple, steps: tuple) -> Feature:
    return Feature(name, "single_stock_broker", description, (B, *queries), steps, ("brokers",))


def with_daily(name: str, description: str, queries: tuple, steps: tuple) -> Feature:
    return Feature(name, "cross_broker_daily", description, (B, *queries), steps, ("brokers", "daily"))


def joined(columns: str, select: str = "") -> tuple[str, str]:
    """Daily bars with what the last query has of the same day."""
    return ("j", f"SELECT a.StockId, a.Date, {columns} FROM {{daily}} AS a LEFT JOIN d ON a.StockId = d.StockId AND a.Date = d.Date")


ROWS = ("r", "SELECT StockId, Date, BrokerId, Price, BuyQtm - SellQtm AS net FROM {brokers}")
Z20, Z42 = (("z", "zscore", "x", 20),), (("z", "zscore", "x", 42),)
ATR = (("before", "shift", "close"), ("tr", "sql", "greatest(high - low, coalesce(abs(high - before), high - low), coalesce(abs(low - before), high - low))"), ("atr", "rolling_mean", "tr", 20, 1))

FEATURES = [
    broker("f_activ_surp", "active fills against their mean", (ROWS, ("d", f"SELECT StockId, Date, count(CASE WHEN net <> 0 THEN 1 END) * 1.0 AS n FROM r {BY_DAY}")), (
        ("m", "rolling_mean", "n", 20, 10), ("x", "sql", "n / (m + 0.000000001)"), ("z", "zscore", "x", 60), ("y", "sql", "-z"), *c5("y"))),
    broker("f_allee_reproduction_deficit", "buying of the ten largest against its mean, over selling of the others", (
        day("1.0 * sum(CASE WHEN by_buy <= 10 THEN buy ELSE 0 END) AS top, 1.0 * sum(CASE WHEN sell_rank <= 0.8 THEN sell ELSE 0 END) AS bottom", "b"),), (
        ("m", "rolling_mean", "top", 20, 1), ("x", "sql", "(top - m) / (bottom + 0.00000001)"), *Z42, *c5("z"))),
    broker("f_broker_concentration_shift", "change of broker concentration in five days", (day(f"{HHI} AS h", "b"),), (("x", "diff", "h", 5), *Z20, *c0("z"))),
    broker("f_net_reversal", "net buying against its short mean", (ROWS, ("d", f"SELECT StockId, Date, 1.0 * sum(net) AS n FROM r {BY_DAY}")), (
        ("m", "rolling_mean", "n", 5, 3), ("s", "rolling_std", "n", 20, 10), ("x", "sql", "(n - m) / (s + 0.000000001)"), ("z", "zscore", "x", 5), ("y", "sql", "-z"), ("e", "ewm", "y", 10), *c5("e"))),
    broker("f_newcomer_net_momentum", "what small brokers pay against the vwap", (
        ("q", "SELECT *, QUANTILE(vol, 0.5) OVER (PARTITION BY StockId, Date) AS half FROM b"),
        ("s", f"""SELECT StockId, Date, count(*) AS n, sum(vol) AS v, sum(CASE WHEN vol <= half THEN pq_buy ELSE 0 END) / (sum(CASE WHEN vol <= half THEN buy ELSE 0 END) + 0.00000001) AS small, {VWAP} AS vwap FROM q {BY_DAY}"""),
        ("d", "SELECT StockId, Date, CASE WHEN n >= 3 AND v > 0 THEN CASE WHEN vwap > 0 THEN small / vwap - 1 ELSE 0.0 END END AS x FROM s")), (("y", "filled", "x"), ("value", "ewm", "y", 5))),
    broker("f_post_latency_infectivity_jump", "five days of leading net buying over the price range, times the jump in volume", (
        day(f"1.0 * {TOP5_BUY} AS top, max(avg_buy) / (min(avg_buy) + 0.00000001) - 1 AS width, 1.0 * sum(vol) AS v", "b"),), (
        ("s", "rolling_sum", "top", 5, 1), ("score", "sql", "s / (width + 0.001)"), ("late", "shift", "score"), ("m", "rolling_mean", "v", 5, 1), ("m1", "shift", "m"),
        ("x", "sql", "coalesce(late, 0.0) * coalesce(v / (m1 + 0.00000001), 1.0)"), *Z42, *c5("z"))),
    broker("f_primary_secondary_infection_div", "leading net buying against how many others buy", (
        day(f"1.0 * {TOP5_BUY} / (sum(buy) + 0.00000001) - count(CASE WHEN by_buy > 5 AND buy > 0 THEN 1 END) / (count(*) + 0.00000001) AS x", "b"),), (*Z42, *c5("z"))),
    broker("f_qit_athermal_free_energy", "divergence of net buyers' shares from equal ones", (
        ("p", "SELECT StockId, Date, 1.0 * net / sum(net) OVER (PARTITION BY StockId, Date) AS p, count(*) OVER (PARTITION BY StockId, Date) AS n FROM b WHERE net > 0"),
        ("e", f"SELECT StockId, Date, sum(p * ln(p * n)) AS x FROM p {BY_DAY}"),
        ("d", "SELECT a.StockId, a.Date, x FROM (SELECT DISTINCT StockId, Date FROM b) AS a LEFT JOIN e ON a.StockId = e.StockId AND a.Date = e.Date")), c0("x")),
    broker("f_resistance_gamma_heterogeneity", "concentration for each seller", (day(f"{HHI} / (count(CASE WHEN sell > 0 THEN 1 END) + 0.00000001) AS x", "b"),), (*Z42, *c5("z"))),
    broker("f_top5_consist", "how many of today's five leading net fills' brokers led before", (
        ROWS,
        ("k", "SELECT StockId, Date, BrokerId, row_number() OVER (PARTITION BY StockId, Date ORDER BY net DESC, BrokerId, Price) AS rank FROM r"),
        ("top", "SELECT DISTINCT StockId, Date, BrokerId FROM k WHERE rank <= 5"),
        ("days", "SELECT StockId, Date, row_number() OVER (PARTITION BY StockId ORDER BY Date) AS ordinal FROM (SELECT DISTINCT StockId, Date FROM top) AS u"),
        ("o", "SELECT top.StockId, top.Date, BrokerId, ordinal FROM top JOIN days ON top.StockId = days.StockId AND top.Date = days.Date"),
        ("m", "SELECT StockId, Date, ordinal, count(*) OVER (PARTITION BY StockId, BrokerId ORDER BY ordinal RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING) AS hits FROM o"),
        ("d", f"SELECT StockId, Date, CASE WHEN max(ordinal) > 5 THEN sum(hits) / 5.0 / count(*) END AS x FROM m {BY_DAY}")), (("z", "zscore", "x", 60), *c5("z"))),
    broker("f_tumor_fingering_instability", "highest mean price paid over the vwap, by its buyers' share", (
        ("m", "SELECT *, max(avg_buy) OVER (PARTITION BY StockId, Date) AS top FROM b"),
        day(f"(max(top) - {VWAP}) / ({VWAP} + 0.00000001) * sum(CASE WHEN avg_buy = top THEN buy ELSE 0 END) / (sum(buy) + 0.00000001) AS x", "m")), (*Z42, *c5("z"))),
    with_daily("f_gt_in_group_stealth_collusion", "whether the five largest net buyers buy on the whole", (
        day("1.0 * sum(CASE WHEN by_net <= 5 THEN net ELSE 0 END) AS top", "b"), joined("coalesce(top, 0.0) AS top")), (("x", "sql", "CASE WHEN top > 0 THEN top / (top + 0.00001) ELSE 0.0 END"), *Z20, *c5("z"))),
    with_daily("f_phy_geodesic_jacobi_convergence", "leading net buying times the day's return", (
        day("1.0 * sum(CASE WHEN by_vol <= 5 THEN net ELSE 0 END) AS top", "b"), joined("coalesce(top, 0.0) / CASE WHEN volume_k = 0 THEN 1.0 ELSE volume_k END * ret_pct AS x")), c0("x")),
    with_daily("f_retail_trap", "what the smaller net buyers paid above the day's vwap", (
        ("q", "SELECT *, QUANTILE(vol, 0.8) OVER (PARTITION BY StockId, Date) AS most FROM b"),
        ("d", f"""SELECT StockId, Date, sum(CASE WHEN vol <= most AND buy > sell THEN pq_buy END) / (sum(CASE WHEN vol <= most AND buy > sell THEN buy END) + 0.00000001) AS paid FROM q {BY_DAY}"""),
        joined("open, high, low, close, coalesce(paid - turnover_value / (volume_k * 1000 + 0.00000001), 0.0) AS depth")), (*ATR, ("x", "sql", "depth / (atr + 0.00000001)"), ("z", "zscore", "x", 20, 1), *c0("z"))),
    with_daily("f_cost_stack", "the close above what the larger net buyers paid", (
        ("n", "SELECT * FROM b WHERE buy > sell"),
        ("q", "SELECT *, QUANTILE(vol, 0.9) OVER (PARTITION BY StockId, Date) AS least FROM n"),
        ("d", f"SELECT StockId, Date, sum(CASE WHEN vol >= least THEN pq_buy END) / (sum(CASE WHEN vol >= least THEN buy END) + 0.00000001) AS paid FROM q {BY_DAY}"),
        joined("open, high, low, close, coalesce(nullif(paid, 0), close) AS paid")), (*ATR, ("x", "sql", "(close - paid) / (atr + 0.00000001)"), ("z", "zscore", "x", 20, 1), *c0("z"))),
    *(with_daily(name, text, (
        ("e", "SELECT f.StockId, f.Date, f.Price, f.BuyQtm, a.high, a.low FROM {brokers} AS f JOIN b ON f.StockId = b.StockId AND f.Date = b.Date AND f.BrokerId = b.BrokerId AND b.by_vol <= 10 JOIN {daily} AS a ON f.StockId = a.StockId AND f.Date = a.Date"),
        ("d", f"SELECT StockId, Date, 1.0 * sum(CASE WHEN {where} THEN BuyQtm ELSE 0 END) AS part, 1.0 * sum(BuyQtm) AS whole FROM e {BY_DAY}"),
        joined("coalesce(part, 0.0) / (coalesce(whole, 0.0) + 0.00000001) AS x")), (*Z42, *c5("z")))
      for name, text, where in (("f_stefan_boundary_sacrifice_ratio", "share of leading buying near the high", "Price >= high * 0.99"), ("f_super_invader_baseline_defense", "share of leading buying near the low", "Price <= low * 1.01"))),
]

#: Broker days with what the tick features need of the same day.
LEADERS = ("l", f"SELECT StockId, Date, 1.0 * sum(CASE WHEN by_lead <= 5 THEN net ELSE 0 END) AS top5, count(CASE WHEN net > 0 THEN 1 END) * 1.0 AS buyers FROM (SELECT *, row_number() OVER (PARTITION BY StockId, Date ORDER BY buy DESC, net DESC, BrokerId) AS by_lead FROM b) AS k {BY_DAY}")
MOVES = ("m", f"SELECT StockId, Date, max_by(p, pos) - min_by(p, pos) AS dp, max_by(p, pos) / min_by(p, pos) - 1 AS ret FROM t {BY_DAY}")


def with_ticks(name: str, description: str, queries: tuple, steps: tuple) -> Feature:
    return Feature(name, "cross_broker_tick", description, (B, T, *queries), steps, ("brokers", "ticks"))


BOTH = ("d", "SELECT l.StockId, l.Date, top5, buyers, dp, ret FROM l JOIN m ON l.StockId = m.StockId AND l.Date = m.Date")
SMALL = "count(CASE WHEN f = 1 AND q <= 1 THEN 1 END) * 1.0 AS small"

FEATURES += [
    with_ticks("f_afd_jet_exit_radiation", "leading net buying times the change of the day's return", (LEADERS, MOVES, BOTH), (
        ("change", "diff", "ret"), ("x", "sql", "greatest(top5, 0.0) * coalesce(change, 0.0)"), ("z", "zscore", "x", 20, 10, 1e-10), *c5("z"))),
    with_ticks("f_afd_updraft_width_entrainment", "net buyers times the day's rise", (LEADERS, MOVES, BOTH), (("x", "sql", "buyers * greatest(dp, 0.0)"), ("z", "zscore", "x", 20, 10, 1e-10), *c5("z"))),
    Feature("f_gt_reputation_manipulation_fraud", "cross_tick_broker_daily", "one-lot buys and leading net selling, each against its mean", (
        B, ("s", f"SELECT StockId, Date, {SMALL} FROM {{ticks}} {BY_DAY}"), ("n", f"SELECT StockId, Date, 1.0 * sum(CASE WHEN by_net_sell <= 5 THEN -net ELSE 0 END) AS sold FROM b {BY_DAY}"),
        ("d", "SELECT a.StockId, a.Date, coalesce(small, 0.0) AS small, coalesce(sold, 0.0) AS sold FROM {daily} AS a LEFT JOIN s ON a.StockId = s.StockId AND a.Date = s.Date LEFT JOIN n ON a.StockId = n.StockId AND a.Date = n.Date")), (
        ("sm", "rolling_mean", "small", 20, 5), ("nm", "rolling_mean", "sold", 20, 5), ("x", "sql", "small / (sm + 0.00001) * CASE WHEN sold <= 0 THEN 0.0 ELSE coalesce(sold / (nm + 0.00001), 0.0) END"), *Z20, *c5("z")), ("brokers", "ticks", "daily")),
]


def scripts(name: str, description: str, columns: str, steps: tuple, least: int = 3) -> Feature:
    """A broker feature of its own: days with too few fills count as zero."""
    guard = f"SELECT StockId, Date, CASE WHEN sum(fills) >= {least} THEN 1.0 ELSE 0.0 END AS whole, {columns} FROM b {BY_DAY}"
    return Feature(name, "broker_only", description, (B, ("d", guard)), steps, ("brokers",))


def second(column: str, out: str = "d2") -> tuple[tuple, ...]:
    """The second difference of a smoothed series."""
    return ((f"{column}_e", "ewm", column, 3, 1), (f"{column}_d", "diff", f"{column}_e"), (out, "diff", f"{column}_d"))


def net_of(where: str, name: str) -> str:
    return f"1.0 * sum(CASE WHEN {where} THEN net ELSE 0 END) AS {name}"


Z20_FINE = (("z", "zscore", "x", 20, 10, 1e-10),)
HHI_OF = "coalesce(sum(1.0 * {0} * {0}) / nullif(1.0 * sum({0}) * sum({0}), 0), 0.0)"

FEATURES += [
    scripts("f_nld_fvs_controlling_dot", "curvature of the largest brokers' net buying times that of the rest", f"{net_of('by_vol <= 5', 'lead0')}, {net_of('by_vol > 5', 'rest0')}", (
        ("lead", "sql", "whole * lead0"), ("rest", "sql", "whole * rest0"), *second("lead", "d2a"), *second("rest", "d2b"), ("x", "sql", "coalesce(d2a * d2b * sign(lead), 0.0)"), *Z20_FINE, *c5("z"))),
    scripts("f_nld_subcritical_pitchfork", "curvature of the five leading net buyers' buying, by the day's sign", f"{net_of('by_net <= 5', 'lead0')}, sign(1.0 * sum(net)) AS way", (
        ("lead", "sql", "whole * lead0"), *second("lead"), ("x", "sql", "coalesce(d2 * way * whole, 0.0)"), *Z20_FINE, *c5("z"))),
    scripts("f_nld_symmetry_restoring_phase", "curvature of the angle between selling and buying concentration", f"{HHI_OF.format('buy')} AS hb, {HHI_OF.format('sell')} AS hs, sign(1.0 * sum(net)) AS way", (
        ("angle", "sql", "atan2(whole * hs + 0.0000000001, whole * hb + 0.0000000001)"), *second("angle"), ("x", "sql", "coalesce(d2 * way * whole, 0.0)"), *Z20_FINE, *c5("z"))),
    scripts("f_nld_pyr_pv_eigen_gap", "gap of the eigenvalues of leading buyers' and sellers' trades", ", ".join(f"1.0 * sum(CASE WHEN {w} <= 5 THEN {c} ELSE 0 END) AS {n}" for w, c, n in (("by_net", "buy", "bb"), ("by_net", "sell", "bs"), ("by_net_low", "buy", "sb"), ("by_net_low", "sell", "ss"))) + ", count(*) AS k", (
        ("total", "sql", "bb + bs + sb + ss + 4"),
        ("gap", "sql", "2 * sqrt(power((bb - ss) / total / 2, 2) + (bs + 1) / total * (sb + 1) / total)"),
        ("x", "sql", "CASE WHEN whole > 0 AND k >= 3 THEN gap * sign(bb - bs + sb - ss) ELSE 0.0 END"), *Z20_FINE, *c5("z")), 5),
    scripts("f_nld_p53_antagonistic_cross", "turn of leading buyers' and sellers' net buying from one day to the next", f"{net_of('by_net <= 3', 'a0')}, {net_of('by_net_low <= 3', 'b0')}", (
        ("a", "sql", "whole * a0 / (stddev_pop(whole * a0) OVER (PARTITION BY StockId) + 0.0000000001)"), ("b1", "sql", "whole * b0 / (stddev_pop(whole * b0) OVER (PARTITION BY StockId) + 0.0000000001)"),
        ("before_a", "shift", "a"), ("before_b", "shift", "b1"), ("x", "sql", "before_a * b1 - before_b * a"), *Z20_FINE, *c5("z"))),
    scripts("f_nld_hopf_partial_antiphase", "turn among changes of leading buyers, leading sellers and the rest", f"{net_of('by_net <= 5', 'a0')}, {net_of('by_net_low <= 5', 'b0')}, CASE WHEN count(*) > 10 THEN {net_of('by_net > 5 AND by_net_low > 5', 'r0').removesuffix(' AS r0')} ELSE 0.0 END AS r0", (
        ("a", "sql", "whole * a0"), ("b1", "sql", "whole * b0"), ("r", "sql", "whole * r0"), ("da", "diff", "a"), ("db", "diff", "b1"), ("dr", "diff", "r"),
        ("scale", "sql", "greatest(stddev_pop(da) OVER (PARTITION BY StockId), stddev_pop(db) OVER (PARTITION BY StockId), stddev_pop(dr) OVER (PARTITION BY StockId), 0.0000000001)"),
        ("x", "sql", "da / scale * db / scale - db / scale * dr / scale"), *Z20_FINE, *c5("z"))),
    with_ticks("f_gt_information_design_obfuscation", "turns of flags and uneven sizes in bins of 50 ticks, times the market's leading net selling", (
        ("turn", "SELECT StockId, Date, floor(pos / 50) AS bin, q, n, CASE WHEN f <> lag(f) OVER (PARTITION BY StockId, Date, floor(pos / 50) ORDER BY pos) THEN 1 ELSE 0 END AS turned FROM t"),
        ("bin", "SELECT StockId, Date, n, sum(turned) * (stddev_pop(q) / (avg(q) + 0.00000001)) AS hidden FROM turn GROUP BY StockId, Date, n, bin"),
        ("o", "SELECT StockId, Date, CASE WHEN n < 100 THEN 0.0 ELSE avg(hidden) END AS hidden FROM bin GROUP BY StockId, Date, n"),
        ("market", "SELECT Date, BrokerId, 1.0 * sum(sell - buy) AS sold FROM b GROUP BY Date, BrokerId"),
        ("lead", "SELECT Date, sold, row_number() OVER (PARTITION BY Date ORDER BY sold DESC, BrokerId) AS rank FROM market"),
        ("five", "SELECT Date, sum(sold) AS sold FROM lead WHERE rank <= 5 GROUP BY Date"),
        ("d", "SELECT o.StockId, o.Date, hidden * coalesce(sold, 0.0) AS x FROM o LEFT JOIN five ON o.Date = five.Date")), (("e", "ewm", "x", 10, 1), ("z", "zscore", "e", 20), *c5("z"))),
]
