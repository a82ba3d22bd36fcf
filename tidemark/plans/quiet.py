"""Broker fills met with what ticks did at their price in quiet and in bursting bars, and how brokers' net shares are spread.

Bars' means and the burst bar are windows over the ticks of a day, so ticks go to the price ladder in one pass and meet
the fills in one join on whole hundredths of a price.
"""

from __future__ import annotations

from tidemark.plans.brokers import B
from tidemark.plans.feature import Columns, Feature
from tidemark.plans.ladder import CENTS
from tidemark.plans.ticks import BY_DAY, IN_DAY, T, c0
from tidemark.plans.wide import D, S

BAR = "(PARTITION BY StockId, Date, floor(sec / 300))"
#: Ticks with their five-minute bar: its volume, buying and largest jump, and whether the tick is the bar's first.
BARS = ("bars", f"SELECT StockId, Date, p, q, sec, floor(sec / 300) AS bar, sum(q) OVER {BAR} AS vol, sum(buy) OVER {BAR} AS bought, max(CASE WHEN pp > 0 THEN abs(dp) / pp ELSE 0.0 END) OVER {BAR} AS jump, CASE WHEN pos = min(pos) OVER {BAR} THEN 1 ELSE 0 END AS opens FROM t")
MEANS = ("means", f"SELECT *, 1.0 * sum(q) OVER {D} / sum(opens) OVER {D} AS mean_vol, avg(CASE WHEN opens = 1 THEN jump END) OVER {D} AS mean_jump, max(bought) OVER {D} AS most FROM bars")
BURST = ("burst", f"SELECT *, min(CASE WHEN bought = most THEN bar END) OVER {D} AS burst_bar FROM means")
#: Shares of each price's volume in the burst bar, in refuges (less volume and smaller jumps than usual) and in late quiet bars.
SHARES = ("shares", f"""SELECT StockId, Date, {CENTS.format('p')} AS cents, sum(CASE WHEN bar = burst_bar THEN q ELSE 0 END) / (sum(q) + 0.00000001) AS burst, sum(CASE WHEN vol < mean_vol AND jump < mean_jump THEN q ELSE 0 END) / (sum(q) + 0.00000001) AS refuge,
       sum(CASE WHEN sec >= 46800 AND jump < mean_jump THEN q ELSE 0 END) / (sum(q) + 0.00000001) AS late FROM burst GROUP BY StockId, Date, {CENTS.format('p')}""")
MET = ("met", f"""SELECT *, row_number() OVER (PARTITION BY StockId, Date ORDER BY buy + sell, BrokerId) * 1.0 / count(*) OVER {D} AS rank FROM (
       SELECT f.StockId, f.Date, f.BrokerId, sum(f.BuyQtm) AS buy, sum(f.SellQtm) AS sell, sum(f.BuyQtm * l.burst) AS burst, sum(f.BuyQtm * l.refuge) AS refuge, sum(f.BuyQtm * l.late) AS late
       FROM {{brokers}} AS f JOIN shares AS l ON f.StockId = l.StockId AND f.Date = l.Date AND {CENTS.format('f.Price')} = l.cents GROUP BY f.StockId, f.Date, f.BrokerId) AS own""")
LADDERED = (T, BARS, MEANS, BURST, SHARES, MET)
TOP10, TOP5 = "rank >= 0.9 AND buy > 0", "rank >= 0.95 AND buy > 0"


def part(what: str, of: str) -> str:
    return f"coalesce(sum(CASE WHEN {of} THEN {what} END) / (sum(CASE WHEN {of} THEN buy END) + 1), 0.0)"


REFUGE = Columns("raw_quiet_columns", "buying in refuges, bursts and late quiet bars", LADDERED, (
    ("raw_top10_refuge_ratio", part("refuge", TOP10)), ("raw_burst_hhi_top10", f"coalesce(sum(CASE WHEN {TOP10} THEN burst * burst END) / nullif(power(sum(CASE WHEN {TOP10} THEN burst END), 2), 0), 0.0)"),
    ("raw_top5_quiet_ratio", part("late", TOP5)), ("raw_rest_quiet_ratio", part("late", f"NOT ({TOP5})")),
), "met", ("brokers", "ticks"))

FEATURES = [
    Feature("f_inverse_allee_refuge_accumulation", "cross_broker_tick", "leading brokers' buying in quiet bars", (*LADDERED, ("d", f"SELECT StockId, Date, {part('refuge', TOP10)} AS x FROM met {BY_DAY}")), (("z", "zscore", "x", 42, 21), *c0("z")), ("brokers", "ticks")),
]

#: Brokers with a share of net buying, in five bins; the larger fifth apart from the others.
EDGES, CENTRES = (-0.6, -0.2, 0.2, 0.6), (-0.8, -0.4, 0.0, 0.4, 0.8)


def bin_of(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} <= {e} THEN {k}" for k, e in enumerate(EDGES)) + " ELSE 4 END"


NETS = ("nets", f"SELECT StockId, Date, BrokerId, buy, sell, vol, 1.0 * net / vol AS share, CASE WHEN vol >= QUANTILE(vol, 0.8) OVER {D} THEN 1 ELSE 0 END AS big FROM b WHERE vol > 0")
BINNED = ("binned", f"SELECT *, {bin_of('share')} AS k FROM nets")


def counted(big: int) -> str:
    return ", ".join(f"count(CASE WHEN big = {big} AND k = {k} THEN 1 END) AS {'nb'[big]}{k}" for k in range(5))


#: By day: the counts, what the larger ones bought net, and their shares of volume and of net in order of their ids.
SPREAD = (
    "spread",
    f"""SELECT StockId, Date, {counted(0)}, {counted(1)}, count(CASE WHEN big = 0 THEN 1 END) AS others, count(CASE WHEN big = 1 THEN 1 END) AS bigs, coalesce(sum(CASE WHEN big = 1 THEN buy - sell END) / (sum(CASE WHEN big = 1 THEN vol END) + 0.000000001), 0.0) AS x,
       transform(array_sort(collect_list(CASE WHEN big = 1 THEN struct(BrokerId, 1.0 * vol AS v, share) END)), r -> r.v) AS vols, transform(array_sort(collect_list(CASE WHEN big = 1 THEN struct(BrokerId, share AS v) END)), r -> r.v) AS shares_ FROM binned {BY_DAY}""",
    f"""SELECT StockId, Date, {counted(0)}, {counted(1)}, count(CASE WHEN big = 0 THEN 1 END) AS others, count(CASE WHEN big = 1 THEN 1 END) AS bigs, coalesce(sum(CASE WHEN big = 1 THEN buy - sell END) / (sum(CASE WHEN big = 1 THEN vol END) + 0.000000001), 0.0) AS x,
       list(1.0 * vol ORDER BY BrokerId) FILTER (WHERE big = 1) AS vols, list(share ORDER BY BrokerId) FILTER (WHERE big = 1) AS shares_ FROM binned {BY_DAY}""",
)
TICKED = ("ticked", f"SELECT StockId, Date, sum(CASE WHEN f = 1 THEN 1 ELSE 0 END) * 1.0 / count(*) AS up FROM {{ticks}} {BY_DAY}")
PAST20, PAST60 = "ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING", "ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING"
#: Days in order, with shares in bins as numbers; `day` counts from 0.
DAYS = ("days", f"""SELECT s.*, coalesce(up, 0.5) AS up, row_number() OVER (PARTITION BY s.StockId ORDER BY s.Date) - 1 AS day, CASE WHEN x > 0 THEN 1 ELSE 0 END AS bought, CASE WHEN coalesce(up, 0.5) > 0.5 THEN 1 ELSE 0 END AS rose, {bin_of('x')} AS xk,
       {', '.join(f'CASE WHEN bigs > 0 THEN (b{k} + 0.001) / (bigs + 0.005) END AS sb{k}' for k in range(5))} FROM spread AS s LEFT JOIN ticked AS t ON s.StockId = t.StockId AND s.Date = t.Date""")
BEFORE = ("before", f"SELECT *, lag(bought) OVER ({S}) AS bought1, lag(rose) OVER ({S}) AS rose1 FROM days")
#: Frames of the 20 days before, of their 19 steps, and of up to 60 days before.
STEPS19 = "ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING"
FRAMES = (
    "frames",
    "SELECT *, " + ", ".join(f"count(CASE WHEN xk = {k} THEN 1 END) OVER p20 AS h{k}, sum(sb{k}) OVER p60 AS m{k}" for k in range(5)) + ", avg(x) OVER p20 AS mean20, stddev_pop(x) OVER p20 AS dev20, sum(bought) OVER p20 AS bought20, count(sb0) OVER p60 AS valid60, "
    + ", ".join(f"count(CASE WHEN bought1 = {b} AND rose1 = {y} AND rose = {z} THEN 1 END) OVER s19 AS c{b}{y}{z}" for b in (0, 1) for y in (0, 1) for z in (0, 1))
    + ", {held20} AS hist20, {held60} AS hist60 FROM before WINDOW p20 AS ({s} {p20}), p60 AS ({s} {p60}), s19 AS ({s} {s19}), l60 AS ({s} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)",
)


def frames(held: str) -> str:
    return FRAMES[1].format(held20=f"{held}(x) OVER p20", held60=f"{held}(x) OVER l60", s=S, p20=PAST20, p60=PAST60, s19=STEPS19)


HELD = ("frames", frames("collect_list"), frames("list"))


def informed() -> str:
    """What yesterday's net buying says of today's ticks beyond what yesterday's ticks say, of 19 steps in nats."""
    parts = []
    for y in (0, 1):
        for z in (0, 1):
            alone = f"((c0{y}{z} + c1{y}{z} + 0.001) / (c0{y}0 + c0{y}1 + c1{y}0 + c1{y}1 + 0.002))"
            parts += [f"c{b}{y}{z} * ln((c{b}{y}{z} + 0.001) / (c{b}{y}0 + c{b}{y}1 + 0.002) / {alone})" for b in (0, 1)]
    return f"CASE WHEN day >= 20 AND bought20 BETWEEN 2 AND 18 THEN greatest(0.0, ({' + '.join(parts)}) / 19) END"


def listed(values: list[str], when: str) -> tuple[str, str]:
    """An array of so many values, for both engines."""
    inside = ", ".join(f"CAST({v} AS DOUBLE)" for v in values)
    return f"CASE WHEN {when} THEN array({inside}) END", f"CASE WHEN {when} THEN [{inside}] END"


MEAN60 = [f"(m{k} / valid60) / (({' + '.join(f'm{j}' for j in range(5))}) / valid60 + 0.000000001)" for k in range(5)]
SPREADS = Columns("raw_spread_columns", "how brokers' shares of net buying are spread, and their history", (B, NETS, BINNED, SPREAD, TICKED, DAYS, BEFORE, HELD), (
    ("raw_dist_big", *listed([f"(b{k} + 0.001) / (bigs + 0.005)" for k in range(5)], "bigs > 0")), ("raw_dist_small", *listed([f"(n{k} + 0.001) / (others + 0.005)" for k in range(5)], "others > 0")),
    ("raw_broker_weights_big", "CASE WHEN bigs < 2 THEN array(1.0) ELSE transform(vols, v -> v / aggregate(vols, 0.0, (a, x) -> a + x)) END", "CASE WHEN bigs < 2 THEN [1.0] ELSE list_transform(vols, lambda v: v / list_sum(vols)) END"),
    ("raw_broker_nets_big", "CASE WHEN bigs < 2 THEN array(0.0) ELSE shares_ END", "CASE WHEN bigs < 2 THEN [0.0] ELSE shares_ END"),
    ("raw_net_ratio_hist_20d", "CASE WHEN day >= 20 THEN hist20 END"), ("raw_net_ratio_hist_60d", "CASE WHEN day >= 59 THEN hist60 END"), ("raw_dist_big_hist_60d", *listed(MEAN60, "day >= 20 AND valid60 >= 30")),
    ("raw_di_series", informed()),
), "frames", ("brokers", "ticks"), False, ("raw_dist_big", "raw_dist_small", "raw_broker_weights_big", "raw_broker_nets_big", "raw_net_ratio_hist_20d", "raw_net_ratio_hist_60d", "raw_dist_big_hist_60d"))


def normed(values: list[str]) -> list[str]:
    return [f"(({v}) / ({' + '.join(values)}))" for v in values]


#: Today's net buying as a bump over the bins, against the bins of the 20 days before.
TODAY = [f"(p{k} + 0.000000001)" for k in range(5)]
THEN = [f"(q{k} + 0.000000001)" for k in range(5)]
BUMPS = (
    ("bumps", "SELECT *, " + ", ".join(f"exp(-0.5 * power((x - ({c})) / 0.3, 2)) + 0.001 AS e{k}, (h{k} + 0.001) / 20.005 AS q{k}" for k, c in enumerate(CENTRES)) + " FROM frames"),
    ("ps", "SELECT *, " + ", ".join(f"e{k} / (e0 + e1 + e2 + e3 + e4) AS p{k}" for k in range(5)) + " FROM bumps"),
    ("d", f"SELECT StockId, Date, CASE WHEN day >= 20 THEN ({' + '.join(f'{a} * ln({a} / {b})' for a, b in zip(normed(TODAY), normed(THEN)))}) * tanh((x - mean20) / (dev20 + 0.000000001)) END AS deviation FROM ps"),
)
FEATURES += [
    Feature("f_it_broker_distribution_hist_deviation", "cross_broker_tick", "how far the larger brokers' net buying is from its 20 days", (B, NETS, BINNED, SPREAD, TICKED, DAYS, BEFORE, HELD, *BUMPS), c0("deviation"), ("brokers", "ticks")),
]

#: Half hours of a day (from nine) with at least three ticks: entropy of buying, and vwap.
HALF_HOURS = (
    ("h", f"SELECT StockId, Date, floor((sec - 32400) / 1800) AS half, count(*) OVER {D} AS n, f, p, q FROM {{ticks}}"),
    ("s", "SELECT StockId, Date, half, max(n) AS n, count(*) AS k, greatest(0.000000001, least(1 - 0.000000001, avg(CASE WHEN f = 1 THEN 1.0 ELSE 0.0 END))) AS up, sum(p * q) / (sum(q) + 0.000000001) AS vwap FROM h GROUP BY StockId, Date, half"),
    ("w", f"SELECT StockId, Date, {', '.join(f'max(CASE WHEN half = {k} AND k >= 3 AND n >= 20 THEN -(up * ln(up) + (1 - up) * ln(1 - up)) / ln(2.0) END) AS e{k}, max(CASE WHEN half = {k} AND k >= 3 AND n >= 20 THEN vwap END) AS v{k}' for k in range(8))} FROM s {BY_DAY}"),
)
SEGMENTS = Columns("raw_segment_columns", "half hours: entropy of buying and vwap", HALF_HOURS, (("raw_tick_segments_h", *listed([f"e{k}" for k in range(8)], "true")), ("raw_tick_segments_vwap", *listed([f"v{k}" for k in range(8)], "true"))), "w", ("ticks",), False, ("raw_tick_segments_h", "raw_tick_segments_vwap"))

#: Whether a tick buys, given the one before: what knowing it takes from the entropy, after buys and after others.
FED = ("fed", f"SELECT StockId, Date, pos, CASE WHEN f = 1 THEN 1 ELSE 0 END AS y, lag(CASE WHEN f = 1 THEN 1 ELSE 0 END) {IN_DAY} AS y1 FROM {{ticks}}")


def entropy(p: str) -> str:
    inside = f"greatest(0.000000001, least(1 - 0.000000001, {p}))"
    return f"(-({inside} * ln({inside}) + (1 - {inside}) * ln(1 - {inside})) / ln(2.0))"


ALL_UP = entropy("avg(1.0 * y)")
AFTER_UP, AFTER_DOWN = (f"CASE WHEN count(CASE WHEN y1 = {k} THEN 1 END) >= 2 THEN {entropy(f'avg(CASE WHEN y1 = {k} THEN 1.0 * y END)')} ELSE {ALL_UP} END" for k in (1, 0))
FEEDBACK = Columns("raw_feedback_columns", "how much a tick's side says of the next", (FED,), (("raw_feedback_capacity_skew", f"CASE WHEN count(*) >= 20 THEN ({AFTER_DOWN} - {AFTER_UP}) / ({ALL_UP} + 0.000000001) END"),), "fed")

#: Daily series of the same: smoothed and skewed net buying, change of the vwap.
RECURSIVE = Feature("raw_ewm_net", "transform", "recursive mean of the larger brokers' net buying", (B, NETS, BINNED, SPREAD), (("value", "ewm_recursive", "x", 5),), ("brokers",))
RECURSIVE_Z = Feature("t_recursive_zscore", "transform", "distance of the close from its recursive mean in recursive deviations", (("d", "SELECT * FROM {daily}"),), (("m", "ewm_recursive", "close", 20), ("s", "ewm_recursive_std", "close", 20), ("z", "sql", "coalesce((close - m) / nullif(s, 0), 0.0)")), ("daily",))
SKEW_NET = Feature("raw_rolling_skew_net", "transform", "skew of 20 days' net buying of the larger brokers", (B, NETS, BINNED, SPREAD), (("value", "rolling_skew", "x", 20, 10),), ("brokers",))
SKEW_TICK = Feature("raw_rolling_skew_tick", "transform", "skew of 20 days' shares of buying ticks", (TICKED,), (("value", "rolling_skew", "up", 20, 10),))
DELTA = Feature("raw_delta_vwap", "transform", "change of the day's vwap", (("d", f"SELECT StockId, Date, sum(p * q) / sum(q) AS vwap FROM {{ticks}} {BY_DAY}"),), (("value", "pct_change", "vwap"),))
FEATURES += [RECURSIVE, RECURSIVE_Z, SKEW_NET, SKEW_TICK, DELTA]
#: The 20 days before as two sequences, net bought and rose: counts of both together, and of a day's rise after each pair of the day before.
SEQUENCES = (
    "seq",
    "SELECT StockId, Date, day, bought20, " + ", ".join(f"count(CASE WHEN bought = {b} AND rose = {y} THEN 1 END) OVER p20 AS n{b}{y}" for b in (0, 1) for y in (0, 1)) + ", " + ", ".join(f"c{b}{y}{z}" for b in (0, 1) for y in (0, 1) for z in (0, 1))
    + f" FROM frames WINDOW p20 AS ({S} {PAST20})",
)


def split(z: int) -> str:
    """Of the days that rose (or not): what yesterday's net buying says beyond yesterday's ticks, by day."""
    parts = []
    for y in (0, 1):
        alone = f"((c0{y}{z} + c1{y}{z} + 0.001) / (c0{y}0 + c0{y}1 + c1{y}0 + c1{y}1 + 0.002))"
        parts += [f"c{b}{y}{z} * ln((c{b}{y}{z} + 0.001) / (c{b}{y}0 + c{b}{y}1 + 0.002) / {alone})" for b in (0, 1)]
    return f"CASE WHEN day >= 20 THEN ({' + '.join(parts)}) / greatest({' + '.join(f'c{b}{y}{z}' for b in (0, 1) for y in (0, 1))}, 1) END"


def after(b: int, z: int) -> str:
    """The share of days that rose (or not) after net bought days (or others), of 19."""
    seen, hit = (" + ".join(f"c{b}{y}{k}" for y in (0, 1) for k in ks) for ks in ((0, 1), (z,)))
    return f"CASE WHEN {seen} = 0 THEN 0.5 ELSE greatest({EPS19!r}, least({1 - EPS19!r}, ({hit} + {5 * EPS19!r}) / ({seen} + {10 * EPS19!r}))) END"


EPS19 = 0.01 / 19
UP = " + ".join(f"c{b}{y}1" for b in (0, 1) for y in (0, 1))
PHI = "((n10 + n11) * (n00 + n01) * 1.0 * (n01 + n11) * (n00 + n10))"
BINARY = Columns("raw_binary_columns", "how net buying and rising ticks of 20 days go together", (B, NETS, BINNED, SPREAD, TICKED, DAYS, BEFORE, HELD, SEQUENCES), (
    ("raw_phi_20d", f"CASE WHEN day >= 20 THEN coalesce((n11 * n00 - n10 * n01) / nullif(sqrt({PHI}), 0), 0.0) END"), ("raw_di_up", split(1)), ("raw_di_down", split(0)),
    ("raw_logloss_gain", f"CASE WHEN day >= 20 THEN ln({after(1, 1)}) - ln(greatest({EPS19!r}, least({1 - EPS19!r}, ({UP}) / 19.0))) - ln({after(0, 0)}) + ln(nullif(19.0 - ({UP}), 0) / 19.0) END"),
), "seq", ("brokers", "ticks"), False)
TABLES = (REFUGE, SPREADS, SEGMENTS, FEEDBACK, BINARY)
