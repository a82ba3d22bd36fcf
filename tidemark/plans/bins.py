"""Columns of a day's bins and of what follows large trades."""

from __future__ import annotations

from tidemark.plans.columns import csum
from tidemark.plans.dynamics import E10, IN_BINS, RUN
from tidemark.plans.feature import Columns
from tidemark.plans.paths import corr
from tidemark.plans.ticks import BY_DAY, IN_DAY, T
from tidemark.plans.wide import D


def way(change: str) -> str:
    """The sign of a change; a change of none counts as a little rise."""
    return f"coalesce(nullif(sign({change}), 0), 0.00001)"


V75 = ("v", f"SELECT *, QUANTILE(q, 0.75) OVER {D} AS q75, QUANTILE(q, 0.9) OVER {D} AS q90, buy - sell AS nf FROM t")
FIFTY = ("b", f"""SELECT StockId, Date, floor(pos / 50) AS bin, max_by(p, pos) - min_by(p, pos) AS moved, 1.0 * sum(q) AS vol, sum(p * q) / (sum(q) + {E10}) AS mean, max(vwap) AS vwap, 1.0 * sum(CASE WHEN q >= q75 THEN nf ELSE 0 END) AS large,
       1.0 * (sum(buy) - sum(sell)) / (sum(buy) + sum(sell) + {E10}) AS pull, QUANTILE(bid, 0.5) AS bid, QUANTILE(ask, 0.5) AS ask, QUANTILE(p, 0.5) AS mid FROM v GROUP BY StockId, Date, floor(pos / 50)""")
CHANGED = ("k", f"SELECT *, large - lag(large) {IN_BINS} AS current, (mean - vwap) / (vwap + {E10}) AS off, coalesce((bid - lag(bid) {IN_BINS}) / (mid + {E10}), 0.0) AS bid_way, coalesce((ask - lag(ask) {IN_BINS}) / (mid + {E10}), 0.0) AS ask_way FROM b")
CENTRED = ("c", f"SELECT *, coalesce(current, 0.0) AS j, vol - avg(vol) OVER {D} AS vc, off - avg(off) OVER {D} AS oc FROM k")
FIFTIES = Columns("raw_fifty_columns", "bins of 50 ticks: currents, quotes and work", (T, V75, FIFTY, CHANGED, CENTRED), (
    ("raw_mhd_beltrami_alignment", f"CASE WHEN count(*) >= 5 THEN greatest(-1.0, least(1.0, sum(moved * j) / ((sqrt(sum(moved * moved)) + {E10}) * (sqrt(sum(j * j)) + {E10})))) END"),
    ("raw_lrt_conjugate_coskewness", f"CASE WHEN count(*) >= 10 THEN CASE WHEN stddev_pop(vol) < {E10} OR stddev_pop(off) < {E10} THEN 0.0 ELSE avg(vc * vc * oc) / (var_pop(vol) * stddev_pop(off) + {E10}) END END"),
    ("raw_crack_liquidity_collapse", f"CASE WHEN count(*) >= 5 THEN (sum(greatest(ask_way, 0.0)) + sum(greatest(bid_way, 0.0))) / (sum(abs(ask_way)) + sum(abs(bid_way)) + {E10}) END"),
    ("raw_geo_entropy_directed_work", f"CASE WHEN sum(abs(moved)) < {E10} THEN 0.0 WHEN count(*) >= 5 THEN sum(pull * moved) / (sum(abs(moved)) * avg(abs(pull)) + {E10}) END"),
), "c")

THIRTY = ("b", "SELECT StockId, Date, floor(pos / 30) AS bin, max_by(p, pos) AS last, 1.0 * sum(CASE WHEN f = 1 AND p >= ask THEN q ELSE 0 END) AS up, 1.0 * sum(CASE WHEN f = 0 AND p <= bid THEN q ELSE 0 END) AS down FROM t GROUP BY StockId, Date, floor(pos / 30)")
STEPPED = ("k", f"SELECT *, (last - lag(last) {IN_BINS}) / (lag(last) {IN_BINS} + {E10}) AS ret, coalesce(up - 2 * lag(up) {IN_BINS} + lag(up, 2) {IN_BINS}, 0.0) AS up2, coalesce(down - 2 * lag(down) {IN_BINS} + lag(down, 2) {IN_BINS}, 0.0) AS down2 FROM b")
THIRTIES = Columns("raw_thirty_columns", "bins of 30 ticks: drift, and how eating into quotes quickens", (T, THIRTY, STEPPED), (
    ("raw_sindy_drift_polarity", f"CASE WHEN count(ret) >= 10 THEN CASE WHEN stddev_pop(ret) < {E10} THEN 0.0 ELSE avg(ret) / (stddev_pop(ret) + {E10}) END END"),
    ("raw_crack_creep_to_jump", f"CASE WHEN count(*) >= 5 THEN (avg(up2) - avg(down2)) / (abs(avg(up2)) + abs(avg(down2)) + {E10}) END"),
), "k")

#: Ticks with what came after them: the price five ticks later, the share of buys among the next ten, the next trade's size.
AFTER = ("a", f"""SELECT *, sum(CASE WHEN q >= q75 THEN p * q END) OVER {D} / (sum(CASE WHEN q >= q75 THEN q END) OVER {D} + {E10}) AS heavy, lead(p, 5) {IN_DAY} - p AS answer, coalesce(lead(q) {IN_DAY}, 0) AS next_q,
       avg(CASE WHEN f = 1 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY StockId, Date ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS bought, CASE WHEN dp IS NOT NULL THEN sum(CASE WHEN dp IS NOT NULL THEN q END) {RUN.format('pos')} END AS so_far, max_by(p, pos) OVER {D} - min_by(p, pos) OVER {D} AS rise FROM v""")
FIRST, SECOND = "2 * so_far <= tot - first_q", "2 * so_far > tot - first_q"
HALVES = ("h", f"SELECT *, CASE WHEN {FIRST} THEN dp END AS d1, CASE WHEN {SECOND} THEN dp END AS d2 FROM (SELECT *, min_by(q, pos) OVER {D} AS first_q FROM a) AS own")
#: Sizes against the size at the mirrored place of the day.
MIRRORED = (
    "mirror",
    f"SELECT StockId, Date, aggregate(zip_with(reverse(sizes), moves, (x, y) -> x * y), 0.0, (a, x) -> a + x) AS back FROM (SELECT StockId, Date, transform(array_sort(collect_list(struct(pos, 1.0 * abs(nf) AS x))), r -> r.x) AS sizes, transform(array_sort(collect_list(struct(pos, abs(coalesce(dp, 0.0)) AS x))), r -> r.x) AS moves FROM v {BY_DAY}) AS arrays",
    f"SELECT a.StockId, a.Date, sum(1.0 * abs(b.nf) * abs(coalesce(a.dp, 0.0))) AS back FROM v AS a JOIN v AS b ON a.StockId = b.StockId AND a.Date = b.Date AND b.pos = a.n - 1 - a.pos GROUP BY a.StockId, a.Date",
)
LARGE = "q >= q90"
BUY, SELL = (f"{LARGE} AND answer IS NOT NULL AND f = {k}" for k in (1, 0))


def paid(condition: str) -> str:
    """The mean answer for the mean size of the trades of a kind."""
    return f"(avg(CASE WHEN {condition} THEN answer END) / (avg(CASE WHEN {condition} THEN q END) + {E10}))"


def mass(condition: str) -> str:
    return f"({csum(condition)} / ({csum(condition, 'abs(dp)')} + {E10}))"


S1, S2 = f"(stddev_pop(d1) + {E10})", f"(stddev_pop(d2) + {E10})"
FORWARD = "sum(1.0 * abs(nf) * abs(coalesce(dp, 0.0)))"
UP, DOWN = csum("dp > 0", "next_q * dp"), csum("dp < 0", "next_q * -dp")
POISSON = {k: f"count(CASE WHEN {LARGE} AND f = {k} AND sec >= 32400 AND sec < 45000 THEN 1 END) / 900.0 * 60 / 14" for k in (1, 0)}
ANSWERS = Columns("raw_answer_columns", "what follows large trades, and how a day's halves differ", (T, V75, AFTER, HALVES, MIRRORED, ("j", "SELECT h.*, back FROM h JOIN mirror ON h.StockId = mirror.StockId AND h.Date = mirror.Date")), (
    ("raw_pvg_high_energy_reference_shift", f"CASE WHEN count(*) >= 30 THEN ln(({csum('p > heavy')} + {E10}) / ({csum('p <= heavy')} + {E10})) END"),
    ("raw_lrt_kubo_response_polarization", f"CASE WHEN count(CASE WHEN {BUY} THEN 1 END) >= 3 AND count(CASE WHEN {SELL} THEN 1 END) >= 3 THEN ({paid(BUY)} + {paid(SELL)}) / (abs({paid(BUY)}) + abs({paid(SELL)}) + {E10}) END"),
    ("raw_crack_time_reversal_action", f"CASE WHEN count(*) >= 30 THEN ({FORWARD} - max(back)) / ({FORWARD} + max(back) + {E10}) * {way('max(rise)')} END"),
    ("raw_sindy_phase_transition_gain", f"CASE WHEN count(d1) >= 20 AND count(d2) >= 20 THEN (ln({S2} / {S1}) + (power({S1}, 2) + power(avg(d1) - avg(d2), 2)) / (2 * power({S2}, 2)) - 0.5) * {way('avg(d2) - avg(d1)')} END"),
    ("raw_pol_effective_mass_asymmetry", f"CASE WHEN {csum('dp > 0', 'dp')} >= {E10} AND {csum('dp < 0', '-dp')} >= {E10} THEN ({mass('dp < 0')} - {mass('dp > 0')}) / ({mass('dp < 0')} + {mass('dp > 0')} + {E10}) END"),
    ("raw_net_markov_flow_asymmetry", f"CASE WHEN count(dp) >= 50 THEN CASE WHEN {UP} + {DOWN} > {E10} THEN ({UP} - {DOWN}) / ({UP} + {DOWN} + {E10}) ELSE 0.0 END END"),
    ("raw_it_post_event_directional_impulse", f"CASE WHEN count(*) >= 30 AND count(CASE WHEN {LARGE} THEN 1 END) >= 3 THEN coalesce(avg(CASE WHEN {LARGE} AND f = 1 THEN bought END), 0.5) - coalesce(avg(CASE WHEN {LARGE} AND f <> 1 THEN bought END), 0.5) END"),
    ("raw_it_broker_poisson_intensity_onesidedness", f"CASE WHEN count(*) >= 20 AND count(CASE WHEN {LARGE} THEN 1 END) >= 5 THEN ({POISSON[1]} - {POISSON[0]}) / ({POISSON[1]} + {POISSON[0]} + 0.000000001) END"),
), "j")

#: Large trades of a kind in order of time; the mean gaps of the first and second half need three of the times only.
TIMED = ("i", f"SELECT *, row_number() OVER (PARTITION BY StockId, Date, f ORDER BY sec, pos) - 1 AS i, count(*) OVER (PARTITION BY StockId, Date, f) AS m, count(*) OVER {D} AS larges FROM v WHERE {LARGE}")


def quickened(k: int) -> str:
    at = lambda place: f"max(CASE WHEN f = {k} AND i = {place} THEN sec END)"
    half, many = "floor((m - 1) / 2)", f"max(CASE WHEN f = {k} THEN m END)"
    middle = f"floor(({many} - 1) / 2)"
    return f"CASE WHEN {many} >= 4 THEN (1.0 * ({at('m - 1')} - {at(half)}) / ({many} - 1 - {middle}) + 0.000000001) / (1.0 * ({at(half)} - {at('0')}) / {middle} + 0.000000001) ELSE 1.0 END"


GAPS = Columns("raw_large_gap_columns", "how gaps between large sells and between large buys change", (T, V75, TIMED, ("g", f"SELECT StockId, Date, max(n) AS n, max(larges) AS larges, {quickened(1)} AS buys, {quickened(0)} AS sells FROM i {BY_DAY}")), (
    ("raw_it_large_trade_iat_asymmetry", "CASE WHEN n >= 30 AND larges >= 6 THEN sells / (buys + 0.000000001) - 1 END"),
), "g", grouped=False)

#: The next ten small ticks within thirty, of each large one that has ten ticks after it: how many move its way, and their size.
_FRAME = "OVER (PARTITION BY StockId, Date ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 30 FOLLOWING)"
DRAG = (
    ("m", "SELECT *, coalesce(sign(dp), 0.0) AS moved, CASE WHEN f = 1 THEN 1.0 ELSE -1.0 END AS side FROM v"),
    ("d", f"SELECT StockId, Date, pos, n, q, q90, side, avg(CASE WHEN q < q90 THEN q END) OVER {D} AS usual, slice(collect_list(CASE WHEN q < q90 THEN struct(moved, 1.0 * q AS q) END) {_FRAME}, 1, 10) AS ten FROM m",
     f"SELECT StockId, Date, pos, n, q, q90, side, avg(CASE WHEN q < q90 THEN q END) OVER {D} AS usual, list_filter(list(CASE WHEN q < q90 THEN {{{{'moved': moved, 'q': 1.0 * q}}}} END) {_FRAME}, lambda x: x IS NOT NULL)[1:10] AS ten FROM m"),
    ("e", "SELECT StockId, Date, q, q90, usual, side * aggregate(ten, 0.0, (a, x) -> a + CASE WHEN x.moved = side THEN 1.0 ELSE 0.0 END) / size(ten) * ln(1 + aggregate(ten, 0.0, (a, x) -> a + x.q) / size(ten) / (usual + 0.0000000001)) AS drag FROM d WHERE q >= q90 AND pos + 10 < n AND size(ten) >= 3",
     "SELECT StockId, Date, q, q90, usual, side * len(list_filter(ten, lambda x: x.moved = side)) / len(ten) * ln(1 + list_sum(list_transform(ten, lambda x: x.q)) / len(ten) / (usual + 0.0000000001)) AS drag FROM d WHERE q >= q90 AND pos + 10 < n AND len(ten) >= 3"),
    ("days", f"SELECT StockId, Date, count(CASE WHEN {LARGE} THEN 1 END) AS larges, avg(CASE WHEN q < q90 THEN q END) AS usual FROM v {BY_DAY}"),
    ("dragged", f"SELECT StockId, Date, count(drag) AS k, avg(drag) AS drag FROM e {BY_DAY}"),
    ("j", "SELECT days.StockId, days.Date, larges, usual, k, drag FROM days LEFT JOIN dragged ON days.StockId = dragged.StockId AND days.Date = dragged.Date"),
)
FOLLOWERS = Columns("raw_follower_columns", "small trades that move the way of a large one before them", (T, V75, *DRAG), (
    ("raw_pol_phonon_drag_coefficient", "CASE WHEN larges >= 3 AND usual >= 0.0000000001 AND k >= 3 THEN drag END"),
), "j", grouped=False)

#: Paths of ticks against their running vwap and among each other.
PATH = ("w0", f"SELECT *, 1.0 * (q - lag(q) {IN_DAY}) AS dv, cum_pq / (cum_q + {E10}) AS rv, sign(max_by(p, pos) OVER {D} - min_by(p, pos) OVER {D}) AS way, pos - 1 AS i FROM t")
NORMED = ("w", f"SELECT *, dp / (stddev_pop(dp) OVER {D} + {E10}) AS y, dv / (stddev_pop(dv) OVER {D} + {E10}) AS z, CASE WHEN dp IS NOT NULL THEN rv / (stddev_pop(CASE WHEN dp IS NOT NULL THEN rv END) OVER {D} + {E10}) END AS x, sign(p - rv) AS side FROM w0")
LATER = ("u", f"SELECT *, lag(x) {IN_DAY} AS x1, lag(y) {IN_DAY} AS y1, lag(z) {IN_DAY} AS z1, CASE WHEN side <> lag(side) {IN_DAY} THEN pos - 1 END AS crossing FROM w")
TURNS = ("r", f"SELECT *, sqrt(power(y1 * z - z1 * y, 2) + power(z1 * x - x1 * z, 2) + power(x1 * y - y1 * x, 2)) AS turn FROM u")


def curve(x: str, i: str, first: int, last: str, many: str) -> str:
    """The mean second difference of the values x at places i, from their first two and last two."""
    at = lambda place: f"max(CASE WHEN {i} = {place} THEN {x} END)"
    return f"({at(last)} - {at(f'{last} - 1')} - {at(first + 1)} + {at(first)}) / ({many} - 2)"


TORUS = ("torus", f"SELECT StockId, Date, max(n) AS n, CASE WHEN max(n) >= 30 THEN {curve('turn', 'pos', 2, 'n - 1', '(max(n) - 2)')} * max(way) ELSE 0.0 END AS torus, max_by(side, pos) AS side, sum(buy) - sum(sell) AS flow FROM r {BY_DAY}")
CROSSED = (
    ("cr", "SELECT StockId, Date, crossing - lag(crossing) OVER (PARTITION BY StockId, Date ORDER BY crossing) AS gap, row_number() OVER (PARTITION BY StockId, Date ORDER BY crossing) - 1 AS c, count(*) OVER (PARTITION BY StockId, Date) AS m FROM u WHERE crossing IS NOT NULL"),
    ("loops", f"SELECT StockId, Date, CASE WHEN max(m) >= 4 THEN 1.0 * {curve('gap', 'c', 1, 'm - 1', '(max(m) - 1)')} END AS looped FROM cr {BY_DAY}"),
)
#: Changes in whole bins: areas of (dp, dv) in bins of 50, and phases of (mean size, echo of dp) in bins of 100.
AREAS = ("areas", f"SELECT StockId, Date, CASE WHEN max(n) >= 50 AND max(floor((n - 1) / 50)) >= 2 THEN sum(CASE WHEN i % 50 > 0 AND i < floor((n - 1) / 50) * 50 THEN 0.5 * (y1 * z - y * z1) END) / max(floor((n - 1) / 50)) ELSE 0.0 END AS area FROM u {BY_DAY}")
PHASES = (
    ("h0", f"SELECT StockId, Date, n, floor(i / 100) AS bin, q, dp, CASE WHEN i % 100 > 0 THEN lag(dp) {IN_DAY} END AS dp1 FROM u"),
    ("h1", f"SELECT StockId, Date, bin, max(floor((n - 1) / 100)) AS bins, atan2(avg(q), greatest(-0.99, least(0.99, {corr('dp1', 'dp', 2)}))) AS phase FROM h0 WHERE dp IS NOT NULL AND bin < floor((n - 1) / 100) GROUP BY StockId, Date, bin"),
    ("phases", f"SELECT StockId, Date, CASE WHEN max(bins) >= 3 THEN {curve('phase', 'bin', 0, 'bins - 1', 'max(bins)')} END AS phased FROM h1 {BY_DAY}"),
)
#: Quarters of an hour from the second tick on: the gap of the eigenvalues of the covariance of scaled changes, and how prices quicken.
QUARTER = (
    ("g0", f"SELECT StockId, Date, n, way, dp, dv, pos, floor((sec - min(sec) OVER {D}) / 900) AS slot FROM (SELECT * FROM w0 WHERE dp IS NOT NULL) AS own"),
    ("g1", f"""SELECT StockId, Date, slot, max(n) AS n, max(way) AS way, count(*) AS k, var_samp(dp) / power(stddev_pop(dp) + {E10}, 2) AS a, var_samp(dv) / power(stddev_pop(dv) + {E10}, 2) AS b, covar_samp(dp, dv) / ((stddev_pop(dp) + {E10}) * (stddev_pop(dv) + {E10})) AS c,
              (max_by(dp, pos) - min_by(dp, pos)) / nullif(count(*) - 1, 0) AS quick FROM g0 GROUP BY StockId, Date, slot"""),
    ("g2", "SELECT *, row_number() OVER (PARTITION BY StockId, Date ORDER BY CASE WHEN k >= 5 THEN 0 ELSE 1 END, round(sqrt(power(a - b, 2) + 4 * c * c), 9), slot) AS nth, count(*) OVER (PARTITION BY StockId, Date) AS slots FROM g1"),
    ("delays", f"SELECT StockId, Date, coalesce(max(CASE WHEN nth = 1 AND k >= 5 AND slots >= 2 AND n >= 30 THEN quick * way END), 0.0) AS delayed FROM g2 {BY_DAY}"),
)
CYCLES = Columns("raw_cycle_columns", "areas, turns and crossings of a day's path", (T, PATH, NORMED, LATER, TURNS, TORUS, *CROSSED, AREAS, *PHASES, *QUARTER, ("j", """SELECT a.StockId, a.Date, a.n, torus, side, flow, looped, area, phased, delayed FROM torus AS a LEFT JOIN loops ON a.StockId = loops.StockId AND a.Date = loops.Date
    LEFT JOIN areas ON a.StockId = areas.StockId AND a.Date = areas.Date LEFT JOIN phases ON a.StockId = phases.StockId AND a.Date = phases.Date LEFT JOIN delays ON a.StockId = delays.StockId AND a.Date = delays.Date""")), (
    ("raw_nld_neimark_sacker_torus", "torus"), ("raw_nld_saddle_loop_divergence", "CASE WHEN n >= 50 THEN coalesce(looped, 0.0) * side ELSE 0.0 END"), ("raw_nld_hysteresis_area", "area"),
    ("raw_nld_critical_slowing_phase_accel", "CASE WHEN n >= 100 THEN coalesce(phased, 0.0) * sign(flow) ELSE 0.0 END"), ("raw_nld_bifurcation_delay_eigen", "coalesce(delayed, 0.0)"),
), "j", grouped=False)

TABLES = (FIFTIES, THIRTIES, ANSWERS, GAPS, FOLLOWERS, CYCLES)
