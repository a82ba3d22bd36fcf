"""Columns of a day's price ladder, its slots of time, what follows falls, sums along its ticks, and its spectrum."""

from __future__ import annotations

from tidemark.plans.bars import skewed
from tidemark.plans.bins import way
from tidemark.plans.columns import csum
from tidemark.plans.dynamics import E10, IN_BINS
from tidemark.plans.feature import Columns
from tidemark.plans.paths import MINUTE, corr
from tidemark.plans.ticks import BY_DAY, IN_DAY, T
from tidemark.plans.wide import D

#: Volume by price; the price of most volume, the next one farther than a hundredth, and the least volume between both.
LEVELS = (
    ("levels", "SELECT StockId, Date, p, sum(q) AS vol, count(*) OVER (PARTITION BY StockId, Date) AS k FROM t GROUP BY StockId, Date, p"),
    ("peak", f"SELECT *, sum(vol) OVER {D} AS tot, first_value(p) OVER (PARTITION BY StockId, Date ORDER BY vol DESC, p) AS p1 FROM levels"),
    ("far", "SELECT *, row_number() OVER (PARTITION BY StockId, Date, CASE WHEN abs(p - p1) / (p1 + 0.00000001) > 0.01 THEN 1 ELSE 0 END ORDER BY vol DESC, p) AS nth FROM peak"),
    ("two", f"SELECT *, max(CASE WHEN nth = 1 AND abs(p - p1) / (p1 + 0.00000001) > 0.01 THEN p END) OVER {D} AS p2 FROM far"),
    ("saddle", f"SELECT StockId, Date, CASE WHEN max(k) >= 3 THEN coalesce(1.0 * min(CASE WHEN p > least(p1, p2) AND p < greatest(p1, p2) THEN vol END) / max(tot), 0.0) ELSE 0.0 END AS barrier FROM two {BY_DAY}"),
)


def parted(kind: str, bin_: str) -> tuple[tuple[str, str], ...]:
    """Which way the vwap goes over the last three of nine parts of the day."""
    return (
        (f"{kind}_p", f"SELECT StockId, Date, {bin_} AS part, sum(p * q) / sum(q) AS vwap FROM (SELECT *, min(sec) OVER {D} AS t0, max(sec) OVER {D} AS t1 FROM t) AS own WHERE n >= 18 GROUP BY StockId, Date, {bin_}"),
        (f"{kind}_s", f"SELECT StockId, Date, coalesce(sign(max_by(vwap, part) - min_by(vwap, part)), 0) AS way FROM {kind}_p WHERE part >= 6 {BY_DAY}"),
    )


CONFLICT = (
    *parted("time_", "CASE WHEN t1 > t0 THEN least(8, floor((sec - t0) * 9.0 / (t1 + 1 - t0))) ELSE 0 END"), *parted("size_", "ceil(cum_q * 9.0 / tot) - 1"), *parted("tick_", "least(8, floor(pos / floor(n / 9)))"),
)
#: Ranks of ten slots of the session by vwap and by volume.
SLOTS = (
    ("slots", "SELECT StockId, Date, least(9, greatest(0, floor((sec - 32400) / 1620))) AS slot, sum(p * q) / sum(q) AS vwap, sum(q) AS vol, max(n) AS n FROM t GROUP BY StockId, Date, least(9, greatest(0, floor((sec - 32400) / 1620)))"),
    ("ranks", "SELECT StockId, Date, n, row_number() OVER (PARTITION BY StockId, Date ORDER BY vwap, slot) AS a, row_number() OVER (PARTITION BY StockId, Date ORDER BY vol, slot) AS b FROM slots"),
    ("spear", f"SELECT StockId, Date, CASE WHEN max(n) >= 30 AND count(*) >= 5 THEN 1 - 6.0 * sum(power(a - b, 2)) / (1.0 * count(*) * (count(*) * count(*) - 1)) END AS rho FROM ranks {BY_DAY}"),
)
DAY = ("day", f"SELECT StockId, Date, max(n) AS n, max_by(p, pos) AS last, max_by(ref, pos) AS ref, max(tot) AS tot FROM t {BY_DAY}")
SIZES = ("sizes", f"SELECT StockId, Date, {skewed('q')} AS skew, count(*) AS n FROM (SELECT *, q - avg(1.0 * q) OVER {D} AS q_c FROM t) AS own {BY_DAY}")
JOINED = "SELECT day.*, barrier, rho, skew, coalesce(a.way, 0) AS wa, coalesce(b.way, 0) AS wb, coalesce(c.way, 0) AS wc FROM day " + " ".join(f"LEFT JOIN {t} AS {n} ON day.StockId = {n}.StockId AND day.Date = {n}.Date" for t, n in (("saddle", "s"), ("spear", "r"), ("sizes", "z"), ("time__s", "a"), ("size__s", "b"), ("tick__s", "c")))
NEAR = "least((1.1 * ref - last) / nullif(last, 0), (last - 0.9 * ref) / nullif(last, 0))"
LADDERS = Columns("raw_ladder_shape_columns", "shape of the price ladder and of parts of the day", (T, *LEVELS, *CONFLICT, *SLOTS, DAY, SIZES, ("j", JOINED)), (
    ("raw_att_saddle_point_barrier", "barrier"), ("raw_volume_price_divergence", "rho"), ("raw_trade_skew", "CASE WHEN n >= 5 THEN skew ELSE 0.0 END"), ("raw_contextual_momentum_conflict", "CASE WHEN n >= 30 THEN (3 - abs(wa + wb + wc)) / 2.0 END"),
    ("raw_dpt_arrhenius_escape_rate", f"coalesce(CASE WHEN greatest({NEAR}, 0.0) < 0.015 THEN exp(-greatest({NEAR}, 0.0) * 100 / (tot / 1000.0 + 0.00001)) END, 0.0)"),
), "j", grouped=False)

#: One-lot ticks from 60 to 90 seconds after the first tick of a minute that falls: a frame of seconds, or a join on intervals.
FALLS = (
    ("after", f"SELECT *, count(CASE WHEN q = 1 THEN 1 END) OVER (PARTITION BY StockId, Date ORDER BY sec RANGE BETWEEN 61 FOLLOWING AND 90 FOLLOWING) AS ones, row_number() OVER (PARTITION BY StockId, Date, floor(sec / 60) ORDER BY sec, pos) AS nth, max_by(p, pos) OVER (PARTITION BY StockId, Date, floor(sec / 60)) AS last, min_by(p, pos) OVER (PARTITION BY StockId, Date, floor(sec / 60)) AS first FROM t",
     "SELECT StockId, Date, floor(sec / 60) AS minute, min(sec) AS began, max_by(p, pos) AS last, min_by(p, pos) AS first FROM t GROUP BY StockId, Date, floor(sec / 60)"),
    ("radiated", f"SELECT StockId, Date, sum(CASE WHEN nth = 1 AND (last - first) / nullif(first, 0) < -0.003 THEN ones ELSE 0 END) AS ones FROM after {BY_DAY}",
     "SELECT a.StockId, a.Date, count(t.pos) AS ones FROM after AS a LEFT JOIN t ON a.StockId = t.StockId AND a.Date = t.Date AND t.q = 1 AND t.sec > a.began + 60 AND t.sec <= a.began + 90 AND (a.last - a.first) / a.first < -0.003 GROUP BY a.StockId, a.Date"),
)
#: Returns of the first half hour's minutes against those of the half hour from one o'clock.
TWINS = (
    MINUTE, ("rets", "SELECT StockId, Date, minute, coalesce(last / nullif(lag(last) OVER (PARTITION BY StockId, Date ORDER BY minute), 0) - 1, 0.0) AS ret FROM m"),
    ("pairs", "SELECT StockId, Date, minute - CASE WHEN minute >= 780 THEN 780 ELSE 540 END AS place, max(CASE WHEN minute < 570 THEN ret END) AS early, max(CASE WHEN minute >= 780 THEN ret END) AS late FROM rets WHERE minute >= 540 AND minute < 570 OR minute >= 780 AND minute < 810 GROUP BY StockId, Date, minute - CASE WHEN minute >= 780 THEN 780 ELSE 540 END"),
    ("twins", f"SELECT StockId, Date, CASE WHEN count(early) >= 10 AND count(late) >= 10 THEN coalesce(sum(early * late) / nullif(sqrt(sum(early * early)) * sqrt(sum(late * late)), 0), 0.0) ELSE 0.0 END AS alike FROM pairs {BY_DAY}"),
)
FALLING = Columns("raw_after_fall_columns", "small trades after falls, and minutes that repeat others", (T, *FALLS, *TWINS, ("j", "SELECT a.StockId, a.Date, ones, coalesce(alike, 0.0) AS alike FROM radiated AS a LEFT JOIN twins AS b ON a.StockId = b.StockId AND a.Date = b.Date")), (
    ("raw_qit_bremsstrahlung_tick_radiation", "ones"), ("raw_qit_teleportation_fidelity", "alike"),
), "j", grouped=False)

#: Ticks with returns on the reference price, sizes on the day's mean, signs, runs at one price, and what was traded at the price before.
SUMMED = (
    ("s0", f"SELECT *, coalesce(dp, 0.0) / coalesce(nullif(ref, 0), 1.0) AS tr, q / nullif(avg(1.0 * q) OVER {D}, 0) AS vr, CASE f WHEN 1 THEN 1 WHEN 0 THEN -1 ELSE 0 END AS fs, sum(q) OVER (PARTITION BY StockId, Date, p ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - q AS deep, avg(1.0 * q) OVER {D} AS mean_q, sum(CASE WHEN dp <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY StockId, Date ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block FROM t"),
    ("s1", f"SELECT *, row_number() OVER (PARTITION BY StockId, Date, block ORDER BY pos) AS run, CASE WHEN sign(tr) * lag(sign(tr)) {IN_DAY} < 0 THEN 1.0 ELSE 0.0 END AS turned, max_by(p, pos) OVER {D} AS close, min_by(p, pos) OVER {D} AS open FROM s0"),
    ("s2", "SELECT *, avg(turned) OVER (PARTITION BY StockId, Date ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS turning FROM s1"),
)
RESIST = {k: f"greatest(sum(CASE WHEN f = {f} THEN vr ELSE 0.0 END) / ({csum(c, 'abs(tr)')} + 0.000001), 0.000001)" for k, f, c in (("up", 1, "tr > 0"), ("down", 0, "tr < 0"))}
GAIN = "(max(close) - max(open)) / (coalesce(nullif(max(open), 0), 1.0) + 0.000001)"
SUMS = Columns("raw_sum_columns", "sums of scaled returns, sizes and signs along a day", (T, *SUMMED), (
    ("raw_phy_dislocation_glide_climb_bias", f"ln({RESIST['down']} / {RESIST['up']})"), ("raw_phy_neutrino_energy_degradation_regeneration", f"sum(vr) / (sum(abs(tr)) + 0.0001) * {GAIN}"),
    ("raw_phy_tidal_trapping_breakout", f"sum(vr / (abs(p - vwap) / coalesce(nullif(ref, 0), 1.0) + 0.001)) * {GAIN}"), ("raw_phy_fractional_charge_excitation", "sum(vr * run / n * fs)"),
    ("raw_phy_optical_depth_breakthrough", "sum(deep / nullif(mean_q, 0) * tr)"), ("raw_phy_landau_peierls_quench", "sum(turning * vr * fs)"),
), "s2")
ECHO = (
    ("net", "SELECT StockId, Date, floor(sec / 60) AS minute, 1.0 * sum(buy - sell) AS net, sum(q) AS vol FROM t GROUP BY StockId, Date, floor(sec / 60)"),
    ("net1", "SELECT *, lag(net) OVER (PARTITION BY StockId, Date ORDER BY minute) AS net1 FROM net"),
)
ECHOES = Columns("raw_echo_columns", "how a minute's net buying follows the last one's", (T, *ECHO), (("raw_phy_phase_matching_resonance", f"abs({corr('net1', 'net', 2)}) * sum(net) / (sum(vol) + 0.000001)"),), "net1")

#: Moves of bins of 20 ticks times their volume, without their mean; power at each frequency by its definition.
MOMENTA = (
    ("mo", "SELECT StockId, Date, floor(pos / 20) AS bin, max_by(p, pos) AS last, sum(q) AS vol FROM t GROUP BY StockId, Date, floor(pos / 20)"),
    ("mo1", f"SELECT *, coalesce(last - lag(last) {IN_BINS}, 0.0) * vol AS momentum FROM mo"),
    ("mo2", f"SELECT *, momentum - avg(momentum) OVER {D} AS x, count(*) OVER {D} AS n, max_by(last, bin) OVER {D} - min_by(last, bin) OVER {D} AS rise FROM mo1"),
)
TURN = "2 * pi() * k * b.bin / b.n"
POWER = (
    "power",
    f"""SELECT StockId, Date, n, rise, aggregate(waves, 0.0, (a, w) -> a + w.power) AS total, aggregate(waves, 0.0, (a, w) -> a + w.power * w.k / n) AS weighted FROM (
          SELECT *, transform(sequence(1, greatest(1, CAST(n / 2 AS INT))), k -> struct(k, power(aggregate(transform(xs, (x, i) -> x * cos(2 * pi() * k * i / n)), 0.0, (a, x) -> a + x), 2) + power(aggregate(transform(xs, (x, i) -> x * sin(2 * pi() * k * i / n)), 0.0, (a, x) -> a + x), 2) AS power)) AS waves
          FROM (SELECT StockId, Date, max(n) AS n, max(rise) AS rise, transform(array_sort(collect_list(struct(bin, x))), r -> r.x) AS xs FROM mo2 {BY_DAY}) AS arrays) AS spectra""",
    f"""SELECT StockId, Date, max(n) AS n, max(rise) AS rise, sum(power) AS total, sum(power * k / n) AS weighted FROM (
          SELECT b.StockId, b.Date, max(b.n) AS n, max(b.rise) AS rise, k, power(sum(b.x * cos({TURN})), 2) + power(sum(b.x * sin({TURN})), 2) AS power
          FROM mo2 AS b JOIN (SELECT DISTINCT StockId, Date, unnest(range(1, greatest(1, n // 2) + 1)) AS k FROM mo2) AS f ON b.StockId = f.StockId AND b.Date = f.Date GROUP BY b.StockId, b.Date, k) AS waves {BY_DAY}""",
)
SPECTRA = Columns("raw_spectral_columns", "where the power of bins' moves lies", (T, *MOMENTA, POWER), (("raw_pol_spectral_centroid_shift", f"CASE WHEN n >= 16 THEN CASE WHEN total < {E10} THEN 0.0 ELSE weighted / (total + {E10}) * {way('rise')} END END"),), "power", grouped=False)

TABLES = (LADDERS, FALLING, SUMS, ECHOES, SPECTRA)
