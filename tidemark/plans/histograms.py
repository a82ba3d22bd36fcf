"""Histograms of prices, smoothed, and their two highest peaks: of a whole day, and of its spans of five minutes.

A histogram has 50 equal bins from the least to the greatest price. Smoothing is by a normal curve of two bins' width,
cut after eight bins and mirrored at the ends: each bin's count goes to the bins around it and around its mirror images,
and sums by bin give the smoothed counts. A peak is higher than the three bins on either side.
"""

from __future__ import annotations

import math

from tidemark.plans.dynamics import ewm, held, mean
from tidemark.plans.feature import Columns
from tidemark.plans.ticks import BY_DAY, T

SIGMA, REACH = 2.0, 8
_RAW = [math.exp(-0.5 * (d / SIGMA) ** 2) for d in range(-REACH, REACH + 1)]
#: The curve's weights by distance, as SQL.
WEIGHT = "CASE abs(d) " + " ".join(f"WHEN {d} THEN {_RAW[REACH + d] / sum(_RAW)!r}" for d in range(REACH + 1)) + " END"
KEY = "StockId, Date, span"


def peaks(ticks: str) -> tuple[tuple[str, ...], ...]:
    """Queries from ticks with a `span` to `modes`: StockId, Date, span, high, low (the mean price twice without two peaks)."""
    place = "least(49, CAST(floor((p - low) * (50.0 / (top - low))) AS INT))"
    moved = lambda images: f"SELECT {KEY}, low, top, k, image + d AS i, {WEIGHT} AS weight FROM (SELECT *, {images}) AS mirrored"
    spread = moved("explode(array(bin, -bin - 1, 99 - bin)) AS image FROM (SELECT *, explode(sequence(-8, 8)) AS d FROM counts) AS near")
    other = moved("unnest([bin, -bin - 1, 99 - bin]) AS image FROM (SELECT *, unnest(range(-8, 9)) AS d FROM counts) AS near")
    frame = lambda a, b: f"OVER (PARTITION BY {KEY} ORDER BY i RANGE BETWEEN {a} AND {b})"
    return (
        ("wide", f"SELECT {KEY}, p, least_ - CASE WHEN least_ = most THEN 0.5 ELSE 0.0 END AS low, most + CASE WHEN least_ = most THEN 0.5 ELSE 0.0 END AS top FROM (SELECT {KEY}, p, min(p) OVER (PARTITION BY {KEY}) AS least_, max(p) OVER (PARTITION BY {KEY}) AS most FROM {ticks}) AS own"),
        # A price within rounding of an edge goes to the bin whose edges, as doubles, hold it.
        ("placed", f"SELECT *, {place} AS at0 FROM wide"),
        ("binned", f"SELECT {KEY}, low, top, at0 + CASE WHEN p < low + at0 * ((top - low) / 50.0) THEN -1 WHEN at0 < 49 AND p >= low + (at0 + 1) * ((top - low) / 50.0) THEN 1 ELSE 0 END AS bin FROM placed"),
        ("counts", f"SELECT {KEY}, low, top, bin, count(*) AS k FROM binned GROUP BY {KEY}, low, top, bin"),
        ("spread", spread, other),
        ("smooth", f"SELECT {KEY}, low, top, i, round(sum(k * weight), 9) AS s FROM spread WHERE i BETWEEN 0 AND 49 GROUP BY {KEY}, low, top, i"),
        ("sided", f"SELECT *, coalesce(max(s) {frame('3 PRECEDING', '1 PRECEDING')}, 0.0) AS left_, coalesce(max(s) {frame('1 FOLLOWING', '3 FOLLOWING')}, 0.0) AS right_ FROM smooth"),
        ("peaked", f"SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY s DESC, i DESC) AS nth FROM sided WHERE i BETWEEN 1 AND 48 AND s > left_ AND s > right_"),
        ("tops", f"SELECT {KEY}, count(*) AS k, max(low + (i + 0.5) * ((top - low) / 50.0)) AS high, min(low + (i + 0.5) * ((top - low) / 50.0)) AS low FROM peaked WHERE nth <= 2 GROUP BY {KEY}"),
        ("modes", f"SELECT m.StockId, m.Date, m.span, CASE WHEN k = 2 THEN high ELSE average END AS mode2, CASE WHEN k = 2 THEN low ELSE average END AS mode1 FROM (SELECT {KEY}, avg(p) AS average FROM {ticks} GROUP BY {KEY}) AS m LEFT JOIN tops AS t ON m.StockId = t.StockId AND m.Date = t.Date AND m.span = t.span"),
    )


S20, N20 = mean(20)
#: How the smoothed running vwap bends in the first and in the second half of the day's ticks.
HALVES = (
    "halves",
    f"""SELECT StockId, Date, n, (a.half - (vs[1] - vs[0]) * 1.0) AS first_, (a.e - a.e1 - a.half) AS second_ FROM (
          SELECT StockId, Date, n, array(vs[0], (vs[1] + (1.0 - 2.0 / 21) * vs[0]) / (1.0 + (1.0 - 2.0 / 21))) AS vs,
                 aggregate(vs, named_struct('top', 0.0, 'w', 0.0, 'e', 0.0, 'e1', 0.0, 'k', 0, 'half', 0.0), (a, x) -> named_struct({S20}, 'e', {N20}, 'e1', a.e, 'k', a.k + 1, 'half', CASE WHEN a.k = CAST(floor(n / 2) AS INT) - 1 THEN {N20} - a.e ELSE a.half END)) AS a
          FROM (SELECT StockId, Date, max(n) AS n, {held('cum_pq / (cum_q + 0.0000000001)')} AS vs FROM t WHERE n >= 50 {BY_DAY}) AS arrays) AS folded""",
    f"""SELECT StockId, Date, max(n) AS n, sum(CASE WHEN pos >= 2 AND pos < floor(n / 2) THEN e - 2 * e1 + e2 END) AS first_, sum(CASE WHEN pos >= floor(n / 2) THEN e - 2 * e1 + e2 END) AS second_ FROM (
          SELECT *, lag(e) OVER (PARTITION BY StockId, Date ORDER BY pos) AS e1, lag(e, 2) OVER (PARTITION BY StockId, Date ORDER BY pos) AS e2 FROM (SELECT *, {ewm('v', 20)} AS e FROM (SELECT *, cum_pq / (cum_q + 0.0000000001) AS v FROM t WHERE n >= 50) AS own) AS smoothed) AS lagged {BY_DAY}""",
)
WHOLE = ("whole", "SELECT *, 0 AS span FROM t")
BENT = ("j", "SELECT d.StockId, d.Date, d.n, mode2, mode1, first_ / nullif(floor(d.n / 2) - 2, 0) AS first_, second_ / (d.n - floor(d.n / 2)) AS second_ FROM (SELECT DISTINCT StockId, Date, n FROM t) AS d LEFT JOIN modes AS m ON d.StockId = m.StockId AND d.Date = m.Date LEFT JOIN halves AS h ON d.StockId = h.StockId AND d.Date = h.Date")
DAY_PEAKS = Columns("raw_peak_columns", "two modes of a day's prices along which its vwap bends", (T, WHOLE, *peaks("whole"), HALVES, BENT), (("raw_nld_stochastic_bifurcation_phase", "CASE WHEN n >= 50 THEN coalesce(mode2 * first_ + mode1 * second_, 0.0) ELSE 0.0 END"),), "j", grouped=False)

#: Spans of five minutes from the day's first second, of twenty ticks at least: two states, above and below the middle of the modes.
SPANS = (
    ("spans", "SELECT *, count(*) OVER (PARTITION BY StockId, Date, span) AS size FROM (SELECT *, floor((sec - min(sec) OVER (PARTITION BY StockId, Date)) / 300) AS span FROM t WHERE n >= 100) AS own"),
    ("full_", "SELECT * FROM spans WHERE size >= 20"),
)
STATES = (
    ("states", "SELECT f.StockId, f.Date, f.span, pos, p, CASE WHEN p >= (mode2 + mode1) / 2 THEN 0 ELSE 1 END AS s FROM full_ AS f JOIN modes AS m ON f.StockId = m.StockId AND f.Date = m.Date AND f.span = m.span"),
    ("moves", f"SELECT *, lag(s) OVER (PARTITION BY {KEY} ORDER BY pos) AS s0, p - 2 * lag(p) OVER (PARTITION BY {KEY} ORDER BY pos) + lag(p, 2) OVER (PARTITION BY {KEY} ORDER BY pos) AS quick FROM states"),
    ("chains", f"SELECT {KEY}, " + ", ".join(f"1.0 + count(CASE WHEN s0 = {a} AND s = {b} THEN 1 END) AS k{a}{b}" for a in (0, 1) for b in (0, 1)) + f", coalesce(avg(CASE WHEN s = 0 THEN quick END), 0.0) AS above, coalesce(avg(CASE WHEN s = 1 THEN quick END), 0.0) AS below FROM moves GROUP BY {KEY}"),
    ("settled", f"SELECT {KEY}, (k10 / (k10 + k11) * above + k01 / (k00 + k01) * below) / (k10 / (k10 + k11) + k01 / (k00 + k01)) AS x FROM chains"),
    ("means", f"SELECT StockId, Date, avg(x) AS x FROM settled {BY_DAY}"),
    ("many", f"SELECT StockId, Date, count(DISTINCT span) AS spans FROM spans {BY_DAY}"),
    ("j", "SELECT d.StockId, d.Date, spans, x FROM (SELECT DISTINCT StockId, Date FROM t) AS d LEFT JOIN many AS m ON d.StockId = m.StockId AND d.Date = m.Date LEFT JOIN means AS v ON d.StockId = v.StockId AND d.Date = v.Date"),
)
SPAN_PEAKS = Columns("raw_span_peak_columns", "two modes of prices in five minutes as states", (T, *SPANS, *peaks("full_"), *STATES), (("raw_nld_bimodal_eigen_proj", "CASE WHEN spans >= 3 THEN coalesce(x, 0.0) ELSE 0.0 END"),), "j", grouped=False)

TABLES = (DAY_PEAKS, SPAN_PEAKS)
