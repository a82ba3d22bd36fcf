"""Features of trade ticks."""

from __future__ import annotations

from tidemark.plans.feature import Feature

#: Ticks with their place in the day, running sums and the day's totals. Windows by (StockId, Date): one shuffle.
_T = """
SELECT *, p - pp AS dp, sum_pq / tot AS vwap FROM (
  SELECT StockId, Date, sec, p, q, f, bid, ask, ref, pos, CASE WHEN f = 1 THEN q ELSE 0 END AS buy, CASE WHEN f = 0 THEN q ELSE 0 END AS sell,
         lag(p) OVER o AS pp, count(*) OVER d AS n, sum(q) OVER d AS tot, sum(p * q) OVER d AS sum_pq, max(p) OVER d AS high, min(p) OVER d AS low,
         sum(q) OVER r AS cum_q, sum(p * q) OVER r AS cum_pq
  FROM {ticks}
  WINDOW o AS (PARTITION BY StockId, Date ORDER BY pos), d AS (PARTITION BY StockId, Date),
         r AS (PARTITION BY StockId, Date ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS own"""
#: All rows of a day in order: a frame for sums of the day that shares one pass with what looks back along it.
WHOLE_DAY = "(PARTITION BY StockId, Date ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
T = ("t", _T.replace("d AS (PARTITION BY StockId, Date)", f"d AS {WHOLE_DAY}"), _T)
BY_DAY = "GROUP BY StockId, Date"
IN_DAY = "OVER (PARTITION BY StockId, Date ORDER BY pos)"


def c0(column: str) -> tuple[tuple, ...]:
    """Nulls to zero."""
    return (("filled_", "filled", column),)


def c5(column: str) -> tuple[tuple, ...]:
    """Nulls to zero, then within -5 and 5."""
    return (("filled_", "filled", column), ("within_", "clipped", "filled_", -5.0, 5.0))


def day(select: str, source: str = "t") -> tuple[str, str]:
    return ("d", f"SELECT StockId, Date, {select} FROM {source} {BY_DAY}")


def tick(name: str, description: str, queries: tuple, steps: tuple) -> Feature:
    return Feature(name, "single_stock_tick", description, (T, *queries), steps)


Z20, Z42 = (("z", "zscore", "x", 20),), (("z", "zscore", "x", 42),)

FEATURES = [
    tick("f_density_ratio", "volume against its mean over tick count against its mean", (day("CAST(sum(q) AS DOUBLE) AS vol, count(*) * 1.0 AS n"),), (
        ("vol_mean", "rolling_mean", "vol", 20, 5), ("n_mean", "rolling_mean", "n", 20, 5),
        ("x", "sql", "(vol / nullif(vol_mean, 0)) / nullif(n / nullif(n_mean, 0), 0)"), ("value", "filled", "x", 1.0))),
    tick("f_db_downside_deviation", "root mean square of falling dollar bars' returns", (
        ("bar", f"SELECT StockId, Date, floor(cum_pq * 1000 / 30000000) AS bar, max_by(p, pos) AS last FROM t GROUP BY StockId, Date, floor(cum_pq * 1000 / 30000000)"),
        ("ret", "SELECT StockId, Date, last / lag(last) OVER (PARTITION BY StockId, Date ORDER BY bar) - 1 AS r FROM bar"),
        day("coalesce(sqrt(avg(CASE WHEN r < 0 THEN r * r END)), 0.0) AS x", "ret")), (("e", "ewm", "x", 20), *c0("e"))),
    tick("f_imbalance_bar_speed", "rolling rank of the order imbalance", (day("(sum(buy) - sum(sell)) / (sum(q) + 0.00000001) AS x"),), (("r", "pct_rank", "x", 20, 5), *c0("r"))),
    tick("f_integer_level_density", "share of volume at round prices", (day("""sum(CASE WHEN CASE WHEN p < 10 THEN CAST(round(p * 100) AS BIGINT) % 100 WHEN p < 50 THEN CAST(round(p * 20) AS BIGINT) % 10
        WHEN p < 100 THEN CAST(round(p * 10) AS BIGINT) % 10 WHEN p < 500 THEN CAST(round(p * 2) AS BIGINT) % 10 WHEN p < 1000 THEN CAST(round(p) AS BIGINT) % 10
        ELSE CAST(round(p) AS BIGINT) % 50 END = 0 THEN q ELSE 0 END) / (sum(q) + 0.0000000001) AS x"""),), (*Z20, *c0("z"))),
    tick("f_intraday_momentum_decay", "log of the close's distance to the high over that to the low", (
        ("c", f"SELECT StockId, Date, max_by(p, pos) AS last, max(p) AS high, min(p) AS low FROM t {BY_DAY}"),
        ("d", "SELECT StockId, Date, CASE WHEN last > low AND high > last THEN ln((high - last) / (last - low)) ELSE 0.0 END AS x FROM c")), (("e", "ewm", "x", 5), *c0("e"))),
    tick("f_lrt_fd_asymmetry", "fluctuation-dissipation ratio of rises against falls", (
        ("v", "SELECT StockId, Date, dp, dp / (q + 0.0000000001) AS r FROM t WHERE dp IS NOT NULL"),
        ("s", f"""SELECT StockId, Date, count(CASE WHEN dp > 0 THEN 1 END) AS nu, count(CASE WHEN dp < 0 THEN 1 END) AS nd,
           abs(avg(CASE WHEN dp > 0 THEN r END)) / (stddev_samp(CASE WHEN dp > 0 THEN r END) + 0.0000000001) AS ru,
           abs(avg(CASE WHEN dp < 0 THEN r END)) / (stddev_samp(CASE WHEN dp < 0 THEN r END) + 0.0000000001) AS rd FROM v {BY_DAY}"""),
        ("d", "SELECT StockId, Date, CASE WHEN nu >= 10 AND nd >= 10 THEN (ru - rd) / (ru + rd + 0.0000000001) END AS x FROM s")), c0("x")),
    tick("f_mac_kramers_moyal_error", "skew times excess kurtosis of trade sizes", (
        ("m", "SELECT StockId, Date, q - avg(q) OVER (PARTITION BY StockId, Date) AS c FROM t"),
        ("s", f"SELECT StockId, Date, count(*) AS n, avg(c * c) AS m2, avg(c * c * c) AS m3, avg(c * c * c * c) AS m4 FROM m {BY_DAY}"),
        ("d", """SELECT StockId, Date, CASE WHEN n > 3 AND m2 > 0 THEN sqrt(1.0 * n * (n - 1)) / nullif(n - 2, 0) * m3 / (m2 * sqrt(m2))
           * (1.0 * (n - 1) / nullif((n - 2) * (n - 3), 0) * ((n + 1) * (m4 / (m2 * m2) - 3) + 6)) END AS x FROM s""")), c0("x")),
    tick("f_mhd_vortex_asymmetric_contraction", "log ratio of the spread of rises and falls in price and size", (
        ("md", f"SELECT StockId, Date, QUANTILE(abs(dp), 0.5) AS mp, QUANTILE(q, 0.5) AS mq FROM t {BY_DAY}"),
        ("v", "SELECT t.StockId, t.Date, dp, dp / (mp + 0.0000000001) AS a, q / (mq + 0.0000000001) AS b FROM t JOIN md ON t.StockId = md.StockId AND t.Date = md.Date WHERE dp IS NOT NULL"),
        ("s", f"""SELECT StockId, Date, count(CASE WHEN dp > 0 THEN 1 END) AS nu, count(CASE WHEN dp < 0 THEN 1 END) AS nd,
           var_samp(CASE WHEN dp > 0 THEN a END) * var_samp(CASE WHEN dp > 0 THEN b END) - power(covar_samp(CASE WHEN dp > 0 THEN a END, CASE WHEN dp > 0 THEN b END), 2) + 0.0000000001 AS du,
           var_samp(CASE WHEN dp < 0 THEN a END) * var_samp(CASE WHEN dp < 0 THEN b END) - power(covar_samp(CASE WHEN dp < 0 THEN a END, CASE WHEN dp < 0 THEN b END), 2) + 0.0000000001 AS dd FROM v {BY_DAY}"""),
        ("d", "SELECT StockId, Date, CASE WHEN nu >= 30 AND nd >= 30 THEN CASE WHEN du > 0 AND dd > 0 THEN ln(du / dd) ELSE 0.0 END END AS x FROM s")), c0("x")),
    tick("f_mixed_levy_gaussian_dispersion", "share of bought volume at small rises times that at jumps", (
        ("j", "SELECT StockId, Date, buy, CASE WHEN pp > 0 THEN dp / pp ELSE 0.0 END AS r FROM t"),
        day("sum(CASE WHEN r >= 0 AND r <= 0.001 THEN buy ELSE 0 END) / (sum(buy) + 0.00000001) * (sum(CASE WHEN r >= 0.003 THEN buy ELSE 0 END) / (sum(buy) + 0.00000001)) AS x", "j")), (*Z42, *c0("z"))),
    tick("f_qit_incompatible_observables_product", "place of the close in the range times late share of buying", (
        ("s", f"SELECT StockId, Date, max_by(p, pos) AS last, max(p) AS high, min(p) AS low, sum(buy) AS buy, sum(CASE WHEN sec >= 47700 THEN buy ELSE 0 END) AS late FROM t {BY_DAY}"),
        ("d", "SELECT StockId, Date, CASE WHEN high > low THEN (last - low) / (high - low) ELSE 0.5 END * CASE WHEN buy > 0 THEN late / nullif(buy, 0) ELSE 0.0 END AS x FROM s")), (("value", "sql", "x * 1.0"),)),
    tick("f_qm_coarse_graining_loss_bias", "movement lost in five-minute bars, falls against rises", (
        ("b", """SELECT StockId, Date, max_by(p, pos) - min_by(p, pos) AS macro, sum(greatest(coalesce(dp, 0), 0)) AS up, sum(greatest(-coalesce(dp, 0), 0)) AS down
           FROM t GROUP BY StockId, Date, floor(sec / 300)"""),
        day("CASE WHEN count(*) >= 5 THEN (sum(down - greatest(-macro, 0)) - sum(up - greatest(macro, 0))) / (sum(abs(macro)) + 0.0000000001) END AS x", "b")), c0("x")),
    tick("f_momentum_continuity", "share of ticks that rise after a rise", (
        ("u", f"SELECT StockId, Date, pos, CASE WHEN dp > 0 THEN 1 ELSE 0 END AS up, lag(CASE WHEN dp > 0 THEN 1 ELSE 0 END) {IN_DAY} AS before FROM t"),
        day("sum(CASE WHEN up = 1 AND before = 1 THEN 1 ELSE 0 END) * 1.0 / greatest(count(*) - 2, 1) AS x", "u")), (("y", "filled", "x", 0.5), ("z", "zscore", "y", 20, 1), *c0("z"))),
    tick("f_spread_compression", "median spread over median reference price", (
        day("QUANTILE(CASE WHEN bid > 0 AND ask > 0 AND ask >= bid THEN ask - bid END, 0.5) / nullif(QUANTILE(CASE WHEN bid > 0 AND ask > 0 AND ask >= bid THEN ref END, 0.5), 0) AS x"),), (*Z20, *c0("z"))),
    tick("f_tail_session_ofi_zscore", "signed volume after 13:00", (
        day("CASE WHEN count(CASE WHEN sec >= 46800 THEN 1 END) >= 5 THEN sum(CASE WHEN sec >= 46800 THEN buy - sell ELSE 0 END) / (sum(CASE WHEN sec >= 46800 THEN q ELSE 0 END) + 0.0000000001) END AS x"),), (*Z20, *c0("z"))),
    tick("f_tick_entropy_rate", "entropy of three flags in a row", (
        ("g", f"SELECT StockId, Date, f, lead(f) {IN_DAY} AS f1, lead(f, 2) {IN_DAY} AS f2, count(*) OVER (PARTITION BY StockId, Date) AS n FROM t WHERE f IN (0, 1)"),
        ("c", "SELECT StockId, Date, n, count(CASE WHEN f2 IS NOT NULL THEN 1 END) AS k FROM g GROUP BY StockId, Date, n, f, f1, f2"),
        ("w", "SELECT StockId, Date, n, k, sum(k) OVER (PARTITION BY StockId, Date) AS total FROM c WHERE k > 0"),
        ("e", f"SELECT StockId, Date, CASE WHEN max(n) >= 20 THEN -sum(1.0 * k / total * ln(1.0 * k / total)) / ln(2.0) / 3 END AS x FROM w {BY_DAY}"),
        ("d", f"SELECT a.StockId, a.Date, x FROM (SELECT DISTINCT StockId, Date FROM t) AS a LEFT JOIN e ON a.StockId = e.StockId AND a.Date = e.Date")), (*Z20, *c0("z"))),
    tick("f_tick_run_imbalance", "longest run of buys against the longest of sells", (
        ("g", f"SELECT StockId, Date, f, pos, CASE WHEN f = lag(f) {IN_DAY} THEN 0 ELSE 1 END AS turn FROM t WHERE f IN (0, 1)"),
        ("r", f"SELECT StockId, Date, f, sum(turn) OVER (PARTITION BY StockId, Date ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM g"),
        ("l", "SELECT StockId, Date, f, count(*) AS k FROM r GROUP BY StockId, Date, f, run"),
        ("s", f"SELECT StockId, Date, sum(k) AS n, coalesce(max(CASE WHEN f = 1 THEN k END), 0) AS b, coalesce(max(CASE WHEN f = 0 THEN k END), 0) AS s FROM l {BY_DAY}"),
        ("d", "SELECT a.StockId, a.Date, CASE WHEN n >= 20 THEN (b - s) * 1.0 / nullif(b + s, 0) END AS x FROM (SELECT DISTINCT StockId, Date FROM t) AS a LEFT JOIN s ON a.StockId = s.StockId AND a.Date = s.Date")), (("e", "ewm", "x", 5, 1), *c0("e"))),
    tick("f_timebar_am_pm_divergence_ewm20_tsrank_ewm20", "buy share before 10:00 less that after 12:30", (
        day("""coalesce(sum(CASE WHEN sec < 36000 THEN buy END) * 1.0 / nullif(sum(CASE WHEN sec < 36000 THEN q END), 0), 0.5)
           - coalesce(sum(CASE WHEN sec > 45000 THEN buy END) * 1.0 / nullif(sum(CASE WHEN sec > 45000 THEN q END), 0), 0.5) AS x"""),),
        (("e", "ewm", "x", 20), ("e9", "sql", "round(e, 9)"), ("r", "pct_rank", "e9", 120, 60), ("y", "sql", "r - 0.5"), ("s", "ewm", "y", 20), *c0("s"))),
    tick("f_tk_active_sell_above_vwap", "share of sells in the volume above vwap", (
        day("coalesce(sum(CASE WHEN p > vwap THEN sell END) * 1.0 / nullif(sum(CASE WHEN p > vwap THEN q END), 0), 0.0) AS x"),), (("e", "ewm", "x", 3, 1), *c0("e"))),
    tick("f_tkb_reversal_frequency", "changes of direction among bars of 50 ticks", (
        ("b", "SELECT StockId, Date, floor(pos / 50) AS bar, max_by(p, pos) AS last FROM t GROUP BY StockId, Date, floor(pos / 50)"),
        ("m", "SELECT StockId, Date, bar, sign(last - lag(last) OVER (PARTITION BY StockId, Date ORDER BY bar)) AS s FROM b"),
        ("c", "SELECT StockId, Date, s, lag(s) OVER (PARTITION BY StockId, Date ORDER BY bar) AS before FROM m"),
        day("coalesce(sum(CASE WHEN s IS NOT NULL AND (before IS NULL OR s <> before) THEN 1 ELSE 0 END) * 1.0 / nullif(count(s), 0), 0.0) AS x", "c")), (("value", "sql", "x * 1.0"),)),
    tick("f_vwap_gravity_pull", "how the distance to the running vwap follows itself", (
        ("v", "SELECT StockId, Date, pos, n, (p - cum_pq / (cum_q + 0.0000000001)) / (cum_pq / (cum_q + 0.0000000001) + 0.0000000001) AS dev FROM t"),
        ("c", "SELECT StockId, Date, pos, n, dev - avg(dev) OVER (PARTITION BY StockId, Date) AS c FROM v"),
        ("l", f"SELECT StockId, Date, n, c, lag(c) {IN_DAY} AS before FROM c"),
        day("CASE WHEN max(n) >= 30 AND sum(c * c) >= 0.000000000000001 THEN sum(before * c) / nullif(sum(c * c), 0) END AS x", "l")), (("e", "ewm", "x", 5, 1), *c0("e"))),
]

#: The day's own 80th percentile of sizes, and the median of the last 20 days' as it was the day before.
LARGE = (
    ("own", f"SELECT StockId, Date, QUANTILE(q, 0.8) AS q80 FROM t {BY_DAY}"),
    ("rolled", "SELECT StockId, Date, q80, CASE WHEN count(q80) OVER w >= 10 THEN QUANTILE(q80, 0.5) OVER w END AS med FROM own WINDOW w AS (PARTITION BY StockId ORDER BY Date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"),
    ("large", "SELECT StockId, Date, greatest(coalesce(lag(med) OVER (PARTITION BY StockId ORDER BY Date), q80), 1.0) AS least FROM rolled"),
)

FEATURES += [
    tick("f_be_salience_compression_stealth", "large buys in a still bin of 500 ticks", (
        *LARGE,
        ("bin", """SELECT t.StockId, t.Date, sum(CASE WHEN q >= least THEN buy ELSE 0 END) / (coalesce(stddev_samp(p), 0.0) / (avg(p) + 0.00000001) + 0.00000001) AS hidden
           FROM t JOIN large ON t.StockId = large.StockId AND t.Date = large.Date WHERE pos < floor(n / 500) * 500 GROUP BY t.StockId, t.Date, floor(pos / 500)"""),
        day("max(hidden) AS x", "bin")), (("e", "ewm", "x", 5), ("z", "zscore", "e", 42), *c5("z"))),
    tick("f_gt_trust_rebuilding_delay", "buying after the bin of most selling against buying before it", (
        ("bin", "SELECT StockId, Date, floor(pos / 100) AS bin, 1.0 * sum(buy) AS buy, 1.0 * sum(sell) AS sell, max(floor(n / 100)) AS bins FROM t WHERE pos < floor(n / 100) * 100 GROUP BY StockId, Date, floor(pos / 100)"),
        ("s", "SELECT *, first_value(bin) OVER (PARTITION BY StockId, Date ORDER BY sell DESC, bin ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS shock FROM bin"),
        day("CASE WHEN max(bins) >= 7 AND max(shock) >= 1 AND max(shock) + 5 < max(bins) THEN 1 - avg(CASE WHEN bin > shock AND bin <= shock + 5 THEN buy END) / (avg(CASE WHEN bin < shock THEN buy END) + 0.00000001) END AS x", "s")), (*Z20, *c5("z"))),
    tick("f_nld_ei_transition_eigen_dot", "mean moves after buys and others, weighted by how long the flags stay", (
        ("g", f"SELECT StockId, Date, n, dp, CASE WHEN f = 1 THEN 0 ELSE 1 END AS s, lag(CASE WHEN f = 1 THEN 0 ELSE 1 END) {IN_DAY} AS before FROM t"),
        ("c", f"""SELECT StockId, Date, max(n) AS n, 1.0 + count(CASE WHEN before = 0 AND s = 0 THEN 1 END) AS ee, 1.0 + count(CASE WHEN before = 0 AND s = 1 THEN 1 END) AS ei,
           1.0 + count(CASE WHEN before = 1 AND s = 0 THEN 1 END) AS ie, 1.0 + count(CASE WHEN before = 1 AND s = 1 THEN 1 END) AS ii,
           coalesce(avg(CASE WHEN s = 0 THEN dp END), 0.0) AS e, coalesce(avg(CASE WHEN s = 1 THEN dp END), 0.0) AS i FROM g {BY_DAY}"""),
        ("d", "SELECT StockId, Date, CASE WHEN n < 30 THEN 0.0 ELSE (ie / (ie + ii) * e + ei / (ee + ei) * i) / (ie / (ie + ii) + ei / (ee + ei)) END AS x FROM c")), (("z", "zscore", "x", 20, 10, 1e-10), *c5("z"))),
]
