"""Dynamics inside a day: folds over ordered ticks and bins, Markov chains of price moves, lagged correlations.

A recursive mean needs a day's values in order: they are gathered as one array of the stock's day (its size is the
day's own) and folded with a state of a few numbers. The second text of such a query says the same by windows of
growing weights, for another engine to compare with.
"""

from __future__ import annotations

from tidemark.plans.columns import V, csum
from tidemark.plans.feature import Columns, Feature
from tidemark.plans.paths import corr
from tidemark.plans.ticks import BY_DAY, IN_DAY, T, c0, c5, tick
from tidemark.plans.wide import D

E10 = "0.0000000001"
RUN = "OVER (PARTITION BY StockId, Date ORDER BY {} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def held(what: str, order: str = "pos") -> str:
    """A day's values in order, without nulls, as an array."""
    return f"transform(array_sort(collect_list(CASE WHEN ({what}) IS NOT NULL THEN struct({order} AS place, CAST({what} AS DOUBLE) AS x) END)), r -> r.x)"


def mean(span: int) -> tuple[str, str]:
    """How the state (top, w) of a weighted mean with this span goes on with x, and the mean itself then."""
    keep = f"(1.0 - 2.0 / {span + 1})"
    return f"'top', a.top * {keep} + x, 'w', a.w * {keep} + 1", f"((a.top * {keep} + x) / (a.w * {keep} + 1))"


def ewm(what: str, span: int, order: str = "pos") -> str:
    """The weighted mean of all values so far, by sums with growing weights (for the other engine)."""
    grow = f"pow({1 / (1 - 2 / (span + 1))!r}, {order})"
    return f"sum({what} * {grow}) {RUN.format(order)} / sum(CASE WHEN {what} IS NOT NULL THEN {grow} END) {RUN.format(order)}"


def bend(array: str, span: int) -> str:
    """The mean second difference of the smoothed values: that of first differences at both ends, over their number."""
    state, now = mean(span)
    keep = 1 - 2 / (span + 1)
    last = f"aggregate({array}, named_struct('top', 0.0, 'w', 0.0, 'e', 0.0, 'e1', 0.0), (a, x) -> named_struct({state}, 'e', {now}, 'e1', a.e), a -> a.e - a.e1)"
    return f"CASE WHEN size({array}) > 2 THEN ({last} - (({array}[1] + {keep!r} * {array}[0]) / {1 + keep!r} - {array}[0])) / (size({array}) - 2) ELSE 0.0 END"


#: Ticks with changes, the day's deviations and its way.
W0 = ("w0", f"SELECT *, q - lag(q) {IN_DAY} AS dv, sec - lag(sec) {IN_DAY} AS gap, lag(p, 10) {IN_DAY} AS p10, sign(max_by(p, pos) OVER {D} - min_by(p, pos) OVER {D}) AS way, stddev_pop(p) OVER {D} + {E10} AS ps FROM t")
W1 = ("w1", f"SELECT *, stddev_pop(dp) OVER {D} + {E10} AS sp, stddev_pop(dv) OVER {D} + {E10} AS sv, stddev_pop(gap) OVER {D} + {E10} AS st FROM w0")
#: Radius and angle of the change of price and size, angle of the quotes, distance to ten ticks before, place between the price limits (a tenth around the reference price).
W = (
    "w",
    f"""SELECT *, sqrt(power(dp / sp, 2) + power(dv / sv, 2)) AS radius, atan2(dp / sp, dv / sv) AS angle, atan2(greatest(ask - p, 0.0001), greatest(p - bid, 0.0001)) AS quotes,
        CASE WHEN p10 IS NOT NULL THEN sqrt(power((p - p10) / ps, 2) + power(CASE WHEN pos < n - 1 THEN gap / st ELSE 0.0 END, 2)) END AS away,
        (1.1 * ref - p - (p - 0.9 * ref)) / coalesce(nullif(greatest(first_value(0.2 * ref) {IN_DAY}, 0.0), 0.0), 1.0) AS side FROM w1""",
)
S5, N5 = mean(5)
S10, N10 = mean(10)
#: By day: the folds; and once more by windows.
FOLDS = (
    "f",
    f"""SELECT StockId, Date, n, way, radius, angle, away,
        CASE WHEN n >= 30 THEN aggregate(pairs, named_struct('top', 0.0, 'w', 0.0, 's', 0.0, 'd', 0.0, 'k', 0, 'sum', 0.0),
          (a, r) -> named_struct({S5.replace('+ x', '+ r.dp')}, 's', {N5.replace('+ x', '+ r.dp')}, 'd', r.dp, 'k', a.k + 1,
             'sum', a.sum + CASE WHEN a.k >= 2 THEN (a.d * {N5.replace('+ x', '+ r.dp')} - a.s * r.dp) * sign(r.dv) ELSE 0.0 END), a -> a.sum / (a.k - 2)) ELSE 0.0 END AS crossed,
        CASE WHEN size(quotes) = 0 THEN NULL WHEN n >= 20 THEN aggregate(quotes, named_struct('top', 0.0, 'w', 0.0, 'e', 0.0, 'e1', 0.0, 'k', 0, 'best', 0.0),
          (a, x) -> named_struct({S10}, 'e', {N10}, 'e1', a.e, 'k', a.k + 1, 'best', CASE WHEN a.k >= 2 AND abs({N10} - 2 * a.e + a.e1) > abs(a.best) THEN {N10} - 2 * a.e + a.e1 ELSE a.best END), a -> a.best) ELSE 0.0 END AS sharpest,
        CASE WHEN n >= 20 THEN aggregate(sides, named_struct('top', 0.0, 'w', 0.0, 'e', 0.0, 'e1', 0.0, 'k', 0, 'sum', 0.0),
          (a, r) -> named_struct({S10.replace('+ x', '+ r.p')}, 'e', {N10.replace('+ x', '+ r.p')}, 'e1', a.e, 'k', a.k + 1, 'sum', a.sum + CASE WHEN a.k >= 2 THEN ({N10.replace('+ x', '+ r.p')} - 2 * a.e + a.e1) * r.side ELSE 0.0 END), a -> a.sum / (a.k - 2)) ELSE 0.0 END AS drawn
        FROM (SELECT StockId, Date, max(n) AS n, max(way) AS way, {held('radius')} AS radius, {held('angle')} AS angle, {held('away')} AS away, {held('quotes')} AS quotes,
                     array_sort(collect_list(CASE WHEN dp IS NOT NULL THEN struct(pos, CAST(dp AS DOUBLE) AS dp, CAST(dv AS DOUBLE) AS dv) END)) AS pairs,
                     array_sort(collect_list(struct(pos, CAST(p AS DOUBLE) AS p, CAST(side AS DOUBLE) AS side))) AS sides FROM w {BY_DAY}) AS arrays""",
    f"""SELECT StockId, Date, max(n) AS n, max(way) AS way, coalesce(avg(r - 2 * r1 + r2), 0.0) AS radius, coalesce(avg(g - 2 * g1 + g2), 0.0) AS angle, coalesce(avg(y - 2 * y1 + y2), 0.0) AS away,
        CASE WHEN max(n) >= 30 THEN avg(CASE WHEN pos >= 3 THEN (dp1 * s - s1 * dp) * sign(dv) END) ELSE 0.0 END AS crossed, CASE WHEN count(u) = 0 THEN NULL WHEN max(n) >= 20 THEN max_by(u - 2 * u1 + u2, abs(u - 2 * u1 + u2)) ELSE 0.0 END AS sharpest,
        CASE WHEN max(n) >= 20 THEN avg((m - 2 * m1 + m2) * side) ELSE 0.0 END AS drawn
        FROM (SELECT *, {', '.join(f'lag({c}) {IN_DAY} AS {c}1, lag({c}, 2) {IN_DAY} AS {c}2' for c in 'rgyusm')}, lag(dp) {IN_DAY} AS dp1
              FROM (SELECT *, {ewm('radius', 10)} AS r, {ewm('angle', 10)} AS g, CASE WHEN away IS NOT NULL THEN {ewm('away', 10)} END AS y, {ewm('quotes', 10)} AS u, CASE WHEN dp IS NOT NULL THEN {ewm('dp', 5)} END AS s, {ewm('p', 10)} AS m FROM w) AS smooth) AS lagged {BY_DAY}""",
)
BENT = ("g", f"SELECT StockId, Date, n, way, crossed, sharpest, drawn, {', '.join(f'{bend(c, 10)} AS {c}' for c in ('radius', 'angle', 'away'))} FROM f", "SELECT * FROM f")
FOLD_COLUMNS = Columns("raw_fold_columns", "smoothed paths of a day: how they bend and turn", (T, W0, W1, W, FOLDS, BENT), (
    ("raw_nld_dtb_singularity_cross", "crossed"), ("raw_nld_limit_cycle_radius_accel", "CASE WHEN n >= 20 THEN radius * way ELSE 0.0 END"), ("raw_nld_saddle_node_phase_accel", "sharpest"),
    ("raw_nld_stochastic_focusing_phase", "CASE WHEN n >= 30 THEN angle * way ELSE 0.0 END"), ("raw_nld_transient_attractor_proj", "drawn"), ("raw_nld_lyapunov_divergence_accel", "CASE WHEN n >= 30 THEN away * way ELSE 0.0 END"),
), "g", grouped=False)


def last_of(size: int, name: str) -> tuple[tuple[str, str], ...]:
    """Bins of so many ticks, also the last one, with their last price and its change."""
    return ((f"{name}0", f"SELECT StockId, Date, floor(pos / {size}) AS bin, max_by(p, pos) AS last FROM t GROUP BY StockId, Date, floor(pos / {size})"), (name, f"SELECT *, last - lag(last) OVER (PARTITION BY StockId, Date ORDER BY bin) AS dp FROM {name}0"))


IN_BINS = "OVER (PARTITION BY StockId, Date ORDER BY bin)"
S20, N20 = mean(20)
#: Residuals of bins' moves against the mean so far, from the fourth on: their number and the sums of three powers.
RESIDUALS = (
    "residuals",
    f"""SELECT StockId, Date, size(dps) AS n, aggregate(dps, named_struct('top', 0.0, 'w', 0.0, 'e', 0.0, 'k', 0, 's1', 0.0, 's2', 0.0, 's3', 0.0),
          (a, x) -> named_struct({S20}, 'e', {N20}, 'k', a.k + 1, {', '.join(f"'s{k}', a.s{k} + CASE WHEN a.k >= 3 THEN power(x - a.e, {k}) ELSE 0.0 END" for k in (1, 2, 3))})) AS a
        FROM (SELECT StockId, Date, {held('dp', 'bin')} AS dps FROM b20 {BY_DAY}) AS own""",
    f"""SELECT StockId, Date, count(dp) AS n, skewness(CASE WHEN k >= 4 THEN dp - e1 END) AS skew FROM (SELECT *, lag(e) {IN_BINS} AS e1, count(dp) {RUN.format('bin')} AS k FROM (SELECT *, {ewm('dp', 20, 'bin')} AS e FROM b20) AS own) AS late {BY_DAY}""",
)
SKEWED = (
    "skewed",
    """SELECT StockId, Date, CASE WHEN n >= 20 THEN CASE WHEN m2 > 0.00000000000001 THEN m3 / power(m2, 1.5) * sqrt(1.0 * c * (c - 1)) / (c - 2) ELSE 0.0 END END AS skew
       FROM (SELECT *, a.s2 / c - power(a.s1 / c, 2) AS m2, a.s3 / c - 3 * a.s1 / c * a.s2 / c + 2 * power(a.s1 / c, 3) AS m3 FROM (SELECT *, nullif(n - 3, 0) AS c FROM residuals) AS counted) AS moments""",
    "SELECT StockId, Date, CASE WHEN n >= 20 THEN CASE WHEN isfinite(skew) THEN skew ELSE 0.0 END END AS skew FROM residuals",
)
DRIFTS = (
    "drifts",
    f"""SELECT StockId, Date, CASE WHEN size(dps) >= 20 THEN CASE WHEN dev >= {E10} THEN aggregate(dps, named_struct('e', 0.0, 'd', dps[0]), (a, x) -> named_struct('e', 2.0 / 51 * (x - a.d) + (1.0 - 2.0 / 51) * a.e, 'd', x), a -> a.e) / dev ELSE 0.0 END END AS drift
        FROM (SELECT StockId, Date, {held('dp', 'bin')} AS dps, stddev_pop(dp) AS dev FROM b10 {BY_DAY}) AS own""",
    f"""SELECT StockId, Date, CASE WHEN count(dp) >= 20 THEN CASE WHEN stddev_pop(dp) >= {E10} THEN sum((dp - dp1) * pow(1.0 - 2.0 / 51, last_bin - bin)) * 2.0 / 51 / stddev_pop(dp) ELSE 0.0 END END AS drift
        FROM (SELECT *, lag(dp) {IN_BINS} AS dp1, max(bin) OVER {D} AS last_bin FROM b10) AS own {BY_DAY}""",
)
BIN_FOLDS = Columns("raw_bin_fold_columns", "bins' moves against their smoothed past", (T, *last_of(20, "b20"), *last_of(10, "b10"), RESIDUALS, SKEWED, DRIFTS, ("j", "SELECT a.StockId, a.Date, skew, drift FROM skewed AS a JOIN drifts AS b ON a.StockId = b.StockId AND a.Date = b.Date")), (
    ("raw_sindy_residual_asymmetry", "skew"), ("raw_geo_lyapunov_drift_vector", "drift"),
), "j", grouped=False)

#: Large and small flow of bins of 50 ticks, with the small flow of the four bins that follow.
FLOWS = (
    ("v", f"SELECT *, QUANTILE(q, 0.75) OVER {D} AS q75, buy - sell AS nf FROM t"),
    ("flow", "SELECT StockId, Date, floor(pos / 50) AS bin, 1.0 * sum(CASE WHEN q >= q75 THEN nf ELSE 0 END) AS lf, 1.0 * sum(CASE WHEN q < q75 THEN nf ELSE 0 END) AS sf FROM v GROUP BY StockId, Date, floor(pos / 50)"),
    ("ahead", "SELECT *, " + ", ".join(f"lead(sf, {k}) {IN_BINS} AS sf{k}" for k in range(1, 5)) + " FROM flow"),
    ("cs", f"SELECT StockId, Date, count(*) AS n, {corr('lf', 'sf', 2)} AS c0, " + ", ".join(f"{corr('lf', f'sf{k}', 2)} AS c{k}" for k in range(1, 5)) + f" FROM ahead {BY_DAY}"),
    ("ls", "SELECT *, " + ", ".join(f"CASE WHEN abs(c{k}) > {E10} AND n >= {max(10, 3 * k)} THEN ln(abs(c{k})) END AS l{k}" for k in range(5)) + " FROM cs"),
)


def line(xs: range, y: str) -> str:
    """The slope of a line through (x, column y<x>) where the column is not null; 0 for fewer than two points."""
    total = lambda v: "(" + " + ".join(f"CASE WHEN {y}{x} IS NOT NULL THEN {v.format(x=float(x), y=f'{y}{x}')} ELSE 0.0 END" for x in xs) + ")"
    n, sx, sy, sxy, sxx = (total(v) for v in ("1.0", "{x}", "{y}", "{x} * {y}", "{x} * {x}"))
    return f"coalesce(CASE WHEN {n} >= 2 THEN ({n} * {sxy} - {sx} * {sy}) / nullif({n} * {sxx} - {sx} * {sx}, 0) END, 0.0)"


RELAX = f"CASE WHEN n >= 10 THEN -({line(range(5), 'l')}) * sign(c1) END"

#: Moves of a day's prices as states: up 0, even 1, down 2; counts of all nine steps and one more.
STEPS = (
    ("sg", "SELECT StockId, Date, pos, n, CASE WHEN dp > 0 THEN 0 WHEN dp < 0 THEN 2 WHEN dp = 0 THEN 1 END AS s FROM t"),
    ("s1", f"SELECT *, lag(s) {IN_DAY} AS s0 FROM sg"),
    ("nine", "SELECT StockId, Date, max(n) AS n, " + ", ".join(f"1.0 + count(CASE WHEN s0 = {i} AND s = {j} THEN 1 END) AS k{i}{j}" for i in range(3) for j in range(3)) + f" FROM s1 {BY_DAY}"),
    ("chain", "SELECT StockId, Date, n, " + ", ".join(f"k{i}{j} / (k{i}0 + k{i}1 + k{i}2) AS p{i}{j}" for i in range(3) for j in range(3)) + " FROM nine"),
)


def det(m: list[list[str]]) -> str:
    """A determinant as text, by the first row."""
    if len(m) == 1:
        return m[0][0]
    parts = [f"({m[0][j]}) * ({det([r[:j] + r[j + 1 :] for r in m[1:]])})" for j in range(len(m))]
    return " ".join(("+ " if j % 2 == 0 else "- ") + x for j, x in enumerate(parts)).removeprefix("+ ")


def stationary(n: int) -> list[str]:
    """What the stationary shares of a chain with columns p<i><j> are in proportion to: cofactors of I - P."""
    m = [[f"{1.0 if i == j else 0.0} - p{i}{j}" for j in range(n)] for i in range(n)]
    return [f"({det([[m[i][j] for j in range(n) if j != k] for i in range(n) if i != k])})" for k in range(n)]


def settled(weights: list[float]) -> str:
    """The mean of the weights over the stationary shares."""
    pi = stationary(len(weights))
    return f"({' + '.join(f'({w}) * {x}' for w, x in zip(weights, pi))}) / ({' + '.join(pi)})"


CHAINS = Columns("raw_chain_columns", "three states of price moves as a Markov chain", (T, *STEPS), (
    ("raw_nld_limit_cycle_collapse_markov", f"CASE WHEN n >= 20 THEN {settled([1.0, 0.0, -1.0])} ELSE 0.0 END"), ("raw_nld_hopf_eigen_asymmetry", "CASE WHEN n >= 20 THEN p00 - p22 ELSE 0.0 END"),
), "chain", grouped=False)

FEATURES: list[Feature] = [
    tick("f_sindy_residual_asymmetry", "skew of bins' moves against their smoothed past", (*last_of(20, "b20"), RESIDUALS, SKEWED), c0("skew")),
    tick("f_qm_density_offdiag_relaxation", "decay of the correlation of large flow with later small flow", (*FLOWS, ("d", f"SELECT StockId, Date, {RELAX} AS x FROM ls")), c0("x")),
    tick("f_gt_uninformed_herding_bias", "how often small trades follow the price's last move", (
        ("half", f"SELECT StockId, Date, QUANTILE(q, 0.5) AS q50 FROM t {BY_DAY}"),
        ("least", "SELECT StockId, Date, avg(q50) OVER (PARTITION BY StockId ORDER BY Date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS small FROM half"),
        ("m", f"SELECT StockId, Date, pos, n, q, 2 * f - 1 AS way, coalesce(lag(sign(dp)) {IN_DAY}, 0) AS moved FROM t"),
        ("k", "SELECT m.StockId, m.Date, n, small, floor(pos / 100) AS bin, CASE WHEN moved <> 0 AND q <= small THEN 1 END AS could, CASE WHEN moved <> 0 AND q <= small AND way = moved THEN 1 END AS did FROM m JOIN least ON m.StockId = least.StockId AND m.Date = least.Date"),
        ("r", "SELECT StockId, Date, max(n) AS n, max(small) AS small, 1.0 * count(did) / nullif(count(could), 0) AS rate FROM k GROUP BY StockId, Date, bin"),
        ("d", f"SELECT StockId, Date, CASE WHEN max(small) IS NULL OR max(n) < 200 THEN 0.0 ELSE coalesce(avg(rate), 0.0) END AS x FROM r {BY_DAY}")), (("z", "zscore", "x", 20), *c5("z"))),
]

RESPONSES = Columns("raw_response_columns", "spins of bins and how flows answer each other", (T, *FLOWS, ("hundred", f"SELECT StockId, Date, floor(pos / 100) AS bin, sign(1.0 * sum(buy - sell)) AS spin FROM t GROUP BY StockId, Date, floor(pos / 100)"),
    ("later", "SELECT *, " + ", ".join(f"lead(spin, {k}) {IN_BINS} AS spin{k}" for k in range(1, 6)) + " FROM hundred"),
    ("glass", f"SELECT StockId, Date, CASE WHEN count(*) >= 10 THEN ({' + '.join(corr('spin', f'spin{k}', 2) for k in range(1, 6))}) * avg(spin) END AS glass FROM later {BY_DAY}"),
    ("j", f"SELECT ls.StockId, ls.Date, {RELAX} AS relax, glass FROM ls JOIN glass ON ls.StockId = glass.StockId AND ls.Date = glass.Date")), (
    ("raw_qm_density_offdiag_relaxation", "relax"), ("raw_pvg_spin_glass_susceptibility", "glass"),
), "j", grouped=False)

TABLES = (FOLD_COLUMNS, BIN_FOLDS, CHAINS, RESPONSES)
