"""The transforms of series.py once more, as SQL text for another engine to check them by."""

from __future__ import annotations


def days(last: int | str) -> str:
    frame = "UNBOUNDED" if last == "all" else str(int(last) - 1)
    return f"OVER (PARTITION BY StockId ORDER BY Date ROWS BETWEEN {frame} PRECEDING AND CURRENT ROW)"


ORDER = "OVER (PARTITION BY StockId ORDER BY Date)"


def rolling_mean(x: str, w: int, m: int | None = None) -> str:
    return f"CASE WHEN count({x}) {days(w)} >= {w if m is None else m} THEN avg({x}) {days(w)} END"


def rolling_std(x: str, w: int, m: int | None = None) -> str:
    return f"CASE WHEN count({x}) {days(w)} >= {w if m is None else m} THEN stddev_samp({x}) {days(w)} END"


def zscore(x: str, w: int = 20, m: int | None = None, eps: float = 1e-8) -> str:
    return f"CASE WHEN count({x}) {days(w)} >= {max(1, w // 2) if m is None else m} THEN ({x} - avg({x}) {days(w)}) / (stddev_samp({x}) {days(w)} + {eps:.12f}) END"


def ewm(x: str, span: int, m: int | None = None) -> str:
    """By cumulative sums with growing weights; fit for series of some hundred days."""
    grow = f"pow({1 / (1 - 2 / (span + 1))!r}, age)"
    least = max(span // 2, 2) if m is None else m
    return f"CASE WHEN count({x}) {days('all')} >= {least} THEN sum({x} * {grow}) {days('all')} / sum(CASE WHEN {x} IS NOT NULL THEN {grow} END) {days('all')} END"


def _weights(span: int) -> tuple[str, str]:
    """Growing weights of the days, the first one's larger by 1 / a, and the frame of all days so far."""
    a = 2 / (span + 1)
    return f"(CASE WHEN age = 1 THEN 1.0 ELSE {a!r} END * pow({1 / (1 - a)!r}, age - 1))", days("all")


def ewm_recursive(x: str, span: int) -> str:
    """By sums of growing weights over all days; fit for series of some hundred days without nulls."""
    w, frame = _weights(span)
    return f"sum({x} * {w}) {frame} / sum({w}) {frame}"


def ewm_recursive_std(x: str, span: int) -> str:
    w, frame = _weights(span)
    total, mean = f"(sum({w}) {frame})", f"({ewm_recursive(x, span)})"
    square = f"(sum({x} * {x} * {w}) {frame} / {total} - {mean} * {mean})"
    return f"CASE WHEN age > 1 THEN sqrt(greatest({square}, 0.0) / (1 - sum({w} * {w}) {frame} / ({total} * {total}))) END"


def pct_rank(x: str, w: int, m: int) -> str:
    held = f"list_filter(list({x}) {days(w)}, lambda y: y IS NOT NULL)"
    return f"CASE WHEN {x} IS NOT NULL AND len({held}) >= {m} THEN (len(list_filter({held}, lambda y: y < {x})) + (len(list_filter({held}, lambda y: y = {x})) + 1) / 2) / len({held}) END"


def ffill(x: str) -> str:
    return f"last_value({x} IGNORE NULLS) {days('all')}"


def shift(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) {ORDER}"


def diff(x: str, k: int = 1) -> str:
    return f"{x} - {shift(x, k)}"


def pct_change(x: str, k: int = 1) -> str:
    return f"{x} / nullif({shift(x, k)}, 0) - 1"


def cumulative(x: str) -> str:
    return f"sum({x}) {days('all')}"


def filled(x: str, value: float = 0.0) -> str:
    return f"coalesce({x}, {value!r})"


def clipped(x: str, low: float, high: float) -> str:
    return f"greatest({low!r}, least({high!r}, {x}))"


def rolling_max(x: str, w: int, m: int | None = None) -> str:
    return f"CASE WHEN count({x}) {days(w)} >= {w if m is None else m} THEN max({x}) {days(w)} END"


def rolling_sum(x: str, w: int, m: int | None = None) -> str:
    return f"CASE WHEN count({x}) {days(w)} >= {w if m is None else m} THEN sum({x}) {days(w)} END"


def rolling_min(x: str, w: int, m: int | None = None) -> str:
    return f"CASE WHEN count({x}) {days(w)} >= {w if m is None else m} THEN min({x}) {days(w)} END"


def rolling_quantile(x: str, w: int, m: int, q: float) -> str:
    return f"CASE WHEN count({x}) {days(w)} >= {m} THEN quantile_cont({x}, {q!r}) {days(w)} END"


def rolling_skew(x: str, w: int, m: int) -> str:
    """By sums of powers over the window."""
    s = lambda k: f"(sum({' * '.join([x] * k)}) {days(w)})"
    n = f"(count({x}) {days(w)} * 1.0)"
    m2 = f"({s(2)} / {n} - power({s(1)} / {n}, 2))"
    m3 = f"({s(3)} / {n} - 3 * {s(1)} / {n} * {s(2)} / {n} + 2 * power({s(1)} / {n}, 3))"
    return f"CASE WHEN {n} >= {max(m, 3)} AND stddev_samp({x}) {days(w)} > 0 THEN {m3} / power({m2}, 1.5) * sqrt({n} * ({n} - 1)) / ({n} - 2) END"


def rolling_corr(x: str, other: str, w: int, m: int) -> str:
    mean = lambda c: f"avg({c}) {days(w)}"
    vx, vy = (f"({mean(f'{c} * {c}')} - {mean(c)} * {mean(c)})" for c in (x, other))
    return f"coalesce(CASE WHEN count({x}) {days(w)} >= {m} AND {vx} > 1e-12 AND {vy} > 1e-12 THEN ({mean(f'{x} * {other}')} - {mean(x)} * {mean(other)}) / sqrt({vx} * {vy}) END, 0.0)"


def rolling_slope(x: str, w: int) -> str:
    """By the regression function of the engine over whole windows."""
    return f"CASE WHEN count({x}) {days(w)} = {w} THEN regr_slope({x}, age) {days(w)} END"


def zscore_transform(x: str, w: int = 20) -> str:
    return clipped(f"coalesce(CASE WHEN count({x}) {days(w)} >= {w} THEN ({x} - avg({x}) {days(w)}) / nullif(stddev_samp({x}) {days(w)}, 0) END, 0.0)", -3.0, 3.0)


def zscore_population(x: str, w: int, m: int, eps: float = 1e-9) -> str:
    return f"CASE WHEN count({x}) {days(w)} >= {m} THEN ({x} - avg({x}) {days(w)}) / (stddev_pop({x}) {days(w)} + {eps:.12f}) END"


def mad_zscore(x: str, median: str, w: int, m: int, eps: float = 1e-8) -> str:
    held = f"list_transform(list_filter(list({x}) {days(w)}, lambda v: v IS NOT NULL), lambda v: abs(v - {median}))"
    return f"CASE WHEN count({x}) {days(w)} >= {m} THEN ({x} - {median}) / (list_aggregate({held}, 'median') + {eps:.12f}) END"


def rank_by_date(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY Date ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY Date, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY Date) END"
