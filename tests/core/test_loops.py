"""Columns of a day's ticks against plain loops over random days of three stocks, on which all of them vary."""

import math

import numpy as np
import pandas as pd
import pytest

from tidemark.plans import bars, bins, dynamics, histograms, marks

E = 1e-10


def ticks_of(seed: int = 7) -> pd.DataFrame:
    rng, out = np.random.default_rng(seed), []
    for stock in ("A", "B", "C"):
        for date, n in ((20240102, 1300), (20240103, 620), (20240104, 240), (20240105, 60), (20240108, 12), (20240109, 1), (20240110, 1100), (20240111, 4), (20240112, 80), (20240115, 2), (20240116, 3)):
            p = np.round(50 + np.cumsum(rng.choice([-0.5, 0, 0, 0.5], n)), 2)
            bid, ask = p - rng.choice([0.0, 0.5, 1.0], n), p + rng.choice([0.0, 0.5], n)
            q = rng.choice([1, 1, 2, 3, 5, 8, 20, 60], n)
            out.append(pd.DataFrame({"StockId": stock, "Date": date, "sec": np.sort(rng.integers(32400, 48600, n)), "p": p, "q": q, "f": rng.choice([0, 1, 2], n, p=[0.45, 0.45, 0.1]), "bid": bid, "ask": ask, "ref": 50.0, "pos": np.arange(n)}))
    return pd.concat(out)


@pytest.fixture(scope="module")
def ticks():
    return ticks_of()


def smoothed(x, span: int) -> np.ndarray:
    """Weighted means of all values so far, one after the other."""
    keep, top, weight, out = 1 - 2 / (span + 1), 0.0, 0.0, []
    for v in x:
        top, weight = top * keep + v, weight * keep + 1
        out.append(top / weight)
    return np.array(out)


def bend(x, span: int) -> float:
    d = np.diff(smoothed(x, span), n=2)
    return float(d.mean()) if len(d) else 0.0


def corr(a, b) -> float:
    return float(np.corrcoef(a, b)[0, 1]) if len(a) >= 2 and np.std(a) > 0 and np.std(b) > 0 else 0.0


def sign(x) -> float:
    return float(np.sign(x))


def rise(d) -> float:
    return sign(d.p.iloc[-1] - d.p.iloc[0])


def scaled(d):
    dp, dv = np.diff(d.p), np.diff(d.q.astype(float))
    return dp, dv, dp / (dp.std() + E), dv / (dv.std() + E)


def crossed(d):
    if len(d) < 30:
        return 0.0
    dp, dv = np.diff(d.p), np.diff(d.q)
    s = smoothed(dp, 5)
    return np.mean([(dp[j - 1] * s[j] - s[j - 1] * dp[j]) * sign(dv[j]) for j in range(2, len(dp))])


def radius(d):
    return bend(np.hypot(*scaled(d)[2:]), 10) * rise(d) if len(d) >= 20 else 0.0


def angle(d):
    _, _, x, y = scaled(d) if len(d) > 1 else (0, 0, 0, 0)
    return bend(np.arctan2(x, y), 10) * rise(d) if len(d) >= 30 else 0.0


def sharpest(d):
    if len(d) < 20:
        return 0.0
    bends = np.diff(smoothed(np.arctan2(np.maximum(d.ask - d.p, 1e-4), np.maximum(d.p - d.bid, 1e-4)), 10), n=2)
    return bends[np.argmax(np.abs(bends))]


def drawn(d):
    if len(d) < 20:
        return 0.0
    side = ((55.0 - d.p) - (d.p - 45.0)).to_numpy() / 10.0
    return float(np.mean(np.diff(smoothed(d.p, 10), n=2) * side[2:]))


def away(d):
    if len(d) < 30:
        return 0.0
    p, t = d.p.to_numpy() / (d.p.std(ddof=0) + E), d.sec.to_numpy()
    gaps = np.diff(t) / (np.diff(t).std() + E)
    out = [math.hypot(p[i + 10] - p[i], gaps[i + 9] if i + 10 < len(p) - 1 else 0) for i in range(len(p) - 10)]
    return bend(out, 10) * rise(d)


def moves(d, size: int) -> np.ndarray:
    return np.diff([g.p.iloc[-1] for _, g in d.groupby(d.pos // size)])


def skew(d):
    dp = moves(d, 20)
    if len(dp) < 20:
        return None
    return pd.Series([dp[i] - smoothed(dp, 20)[i - 1] for i in range(3, len(dp))]).skew()


def drift(d):
    dp = moves(d, 10)
    if len(dp) < 20:
        return None
    e = 0.0
    for x in np.diff(dp, prepend=dp[0]):
        e = 2 / 51 * x + (1 - 2 / 51) * e
    return e / dp.std() if dp.std() >= E else 0.0


def chain(d):
    s = np.where(np.diff(d.p) > 0, 0, np.where(np.diff(d.p) < 0, 2, 1))
    m = np.ones((3, 3))
    for a, b in zip(s[:-1], s[1:]):
        m[a, b] += 1
    return m / m.sum(axis=1, keepdims=True)


def collapse(d):
    if len(d) < 20:
        return 0.0
    values, vectors = np.linalg.eig(chain(d).T)
    v = np.abs(vectors[:, np.argmin(np.abs(values - 1))].real)
    return (v[0] - v[2]) / v.sum()


def hopf(d):
    m = chain(d) if len(d) >= 20 else np.eye(3)
    return max(np.linalg.eigvals(m), key=abs).real * (m[0, 0] - m[2, 2]) if len(d) >= 20 else 0.0


def flow(d):
    return d.q * np.where(d.f == 1, 1, np.where(d.f == 0, -1, 0))


def relax(d):
    least, nf, bin_ = d.q.quantile(0.75), flow(d), d.pos // 50
    large, small = (nf.where(m, 0).groupby(bin_).sum().to_numpy(float) for m in (d.q >= least, d.q < least))
    n = len(large)
    if n < 10:
        return None
    c = [corr(large[: n - k], small[k:]) for k in range(min(4, n // 3) + 1)]
    at = [(k, math.log(abs(x))) for k, x in enumerate(c) if abs(x) > E]
    return -np.polyfit(*zip(*at), 1)[0] * sign(c[1]) if len(at) >= 2 else 0.0


def glass(d):
    s = np.sign(flow(d).groupby(d.pos // 100).sum().to_numpy(float))
    return sum(corr(s[:-k], s[k:]) for k in range(1, 6)) * s.mean() if len(s) >= 10 else None


def fifties(d):
    least, nf = d.q.quantile(0.75), flow(d)
    return [(g, float(nf[g.index][g.q >= least].sum())) for _, g in d.groupby(d.pos // 50)]


def beltrami(d):
    b = fifties(d)
    if len(b) < 5:
        return None
    x, y = np.array([g.p.iloc[-1] - g.p.iloc[0] for g, _ in b]), np.diff([n for _, n in b], prepend=b[0][1])
    return np.clip(x @ y / ((np.linalg.norm(x) + E) * (np.linalg.norm(y) + E)), -1, 1)


def coskewness(d):
    whole = np.average(d.p, weights=d.q)
    v, o = (np.array(x, float) for x in zip(*[(g.q.sum(), (np.average(g.p, weights=g.q) - whole) / whole) for g, _ in fifties(d)]))
    if len(v) < 10:
        return None
    return np.mean((v - v.mean()) ** 2 * (o - o.mean())) / (v.var() * o.std() + E) if o.std() >= E else 0.0


def collapse_of_quotes(d):
    bins_ = [(g.bid.median(), g.ask.median(), g.p.median()) for g, _ in fifties(d)]
    if len(bins_) < 5:
        return None
    steps = [((b[0] - a[0]) / b[2], (b[1] - a[1]) / b[2]) for a, b in zip(bins_, bins_[1:])]
    return sum(max(x, 0) for s in steps for x in s) / (sum(abs(x) for s in steps for x in s) + E)


def work(d):
    rows = []
    for g, _ in fifties(d):
        b, s = g.q[g.f == 1].sum(), g.q[g.f == 0].sum()
        rows.append(((b - s) / (b + s + E), g.p.iloc[-1] - g.p.iloc[0]))
    pull, moved = map(np.array, zip(*rows))
    if np.abs(moved).sum() < E:
        return 0.0
    return (pull * moved).sum() / (np.abs(moved).sum() * np.abs(pull).mean() + E) if len(rows) >= 5 else None


def polarity(d):
    last = np.array([g.p.iloc[-1] for _, g in d.groupby(d.pos // 30)])
    r = np.diff(last) / last[:-1]
    return (r.mean() / (r.std() + E) if r.std() >= E else 0.0) if len(r) >= 10 else None


def creep(d):
    rows = [(g.q[(g.f == 1) & (g.p >= g.ask)].sum(), g.q[(g.f == 0) & (g.p <= g.bid)].sum()) for _, g in d.groupby(d.pos // 30)]
    if len(rows) < 5:
        return None
    u, v = (np.diff(np.array(x, float), n=2).sum() / len(rows) for x in zip(*rows))
    return (u - v) / (abs(u) + abs(v) + E)


def shifted(d):
    g = d[d.q >= d.q.quantile(0.75)]
    heavy = (g.p * g.q).sum() / (g.q.sum() + E)
    return math.log((d.q[d.p > heavy].sum() + E) / (d.q[d.p <= heavy].sum() + E)) if len(d) >= 30 else None


def kubo(d):
    answer, large = d.p.shift(-5) - d.p, d.q >= d.q.quantile(0.9)
    rows = [(answer[large & (d.f == k) & answer.notna()], d.q[large & (d.f == k) & answer.notna()]) for k in (1, 0)]
    if min(len(a) for a, _ in rows) < 3:
        return None
    b, s = (a.mean() / (q.mean() + E) for a, q in rows)
    return (b + s) / (abs(b) + abs(s) + E)


def reversal(d):
    if len(d) < 30:
        return None
    a, m = flow(d).abs().to_numpy(), np.abs(np.diff(d.p, prepend=d.p.iloc[0]))
    f, b = (a * m).sum(), (a[::-1] * m).sum()
    return (f - b) / (f + b + E) * (rise(d) or 1e-5)


def gain(d):
    dp, q = np.diff(d.p), d.q.to_numpy()[1:]
    early = 2 * np.cumsum(q) <= q.sum()
    a, b = dp[early], dp[~early]
    if min(len(a), len(b)) < 20:
        return None
    s, t = a.std() + E, b.std() + E
    return (math.log(t / s) + (s**2 + (a.mean() - b.mean()) ** 2) / (2 * t**2) - 0.5) * (sign(b.mean() - a.mean()) or 1e-5)


def mass(d):
    dp, q = np.diff(d.p), d.q.to_numpy()[1:]
    if dp[dp > 0].sum() < E or -dp[dp < 0].sum() < E:
        return None
    u, v = q[dp > 0].sum() / (dp[dp > 0].sum() + E), q[dp < 0].sum() / (-dp[dp < 0].sum() + E)
    return (v - u) / (v + u + E)


def weighted_moves(d):
    dp = np.diff(d.p)
    if len(dp) < 50:
        return None
    w = np.append(d.q.to_numpy()[2:], 0)
    return (w * dp).sum() / ((w * np.abs(dp)).sum() + E)


def impulse(d):
    large = np.flatnonzero(d.q >= d.q.quantile(0.9))
    if len(d) < 30 or len(large) < 3:
        return None
    f, seen = d.f.to_numpy(), {True: [], False: []}
    for i in large:
        if i + 1 < len(f):
            seen[f[i] == 1].append((f[i + 1 : i + 11] == 1).mean())
    a, b = (np.mean(seen[k]) if seen[k] else 0.5 for k in (True, False))
    return a - b


def onesided(d):
    g = d[d.q >= d.q.quantile(0.9)]
    if len(d) < 20 or len(g) < 5:
        return None
    g = g[g.sec < 45000]
    b, s = ((g.f == k).sum() / 900 * 60 / 14 for k in (1, 0))
    return (b - s) / (b + s + 1e-9)


def gaps(d):
    g = d[d.q >= d.q.quantile(0.9)]
    if len(d) < 30 or len(g) < 6:
        return None

    def speed(t):
        x = np.diff(np.sort(t)).astype(float)
        return 1.0 if len(t) < 4 else (x[len(x) // 2 :].mean() + 1e-9) / (x[: len(x) // 2].mean() + 1e-9)

    return speed(g.sec[g.f == 0]) / (speed(g.sec[g.f == 1]) + 1e-9) - 1


def drag(d):
    q, f, least = d.q.to_numpy(), d.f.to_numpy(), d.q.quantile(0.9)
    s, large = np.sign(np.diff(d.p, prepend=d.p.iloc[0])), q >= least
    if large.sum() < 3 or large.all():
        return None
    out = []
    for i in np.flatnonzero(large):
        ten = [j for j in range(i + 1, min(i + 31, len(q))) if not large[j]][:10]
        if i + 10 < len(q) and len(ten) >= 3:
            side = 1.0 if f[i] == 1 else -1.0
            out.append(np.mean(s[ten] == side) * math.log1p(q[ten].mean() / (q[~large].mean() + E)) * side)
    return np.mean(out) if len(out) >= 3 else None


def torus(d):
    if len(d) < 30:
        return 0.0
    rv = (np.cumsum(d.p * d.q) / (np.cumsum(d.q) + E)).to_numpy()[1:]
    _, _, y, z = scaled(d)
    v = np.column_stack([rv / (rv.std() + E), y, z])
    return np.diff(np.linalg.norm(np.cross(v[:-1], v[1:]), axis=1), n=2).mean() * rise(d)


def loops(d):
    if len(d) < 50:
        return 0.0
    off = d.p - np.cumsum(d.p * d.q) / (np.cumsum(d.q) + E)
    at = np.flatnonzero(np.diff(np.sign(off)))
    return np.diff(np.diff(at), n=2).mean() * sign(off.iloc[-1]) if len(at) >= 4 else 0.0


def area(d):
    _, _, x, y = scaled(d) if len(d) > 1 else (0, 0, np.zeros(0), np.zeros(0))
    n = len(x) // 50
    if len(d) < 50 or n < 2:
        return 0.0
    return np.mean([0.5 * (a[:-1] @ b[1:] - a[1:] @ b[:-1]) for a, b in ((x[k * 50 : k * 50 + 50], y[k * 50 : k * 50 + 50]) for k in range(n))])


def slowing(d):
    dp, q, n = np.diff(d.p), d.q.to_numpy()[1:], (len(d) - 1) // 100
    if len(d) < 100 or n < 3:
        return 0.0
    parts = [slice(k * 100, k * 100 + 100) for k in range(n)]
    phases = [math.atan2(q[s].mean(), np.clip(corr(dp[s][:-1], dp[s][1:]), -0.99, 0.99)) for s in parts]
    return np.diff(phases, n=2).mean() * sign(flow(d).sum())


def delay(d):
    if len(d) < 30:
        return 0.0
    dp, dv, t = np.diff(d.p), np.diff(d.q.astype(float)), d.sec.to_numpy()[1:]
    slots, best = (t - t.min()) // 900, []
    for s in np.unique(slots):
        x, y = dp[slots == s], dv[slots == s]
        if len(x) >= 5:
            e = np.sort(np.abs(np.linalg.eigvalsh(np.cov(x / (x.std() + E), y / (y.std() + E)))))
            best.append((round(e[1] - e[0], 9), s, np.diff(x).mean()))
    return min(best)[2] * rise(d) if best and len(np.unique(slots)) >= 2 else 0.0


def barred(d, key) -> pd.DataFrame:
    """A row for each bar, in order; the first return is none."""
    g = d.groupby(key)
    out = pd.DataFrame({"last": g.p.last(), "vol": g.q.sum(), "buy": d.q.where(d.f == 1, 0).groupby(key).sum(), "sell": d.q.where(d.f == 0, 0).groupby(key).sum(), "value": (d.p * d.q).groupby(key).sum(), "lasted": g.sec.last() - g.sec.first(), "ticks": g.size(), "most": g.q.max()})
    return out.assign(ret=out["last"].pct_change().fillna(0), ofi=out.buy - out.sell)


def by_volume(d):
    return barred(d, d.q.cumsum() // 500)


def by_value(d, size: float = 3e7):
    return barred(d, (d.p * d.q * 1000).cumsum() // size)


def by_ticks(d):
    return barred(d, d.pos // 50)


def safe(x) -> float:
    return 0.0 if x is None or x != x or abs(x) == math.inf else float(x)


def vwap_slope(d):
    y = (lambda b: (b.value / b.vol).to_numpy())(by_volume(d))
    return np.polyfit(np.arange(len(y)), y, 1)[0] / (y.mean() + 1e-8) if len(y) > 2 else 0.0


def vwap_of(d) -> float:
    return (d.p * d.q).sum() * 1000 / (d.q.sum() * 1000 + 1e-5)


def extreme(d):
    b = by_volume(d)
    far = (b.ret >= b.ret.quantile(0.95)) | (b.ret <= b.ret.quantile(0.05))
    return safe(b.lasted[far].mean() / (b.lasted[~far].mean() + 1e-5)) if len(b) > 10 else 0.0


def r2(d):
    y = by_value(d)["last"].to_numpy()
    return corr(np.arange(len(y)), y) ** 2 if len(y) > 5 else 0.0


def fast(d):
    b = by_value(d)
    speed = 1 / (b.lasted + 1e-5)
    return b.ret[speed >= speed.quantile(0.9)].abs().sum() if len(b) > 10 else 0.0


def variance_ratio(d):
    r = by_ticks(d).ret.to_numpy()
    blocks = [r[k : k + 10].sum() for k in range(0, len(r), 10)]
    return safe(np.var(blocks, ddof=1) / 10 / np.var(r, ddof=1)) if len(r) > 10 and np.var(r, ddof=1) > 0 and len(blocks) > 1 else 0.0


def longest(d):
    best = now = 0
    for r in by_ticks(d).ret:
        now = now + 1 if r > 0 else 0
        best = max(best, now)
    return best


def reversals(d):
    s = np.sign(by_ticks(d)["last"].diff().dropna()).tolist()
    return sum(k == 0 or s[k] != s[k - 1] for k in range(len(s))) / len(s) if s else 0.0


def barrier(d):
    v = d.groupby("p").q.sum().reset_index().sort_values(["q", "p"], ascending=[False, True])
    far = v[(v.p - v.p.iloc[0]).abs() / (v.p.iloc[0] + 1e-8) > 0.01]
    if len(v) < 3 or far.empty:
        return 0.0
    low, high = sorted((v.p.iloc[0], far.p.iloc[0]))
    between = v.q[(v.p > low) & (v.p < high)]
    return between.min() / v.q.sum() if len(between) else 0.0


def divergence(d):
    g = d.groupby(((d.sec - 32400) // 1620).clip(0, 9))
    x, y = np.array([np.average(s.p, weights=s.q) for _, s in g]), g.q.sum().to_numpy()
    if len(d) < 30 or len(x) < 5:
        return None
    rank = lambda v: np.argsort(np.argsort(v, kind="stable"), kind="stable").astype(float)
    return corr(rank(x), rank(y))


def conflict(d):
    if len(d) < 30:
        return None
    n, c = len(d), d.q.cumsum()
    t = (d.sec - d.sec.min()) / (d.sec.max() + 1 - d.sec.min()) * 9
    total = 0.0
    for part in (np.minimum(8, np.floor(t)), np.ceil(c * 9.0 / c.iloc[-1]) - 1, np.minimum(8, d.pos // (n // 9))):
        v = [np.average(g.p, weights=g.q) for k, g in d.groupby(part) if k >= 6]
        total += sign(v[-1] - v[0]) if len(v) >= 2 else 0.0
    return (3 - abs(total)) / 2


def escape(d):
    p = d.p.iloc[-1]
    near = max(0.0, min((55.0 - p) / p, (p - 45.0) / p))
    return math.exp(-near * 100 / (d.q.sum() / 1000 + 1e-5)) if near < 0.015 else 0.0


def radiation(d):
    out = 0
    for _, g in d.groupby(d.sec // 60):
        if (g.p.iloc[-1] - g.p.iloc[0]) / g.p.iloc[0] < -0.003:
            out += ((d.q == 1) & (d.sec > g.sec.min() + 60) & (d.sec <= g.sec.min() + 90)).sum()
    return out


def twins(d):
    r = d.groupby(d.sec // 60).p.last().pct_change().fillna(0)
    a, b = ({m - s: x for m, x in r.items() if s <= m < s + 30} for s in (540, 780))
    if min(len(a), len(b)) < 10 or not any(a.values()) or not any(b.values()):
        return 0.0
    return sum(a[k] * b[k] for k in a.keys() & b.keys()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))


def path(d):
    tr, vr = np.diff(d.p, prepend=d.p.iloc[0]) / 50.0, d.q / d.q.mean()
    gained = (d.p.iloc[-1] - d.p.iloc[0]) / (d.p.iloc[0] + 1e-6)
    return tr, vr.to_numpy(), np.where(d.f == 1, 1, np.where(d.f == 0, -1, 0)), gained


def glide(d):
    tr, vr, fs, _ = path(d)
    up, down = (max(vr[fs == s].sum() / (np.abs(tr[tr * s > 0]).sum() + 1e-6), 1e-6) for s in (1, -1))
    return math.log(down / up)


def charge(d):
    _, vr, fs, _ = path(d)
    run, runs = 0, []
    for same_price in d.p.diff().fillna(1 if len(d) else 0) == 0:
        run = run + 1 if same_price else 1
        runs.append(run)
    return (vr * np.array(runs) / len(d) * fs).sum()


def depth(d):
    tr, *_ = path(d)
    return ((d.groupby("p").q.cumsum() - d.q) / d.q.mean() * tr).sum()


def quench(d):
    tr, vr, fs, _ = path(d)
    turned = pd.Series(np.append(0, (np.sign(tr[1:]) * np.sign(tr[:-1]) < 0).astype(float)))
    return (turned.rolling(50, min_periods=1).mean().to_numpy() * vr * fs).sum()


def trapped(d):
    _, vr, _, gained = path(d)
    return (vr / (np.abs(d.p - np.average(d.p, weights=d.q)) / 50.0 + 0.001)).sum() * gained


def resonance(d):
    net = flow(d).groupby(d.sec // 60).sum().to_numpy(float)
    return abs(corr(net[:-1], net[1:])) * net.sum() / (d.q.sum() + 1e-6)


def centroid(d):
    b = d.groupby(d.pos // 20)
    x = b.p.last().diff().fillna(0) * b.q.sum()
    if len(x) < 16:
        return None
    power, f = np.abs(np.fft.rfft(x - x.mean()))[1:] ** 2, np.fft.rfftfreq(len(x))[1:]
    change = b.p.last().iloc[-1] - b.p.last().iloc[0]
    return (f * power).sum() / (power.sum() + E) * (sign(change) or 1e-5)


def modes(p: np.ndarray) -> tuple[float, float]:
    """The higher and the lower of the two highest peaks of a smoothed histogram, or the mean twice."""
    counts, edges = np.histogram(p, bins=50)
    curve = np.exp(-0.5 * (np.arange(-8, 9) / 2.0) ** 2)
    mirrored = np.concatenate((counts[:8][::-1], counts, counts[-8:][::-1]))
    s = np.round(np.convolve(mirrored, curve / curve.sum(), "valid"), 9)
    at = [i for i in range(1, 49) if all(s[i] > s[min(max(i + d, 0), 49)] for k in (1, 2, 3) for d in (-k, k))]
    if len(at) < 2:
        return p.mean(), p.mean()
    top = sorted(sorted(at, key=lambda i: (s[i], i))[-2:])
    middle = (edges[:-1] + edges[1:]) / 2
    return middle[top[1]], middle[top[0]]


def phases(d):
    if len(d) < 50:
        return 0.0
    bends = np.diff(smoothed((d.p * d.q).cumsum() / (d.q.cumsum() + E), 20), n=2)
    half = len(d) // 2 - 2
    high, low = modes(d.p.to_numpy())
    return high * bends[:half].mean() + low * bends[half:].mean()


def states(d):
    span, out = (d.sec - d.sec.min()) // 300, []
    if len(d) < 100 or span.nunique() < 3:
        return 0.0
    for _, g in d.groupby(span):
        p = g.p.to_numpy()
        if len(p) < 20:
            continue
        above, m = p >= sum(modes(p)) / 2, np.ones((2, 2))
        for a, b in zip(1 - above[:-1].astype(int), 1 - above[1:].astype(int)):
            m[a, b] += 1
        m /= m.sum(axis=1, keepdims=True)
        quick = np.diff(p, n=2)
        parts = [quick[w[2:]].mean() if w[2:].any() else 0.0 for w in (above, ~above)]
        out.append((m[1, 0] * parts[0] + m[0, 1] * parts[1]) / (m[1, 0] + m[0, 1]))
    return np.mean(out) if out else 0.0


BARS = {
    "raw_ofi_skew": lambda d: safe(by_volume(d).ofi.skew()), "raw_vwap_trend": vwap_slope, "raw_vb_large_domination": lambda d: (lambda b: (b.most / (b.vol + 1e-5) > 0.3).mean())(by_volume(d)),
    "raw_vb_sell_intensity_var": lambda d: safe(by_volume(d).sell.var()), "raw_vb_pinning_prob": lambda d: (by_volume(d).ret == 0).mean(), "raw_vb_ofi_vol": lambda d: safe(by_volume(d).ofi.std()),
    "raw_vb_vwap_twap_dev": lambda d: vwap_of(d) / (by_volume(d)["last"].mean() + 1e-5) - 1, "raw_vb_close_vwap_dev": lambda d: d.p.iloc[-1] / (vwap_of(d) + 1e-5) - 1, "raw_vb_ext_dur_ratio": extreme,
    "raw_vb_trade_dispersion": lambda d: (lambda b: safe(b.ticks.std() / (b.ticks.mean() + 1e-5)))(by_volume(d)), "raw_vb_absorption_ratio": lambda d: (lambda b: b.vol[b.ret == 0].sum() / (d.q.sum() + 1e-5))(by_volume(d)),
    "raw_db_trend_r2": r2, "raw_db_vpin": lambda d: abs(flow(d).sum()) / (d.q[d.f < 2].sum() + 1e-5), "raw_db_downside_dev": lambda d: (lambda r: math.sqrt((r[r < 0] ** 2).mean()) if (r < 0).any() else 0.0)(by_value(d).ret),
    "raw_db_peak_vel_ratio": lambda d: (lambda v: v.rolling(min(5, len(v)), min_periods=1).sum().max() / (v.mean() + 1e-5))(by_value(d).vol), "raw_db_high_vel_vol": fast, "raw_dbar_vol": lambda d: safe(by_value(d, 5e7).ret.std()),
    "raw_tkb_var_ratio": variance_ratio, "raw_tkb_run_length": longest, "raw_tkb_reversal_freq": reversals, "raw_total_vol_50bin": lambda d: d.q[d.pos < len(d) // 50 * 50].sum(),
    "raw_att_saddle_point_barrier": barrier, "raw_volume_price_divergence": divergence, "raw_trade_skew": lambda d: safe(d.q.skew()) if len(d) >= 5 and d.q.std(ddof=0) > 0 else 0.0, "raw_contextual_momentum_conflict": conflict,
    "raw_dpt_arrhenius_escape_rate": escape, "raw_qit_bremsstrahlung_tick_radiation": radiation, "raw_qit_teleportation_fidelity": twins, "raw_phy_dislocation_glide_climb_bias": glide,
    "raw_phy_neutrino_energy_degradation_regeneration": lambda d: (lambda x: x[1].sum() / (np.abs(x[0]).sum() + 1e-4) * x[3])(path(d)), "raw_phy_tidal_trapping_breakout": trapped, "raw_phy_fractional_charge_excitation": charge,
    "raw_phy_optical_depth_breakthrough": depth, "raw_phy_landau_peierls_quench": quench, "raw_phy_phase_matching_resonance": resonance, "raw_pol_spectral_centroid_shift": centroid,
    "raw_nld_stochastic_bifurcation_phase": phases, "raw_nld_bimodal_eigen_proj": states,
}

LOOPS = BARS | {
    "raw_nld_dtb_singularity_cross": crossed, "raw_nld_limit_cycle_radius_accel": radius, "raw_nld_saddle_node_phase_accel": sharpest, "raw_nld_stochastic_focusing_phase": angle,
    "raw_nld_transient_attractor_proj": drawn, "raw_nld_lyapunov_divergence_accel": away, "raw_sindy_residual_asymmetry": skew, "raw_geo_lyapunov_drift_vector": drift,
    "raw_nld_limit_cycle_collapse_markov": collapse, "raw_nld_hopf_eigen_asymmetry": hopf, "raw_qm_density_offdiag_relaxation": relax, "raw_pvg_spin_glass_susceptibility": glass,
    "raw_mhd_beltrami_alignment": beltrami, "raw_lrt_conjugate_coskewness": coskewness, "raw_crack_liquidity_collapse": collapse_of_quotes, "raw_geo_entropy_directed_work": work,
    "raw_sindy_drift_polarity": polarity, "raw_crack_creep_to_jump": creep, "raw_pvg_high_energy_reference_shift": shifted, "raw_lrt_kubo_response_polarization": kubo,
    "raw_crack_time_reversal_action": reversal, "raw_sindy_phase_transition_gain": gain, "raw_pol_effective_mass_asymmetry": mass, "raw_net_markov_flow_asymmetry": weighted_moves,
    "raw_it_post_event_directional_impulse": impulse, "raw_it_broker_poisson_intensity_onesidedness": onesided, "raw_it_large_trade_iat_asymmetry": gaps, "raw_pol_phonon_drag_coefficient": drag,
    "raw_nld_neimark_sacker_torus": torus, "raw_nld_saddle_loop_divergence": loops, "raw_nld_hysteresis_area": area, "raw_nld_critical_slowing_phase_accel": slowing, "raw_nld_bifurcation_delay_eigen": delay,
}


def same(got, want) -> bool:
    if want is None or want != want:
        return got is None or got != got
    return got is not None and abs(got - want) <= 2e-6 + 1e-6 * abs(want)


@pytest.mark.parametrize("table", dynamics.TABLES + bins.TABLES + bars.TABLES + marks.TABLES + histograms.TABLES, ids=lambda t: t.name)
def test_against_loops(spark, ticks, table):
    made = table(ticks=spark.createDataFrame(ticks.sample(frac=1, random_state=1))).toPandas().set_index(["StockId", "Date"])
    assert len(made) == 33
    for column, *_ in table.columns:
        want = {k: LOOPS[column](d.reset_index(drop=True)) for k, d in ticks.groupby(["StockId", "Date"])}
        got = made[column].to_dict()
        assert all(same(got[k], None if v is None else float(v)) for k, v in want.items()), (column, [(k, got[k], v) for k, v in want.items() if not same(got[k], v)][:3])
        assert len({round(v, 6) for v in want.values() if v is not None and v == v}) > 1, column


def test_small_followers(spark, ticks):
    feature = next(f for f in dynamics.FEATURES if f.name == "f_gt_uninformed_herding_bias")
    many = pd.concat([d.assign(Date=20240000 + k) for k in range(12) for d in [ticks_of(k)] for d in [d[d.Date == 20240103]]])
    got = feature(ticks=spark.createDataFrame(many)).toPandas()
    for stock, days in many.groupby("StockId"):
        half, raw = [d.q.quantile(0.5) for _, d in days.groupby("Date")], []
        for k, (_, d) in enumerate(days.groupby("Date")):
            before = np.roll(np.sign(np.diff(d.p, prepend=d.p.iloc[0])), 1)
            before[0] = 0
            could = (d.q <= np.mean(half[max(0, k - 20) : k])) & (before != 0) if k else d.q < 0
            did = could & (2 * d.f - 1 == before)
            rates = [did[d.pos // 100 == b].sum() / could[d.pos // 100 == b].sum() for b in range((len(d) - 1) // 100 + 1) if could[d.pos // 100 == b].sum()]
            raw.append(np.mean(rates) if rates else 0.0)
        x = pd.Series(raw)
        want = ((x - x.rolling(20, min_periods=10).mean()) / (x.rolling(20, min_periods=10).std() + 1e-8)).fillna(0).clip(-5, 5)
        mine = got[got.StockId == stock].sort_values("Date")[feature.name].to_numpy()
        assert np.allclose(mine, want, atol=2e-6) and len(set(mine)) > 2
