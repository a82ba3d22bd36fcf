"""Broker features and columns against plain loops over random fills of three stocks."""

import numpy as np
import pandas as pd
import pytest

from tests.core.test_loops import ticks_of
from tidemark.plans import leaders, pairs, quiet

E9 = 1e-9


@pytest.fixture(scope="module")
def tables():
    rng, fills, ticks = np.random.default_rng(3), [], []
    for s, stock in enumerate("ABC"):
        for k in range((95, 70, 4)[s]):
            date, n = 20240101 + k, int(rng.integers(1, 60)) if k % 9 and k not in (94, 69) else 2 if k % 9 == 0 else 40
            p = np.round(50 + rng.choice([-0.1, 0, 0.1], max(n, 30)).cumsum(), 2)
            of = rng.integers(1000, 1012 if k < 60 else 1007, n)
            fills.append(pd.DataFrame({"StockId": stock, "Date": date, "BrokerId": [f"B{x}" for x in of], "Price": rng.choice(p, n), "BuyQtm": rng.integers(0, 30, n) * (rng.random(n) < 0.7), "SellQtm": rng.integers(0, 30, n) * (rng.random(n) < 0.6)}))
            m = len(p) * 4
            ticks.append(pd.DataFrame({"StockId": stock, "Date": date, "sec": np.sort(rng.integers(32400, 48600, m)), "p": rng.choice(p, m), "q": rng.integers(1, 20, m), "f": rng.choice([0, 1, 2], m, p=[0.35, 0.5, 0.15]), "bid": 1.0, "ask": 1.0, "ref": 50.0, "pos": np.arange(m)}))
    brokers = pd.concat(fills).groupby(["StockId", "Date", "BrokerId", "Price"], as_index=False).sum()
    return brokers, pd.concat(ticks)


def series(feature, spark, brokers, ticks=None) -> dict:
    given = {"brokers": spark.createDataFrame(brokers)} | ({"ticks": spark.createDataFrame(ticks)} if ticks is not None else {})
    out = feature(**given).toPandas().sort_values("Date")
    return {s: g[feature.name].to_numpy() for s, g in out.groupby("StockId")}


def by_name(name: str):
    return next(f for f in leaders.FEATURES + quiet.FEATURES if f.name == name)


def z(x: list, w: int = 20, m: int = 10, eps: float = 1e-8, clip: bool = True) -> np.ndarray:
    s = pd.Series(x, dtype=float)
    out = ((s - s.rolling(w, min_periods=m).mean()) / (s.rolling(w, min_periods=m).std() + eps)).fillna(0)
    return (out.clip(-5, 5) if clip else out).to_numpy()


def days_of(brokers: pd.DataFrame, stock: str):
    for date, d in brokers[brokers.StockId == stock].groupby("Date"):
        a = d.groupby("BrokerId")[["BuyQtm", "SellQtm"]].sum()
        yield date, d, a.BuyQtm - a.SellQtm, a.BuyQtm + a.SellQtm, a.BuyQtm


def test_symmetry(spark, tables):
    got = series(by_name("f_nld_symmetry_restoring_eigen"), spark, tables[0])
    assert set(got) == {"A", "B"}  # four days are too few
    for stock in got:
        values = []
        for _, d, net, vol, buy in days_of(tables[0], stock):
            lead = vol.reset_index().sort_values([0, "BrokerId"], ascending=[False, True]).BrokerId[:5]
            a, c = (x.clip(lower=0).sum() + 1 for x in (net[lead], net.drop(lead)))
            b, e = ((-x).clip(lower=0).sum() + 1 for x in (net[lead], net.drop(lead)))
            values.append(max(np.linalg.eigvals(np.array([[a, b], [c, e]]) / (a + b + c + e)), key=abs).real if len(d) >= 3 else 0.0)
            tail = np.sign(buy.sort_values(ascending=False)[5:].sum()) if len(d) > 5 else 0
        bend = pd.Series(values).ewm(span=3, min_periods=1).mean().diff().diff()
        assert np.allclose(got[stock], z((bend * tail).fillna(0), eps=1e-10), atol=2e-5)
    assert len({x for v in got.values() for x in v}) > 5


def test_avalanche(spark, tables):
    got = series(by_name("f_nld_avalanche_markov_eigen_proj"), spark, tables[0])
    assert set(got) == {"A", "B"}
    for stock in got:
        up = [int(len(d) >= 3 and net.sum() > 0) for _, d, net, *_ in days_of(tables[0], stock)]
        states = [0] + [2 * a + b for a, b in zip(up, up[1:])]
        raw = []
        for i in range(len(states)):
            w, m = states[max(0, i - 19) : i + 1], np.ones((4, 4))
            for a, b in zip(w, w[1:]):
                m[a, b] += 1
            values, vectors = np.linalg.eig((m / m.sum(axis=1, keepdims=True)).T)
            v = np.abs(vectors[:, np.argmin(np.abs(values - 1))].real)
            raw.append(v @ [-1, -0.5, 0.5, 1] / v.sum() if len(w) >= 5 else 0.0)
        assert np.allclose(got[stock], z(raw, eps=1e-10), atol=2e-5) and len(set(got[stock])) > 5


def test_popular_against_expert(spark, tables):
    got = series(by_name("f_gt_expert_vs_popular_divergence"), spark, tables[0])
    for stock in got:
        d = tables[0][tables[0].StockId == stock]
        net, vol = (d.assign(x=x).pivot_table(index="Date", columns="BrokerId", values="x", aggfunc="sum", fill_value=0).sort_index() for x in (d.BuyQtm - d.SellQtm, d.BuyQtm + d.SellQtm))
        v5, n60, seen, raw = vol.rolling(5, min_periods=1).sum(), net.rolling(60, min_periods=1).sum(), (net.notna() & (vol >= 0)), []
        traded = d.assign(x=1).pivot_table(index="Date", columns="BrokerId", values="x", aggfunc="sum", fill_value=0).sort_index().rolling(60, min_periods=1).sum() > 0
        for date in net.index:
            order = lambda x: sorted(x.index, key=lambda b: (-x[b], not traded.loc[date, b], b))
            popular = order(v5.loc[date])[:3]
            expert = order(n60.loc[date].drop(popular))[:3]
            a, b = net.loc[date, popular].sum(), net.loc[date, expert].sum()
            raw.append(abs(a - b) if a > 0 and b < 0 else 0.0)
        assert np.allclose(got[stock], z(raw), atol=2e-5), stock
        assert stock == "C" or len(set(got[stock])) > 5


def quiet_of(fills: pd.DataFrame, t: pd.DataFrame) -> dict:
    t = t.assign(bar=t.sec // 300, jump=(t.p.diff().abs() / t.p.shift()).fillna(0), bought=t.q.where(t.f == 1, 0))
    bars = t.groupby("bar").agg(vol=("q", "sum"), bought=("bought", "sum"), jump=("jump", "max"))
    calm = bars.index[(bars.vol < bars.vol.mean()) & (bars.jump < bars.jump.mean())]
    late = (t.sec >= 46800) & t.bar.isin(bars.index[bars.jump < bars.jump.mean()])
    whole = t.groupby("p").q.sum() + 1e-8
    share = {k: (t[m].groupby("p").q.sum() / whole).fillna(0) for k, m in (("burst", t.bar == bars.bought.idxmax()), ("calm", t.bar.isin(calm)), ("late", late))}
    met = fills[fills.Price.isin(whole.index)]
    met = met.assign(**{k: met.BuyQtm * met.Price.map(v) for k, v in share.items()}).groupby("BrokerId").sum(numeric_only=True)
    size = (met.BuyQtm + met.SellQtm).reset_index(name="v").sort_values(["v", "BrokerId"]).BrokerId
    rank = pd.Series(np.arange(1, len(size) + 1) / len(size), index=size.to_numpy())[met.index]
    top10, top5 = met[(rank >= 0.9) & (met.BuyQtm > 0)], met[(rank >= 0.95) & (met.BuyQtm > 0)]
    rest, b = met.drop(top5.index), top10.burst
    return {"raw_top10_refuge_ratio": top10.calm.sum() / (top10.BuyQtm.sum() + 1), "raw_burst_hhi_top10": (b**2).sum() / b.sum() ** 2 if b.sum() else 0.0, "raw_top5_quiet_ratio": top5.late.sum() / (top5.BuyQtm.sum() + 1), "raw_rest_quiet_ratio": rest.late.sum() / (rest.BuyQtm.sum() + 1)}


def test_quiet_bars(spark, tables):
    brokers, ticks = tables
    made = quiet.REFUGE(brokers=spark.createDataFrame(brokers), ticks=spark.createDataFrame(ticks)).toPandas().set_index(["StockId", "Date"])
    want = {k: quiet_of(d, ticks[(ticks.StockId == k[0]) & (ticks.Date == k[1])].reset_index(drop=True)) for k, d in brokers.groupby(["StockId", "Date"])}
    frame = pd.DataFrame(want).T
    assert len(made) == len(frame)
    for c in frame:
        assert np.allclose(made[c].reindex(frame.index), frame[c], atol=2e-6) and frame[c].nunique() > 5, c
    got = series(by_name("f_inverse_allee_refuge_accumulation"), spark, brokers, ticks)
    assert np.allclose(got["A"], z(frame.loc["A"].sort_index().raw_top10_refuge_ratio.tolist(), 42, 21, clip=False), atol=2e-5)


EDGES = [-0.6, -0.2, 0.2, 0.6]


def spread_of(d: pd.DataFrame) -> dict:
    a = d.groupby("BrokerId")[["BuyQtm", "SellQtm"]].sum()
    a = a[a.sum(axis=1) > 0]
    vol, net = a.sum(axis=1), (a.BuyQtm - a.SellQtm) / a.sum(axis=1)
    big = vol >= vol.quantile(0.8)
    dist = lambda x: (np.bincount(np.searchsorted(EDGES, x), minlength=5) + 1e-3) / (len(x) + 5e-3) if len(x) else None
    few = big.sum() < 2
    b = a[big]
    return {"raw_dist_big": dist(net[big]), "raw_dist_small": dist(net[~big]), "raw_broker_weights_big": [1.0] if few else vol[big] / vol[big].sum(), "raw_broker_nets_big": [0.0] if few else net[big], "x": (b.BuyQtm.sum() - b.SellQtm.sum()) / (b.to_numpy().sum() + E9)}


def alike(got, want) -> bool:
    return got is None and want is None or got is not None and want is not None and np.allclose(np.array(got, float), np.array(want, float), atol=1e-9)


def test_spreads_and_their_history(spark, tables):
    brokers, ticks = tables
    given = {"brokers": spark.createDataFrame(brokers), "ticks": spark.createDataFrame(ticks)}
    made = {(r.StockId, r.Date): r for r in quiet.SPREADS(**given).collect()}
    deviations = series(by_name("f_it_broker_distribution_hist_deviation"), spark, brokers, ticks)
    for stock in "AB":
        rows = [(date, spread_of(d)) for date, d in brokers[brokers.StockId == stock].groupby("Date") if d[["BuyQtm", "SellQtm"]].to_numpy().sum() > 0]
        xs, up = [r["x"] for _, r in rows], [(ticks[(ticks.StockId == stock) & (ticks.Date == date)].f == 1).mean() for date, _ in rows]
        for i, (date, r) in enumerate(rows):
            got = made[stock, date]
            assert all(alike(got[c], r[c]) for c in r if c != "x")
            assert alike(got.raw_net_ratio_hist_20d, xs[i - 20 : i] if i >= 20 else None) and alike(got.raw_net_ratio_hist_60d, xs[i - 59 : i + 1] if i >= 59 else None)
            before = [q["raw_dist_big"] for _, q in rows[max(0, i - 60) : i] if q["raw_dist_big"] is not None]
            mean = np.mean(before, axis=0) if i >= 20 and len(before) >= 30 else None
            assert alike(got.raw_dist_big_hist_60d, None if mean is None else mean / (mean.sum() + E9))
            b, y = [int(x > 0) for x in xs[max(0, i - 20) : i]], [int(x > 0.5) for x in up[max(0, i - 20) : i]]
            want = None
            if i >= 20 and 2 <= sum(b) <= 18:
                full, base = np.full((4, 2), 1e-3), np.full((2, 2), 1e-3)
                for t in range(1, 20):
                    full[2 * b[t - 1] + y[t - 1], y[t]] += 1
                    base[y[t - 1], y[t]] += 1
                full, base = full / full.sum(axis=1, keepdims=True), base / base.sum(axis=1, keepdims=True)
                want = max(0.0, sum(np.log(full[2 * b[t - 1] + y[t - 1], y[t]] / base[y[t - 1], y[t]]) for t in range(1, 20)) / 19)
            assert (got.raw_di_series is None) == (want is None) and (want is None or abs(got.raw_di_series - want) < 2e-6)
            deviation = 0.0
            if i >= 20:
                h = np.array(xs[i - 20 : i])
                p, q = np.exp(-0.5 * ((xs[i] - np.array([-0.8, -0.4, 0, 0.4, 0.8])) / 0.3) ** 2) + 1e-3, np.bincount(np.searchsorted(EDGES, h), minlength=5) + 1e-3
                p, q = p / p.sum() + E9, q / q.sum() + E9
                deviation = (p / p.sum() * np.log(p / p.sum() / (q / q.sum()))).sum() * np.tanh((xs[i] - h.mean()) / (h.std() + E9))
            assert abs(deviations[stock][i] - deviation) < 2e-5
        assert len({got.raw_di_series for got in made.values()}) > 5


def test_segments_and_feedback(spark, tables):
    _, ticks = tables
    some = pd.concat([ticks[ticks.StockId == "A"][lambda d: d.Date < 20240110], ticks[(ticks.StockId == "C")].groupby("Date").head(15)])
    frame = spark.createDataFrame(some)
    segments = {(r.StockId, r.Date): r for r in quiet.SEGMENTS(ticks=frame).collect()}
    skews = {(r.StockId, r.Date): r.raw_feedback_capacity_skew for r in quiet.FEEDBACK(ticks=frame).collect()}
    h = lambda p: -(p * np.log2(p) + (1 - p) * np.log2(1 - p)) if (p := min(max(p, E9), 1 - E9)) else 0.0
    for k, d in some.groupby(["StockId", "Date"]):
        parts = [d[(d.sec >= 32400 + s * 1800) & (d.sec < 34200 + s * 1800)] for s in range(8)]
        fine = [len(d) >= 20 and len(g) >= 3 for g in parts]
        for got, f in ((segments[k].raw_tick_segments_h, lambda g: h((g.f == 1).mean())), (segments[k].raw_tick_segments_vwap, lambda g: (g.p * g.q).sum() / (g.q.sum() + E9))):
            assert [x is None for x in got] == [not x for x in fine]
            assert all(abs(x - f(g)) < 1e-6 for x, g, ok in zip(got, parts, fine) if ok)
        y = (d.f == 1).astype(int).to_numpy()
        after = [h(s.mean()) if len(s := y[1:][y[:-1] == v]) >= 2 else h(y.mean()) for v in (1, 0)]
        want = (after[1] - after[0]) / (h(y.mean()) + E9) if len(d) >= 20 else None
        assert (skews[k] is None) == (want is None) and (want is None or abs(skews[k] - want) < 2e-6)


def test_recursive_means(spark, tables):
    rng = np.random.default_rng(1)
    daily = pd.DataFrame({"StockId": ["A"] * 150 + ["B"] * 3, "Date": [*range(150), *range(3)], "close": rng.random(153).cumsum() + 5})
    daily = daily.assign(open=1.0, high=1.0, low=1.0, volume_k=1.0, shares_out_k=1.0)
    got = quiet.RECURSIVE_Z(daily=spark.createDataFrame(daily)).toPandas().sort_values("Date")
    for stock, d in daily.groupby("StockId"):
        e = d.close.ewm(span=20, adjust=False)
        want = ((d.close - e.mean()) / e.std().replace(0, np.nan)).fillna(0)
        assert np.allclose(got[got.StockId == stock].t_recursive_zscore, want, atol=2e-6)
    nets = series(quiet.RECURSIVE, spark, tables[0])
    for stock in "AB":
        xs = pd.Series([spread_of(d)["x"] for _, d in tables[0][tables[0].StockId == stock].groupby("Date") if d[["BuyQtm", "SellQtm"]].to_numpy().sum() > 0])
        assert np.allclose(nets[stock], xs.ewm(span=5, adjust=False).mean(), atol=2e-6)


def test_sets_of_leading_brokers(spark, tables):
    given = {"brokers": spark.createDataFrame(tables[0])}
    jaccard = {(r.StockId, r.Date): r.raw_top5_jaccard for r in pairs.JACCARD(**given).collect()}
    consistent = {(r.StockId, r.Date): r.raw_top5_consistency for r in pairs.CONSISTENT(**given).collect()}
    for stock in "ABC":
        buyers, fills = [], []
        for date, d, net, vol, buy in days_of(tables[0], stock):
            entries = (d.BuyQtm > 0).groupby(d.BrokerId).sum()
            buyers.append((date, set(sorted(buy.index, key=lambda b: (-buy[b], -entries[b], b))[:5])))
            lead = d.assign(net=d.BuyQtm - d.SellQtm).sort_values(["net", "BrokerId", "Price"], ascending=[False, True, True])
            fills.append((date, set(lead.BrokerId[:5])))
        for i, (date, now) in enumerate(buyers):
            past = set().union(*(s for _, s in buyers[max(0, i - 4) : i]))
            want = len(past & now) / len(past | now) if i >= 4 else None
            assert jaccard[stock, date] is None if want is None else abs(jaccard[stock, date] - want) < 1e-6
        for i, (date, now) in enumerate(fills):
            want = np.mean([len(now & fills[i - j][1]) / len(now) for j in range(1, 6)]) if i >= 5 else None
            assert consistent[stock, date] is None if want is None else abs(consistent[stock, date] - want) < 1e-6
    assert len(set(jaccard.values())) > 5 and len(set(consistent.values())) > 5


def test_seconds_of_leading_brokers(spark, tables):
    brokers, ticks = tables
    ticks = ticks[ticks.Date < 20240140]
    made = {(r.StockId, r.Date): r for r in pairs.SYNC(brokers=spark.createDataFrame(brokers), ticks=spark.createDataFrame(ticks)).collect()}
    seen = set()
    for (stock, date), t in ticks.groupby(["StockId", "Date"]):
        d = brokers[(brokers.StockId == stock) & (brokers.Date == date)]
        a = d.groupby("BrokerId")[["BuyQtm", "SellQtm"]].sum()
        net = a.BuyQtm - a.SellQtm
        top = sorted(a.index, key=lambda b: (-net[b], -a.BuyQtm[b], b))[:5]
        at = t.groupby("p").sec.agg(set)
        held = [set().union(*(at.get(p, set()) for p in d.Price[d.BrokerId == b])) for b in top]
        both = [(len(x & y), len(x | y)) for k, x in enumerate(held) for y in held[:k]]
        ratios = [i / u for i, u in both if u]
        want = np.mean(ratios) if len(a) >= 5 and ratios else None
        got = made[stock, date]
        assert got.raw_broker_sync_intensity is None if want is None else abs(got.raw_broker_sync_intensity - want) < 1e-6
        last = t.groupby(t.sec // 60).p.last()
        work = net[top].clip(lower=0).sum() / (last.pct_change().abs().fillna(0).sum() * 1000 + 1e-5)
        assert abs(got.raw_eth_conservative_work_divergence - work) < 1e-5 * max(1, abs(work))
        seen.add(want)
    assert len(seen) > 5


def test_ticks_with_daily_bars(spark, tables):
    long = ticks_of(9)
    ticks = pd.concat([tables[1][tables[1].Date < 20240130], long.assign(StockId=long.StockId.str.lower())], ignore_index=True)
    rng = np.random.default_rng(4)
    ticks["ask"], ticks["bid"] = ticks.p + rng.choice([0.1, 0.2], len(ticks)), ticks.p - rng.choice([0.1, 0.3], len(ticks))
    bars = ticks.groupby(["StockId", "Date"], as_index=False).agg(open=("p", "first"), high=("p", "max"), low=("p", "min"), close=("p", "last"), volume_k=("q", "sum")).assign(shares_out_k=1.0)
    bars["open"] += rng.choice([-0.1, 0.0, 0.1], len(bars))
    made = pairs.TICK_DAILY(ticks=spark.createDataFrame(ticks), daily=spark.createDataFrame(bars)).toPandas().set_index(["StockId", "Date"])
    want = {}
    for stock, days in bars.groupby("StockId"):
        run, vols, last = 0, [], None
        for r in days.itertuples():
            t = ticks[(ticks.StockId == stock) & (ticks.Date == r.Date)]
            run, vols = (run + 1, [*vols, r.volume_k * 1000]) if last is not None and r.close > last else (0, [])
            last, vwap, p, q, f = r.close, np.average(t.p, weights=t.q), t.p.to_numpy(), t.q.to_numpy(), t.f.to_numpy()
            above = p >= vwap
            cross = above != np.append(False, above[:-1])
            low, high = min(vwap, r.open), max(vwap, r.open)
            both = np.append(False, (f[1:] == 1) & (p[:-1] < low) & (p[1:] > high))
            vol = t.groupby("p").q.sum()
            mode = vol.idxmax()
            garbled = stream = 0.0
            means = [np.average(p[s : s + 200], weights=q[s : s + 200]) for s in range(0, len(p) // 200 * 200, 200)]
            for k in range(1, len(means)):
                g = slice(k * 200, k * 200 + 200)
                garbled += q[g].sum() / (abs((f[g] == 1).sum() - (f[g] == 0).sum()) + 1e-5) if means[k] < means[k - 1] else 0.0
            spread = (t.ask - t.bid).to_numpy()
            for s in range(0, len(p) // 50 * 50, 50):
                g = slice(s, s + 50)
                stream += np.diff(spread[g][:5]).mean() * (q[g] * np.where(f[g] == 1, 1, np.where(f[g] == 0, -1, 0))).sum() * max(0, p[s + 49] - p[s])
            want[stock, r.Date] = {"raw_cross_count": cross.sum(), "raw_cross_vol": q[cross].sum(), "raw_cross_both_vol": q[both].sum(), "raw_mode_price": mode, "raw_patch_thickness": vol[(vol.index >= mode * 0.995) & (vol.index <= mode * 1.005)].sum() / (vol.sum() + 1e-8), "raw_consecutive_up_days": run, "raw_consecutive_up_vol": np.mean(vols) if run else 0.0, "raw_bin200_garbling_dumping": garbled, "raw_riverbend_val": stream}
    frame = pd.DataFrame(want).T
    for c in frame:
        got = made[c].reindex(frame.index)
        assert np.allclose(got, frame[c].astype(float), rtol=1e-6, atol=2e-5) and frame[c].nunique() > 2, c


def test_two_sequences(spark, tables):
    brokers, ticks = tables
    made = {(r.StockId, r.Date): r for r in quiet.BINARY(brokers=spark.createDataFrame(brokers), ticks=spark.createDataFrame(ticks)).collect()}
    seen = []
    for stock in "AB":
        rows = [(date, spread_of(d)) for date, d in brokers[brokers.StockId == stock].groupby("Date") if d[["BuyQtm", "SellQtm"]].to_numpy().sum() > 0]
        xs, up = [r["x"] for _, r in rows], [(ticks[(ticks.StockId == stock) & (ticks.Date == date)].f == 1).mean() for date, _ in rows]
        for i, (date, _) in enumerate(rows):
            got = made[stock, date]
            if i < 20:
                assert got.raw_phi_20d is got.raw_di_up is got.raw_di_down is got.raw_logloss_gain is None
                continue
            b, y = np.array([int(x > 0) for x in xs[i - 20 : i]]), np.array([int(x > 0.5) for x in up[i - 20 : i]])
            phi = np.corrcoef(b, y)[0, 1] if b.std() and y.std() else 0.0
            full, base = np.full((2, 2, 2), 1e-3), np.full((2, 2), 1e-3)
            for t in range(1, 20):
                full[b[t - 1], y[t - 1], y[t]] += 1
                base[y[t - 1], y[t]] += 1
            full, base = full / full.sum(axis=2, keepdims=True), base / base.sum(axis=1, keepdims=True)
            gains = {k: [np.log(full[b[t - 1], y[t - 1], k] / base[y[t - 1], k]) for t in range(1, 20) if y[t] == k] for k in (1, 0)}
            e, p = 0.01 / 19, y[1:].mean()
            share = lambda v, k: np.clip(((y[1:][b[:-1] == v] == k).sum() + 5 * e) / ((b[:-1] == v).sum() + 10 * e), e, 1 - e) if (b[:-1] == v).any() else 0.5
            loss = np.log(share(1, 1) / np.clip(p, e, 1 - e)) - np.log(share(0, 0) / (1 - p)) if p < 1 else None
            want = [phi, sum(gains[1]) / max(len(gains[1]), 1), sum(gains[0]) / max(len(gains[0]), 1), loss]
            mine = [got.raw_phi_20d, got.raw_di_up, got.raw_di_down, got.raw_logloss_gain]
            assert all(m is None if w is None else abs(m - w) < 2e-6 for m, w in zip(mine, want)), (mine, want)
            seen.append(tuple(mine))
    assert all(len(set(c)) > 5 for c in zip(*seen))
