"""Popular against expert brokers: the rows that are made of a trade, and odd days, against the SQL."""

from dataclasses import replace

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemark.plans import catalogue

FEATURE = catalogue.FEATURES["f_gt_expert_vs_popular_divergence"]
#: What the popular and the experts of each day bought, in one number; the feature is zero on most days.
SIDES = replace(FEATURE, queries=FEATURE.queries[:-1], others=FEATURE.others[:-1], steps=(("sides_", "sql", "popular + 1000.0 * expert"),))
SCHEMA = "StockId string, Date long, BrokerId string, Price double, BuyQtm {0}, SellQtm {0}"


def nodes(plan):
    yield plan
    for k in range(plan.children().size()):
        yield from nodes(plan.children().apply(k))


def test_a_trade_is_not_a_row_for_each_of_the_days_that_it_counts(spark):
    """Each of 300 other brokers a day trades once in 60 days: a row for each broker and day would be 48 for a trade."""
    n, a_day = 150, 300
    fills = pd.DataFrame({"StockId": "A", "Date": np.repeat(20240000 + np.arange(n), a_day), "BrokerId": [f"B{k}" for k in range(n * a_day)], "Price": 1.0, "BuyQtm": np.arange(n * a_day) % 7, "SellQtm": np.arange(n * a_day) % 5})
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = FEATURE(brokers=spark.createDataFrame(fills))
        assert len(got.collect()) == n
        made = sum(p.metrics().apply("numOutputRows").value() for p in nodes(got._jdf.queryExecution().executedPlan()) if p.nodeName() == "Generate")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert 0 < made < 25 * len(fills)


def fills_of(seed: int, brokers: int, share: float, days: int, least: int) -> pd.DataFrame:
    """Stocks whose brokers trade on some days only: gaps of more than 60 days, sellers only, equal sums, trades of nothing."""
    rng, out = np.random.default_rng(seed), []
    for stock in ("A", "B", None):
        often = rng.random(brokers) ** 3 * share * 2
        for k in range(days):
            of = np.flatnonzero(rng.random(brokers) < often)
            of = np.union1d(of, rng.integers(0, brokers, least)) if len(of) < least else of
            m, sells = len(of), (k // 40) % 2
            buy, sell = rng.integers(0, 4, m) * (rng.random(m) < (0.2 if sells else 0.7)), rng.integers(0, 4, m) * (rng.random(m) < (0.9 if sells else 0.4))
            out.append(pd.DataFrame({"StockId": stock, "Date": 20240000 + k * 3, "BrokerId": [f"B{x}" for x in of], "Price": 1.0, "BuyQtm": buy, "SellQtm": sell}))
    return pd.concat(out, ignore_index=True)


@pytest.mark.parametrize("brokers, share, days, least, kind", [(1, 0.9, 30, 1, "long"), (3, 0.3, 200, 1, "long"), (5, 0.04, 260, 1, "long"), (8, 0.3, 200, 0, "double"), (40, 0.02, 300, 1, "long"), (60, 0.3, 130, 3, "long"), (200, 0.03, 150, 3, "double")])
def test_days_with_few_brokers_and_brokers_that_come_back_late(spark, brokers, share, days, least, kind):
    made = fills_of(brokers, brokers, share, days, least)
    if kind == "double":  # quantities that are no whole numbers
        made[["BuyQtm", "SellQtm"]] = made[["BuyQtm", "SellQtm"]] * 0.5
    con = duckdb.connect()
    con.register("made", made)
    want = con.sql(SIDES.sql({"ticks": "SELECT 1 AS one", "brokers": "SELECT * FROM made"})).df()
    ours = spark.createDataFrame(made.astype(object).where(made.notna(), None), SCHEMA.format(kind))
    got = SIDES(brokers=ours).toPandas()
    got, want = (t.assign(StockId=t.StockId.fillna("-")).sort_values(["StockId", "Date"]).reset_index(drop=True) for t in (got, want))
    assert len(got) and got[["StockId", "Date"]].equals(want[["StockId", "Date"]])
    assert got[FEATURE.name].equals(want[FEATURE.name])
    assert got[FEATURE.name].nunique() > (8 if brokers >= 5 else 3) and (brokers < 5 or (got[FEATURE.name].abs() > 400).any())


def test_the_sixth_by_net_buying_is_an_expert_where_the_popular_lead_it(spark):
    """All trade on all days, the three popular also gathered most: the experts are the fourth to the sixth."""
    fills = [("A", 1 + d, f"B{k}", 1.0, 100 - 10 * k, 0) for d in range(2) for k in range(8)] + [("A", 3, f"B{k}", 1.0, 5 if k < 3 else 0, 7 if k == 5 else 0) for k in range(8)]
    got = SIDES(brokers=spark.createDataFrame(fills, SCHEMA.format("long"))).collect()
    assert sorted((r.Date, r[FEATURE.name]) for r in got) == [(1, 270.0 + 180000), (2, 270.0 + 180000), (3, 15.0 - 7000)]
