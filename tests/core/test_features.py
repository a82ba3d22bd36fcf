"""Features against their SQL in another engine, and what must hold of any feature."""

import duckdb
import pandas as pd
import pytest

from tidemark.plans import catalogue
from tidemark.sources.tables import inputs, repeated_keys, require

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return {k: v.cache() for k, v in inputs(spark, SF).items()}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute(f"create view lineitem as select * from '{SF}/lineitem.parquet'")
    return c


def rows(df: pd.DataFrame, name: str) -> list:
    return sorted((s, int(d), None if pd.isna(v) else round(float(v), 5) + 0.0) for s, d, v in df[["StockId", "Date", name]].itertuples(index=False))


@pytest.mark.parametrize("name", list(catalogue.FEATURES))
def test_against_sql(tables, duck, name):
    got = rows(catalogue.FEATURES[name](**tables).toPandas(), name)
    want = rows(duck.sql(catalogue.ORACLES[name]).df(), name)
    assert len(got) == len(want) and (len(got) > 0 or "bins of" in catalogue.FEATURES[name].description or "bin of" in catalogue.FEATURES[name].description)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all((g[2] is None) == (w[2] is None) and (g[2] is None or abs(g[2] - w[2]) <= 2e-5 * max(1, abs(w[2]))) for g, w in zip(got, want))


@pytest.mark.parametrize("name", [t.name for t in catalogue.TABLES])
def test_tables_against_sql(tables, duck, name):
    table = next(t for t in catalogue.TABLES if t.name == name)
    got, want = table.told(**tables).toPandas(), duck.sql(catalogue.ORACLES[name]).df()
    assert len({c for c, *_ in table.columns}) == len(table.columns) and list(got.columns) == ["StockId", "Date", *(c for c, *_ in table.columns)]
    for c, *_ in table.columns:
        if c in table.arrays:  # texts of whole millionths
            texts = [df[["StockId", "Date", c]].fillna("none").sort_values(["StockId", "Date"]).values.tolist() for df in (got, want)]
            assert texts[0] == texts[1], c
            continue
        both = zip(rows(got, c), rows(want, c), strict=True)
        assert all(g[:2] == w[:2] and (g[2] is None) == (w[2] is None) and (g[2] is None or abs(g[2] - w[2]) <= 2e-5 * max(1, abs(w[2]))) for g, w in both), c


def test_keys_are_unique_and_order_does_not_matter(tables):
    f = catalogue.FEATURES["f_tick_run_imbalance"]
    a = f(**tables)
    b = f(**{k: v.orderBy("mix") if k == "ticks" else v for k, v in tables.items()})
    assert repeated_keys(a).isEmpty()
    assert rows(a.toPandas(), f.name) == rows(b.toPandas(), f.name)


def test_stocks_do_not_touch(spark):
    tables = inputs(spark, "/root/testdata/sf0.01")  # with more than one stock
    f = catalogue.FEATURES["f_be_frustration_driven_turnover"]
    both = rows(f(**tables).toPandas(), f.name)
    one = [rows(f(daily=tables["daily"].filter(f"StockId = '{s}'")).toPandas(), f.name) for s in ("S0", "S1")]
    assert both == sorted(one[0] + one[1])


def test_compute_and_errors(spark, tables):
    names = ["f_imbalance_bar_speed", "f_turnover_rate"]
    assert catalogue.compute(names, **tables).columns == ["StockId", "Date", *names]
    with pytest.raises(KeyError):
        catalogue.compute(["f_none"], **tables)
    with pytest.raises(ValueError):
        require(tables["daily"], ["no_such_column"])
    with pytest.raises(ValueError, match="missing columns: close"):
        catalogue.FEATURES["f_turnover_rate"](daily=tables["daily"].drop("close"))
    with pytest.raises(ValueError, match="not given: brokers"):
        catalogue.FEATURES["f_top5_consist"](ticks=tables["ticks"])
    assert catalogue.catalogue(spark).count() == len(catalogue.FEATURES)


def test_any_function_of_a_day(tables):
    from tidemark.operators.groups import daily_feature

    def share(day):
        if day["Date"].iloc[0] % 3 == 0:
            raise ValueError("no value")
        return day["q"].max() / day["q"].sum()

    got = daily_feature(tables["ticks"].select("StockId", "Date", "q"), share, "x").toPandas()
    day = tables["ticks"].toPandas().groupby(["StockId", "Date"])["q"].agg(lambda q: q.max() / q.sum()).reset_index()
    day.loc[day["Date"] % 3 == 0, "q"] = 0.0
    r = day.groupby("StockId")["q"].rolling(20, min_periods=10)
    day["z"] = ((day["q"] - r.mean().reset_index(0, drop=True)) / (r.std().reset_index(0, drop=True) + 1e-10)).fillna(0).clip(-5, 5)
    both = got.merge(day, on=["StockId", "Date"])
    assert len(both) == len(day) and (both["x"] - both["z"]).abs().max() < 1e-9
