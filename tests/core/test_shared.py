"""Many features in one plan, and tables as vendors give them."""

import datetime
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

from tests.core.test_loops import ticks_of
from tidemark.plans import catalogue, shared
from tidemark.sources import market, tables
from tidemark.sources.tables import inputs, repeated_keys

TEN = [
    "f_density_ratio", "f_imbalance_bar_speed", "f_integer_level_density", "f_intraday_momentum_decay", "f_qit_incompatible_observables_product", "f_spread_compression",
    "f_tail_session_ofi_zscore", "f_timebar_am_pm_divergence_ewm20_tsrank_ewm20", "f_tk_active_sell_above_vwap", "raw_vpin",
]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_ten_features_scan_shuffle_and_sort_ticks_once(spark, tmp_path):
    spark.createDataFrame(ticks_of()).write.parquet(f"{tmp_path}/ticks")
    ticks = spark.read.parquet(f"{tmp_path}/ticks")
    text = plan(catalogue.compute(TEN[:9], ticks=ticks))
    assert text.count("FileScan") == 1 and "Join" not in text
    # One shuffle and sort of ticks by stock and day, one of days by stock.
    assert len(re.findall(r"Sort \[", text)) == 2
    assert len(re.findall(r"Exchange hashpartitioning\(StockId#\d+, Date#\d+", text)) == 1 and text.count("Exchange ") == 2
    alone = [plan(catalogue.FEATURES[n](ticks=ticks)) for n in TEN[:9]]
    assert sum(t.count("FileScan") for t in alone) == 9


def test_shared_values_are_those_of_each_feature(spark):
    tables = {k: v.cache() for k, v in inputs(spark, "/root/testdata/sf0.001").items()}
    names = [n for n, f in catalogue.FEATURES.items() if shared.shape(f)]
    assert len(names) >= 40
    got = catalogue.compute([*names, "raw_vpin", "f_tick_run_imbalance"], **tables)
    assert got.columns == ["StockId", "Date", *names, "raw_vpin", "f_tick_run_imbalance"] and repeated_keys(got).isEmpty()
    got = got.toPandas().set_index(["StockId", "Date"]).sort_index()
    for n in [*names[::4], "f_tick_run_imbalance"]:
        one = catalogue.FEATURES[n](**tables).toPandas().set_index(["StockId", "Date"])[n].sort_index()
        assert np.allclose(got[n].reindex(one.index).astype(float), one.astype(float), equal_nan=True, atol=1e-9), n


def vendor_ticks() -> pd.DataFrame:
    t = ticks_of(2)
    out = t.rename(columns={"sec": "DealTimeSecond", "p": "DealPrice", "q": "DealCount", "f": "PrFlag", "bid": "BuyPr", "ask": "SellPr", "ref": "RefPr"})
    return out.assign(TotalQty=out.groupby(["StockId", "Date"]).DealCount.cumsum()).drop(columns="pos")


def test_vendor_ticks_give_the_same_features(spark):
    wanted = ["f_tick_run_imbalance", "f_imbalance_bar_speed", "raw_nld_hysteresis_area"]
    own = catalogue.compute(wanted, ticks=spark.createDataFrame(ticks_of(2))).toPandas()
    given = spark.createDataFrame(vendor_ticks().sample(frac=1, random_state=0))
    assert catalogue.compute(wanted, ticks=market.ticks(given)).toPandas().sort_values(["StockId", "Date"]).reset_index(drop=True).equals(own.sort_values(["StockId", "Date"]).reset_index(drop=True))
    times = given.withColumn("HHMMSS", market.F.expr("concat(lpad(DealTimeSecond div 3600, 2, '0'), ':', lpad(DealTimeSecond div 60 % 60, 2, '0'), ':', lpad(DealTimeSecond % 60, 2, '0'))")).drop("DealTimeSecond", "BuyPr", "SellPr", "RefPr")
    rows = market.ticks(times)
    assert rows.filter("bid IS NOT NULL OR ref IS NOT NULL").isEmpty() and rows.exceptAll(market.ticks(given).withColumns({c: market.F.lit(None).cast("double") for c in ("bid", "ask", "ref")})).isEmpty()
    with pytest.raises(ValueError, match="missing columns: PrFlag"):
        market.ticks(given.drop("PrFlag"))
    with pytest.raises(ValueError, match="missing columns: DealTimeSecond"):
        market.ticks(given.drop("DealTimeSecond"))


def test_vendor_ticks_with_nulls_ties_and_dates(spark):
    rows = [("1", datetime.date(2024, 1, 2), 32400, 10.0, 5, 1, 5, 2), ("1", datetime.date(2024, 1, 2), 32400, 11.0, 5, 0, 5, 1), ("1", datetime.date(2024, 1, 2), 32401, None, 5, 0, 9, 1), ("1", datetime.date(2024, 1, 2), 32402, 9.0, 2, None, None, None)]
    got = market.ticks(spark.createDataFrame(rows, "StockId string, Date date, DealTimeSecond int, DealPrice double, DealCount int, PrFlag int, TotalQty long, tick_seq long"))
    assert sorted((r.pos, r.p, r.Date) for r in got.collect()) == [(0, 9.0, 20240102), (1, 11.0, 20240102), (2, 10.0, 20240102)]
    assert market.ticks(spark.createDataFrame([], "StockId string, Date int, DealTimeSecond int, DealPrice double, DealCount int, PrFlag int")).collect() == []


def test_vendor_daily_bars_and_fills(spark):
    names = {c: market.DAILY_NAMES[c] for c in ["open", "high", "low", "close", "volume_k", "shares_out_k"]}
    bars = pd.DataFrame({"StockId": [1101] * 30, "Date": [f"2024-01-{d:02d}" for d in range(1, 31)], **{n: np.arange(30.0) + k + 1 for k, n in enumerate(names.values())}})
    made = market.daily(spark.createDataFrame(bars))
    r = made.orderBy("Date").first()
    assert (r.StockId, r.Date, r.open, r.ret_pct, r.turnover_value, r.pe) == ("1101", 20240101, 1.0, pytest.approx(300.0), 5.0 * 1000 * 2.5, None)
    assert catalogue.compute(["f_turnover_rate", "f_value_composite"], daily=made).count() == 30
    with pytest.raises(ValueError, match="missing columns: close"):
        market.daily(spark.createDataFrame(bars.drop(columns=names["close"])))
    fills = market.brokers(spark.createDataFrame([(1, 20240101, 77, 10.5, None, 3)], "StockId int, Date int, BrokerId int, Price double, BuyQtm int, SellQtm int"))
    assert [tuple(r) for r in fills.collect()] == [("1", 20240101, "77", 10.5, 0, 3)]


def test_first_of_a_key(spark):
    rows = spark.createDataFrame([("a", 1, 3, "x"), ("a", 1, 2, "y"), ("a", 2, 1, "z"), ("a", 1, 2, "b")], "StockId string, Date int, n int, t string")
    assert sorted((r.Date, r.n, r.t) for r in market.first_of_key(rows, ["t"], ["n"]).collect()) == [(1, 2, "b"), (2, 1, "z")]


def test_tasks_grow_in_number_with_the_ticks(spark, monkeypatch):
    monkeypatch.setattr(tables, "TASK_TICKS", 500)
    small = inputs(spark, "/root/testdata/sf0.001")
    parts = -(-spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count() // 500)
    assert parts > spark.sparkContext.defaultParallelism
    text = plan(catalogue.FEATURES["f_newcomer_net_momentum"](**small))  # broker days are dealt once, as ticks
    assert re.findall(r"Exchange hashpartitioning\(StockId#\d+, Date#\d+L?, (\d+)\)", text) == [str(parts)]
    text = plan(catalogue.FEATURES["f_gt_expert_vs_popular_divergence"](**small))  # and by stock before they become many
    assert re.search(rf"Exchange hashpartitioning\(StockId#\d+, {4 * parts}\), REPARTITION_BY_NUM", text)


def test_paths_of_ticks_pass_a_day_few_times_and_count_seconds_where_they_are(spark):
    """Distinct counts wrote every tick three times and summed 120 columns by second; windows of one order stood apart."""
    text = plan(catalogue.QUERIES["raw_tick_path_columns"](spark, "/root/testdata/sf0.001"))
    assert "Expand" not in text and text.count("Window [") <= 8 and text.count("Sort [") <= 9
    assert not re.search(r"groupBy.*distinct|keys=\[[^]]*sec#", plan(catalogue.QUERIES["raw_minute_path_columns"](spark, "/root/testdata/sf0.001")))


@pytest.mark.parametrize("name", ["raw_tick_path_columns", "raw_minute_path_columns"])
def test_seconds_with_many_ticks_out_of_order_agree_with_sql(spark, name):
    """Seconds that hold several ticks, at equal and other prices, in days whose order is not that of seconds; ticks of a day also without one."""
    rng = np.random.default_rng(5)
    made = ticks_of(9)
    made["sec"] = 32400 + rng.integers(0, 40, len(made)) * 97 % 16200 + (rng.random(len(made)) < 0.3) * 12600.0
    made["p"] = np.where(made.sec % 2 == 0, 50.0, made.p)
    made["total_qty"], made["broker"], made["mix"] = made.groupby(["StockId", "Date"]).q.cumsum(), "B1", 0
    if name == "raw_tick_path_columns":  # a minute without seconds has no share a second in the SQL either
        made.loc[rng.random(len(made)) < 0.02, "sec"] = np.nan
    ours = spark.createDataFrame(made.astype({"sec": object}).where(made.notna(), None), "StockId string, Date long, sec double, p double, q long, f int, bid double, ask double, ref double, pos long, total_qty long, broker string, mix long")
    table, con = catalogue._ALL[name], duckdb.connect()
    con.register("made", made)
    got = table(ticks=ours).toPandas().sort_values(["StockId", "Date"]).reset_index(drop=True)
    want = con.sql(table.sql({"ticks": "SELECT * FROM made"})).df().sort_values(["StockId", "Date"]).reset_index(drop=True)
    for c in got.columns[2:]:
        assert np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True, atol=1e-5), c
    assert len(got) == 33 and (name != "raw_tick_path_columns" or got.raw_qit_quantum_zeno_freezing.between(0.01, 0.99).any())


def test_history_of_brokers_is_dealt_by_stock_to_tasks_that_grow_in_number(spark, monkeypatch):
    monkeypatch.setattr(tables, "TASK_TICKS", 500)
    made = inputs(spark, "/root/testdata/sf0.001")
    text = plan(next(t for t in catalogue.TABLES if t.name == "raw_broker_history_columns")(**made))
    assert re.search(rf"Exchange hashpartitioning\(StockId#\d+, {4 * made['brokers']._tidemark_parts}\), REPARTITION_BY_NUM", text)
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 2  # ticks by stock and day, broker days by stock
