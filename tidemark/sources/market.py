"""Tables as data vendors give them, made into the library's ticks, daily bars and broker fills.

A day's ticks are numbered by the running total of the day's quantity, and by `tick_seq` among equal ones; where the
total is absent, by time. What is optional and absent is null, but for two daily columns that follow from others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, TimestampType

from tidemark.sources.required import require

#: Names of the vendor's daily columns, by ours.
DAILY_NAMES = {
    "open": "開盤價", "high": "最高價", "low": "最低價", "close": "收盤價", "volume_k": "成交量(千股)", "shares_out_k": "流通在外股數(千股)", "daytrade_pct": "當沖買賣占比", "ret_pct": "報酬率", "turnover_value": "成交金額(元)",
    "short_balance_k": "融券餘額(千股)", "margin_balance_k": "融資餘額(千股)", "lending_short_k": "借券賣出餘額(千股)", "short_balance_lots": "融券餘額(張)",
    "inst_foreign": "外資買賣超張數", "inst_trust": "投信買賣超張數", "inst_dealer_self": "自營買賣超張數(自行)", "inst_dealer_hedge": "自營買賣超張數(避險)",
    "holder_gt1000_pct": "超過1000張集保占比_最近1次發布資料", "holder_lt400_count": "未滿400張集保人數_最近1次發布資料", "rev_m1_k": "最近1期單月營收(千元)", "rev_m13_k": "最近13期單月營收(千元)",
    "pe": "本益比(TEJ)", "pb": "股價淨值比(TEJ)", "ps": "股價營收比(TEJ)", "div_yield": "現金股利率(TEJ)",
}
DAILY_NEEDED = ["open", "high", "low", "close", "volume_k", "shares_out_k"]


def key(df: DataFrame) -> list[Column]:
    """StockId as a string, Date as a number like 20240131; dates and texts like 2024-01-31 too."""
    kind, date = df.schema["Date"].dataType, F.col("Date")
    if isinstance(kind, (DateType, TimestampType)):
        date = F.date_format(date, "yyyyMMdd")
    elif isinstance(kind, StringType):
        date = F.regexp_replace(date, "[^0-9]", "")
    return [F.col("StockId").cast("string").alias("StockId"), date.cast("long").alias("Date")]


def optional(df: DataFrame, name: str, kind: str = "double") -> Column:
    return (F.col(f"`{name}`") if name in df.columns else F.lit(None)).cast(kind)


def seconds(df: DataFrame) -> Column:
    """Seconds of the day: as given, or from a time like 09:00:05."""
    parts = F.split(optional(df, "HHMMSS", "string"), ":")
    told = F.get(parts, F.lit(0)).cast("int") * 3600 + F.get(parts, F.lit(1)).cast("int") * 60 + F.get(parts, F.lit(2)).cast("int")
    return F.coalesce(optional(df, "DealTimeSecond", "long"), told.cast("long"))


def ticks(df: DataFrame) -> DataFrame:
    """Ticks from StockId, Date, DealTimeSecond (or HHMMSS), DealPrice, DealCount, PrFlag (1 buy, 0 sell) and, if they are
    there, TotalQty, tick_seq, BuyPr, SellPr, RefPr, CeilPr, FloorPr. Rows without a price or a count are no trades and go."""
    require(df, ["StockId", "Date", "DealPrice", "DealCount", "PrFlag"])
    if not {"DealTimeSecond", "HHMMSS"} & set(df.columns):
        require(df, ["DealTimeSecond"])
    rows = df.select(
        *key(df), seconds(df).alias("sec"), F.col("DealPrice").cast("double").alias("p"), F.col("DealCount").cast("long").alias("q"), F.col("PrFlag").cast("int").alias("f"),
        optional(df, "BuyPr").alias("bid"), optional(df, "SellPr").alias("ask"), optional(df, "RefPr").alias("ref"), optional(df, "CeilPr").alias("ceil"), optional(df, "FloorPr").alias("floor"),
        optional(df, "TotalQty", "long").alias("total_qty"), optional(df, "tick_seq", "long").alias("tick_seq")).filter("p IS NOT NULL AND q IS NOT NULL")
    order = ["total_qty", "tick_seq", "sec", "p", "q", "f"] if "TotalQty" in df.columns else ["sec", "tick_seq", "p", "q", "f"]
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("StockId", "Date").orderBy(*order)) - 1).drop("tick_seq")


def daily(df: DataFrame) -> DataFrame:
    """Daily bars by our names or the vendor's. Without a return it is that from open to close, and without a turnover the
    volume at the mean of both."""
    have = {ours: ours if ours in df.columns else theirs for ours, theirs in DAILY_NAMES.items() if ours in df.columns or theirs in df.columns}
    require(df.select(*(F.col(f"`{c}`").alias(n) for n, c in have.items())), DAILY_NEEDED)
    rows = df.select(*key(df), *(optional(df, have.get(n, n)).alias(n) for n in DAILY_NAMES))
    if "ret_pct" not in have:
        rows = rows.withColumn("ret_pct", F.expr("(close - open) / (open + 1e-9) * 100"))
    return rows if "turnover_value" in have else rows.withColumn("turnover_value", F.expr("volume_k * 1000 * (open + close) / 2"))


def brokers(df: DataFrame) -> DataFrame:
    """Broker fills: a row for each stock, day, broker and price. Null quantities are none."""
    require(df, ["StockId", "Date", "BrokerId", "Price", "BuyQtm", "SellQtm"])
    return df.select(*key(df), F.col("BrokerId").cast("string").alias("BrokerId"), F.col("Price").cast("double").alias("Price"), *(F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("BuyQtm", "SellQtm")))


def first_of_key(df: DataFrame, by: list[str], order: list[str], keys: tuple[str, ...] = ("StockId", "Date")) -> DataFrame:
    """One row of each key: the first in the given order (and, among equals, in that of `by`)."""
    place = Window.partitionBy(*keys).orderBy(*order, *by)
    return df.withColumn("_place", F.row_number().over(place)).filter("_place = 1").drop("_place")
