"""Columns that a table must have."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: What every feature of a table may read; other columns are optional.
REQUIRED = {
    "ticks": ["StockId", "Date", "sec", "p", "q", "f", "pos"],
    "daily": ["StockId", "Date", "open", "high", "low", "close", "volume_k", "shares_out_k"],
    "brokers": ["StockId", "Date", "BrokerId", "Price", "BuyQtm", "SellQtm"],
}


def missing(df: DataFrame, columns: list[str]) -> list[str]:
    """The required columns that a table lacks."""
    return [c for c in columns if c not in df.columns]


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    if lacking := missing(df, columns):
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df
