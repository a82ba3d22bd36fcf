"""A feature from any function of a day's rows, for what columns cannot say."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.series import clipped, filled, zscore


def daily_feature(rows: DataFrame, value_of_day: Callable[[pd.DataFrame], float], name: str) -> DataFrame:
    """(StockId, Date, name): the function's value of each day, as a z-score of 20 days within -5 and 5.

    A day for which the function fails or gives no finite number counts as 0. A task holds one stock's day at a time.
    """

    def run(day: pd.DataFrame) -> pd.DataFrame:
        try:
            value = float(value_of_day(day))
        except (ArithmeticError, ValueError, KeyError, IndexError):
            value = 0.0
        value = value if abs(value) < float("inf") else 0.0
        return pd.DataFrame({"StockId": [day["StockId"].iloc[0]], "Date": [day["Date"].iloc[0]], "x": [value]})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    raw = rows.groupBy("StockId", "Date").applyInPandas(run, f"StockId {kinds['StockId']}, Date {kinds['Date']}, x double")
    z = zscore(F.col("x"), 20, 10, 1e-10)
    return raw.select("StockId", "Date", clipped(filled(z), -5.0, 5.0).alias(name))
