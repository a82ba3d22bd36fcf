"""Reading and writing: parquet with date ranges, and the driver's tables as daily bars, ticks and broker fills.

The three inputs of the library are written as SQL over `lineitem`, so that any engine can repeat them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.required import missing, require  # noqa: F401
from tidemark.sources.sql import BROKERS, DAILY, QUARTERS, TICKS


def read_parquet(spark: SparkSession, path: str, schema=None, first: int | None = None, last: int | None = None) -> DataFrame:
    """A parquet table, perhaps of a range of dates; the range is pushed down to the files."""
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    if first is not None:
        df = df.filter(F.col("Date") >= first)
    return df if last is None else df.filter(F.col("Date") <= last)


def write_parquet(df: DataFrame, path: str) -> None:
    """A result by date: each task writes the dates that it holds after a shuffle by date and stock."""
    df.repartition("Date", "StockId").write.mode("overwrite").partitionBy("Date").parquet(path)


#: Ticks of a task: a stage sorts its rows several times and holds each sort in memory, so their number must not grow with the table.
TASK_TICKS = 125_000


def dealt(text: str, parts: int) -> str:
    """The ticks' SQL with its trades dealt by stock and day to so many tasks, the key of all windows and groupings of a day."""
    return text.replace("FROM (SELECT concat(", f"FROM (SELECT /*+ REPARTITION({parts}, StockId, Date) */ concat(", 1)


def inputs(spark: SparkSession, sf_dir: str, quarters: bool = False) -> dict[str, DataFrame]:
    """{'ticks', 'daily', 'brokers'} made from the driver's lineitem table; a day has a month's trades, or a quarter's."""
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    parts = max(spark.sparkContext.defaultParallelism, -(-lineitem.count() // TASK_TICKS))
    ticks = spark.sql(dealt(QUARTERS if quarters else TICKS, parts), lineitem=lineitem)
    made = {"ticks": ticks, "daily": spark.sql(DAILY, ticks=ticks), "brokers": spark.sql(BROKERS, ticks=ticks)}
    for df in made.values():
        df._tidemark_parts = parts
    return made


def repeated_keys(df: DataFrame) -> DataFrame:
    """Keys (StockId, Date) that stand in more than one row; a result must have none."""
    return df.groupBy("StockId", "Date").count().filter("count > 1")
