"""A feature: SQL from an input to one row a stock and day, then transforms of the stock's daily series.

The same declaration gives a Spark plan (DataFrame columns over one window of a stock's days) and SQL text for another
engine to compare with.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import series, series_sql
from tidemark.sources.required import REQUIRED, require
from tidemark.sources.sql import doubles


#: Columns whose values may be far beyond a billion: ratios to a price that may be zero.
WIDE = {"raw_price_range_5d"}


def read(what: Feature | Columns, inputs: dict[str, DataFrame]) -> None:
    """Name what a call lacks: tables, and the keys that every table must have."""
    if lacking := [k for k in what.reads if k not in inputs]:
        raise ValueError(f"{what.name} reads tables that are not given: {', '.join(lacking)}")
    for k in what.reads:
        require(inputs[k], REQUIRED[k])


#: What is dealt by stock, with all days of a stock in one task, goes to so many times the tasks of what is dealt by stock and day.
BY_STOCK = 4


def parts(inputs: dict[str, DataFrame]) -> int:
    """{parts} in a query's text: the number of tasks for rows dealt by stock. Tables that `sources.tables` made know theirs."""
    df = next(iter(inputs.values()))
    known = [n for n in (getattr(d, "_tidemark_parts", None) for d in inputs.values()) if n]
    return BY_STOCK * max(known) if known else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


@dataclass(frozen=True)
class Feature:
    """name; what it reads (ticks, daily, brokers); named queries that follow each other, the last one by stock and
    day; and steps (new column, function of series.py or 'sql', column or SQL text, further arguments...). A query may
    have a second text after its first: how the other engine gets the same rows by another way. Where its whole way is
    another, `others` has all its queries."""

    name: str
    combination: str
    description: str
    queries: tuple[tuple[str, ...], ...]
    steps: tuple[tuple, ...]
    reads: tuple[str, ...] = field(default=("ticks",))
    others: tuple[tuple[str, ...], ...] = field(default=())

    def __call__(self, **inputs: DataFrame) -> DataFrame:
        read(self, inputs)
        spark = inputs[self.reads[0]].sparkSession
        named = ", ".join(f"{n} AS ({q})" for n, q, *_ in self.queries)
        given = {k: inputs[k] for k in self.reads}
        df = spark.sql(as_spark(f"WITH {named} SELECT * FROM {self.queries[-1][0]}"), **given, parts=parts(given))
        for out, function, what, *args in self.steps:
            value = F.expr(as_spark(what)) if function == "sql" else getattr(series, function)(F.col(what), *args)
            df = df.withColumn(out, value)
        last = self.steps[-1][0]
        return df.select("StockId", "Date", (F.round(F.col(last), 6) + F.lit(0.0)).alias(self.name))

    def sql(self, inputs: dict[str, str]) -> str:
        """The same for DuckDB; `inputs` has the SQL of what it reads."""
        parts = [f"{k} AS ({inputs[k]})" for k in ("ticks", *(r for r in self.reads if r != "ticks"))]
        queries = self.others or self.queries
        parts += [f"{n} AS ({q.format(**{k: k for k in inputs})})" for n, *_, q in queries]
        query = f"SELECT *, row_number() {series_sql.ORDER} AS age FROM {queries[-1][0]}"
        for k, (out, function, what, *args) in enumerate(self.steps):
            text = what if function == "sql" else getattr(series_sql, function)(what, *args)
            query = f"SELECT *, {text} AS {out} FROM ({query}) AS s{k}"
        return as_duckdb(f"WITH {', '.join(parts)} SELECT StockId, Date, round({self.steps[-1][0]}, 6) + 0.0 AS {self.name} FROM ({query}) AS done")


@dataclass(frozen=True)
class Columns:
    """Several columns of a stock and day made in one pass over the same plan. Queries and columns may have a second text
    for the other engine; columns named in `arrays` are arrays of doubles, not rounded."""

    name: str
    description: str
    queries: tuple[tuple[str, ...], ...]
    columns: tuple[tuple[str, ...], ...]
    source: str
    reads: tuple[str, ...] = field(default=("ticks",))
    grouped: bool = True  # else the source has a row for each stock and day
    arrays: tuple[str, ...] = field(default=())

    def _text(self, other: bool = False) -> str:
        at = -1 if other else 1
        named = ", ".join(f"{q[0]} AS ({q[at]})" for q in self.queries)
        exprs = ", ".join(f"{c[at]} AS {c[0]}" if c[0] in self.arrays else f"{told(c[at]) if c[0] in WIDE else f'round(CAST({c[at]} AS DOUBLE), 6) + 0.0'} AS {c[0]}" for c in self.columns)
        return f"{named + ' ' if named else ''}SELECT StockId, Date, {exprs} FROM {self.source}{' GROUP BY StockId, Date' if self.grouped else ''}"

    def __call__(self, **inputs: DataFrame) -> DataFrame:
        read(self, inputs)
        spark = inputs[self.reads[0]].sparkSession
        given = {k: inputs[k] for k in self.reads}
        return spark.sql(as_spark("WITH " + self._text()), **given, parts=parts(given))

    def sql(self, inputs: dict[str, str]) -> str:
        parts = [f"{k} AS ({inputs[k]})" for k in ("ticks", *(r for r in self.reads if r != "ticks"))]
        text = f"WITH {', '.join(parts)}, " + self._text(True).format(**{k: k for k in inputs})
        for c in self.arrays:
            whole = f"array_to_string(list_transform({c}, lambda x: coalesce(CAST(CAST(round(x * 1000000) AS BIGINT) AS VARCHAR), '')), ',')"
            text = f"SELECT * REPLACE ({whole} AS {c}) FROM ({text}) AS with_{c}"
        return as_duckdb(text)

    def told(self, **inputs: DataFrame) -> DataFrame:
        """The table with arrays as text, in whole millionths, so that any engine's rows compare."""
        made = self(**inputs)
        for c in self.arrays:
            made = made.withColumn(c, F.array_join(F.transform(c, lambda x: F.coalesce(F.round(x * 1000000).cast("long").cast("string"), F.lit(""))), ","))
        return made


def told(value: str) -> str:
    """A double to six digits after the point, or as it is where a double has no more than that."""
    return f"CASE WHEN abs(CAST({value} AS DOUBLE)) < 1000000000 THEN round(CAST({value} AS DOUBLE), 6) ELSE CAST({value} AS DOUBLE) END + 0.0"


def as_spark(text: str) -> str:
    return doubles(text).replace(" IGNORE NULLS)", ") IGNORE NULLS").replace("QUANTILE(", "percentile(").replace("DAYS_ORDER", "OVER (PARTITION BY StockId ORDER BY Date)")


def as_duckdb(text: str) -> str:
    return doubles(text).replace("QUANTILE(", "quantile_cont(").replace("DAYS_ORDER", series_sql.ORDER)
