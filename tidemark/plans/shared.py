"""Many features as columns of one plan.

A feature that sums up a stock's day in one grouping, and goes on row by row and over the stock's days, can share its
work: the groupings of all features over the same ticks (or broker days) become structs of one grouping, and their
steps become columns over one window of a stock's days. So ten features of ticks scan, shuffle and sort the ticks once.
Features of another form keep a plan of their own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import series
from tidemark.plans.feature import Columns, Feature, as_spark, read

_GROUPED = re.compile(r"\s*SELECT StockId, Date, (?P<list>.*) FROM (?P<source>\w+) GROUP BY StockId, Date\s*", re.S)
_BY_ROW = re.compile(r"\s*SELECT StockId, Date, (?P<list>.*) FROM (?P<source>\w+)\s*", re.S)
_NOT_BY_ROW = re.compile(r"\b(OVER|JOIN|WHERE|GROUP BY|DISTINCT|UNION|SELECT)\b")


@dataclass(frozen=True)
class Shape:
    """A feature in the form that can be shared: the query that its grouping reads (none: daily bars as they are), what it
    groups to, and what it selects row by row after that."""

    feature: Feature
    base: tuple[str, str] | None
    grouped: str
    rows: tuple[str, ...]

    @property
    def group(self) -> tuple:
        return (self.feature.reads, self.base)


def shape(feature: Feature) -> Shape | None:
    first, *rest = (q[:2] for q in feature.queries)
    if not rest:
        return Shape(feature, None, "", ()) if first[1].strip() == "SELECT * FROM {daily}" else None
    if len(feature.reads) != 1:
        return None
    found = _GROUPED.fullmatch(rest[0][1])
    if not found or found["source"] != first[0] or _NOT_BY_ROW.search(found["list"]):
        return None
    rows, name = [], rest[0][0]
    for n, text in rest[1:]:
        one = _BY_ROW.fullmatch(text)
        if not one or one["source"] != name or _NOT_BY_ROW.search(one["list"]):
            return None
        rows.append(one["list"])
        name = n
    return Shape(feature, first, found["list"], tuple(rows))


def together(shapes: list[Shape], tables: dict[str, DataFrame]) -> DataFrame:
    """The values of features that share a grouping, by stock and day."""
    reads, base = shapes[0].group
    for s in shapes:
        read(s.feature, tables)
    given = {k: tables[k] for k in reads}
    spark = given[reads[0]].sparkSession
    if base is None:
        df, held = given[reads[0]], None
    else:
        structs = ", ".join(f"struct({s.grouped}) AS of_{k}" for k, s in enumerate(shapes))
        df, held = spark.sql(as_spark(f"WITH {base[0]} AS ({base[1]}) SELECT StockId, Date, {structs} FROM {base[0]} GROUP BY StockId, Date"), **given), "of_"
    done: list[str] = []
    for k, s in enumerate(shapes):
        before = ["StockId", "Date", *done, *(f"of_{j}" for j in range(k + 1, len(shapes)) if held)]
        own = df.select(*before, f"of_{k}.*") if held else df
        for texts in s.rows:
            own = own.selectExpr(*before, *_listed(as_spark(texts)))
        for out, function, what, *args in s.feature.steps:
            own = own.withColumn(out, _step(function, what, args))
        last = s.feature.steps[-1][0]
        value = (F.round(F.col(last), 6) + F.lit(0.0)).alias(s.feature.name)
        df = own.select(*before, value) if held else own.select(*df.columns, value)
        done.append(s.feature.name)
    return df.select("StockId", "Date", *done)


def _step(function: str, what: str, args: list) -> Column:
    return F.expr(as_spark(what)) if function == "sql" else getattr(series, function)(F.col(what), *args)


def _listed(text: str) -> list[str]:
    """A select list by its commas outside brackets and quotes."""
    out, depth, quoted, at = [], 0, False, 0
    for k, c in enumerate(text):
        quoted ^= c == "'"
        depth += 0 if quoted else (c in "([") - (c in ")]")
        if c == "," and depth == 0 and not quoted:
            out.append(text[at:k])
            at = k + 1
    return [*out, text[at:]]


def compute(names: list[str], features: dict[str, Feature], columns: dict[str, Columns], tables: dict[str, DataFrame]) -> DataFrame:
    """One table of features and columns by stock and day, in the order asked for; a key that any of them has is in it."""
    groups: dict[object, list] = {}
    for n in dict.fromkeys(names):
        if n in columns:
            groups.setdefault(columns[n].name, []).append(n)
            continue
        found = shape(features[n])
        groups.setdefault(found.group if found else n, []).append(found or features[n])
    out = None
    for key, members in groups.items():
        if isinstance(members[0], Shape):
            part = together(members, tables)
        elif isinstance(members[0], Feature):
            part = members[0](**tables)
        else:
            part = columns[members[0]](**tables).select("StockId", "Date", *members)
        out = part if out is None else out.join(part, ["StockId", "Date"], "full_outer")
    return out.select("StockId", "Date", *dict.fromkeys(names))
