"""All features by name, as queries over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import bars, bins, brokers, columns, crosses, daily, dynamics, histograms, inside, ladder, leaders, marks, pairs, paths, quiet, shared, ticks, transforms, wide
from tidemark.plans.feature import Columns, Feature
from tidemark.sources.sql import BROKERS, DAILY, QUARTERS, TICKS
from tidemark.sources.tables import inputs

FEATURES: dict[str, Feature] = {f.name: f for part in (daily, ticks, brokers, crosses, ladder, transforms, dynamics, quiet, leaders, pairs) for f in part.FEATURES}

TABLES: tuple[Columns, ...] = columns.TABLES + wide.TABLES + paths.TABLES + bars.TABLES + dynamics.TABLES + bins.TABLES + marks.TABLES + histograms.TABLES + quiet.TABLES + pairs.TABLES + inside.TABLES


#: The table that has a column; the first that names it.
COLUMNS: dict[str, Columns] = {c[0]: t for t in reversed(TABLES) for c in t.columns}


def compute(names: list[str], **tables: DataFrame) -> DataFrame:
    """One table of several features and columns by stock and day; a key that any of them has is in it. What reads the same
    ticks, broker days or daily bars in the same way is one plan."""
    if unknown := [n for n in names if n not in FEATURES and n not in COLUMNS]:
        raise KeyError(f"unknown features: {', '.join(unknown)}")
    return shared.compute(names, FEATURES, COLUMNS, tables)


def catalogue(spark: SparkSession) -> DataFrame:
    """What features there are: name, combination, description, tables that they read."""
    return spark.createDataFrame([(f.name, f.combination, f.description, list(f.reads)) for f in FEATURES.values()], "name string, combination string, description string, reads array<string>")


def _query(feature: Feature | Columns, quarters: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    made = feature.told if isinstance(feature, Columns) else feature
    return lambda spark, sf_dir: made(**inputs(spark, sf_dir, quarters))


#: What needs more ticks a day than a month of the driver's trades has; these run over quarters too.
LONG_DAYS = [
    "f_be_salience_compression_stealth", "f_gt_trust_rebuilding_delay", "f_gt_uninformed_herding_bias", "f_qm_density_offdiag_relaxation", "f_sindy_residual_asymmetry",
    *(t.name for t in bars.TABLES + dynamics.TABLES + bins.TABLES + marks.TABLES + histograms.TABLES),
]

_ALL = FEATURES | {t.name: t for t in TABLES}
_SQL, _QUARTERS = ({"ticks": t.format(lineitem="lineitem"), "daily": DAILY.format(ticks="ticks"), "brokers": BROKERS.format(ticks="ticks")} for t in (TICKS, QUARTERS))
QUERIES = {n: _query(f) for n, f in _ALL.items()} | {f"{n}_quarters": _query(_ALL[n], True) for n in LONG_DAYS}
ORACLES = {n: f.sql(_SQL) for n, f in _ALL.items()} | {f"{n}_quarters": _ALL[n].sql(_QUARTERS) for n in LONG_DAYS}
