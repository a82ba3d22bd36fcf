"""Helpers that the operators share: reading tables, folders, Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, StructField, StructType

#: Rows and bytes of an Arrow batch sent to a Python worker: documents may be long, so few go at once.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application."""
    context = spark.sparkContext
    if getattr(context, "_tidemark_shipped", False):
        return
    top = Path(__file__).parents[2]
    path = f"{tempfile.mkdtemp(prefix='tidemark-')}/tidemark_{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((top / "tidemark").rglob("*.py")):
            z.write(p, p.relative_to(top))
    context.addPyFile(path)
    context._tidemark_shipped = True


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Make Python workers ready: they get this package, and an Arrow batch has a bound, whatever the rows' length."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def freed() -> None:
    """Give memory that is no longer used back to the system: a Python worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow; at the end of a partition the worker gives its memory back."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            freed()

    return df.mapInArrow(whole, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a local one only where none is named."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = getattr(spark, "_tidemark_folder", None) or tempfile.mkdtemp(prefix="tidemark-")
        spark._tidemark_folder = folder
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Shuffle files go when the query that made them ends (a setting of Spark's): a table once written is read, not made again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Paths of the tables written inside each open `scratch`, the innermost last; by thread.
_OPEN = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables written with `stored` in here are removed at its end, but for those of the frames put into the list.

    What leaves the scope must only read tables that were put there, or tables from outside.
    """
    scopes = _OPEN.__dict__.setdefault("scopes", [])
    keep: list[DataFrame] = []
    scopes.append([])
    try:
        yield keep
    finally:
        paths = scopes.pop()
        kept = {p for frame in keep for p in getattr(frame, "_tidemark_paths", [])}
        if scopes:
            scopes[-1] += [p for p in paths if p in kept]
        for path in paths:
            if path not in kept:
                place = spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as a Parquet table in the shared folder and read it again: this cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_paths = [path]
    scopes = _OPEN.__dict__.get("scopes")
    if scopes:
        scopes[-1].append(path)
    return out


def with_fields(df: DataFrame, **kinds: str) -> StructType:
    """The frame's schema with more columns at its end."""
    return StructType([*df.schema.fields, *(StructField(k, DataType.fromDDL(v)) for k, v in kinds.items())])


def text_slices(batches: Iterator[pa.RecordBatch], text: int = 1, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of the batches with about `most` characters of text each, and their texts (null: empty)."""
    for batch in batches:
        texts = [t or "" for t in batch.column(text).to_pylist()]
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        at = 0
        while at < len(texts):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at), texts[at:to]
            at = to


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... start+length-1 of each row, joined."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.arange(total, dtype=np.int64)
    out += np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return out
