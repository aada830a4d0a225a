"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one Arrow batch.  Texts are a few KB on average, so a batch stays at some MB;
#: operators cut a batch further by characters (``slices``) before they build arrays.
ROWS_PER_BATCH = 500
BYTES_PER_BATCH = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches that Python workers hold small, and let workers import this package.

    The second matters only where the package is used from a source folder and not installed.
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept for judging a model: crc32 of the id's text is divisible by 5.  A null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column as Python strings; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def slices(texts: Sequence[str], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts with about ``limit`` characters, one text at least."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the frame does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = wanted
    while name.lower() in taken:
        name += "_"
    return name


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType)


def row_keys(df: DataFrame) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a whole row: nulls are marked by place, maps are hashed as JSON."""
    parts: list[Column] = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        parts += [F.to_json(F.struct(column)) if _holds_map(field.dataType) else column, column.isNull()]
    return F.xxhash64(F.lit(0), *parts), F.xxhash64(F.lit(1), *parts)


def sample_below(key: Column, share: Column | float) -> Column:
    """True for a fixed pseudo-random ``share`` of the keys, the same on every run."""
    return (F.xxhash64(key, F.lit("sample")) / F.lit(2.0**64) + F.lit(0.5)) < share


def kept_rows(df: DataFrame, text: str, keep: Callable[[list[str]], Sequence[bool]]) -> DataFrame:
    """The rows, with all their columns, whose texts ``keep`` marks; it sees a batch of texts at a time."""
    bounded_batches(df.sparkSession)

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(texts_of(batch, text)), pa.bool_()))

    return df.mapInArrow(filtered, df.schema)
