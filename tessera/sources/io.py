"""Rows, Arrow and Parquet in and out."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as S

from tessera.errors import ValidationError
from tessera.functions.vectors import require_dim
from tessera.plans.tokens import compile_predicate


def from_rows(spark: SparkSession, rows: Iterable[Any], schema: Any = None, position: str | None = None) -> DataFrame:
    """Dicts get the union of their keys as columns, absent values null; scalars get one column named value."""
    rows = list(rows)
    if rows and isinstance(rows[0], dict):
        names = list(dict.fromkeys(k for r in rows for k in r))
        if position:
            rows = [{position: i, **r} for i, r in enumerate(rows)]
            names = [position, *names]
        data = [tuple(r.get(n) for n in names) for r in rows]
        return spark.createDataFrame(data, schema or names)
    if not rows and schema is None:
        raise ValidationError("an empty collection needs a schema")
    if rows and not isinstance(rows[0], (tuple, list)):
        rows, schema = [(r,) for r in rows], schema or ["value"]
    return spark.createDataFrame(rows, schema)


def scan_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None, filters: Any = None) -> DataFrame:
    """A pruned, filtered scan; Spark pushes both into the Parquet reader."""
    df = spark.read.parquet(path)
    if filters is not None:
        df = df.where(compile_predicate(filters).column(df) if isinstance(filters, (list, tuple)) else filters)
    return df.select(*columns) if columns else df


def parquet_rows(spark: SparkSession, path: str, columns: Sequence[str] | None = None, filters: Any = None) -> list[dict]:
    return [r.asDict(recursive=True) for r in scan_parquet(spark, path, columns, filters).collect()]


def to_arrow(df: DataFrame, columns: Sequence[str] | None = None) -> pa.Table:
    """An Arrow table on the driver; a wanted column that is absent is null."""
    if columns is not None:
        df = df.select(*(S.col(c) if c in df.columns else S.lit(None).cast("string").alias(c) for c in columns))
    return df.toArrow()


def to_parquet(df: DataFrame, path: str, compression: str = "zstd", dictionary: bool = True, row_group_bytes: int | None = None, mode: str = "error", partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode(mode).option("compression", compression).option("parquet.enable.dictionary", str(dictionary).lower())
    if row_group_bytes:
        w = w.option("parquet.block.size", row_group_bytes)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def arrow_to_parquet(spark: SparkSession, table: pa.Table, path: str, **options: Any) -> None:
    to_parquet(spark.createDataFrame(table), path, **options)


def vectors(df: DataFrame, column: str, dim: int) -> DataFrame:
    """The column as array<float> of exactly dim components; a row of another size fails the job."""
    return df.withColumn(column, require_dim(S.col(column), dim))
