"""User functions over partitions, and physical layout in the place of secondary indexes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame


def parallel_scan(df: DataFrame, process: Callable[[dict], dict | None], schema: Any) -> DataFrame:
    """Map and filter each row with Python in Arrow batches; rows for which process gives None are dropped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for r in map(process, b.to_dict("records")) if r is not None]
            if rows:
                yield pd.DataFrame(rows)

    return df.mapInPandas(run, schema)


def flat_scan(df: DataFrame, produce: Callable[[dict], list[dict]], schema: Any) -> DataFrame:
    """Any number of output rows for each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [x for r in b.to_dict("records") for x in produce(r)]
            if rows:
                yield pd.DataFrame(rows)

    return df.mapInPandas(run, schema)


def clustered(df: DataFrame, column: str, partitions: int | None = None) -> DataFrame:
    """Range-clustered rows: written as Parquet, point and range filters on the column skip most row groups."""
    spread = df.repartitionByRange(partitions, column) if partitions else df.repartitionByRange(column)
    return spread.sortWithinPartitions(column)
