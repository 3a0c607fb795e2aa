"""Grouped aggregation with named aggregators, null groups, and no rows out of no rows in."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as S
from pyspark.sql import types as T

from tessera.errors import ValidationError

KINDS: dict[str, Callable[[Column], Column]] = {
    "sum": lambda c: S.coalesce(S.sum(c.cast("double")), S.lit(0.0)),
    "avg": lambda c: S.coalesce(S.avg(S.coalesce(c.cast("double"), S.lit(0.0))), S.lit(0.0)),
    "count": lambda c: S.count(S.lit(1)),
    "min": S.min,
    "max": S.max,
    "array": lambda c: S.transform(S.collect_list(S.struct(c.alias("x"))), lambda e: e.x),
}


@dataclass(frozen=True)
class Spec:
    """kind: a name in KINDS, or a function of a list of values (a grouped pandas UDF then). Missing numbers count as 0; in an
    array other missing values stay null."""

    kind: str | Callable[[list], Any]
    source: str
    target: str
    returns: str = "double"

    def column(self, df: DataFrame) -> Column:
        if isinstance(self.kind, str):
            if self.kind not in KINDS:
                raise ValidationError(f"unknown aggregator {self.kind!r}")
            c = S.col(self.source)
            if self.kind == "array" and isinstance(kind := df.select(c).schema[0].dataType, T.NumericType):
                c = S.coalesce(c, S.lit(0).cast(kind))
            return KINDS[self.kind](c).alias(self.target)
        fn = self.kind

        def run(values: pd.Series) -> float:
            return fn([0 if pd.isna(v) else v for v in values])

        return S.pandas_udf(run, self.returns)(S.col(self.source)).alias(self.target)


def group(df: DataFrame, keys: Sequence[str], specs: Sequence[Spec]) -> DataFrame:
    """One row for each key, the null key included. Without keys: one row, or none where df is empty."""
    aggs = [s.column(df) for s in specs]
    if keys:
        return df.groupBy(*keys).agg(*aggs)
    return df.groupBy(S.lit(1).alias("__one")).agg(*aggs).drop("__one")
