"""Unnesting, correlated collections, and lateral top-n."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as S

from tessera.errors import ValidationError


def unnest(df: DataFrame, path: Column, alias: str | None = None) -> DataFrame:
    """One row for each element; null and empty collections give none. With an alias the row keeps its other columns."""
    return df.select("*", S.explode(path).alias(alias)) if alias else df.select(S.explode(path).alias("value"))


def collection_field(df: DataFrame, child: DataFrame, name: str, on: Sequence[tuple[str, str]], fields: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Each row with the array of its child rows (structs of the fields, sorted by `order`), empty where it has none."""
    keys = [S.col(c).alias(f"__k{i}") for i, (_, c) in enumerate(on)]
    item = S.struct(*[S.col(c).alias(f"__o{i}") for i, c in enumerate(order)], *fields)
    rows = child.groupBy(*keys).agg(S.sort_array(S.collect_list(item)).alias("__items"))
    match = [S.col(p).eqNullSafe(S.col(f"__k{i}")) for i, (p, _) in enumerate(on)]
    shape = S.transform(S.col("__items"), lambda x: S.struct(*[x[f].alias(f) for f in fields]))
    return df.join(rows, match, "left").withColumn(name, S.coalesce(shape, S.array())).drop("__items", *[f"__k{i}" for i in range(len(on))])


def sortable(df: DataFrame) -> list[str]:
    """The columns whose types have an order."""
    return [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]


def top_n(df: DataFrame, child: DataFrame, on: Sequence[tuple[str, str]], order: Sequence[Any], n: int | None, how: str = "inner") -> DataFrame:
    """For each row the first n child rows of its key: the window form of a lateral join, so the child is ranked once.
    Without an order, child rows are ordered by all their columns that have one."""
    if not on:
        raise ValidationError("a correlated select_many needs on=[(parent, child)]")
    if n is not None:
        order = order or sortable(child)
        w = Window.partitionBy(*[c for _, c in on]).orderBy(*order)
        child = child.withColumn("__rn", S.row_number().over(w)).where(S.col("__rn") <= n).drop("__rn")
    taken = set(df.columns)
    renamed = {c: f"__r_{c}" for c in child.columns if c in taken}
    child = child.withColumnsRenamed(renamed)
    match = [df[p].eqNullSafe(child[renamed.get(c, c)]) for p, c in on]
    return df.join(child, match, how).drop(*renamed.values())


def lateral(df: DataFrame, child: DataFrame, how: str = "inner") -> DataFrame:
    """A general correlated subquery; child refers to df's columns with Column.outer()."""
    return df.lateralJoin(child, how=how)
