"""Sets, multisets, maps, multimaps and positional lists as DataFrames; every edit gives a new DataFrame."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as S
from pyspark.sql import types as T

from tessera.errors import ValidationError
from tessera.sources.stage import staged


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b).union(b.subtract(a))


def add(a: DataFrame, *row: Any) -> DataFrame:
    return union(a, a.sparkSession.createDataFrame([row], a.schema))


def remove(a: DataFrame, *row: Any) -> DataFrame:
    return a.subtract(a.sparkSession.createDataFrame([row], a.schema))


def has(a: DataFrame, *row: Any) -> bool:
    return not a.where(_is(a, row)).isEmpty()


def _is(a: DataFrame, row: Sequence[Any]) -> Column:
    c = S.lit(True)
    for name, v in zip(a.columns, row, strict=True):
        c = c & S.col(name).eqNullSafe(S.lit(v))
    return c


def or_merge(parts: Sequence[DataFrame]) -> DataFrame:
    """Concatenation, duplicates kept; or_merge_count counts the different rows."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def or_merge_count(parts: Sequence[DataFrame]) -> DataFrame:
    return or_merge(parts).distinct().agg(S.count(S.lit(1)).alias("count"))


def and_merge(parts: Sequence[DataFrame], residual: Column | None = None) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.intersect(p)
    return out if residual is None else out.where(residual)


class Collection:
    """What all collections have: their rows as a DataFrame, and as a query."""

    df: DataFrame

    def as_query(self) -> Any:
        from tessera.plans.query import from_collection

        return from_collection(self.df)


class Multiset(Collection):
    """Elements with counts: columns element, n."""

    def __init__(self, counts: DataFrame):
        self.df = counts

    @staticmethod
    def of(df: DataFrame, column: str) -> Multiset:
        return Multiset(df.groupBy(S.col(column).alias("element")).agg(S.count(S.lit(1)).alias("n")))

    def _with(self, element: Any, n: int) -> Multiset:
        row = self.df.sparkSession.createDataFrame([(element, n)], self.df.schema)
        return Multiset(self.df.unionAll(row).groupBy("element").agg(S.sum("n").alias("n")).where("n > 0"))

    def add(self, element: Any, n: int = 1) -> Multiset:
        return self._with(element, n)

    def remove(self, element: Any) -> Multiset:
        return self._with(element, -1)

    def get_count(self, element: Any) -> int:
        got = self.df.where(S.col("element").eqNullSafe(S.lit(element))).select("n").first()
        return got[0] if got else 0

    def has(self, element: Any) -> bool:
        return self.get_count(element) > 0

    def count(self) -> int:
        return self.df.count()

    def total_count(self) -> int:
        return self.df.agg(S.coalesce(S.sum("n"), S.lit(0))).first()[0]


class Mapping(Collection):
    """Columns key, value; unique on key."""

    def __init__(self, df: DataFrame):
        self.df = df

    def get(self, key: Any) -> Any:
        got = self.df.where(S.col("key") == S.lit(key)).select("value").first()
        return got[0] if got else None

    def has(self, key: Any) -> bool:
        return not self.df.where(S.col("key") == S.lit(key)).isEmpty()

    def set(self, key: Any, value: Any) -> Mapping:
        row = self.df.sparkSession.createDataFrame([(key, value)], self.df.select("key", "value").schema)
        return self.merge(Mapping(row))

    def remove(self, key: Any) -> Mapping:
        return Mapping(self.df.where(~S.col("key").eqNullSafe(S.lit(key))))

    def merge(self, other: Mapping) -> Mapping:
        """The other's value wins."""
        return Mapping(self.df.join(other.df.select("key"), "key", "left_anti").select("key", "value").unionAll(other.df.select("key", "value")))

    def rebase(self, base: Mapping, current: Mapping, numbers: str = "increment") -> Mapping:
        """Three-way merge of this map, changed since base, onto current. What changed on one side only is taken over, and a
        key removed here stays removed. What changed on both sides: of whole numbers current counts one further (numbers =
        'increment') or by this side's change ('difference'), arrays are sets and are united, maps are merged key by key by
        the same rules, and of other values this side's wins."""
        if numbers not in ("increment", "difference"):
            raise ValidationError("numbers is 'increment' or 'difference'")
        mine, old, now = (m.df.select("key", S.col("value").alias(n), S.lit(True).alias(f"in_{n}")) for m, n in ((self, "mine"), (base, "old"), (current, "now")))
        j = mine.join(old, "key", "full_outer").join(now, "key", "full_outer")
        kind = self.df.schema["value"].dataType
        changed = ~_same(S.col("mine"), S.col("old"), kind) | S.col("in_old").isNull() & S.col("in_mine").isNotNull()
        both = changed & S.col("in_now").isNotNull() & ~_same(S.col("now"), S.col("old"), kind)
        value = S.when(both, _merged(S.col("old"), S.col("mine"), S.col("now"), kind, numbers)).when(changed, S.col("mine")).otherwise(S.col("now"))
        removed = S.col("in_old").isNotNull() & S.col("in_mine").isNull()
        kept = S.col("in_now").isNotNull() | S.col("in_mine").isNotNull() & changed
        return Mapping(j.where(~removed & kept).select("key", value.alias("value")))


def _comparable(c: Column, kind: T.DataType) -> Column:
    """Maps have no order and can't be compared; their sorted entries can."""
    if not isinstance(kind, T.MapType):
        return c
    return S.array_sort(S.transform(S.map_entries(c), lambda e: S.struct(e.key.alias("k"), _comparable(e.value, kind.valueType).alias("v"))))


def _same(a: Column, b: Column, kind: T.DataType) -> Column:
    return _comparable(a, kind).eqNullSafe(_comparable(b, kind))


def _merged(old: Column, mine: Column, now: Column, kind: T.DataType, numbers: str) -> Column:
    """The value of a key that both sides changed."""
    missing = mine.isNull() | now.isNull()
    if isinstance(kind, T.IntegralType):
        return S.when(missing, mine).otherwise(now + (S.lit(1) if numbers == "increment" else mine - S.coalesce(old, S.lit(0)))).cast(kind)
    if isinstance(kind, T.ArrayType):
        return S.when(missing, mine).otherwise(S.array_union(now, mine))
    if isinstance(kind, T.MapType):
        was = lambda k: S.element_at(old, k)
        one = lambda k, m, n: S.when(_same(m, was(k), kind.valueType), n).when(_same(n, was(k), kind.valueType), m).otherwise(_merged(was(k), m, n, kind.valueType, numbers))
        kept = S.map_filter(S.map_zip_with(mine, now, one), lambda k, v: v.isNotNull())
        return S.when(missing, mine).otherwise(kept)
    return mine


class Multimap(Collection):
    """Columns key, value; a key may have many values, each counted once for each time it was put."""

    def __init__(self, df: DataFrame):
        self.df = df

    def get(self, key: Any) -> DataFrame:
        return self.df.where(S.col("key").eqNullSafe(S.lit(key))).select("value")

    def put(self, key: Any, value: Any) -> Multimap:
        return Multimap(self.df.unionAll(self.df.sparkSession.createDataFrame([(key, value)], self.df.schema)))

    def remove(self, key: Any, value: Any) -> Multimap:
        return Multimap(self.df.exceptAll(self.df.sparkSession.createDataFrame([(key, value)], self.df.schema)))

    def grouped(self) -> DataFrame:
        return self.df.groupBy("key").agg(S.collect_set("value").alias("values"))

    @staticmethod
    def index(df: DataFrame, keys: Column, id_column: str) -> Multimap:
        """An inverted index by an extractor: an array gives many keys, a string is one key, null none."""
        many = dict(df.select(keys.alias("k")).dtypes)["k"].startswith("array")
        k = S.explode(keys) if many else keys
        return Multimap(df.select(k.alias("key"), S.col(id_column).alias("value")).where("key is not null"))


class PositionalList(Collection):
    """A sequence: rows with their position in _pos, 0 up without gaps."""

    def __init__(self, df: DataFrame):
        if "_pos" not in df.columns:
            raise ValidationError("a list needs a column _pos")
        self.df = df

    @staticmethod
    def of(df: DataFrame, *order: str) -> PositionalList:
        """The rows in an order, numbered from 0: they are dealt by ranges of the order and numbered in each range after the
        sizes of the ranges before it, so no task holds them all. Equal rows fall into one range."""
        parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", S.spark_partition_id()).withColumn("_in", S.monotonically_increasing_id())
        parts = staged(parts, "ordered")
        first = parts.groupBy("_part").agg(S.min("_in").alias("_first"), S.count(S.lit(1)).alias("_n"))
        before = first.withColumn("_before", S.coalesce(S.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), S.lit(0)))
        numbered = parts.join(S.broadcast(before), "_part").withColumn("_pos", S.col("_in") - S.col("_first") + S.col("_before"))
        return PositionalList(numbered.select("_pos", *df.columns))

    @property
    def fields(self) -> list[str]:
        return [c for c in self.df.columns if c != "_pos"]

    def size(self) -> int:
        return self.df.agg(S.coalesce(S.max("_pos") + 1, S.lit(0))).first()[0]

    def _at(self, i: int, n: int | None = None) -> int:
        return i if i >= 0 else (self.size() if n is None else n) + i

    def slice(self, a: int = 0, b: int | None = None) -> PositionalList:
        """Half open, negative bounds from the end, out-of-range bounds clamped; positions are counted anew."""
        a, b = max(0, self._at(a)), None if b is None else self._at(b)
        df = self.df.where(S.col("_pos") >= a) if b is None else self.df.where((S.col("_pos") >= a) & (S.col("_pos") < b))
        return PositionalList(df.withColumn("_pos", S.col("_pos") - a))

    def head(self, n: int) -> PositionalList:
        return self.slice(0, n)

    def tail(self, k: int) -> PositionalList:
        return self.slice(k)

    def get(self, i: int) -> Any:
        return self.df.where(S.col("_pos") == self._at(i)).select(*self.fields).first()

    def _row(self, i: int, row: Sequence[Any]) -> DataFrame:
        kinds = self.df.select(*self.fields).schema
        return self.df.sparkSession.createDataFrame([tuple(row)], kinds).withColumn("_pos", S.lit(i).cast("long")).select(*self.df.columns)

    def set(self, i: int, *row: Any) -> PositionalList:
        i = self._at(i)
        return PositionalList(self.df.where(S.col("_pos") != i).unionAll(self._row(i, row)))

    def insert(self, i: int, *row: Any) -> PositionalList:
        n = self.size()
        i = max(0, min(self._at(i, n), n))
        moved = self.df.withColumn("_pos", S.when(S.col("_pos") >= i, S.col("_pos") + 1).otherwise(S.col("_pos"))).select(*self.df.columns)
        return PositionalList(moved.unionAll(self._row(i, row)))

    def remove(self, i: int) -> PositionalList:
        i = self._at(i)
        kept = self.df.where(S.col("_pos") != i)
        return PositionalList(kept.withColumn("_pos", S.when(S.col("_pos") > i, S.col("_pos") - 1).otherwise(S.col("_pos"))).select(*self.df.columns))

    def remove_first(self) -> PositionalList:
        return self.remove(0)

    def remove_last(self) -> PositionalList:
        return self.remove(-1)

    def append_first(self, *row: Any) -> PositionalList:
        return self.insert(0, *row)

    def append_last(self, *row: Any) -> PositionalList:
        return PositionalList(self.df.unionAll(self._row(self.size(), row)))

    def extend(self, other: PositionalList) -> PositionalList:
        n = self.size()
        return PositionalList(self.df.unionAll(other.df.withColumn("_pos", S.col("_pos") + n).select(*self.df.columns)))
