"""The fluent, immutable, lazily evaluated query over one DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as S
from pyspark.sql import types as T

from tessera.errors import ValidationError
from tessera.functions.fields import F, GroupFunction, Typed, Untraceable, returns_of, touched, trace
from tessera.operators import joins, nested, traverse
from tessera.plans.expr import And, Compare, Expr, Field, as_column, strict
from tessera.plans.policy import Policy
from tessera.plans.tokens import compile_predicate

RAISE = object()


def from_collection(source: Any, spark: SparkSession | None = None, schema: Any = None) -> Query:
    """A query over a DataFrame, a Parquet path, another query, or rows (dicts, tuples with a schema, or scalars)."""
    if isinstance(source, Query):
        return source
    if isinstance(source, DataFrame):
        return Query(source)
    spark = spark or SparkSession.getActiveSession()
    if isinstance(source, str):
        return Query(spark.read.parquet(source))
    from tessera.sources.io import from_rows

    return Query(from_rows(spark, source, schema))


@dataclass(frozen=True)
class Query:
    df: DataFrame
    policy: Policy = Policy()
    ops: tuple[str, ...] = ()
    keys: tuple[Column, ...] = ()
    scalar: bool = False
    outer: tuple[str, ...] = ()  # of a correlated query: the outer row's fields that its columns __k0, __k1, ... equal

    def _next(self, df: DataFrame, op: str, **more: Any) -> Query:
        return replace(self, df=df, ops=(*self.ops, op), **({"keys": ()} | more))

    # policy

    def with_policy(self, policy: Policy) -> Query:
        return replace(self, policy=policy)

    def on_unsupported(self, mode: str) -> Query:
        return replace(self, policy=replace(self.policy, on_unsupported=mode))

    # expressions

    def _column(self, value: Any, kind: str | None = None) -> Column:
        """A native column; a callable that can't be traced runs as a UDF in Arrow batches over the fields that it reads, if
        the policy lets it. Its type is the one given, that of its annotation, or that of typed()."""
        if isinstance(value, str):
            return Field(value).column(self.df)
        try:
            value = trace(value)
        except Untraceable as e:
            self.policy.allow_python(str(e))
            kind = returns_of(value) or kind
            if kind is None:
                raise ValidationError("this callable runs as Python: say what it returns by an annotation or by typed(fn, 'double')") from e
            names = touched(value)
            names = names if names and set(names) <= set(self.df.columns) else self.df.columns
            return _python(value.fn if isinstance(value, Typed) else value, names, kind)
        return as_column(value, self.df)

    def _predicate(self, p: Any) -> Column:
        if isinstance(p, (list, tuple)):
            p = compile_predicate(p)
        if isinstance(p, Expr):
            return p.column(self.df)
        return p if isinstance(p, Column) else self._column(p, "boolean")

    # transformations

    def where(self, predicate: Any) -> Query:
        """Tokens, an expression, a Column or a callable. Rows for which it is not true are dropped. Inside a select_many, an
        equality with a field of the outer row makes the query correlated: later steps count for each value of it."""
        if callable(predicate) and not isinstance(predicate, (Expr, Column)):
            try:
                predicate = trace(predicate)
            except Untraceable:
                pass
        same, rest = correlated(predicate)
        if not same:
            return self._next(self.df.where(self._predicate(predicate)), "where", keys=self.keys)
        n = len(self.outer)
        df = self.df.withColumns({f"__k{n + i}": e.column(self.df) for i, (e, _) in enumerate(same)})
        q = self._next(df, "where", keys=self.keys, outer=(*self.outer, *(o for _, o in same)))
        return q if rest is None else q.where(rest)

    filter = where

    def select(self, what: Any, **types: str) -> Query:
        """A dict of outputs, or one value: then the result has one column named value. A source that is absent gives null.
        types: the Spark types of callables that can't be traced, by output (value where there is one)."""
        if not isinstance(what, (dict, str, Expr, Column)) and callable(what):
            try:
                what = trace(what)
            except Untraceable:
                pass
        if isinstance(what, dict):
            return self._next(self.df.select(*(self._output(v, types.get(k)).alias(k) for k, v in what.items()), *self._own_keys()), "select", scalar=False)
        return self._next(self.df.select(self._output(what, types.get("value")).alias("value"), *self._own_keys()), "select", scalar=True)

    def _own_keys(self) -> list[str]:
        return [f"__k{i}" for i in range(len(self.outer))]

    def _output(self, value: Any, kind: str | None) -> Column:
        root = value._path.split(".")[0] if isinstance(value, Field) else value.split(".")[0] if isinstance(value, str) else None
        if root is not None and not self._has(root):
            return S.lit(None).cast("string")
        return self._column(value, kind)

    def _has(self, name: str) -> bool:
        try:
            return name in self.df.columns
        except AnalysisException:
            return True  # the columns of a correlated query are known only with the outer row

    def with_field(self, name: str, value: Any) -> Query:
        return self._next(self.df.withColumn(name, self._column(value)), "with_field")

    def order_by(self, key: Any, ascending: bool = True, nulls_last: bool = True) -> Query:
        return self._sorted((), key, ascending, nulls_last, "order_by")

    def then_by(self, key: Any, ascending: bool = True, nulls_last: bool = True) -> Query:
        if not self.keys:
            raise ValidationError("then_by follows order_by")
        return self._sorted(self.keys, key, ascending, nulls_last, "then_by")

    def _sorted(self, before: tuple, key: Any, ascending: bool, nulls_last: bool, op: str) -> Query:
        c = self._column(key)
        c = (c.asc_nulls_last() if nulls_last else c.asc_nulls_first()) if ascending else (c.desc_nulls_last() if nulls_last else c.desc_nulls_first())
        keys = (*before, c)
        return self._next(self.df if self.outer else self.df.orderBy(*keys), op, keys=keys)

    def take(self, n: int) -> Query:
        return self._next(self._ranked(lambda place: place <= n) if self.outer else self.df.limit(max(0, n)), "take", keys=self.keys)

    def skip(self, n: int) -> Query:
        return self._next(self._ranked(lambda place: place > n) if self.outer else self.df.offset(max(0, n)), "skip", keys=self.keys)

    def _ranked(self, which: Callable[[Column], Column]) -> DataFrame:
        """The rows of a correlated query by their place among those of the same outer values."""
        w = Window.partitionBy(*self._own_keys()).orderBy(*(self.keys or nested.sortable(self.df)))
        return self.df.withColumn("__rn", S.row_number().over(w)).where(which(S.col("__rn"))).drop("__rn")

    def distinct(self, key: Any = None, order: Sequence[Any] = ()) -> Query:
        """Distinct rows, or one row for each key: the first by `order`, any one where no order is given."""
        if key is None:
            return self._next(self.df.distinct(), "distinct")
        if not order:
            named = self.df.withColumn("__key", self._column(key))
            return self._next(named.dropDuplicates(["__key"]).drop("__key"), "distinct")
        w = Window.partitionBy(self._column(key)).orderBy(*(self._column(o) for o in order))
        return self._next(self.df.withColumn("__rn", S.row_number().over(w)).where("__rn = 1").drop("__rn"), "distinct")

    def group_by(self, key: Any, element: Any = None) -> Grouped:
        return Grouped(self, key, element)

    def join(self, other: Any, how: str = "inner", on: Any = None, left: str = "left", right: str = "right", null_safe: bool | None = None) -> Query:
        other = other.df if isinstance(other, Query) else other
        return self._next(joins.join(self.df, other, how, on, left, right, null_safe), f"join:{how}", scalar=False)

    def alias(self, name: str) -> Query:
        """FROM with an alias: each row as a struct under the name, so that later steps say name.field."""
        return self._next(self.df.select(S.struct("*").alias(name)), "from", scalar=False)

    def persist(self) -> Query:
        """The same query, whose rows stay in memory or on disk once they are computed, until unpersist()."""
        return self._next(self.df.persist(), "persist", keys=self.keys)

    def unpersist(self) -> Query:
        return self._next(self.df.unpersist(), "unpersist", keys=self.keys)

    def unnest(self, path: Any, alias: str | None = None) -> Query:
        return self._next(nested.unnest(self.df, self._column(path, "array<string>"), alias), "unnest", scalar=alias is None)

    def collection_field(self, name: str, child: Any, on: Sequence[tuple[str, str]], fields: Sequence[str], order: Sequence[str] = ()) -> Query:
        child = child.df if isinstance(child, Query) else child
        return self._next(nested.collection_field(self.df, child, name, on, fields, order), "collection_field")

    def select_many(self, child: Any, on: Sequence[tuple[str, str]] = (), order: Sequence[Any] = (), n: int | None = None, how: str = "inner", result: Callable | None = None) -> Query:
        """An array column (explode), for each row the first n matching rows of another query, or a callable: of a row it
        gives an array, or a query that may use the row's fields (a lateral join). result: what to select of (row, element)."""
        if isinstance(child, (str, Field)):
            return self.unnest(child)
        if callable(child) and not isinstance(child, Query):
            return self._many(child, result, how)
        child = child.df if isinstance(child, Query) else child
        return self._next(nested.top_n(self.df, child, on, order, n, how), "select_many")

    def _many(self, selector: Callable, result: Callable | None, how: str) -> Query:
        whole = S.struct("*").alias("__l")
        try:
            got = selector(_Outer())
        except Exception:
            got = None
        if isinstance(got, Query) and got.outer:
            scalar, keys = got.scalar, got._own_keys()
            child = got.df.select(S.struct(*(f"`{c}`" for c in got.df.columns if c not in keys)).alias("__r"), *keys)
            match = [S.col(f"__l.`{o}`").eqNullSafe(S.col(k)) for o, k in zip(got.outer, keys)]
            df = self.df.select(whole).join(child, match, how).drop(*keys)
            out = df.select("__r.*")
        elif isinstance(got, (Query, DataFrame)):
            child = got.df if isinstance(got, Query) else got
            scalar = isinstance(got, Query) and got.scalar
            df = nested.lateral(self.df.select(whole), child.select(S.struct("*").alias("__r")), how)
            out = df.select("__r.*")
        else:
            scalar = True
            df = self.df.select(whole, (S.explode_outer if how == "left" else S.explode)(self._column(selector)).alias("__r"))
            out = df.select(S.col("__r").alias("value"))
        if result is not None:
            wanted = result(Field("__l"), Field("__r.value") if scalar and isinstance(got, Query) else Field("__r"))
            scalar = not isinstance(wanted, dict)
            out = df.select(*(as_column(v, df).alias(k) for k, v in ({"value": wanted} if scalar else wanted).items()))
        return self._next(out, "select_many", scalar=scalar)

    def lateral(self, child: DataFrame, how: str = "inner") -> Query:
        """A correlated subquery; child refers to this query's columns with Column.outer()."""
        return self._next(nested.lateral(self.df, child, how), "lateral", scalar=False)

    def near(self, index: Any, q: Sequence[float], threshold: float) -> Query:
        """The rows of this query that near[] holds for, found through a vector index over the same ids."""
        found = index.near(q, threshold).select(index.id)
        return self._next(self.df.join(found, index.id, "left_semi"), "near", scalar=self.scalar)

    def traverse(self, edges: DataFrame, key: str = "id", **options: Any) -> Query:
        return self._next(traverse.traverse(self.df.select(S.col(key).alias("node")), edges, **options), "traverse", scalar=False)

    # terminals

    def to_df(self) -> DataFrame:
        return self.df

    def to_list(self) -> list[Any]:
        rows = self.policy.rows(self.df)
        return [r[0] for r in rows] if self.scalar else rows

    def to_set(self) -> set[Any]:
        return set(self.to_list())

    def to_dict(self, key: Any, value: Any = None) -> dict[Any, Any]:
        """A key that occurs twice is refused."""
        v = S.struct("*") if value is None else self._column(value)
        out: dict[Any, Any] = {}
        for k, x in self.policy.rows(self.df.select(self._column(key).alias("k"), v.alias("v"))):
            if k in out:
                raise ValidationError(f"key {k!r} occurs more than once")
            out[k] = x
        return out

    def __iter__(self):
        bounded = self.policy.max_rows_local is not None or self.policy.timeout_ms is not None
        for r in self.policy.rows(self.df) if bounded else self.df.toLocalIterator():
            yield r[0] if self.scalar else r

    def first(self, predicate: Any = None) -> Any:
        got = self.first_or_default(RAISE, predicate)
        if got is RAISE:
            raise ValueError("there is no such row")
        return got

    def first_or_default(self, default: Any = None, predicate: Any = None) -> Any:
        q = self if predicate is None else self.where(predicate)
        got = self.policy.timed(q.df, lambda: q.df.limit(1).collect())
        return (got[0][0] if self.scalar else got[0]) if got else default

    def any(self, predicate: Any = None) -> bool:
        df = (self if predicate is None else self.where(predicate)).df
        return not self.policy.timed(df, df.isEmpty)

    def all(self, predicate: Any) -> bool:
        p = compile_predicate(predicate) if isinstance(predicate, (list, tuple)) else trace(predicate)
        df = self.df.where(~strict(p, self.df))
        return self.policy.timed(df, df.isEmpty)

    def count(self, predicate: Any = None) -> int:
        df = (self if predicate is None else self.where(predicate)).df
        return self.policy.timed(df, df.count)

    def count_plan(self) -> Query:
        return self._next(self.df.agg(S.count(S.lit(1)).alias("count")), "count")

    def _value(self, selector: Any) -> Column:
        return S.col("value") if selector is None else self._column(selector)

    def sum(self, selector: Any = None) -> Any:
        return self._one(S.coalesce(S.sum(self._value(selector)), S.lit(0)))[0]

    def _one(self, *aggregates: Column) -> Any:
        df = self.df.agg(*aggregates)
        return self.policy.timed(df, df.first)

    def min(self, selector: Any = None) -> Any:
        return self._extreme(S.min, selector)

    def max(self, selector: Any = None) -> Any:
        return self._extreme(S.max, selector)

    def _extreme(self, fn: Callable, selector: Any) -> Any:
        n, out = self._one(S.count(S.lit(1)), fn(self._value(selector)))
        if not n:
            raise ValueError("there are no rows")
        return out

    def average(self, selector: Any = None) -> float:
        c = S.coalesce(self._value(selector), S.lit(0)).cast("double")
        return self._one(S.coalesce(S.avg(c), S.lit(0.0)))[0]

    def explain(self, format: str = "text") -> Any:
        plan = self.df._jdf.queryExecution()
        parts = {"plan": list(self.ops), "optimized": plan.optimizedPlan().toString(), "physical": plan.executedPlan().toString()}
        return parts if format == "dict" else " | ".join(f"{k}: {v if isinstance(v, str) else ' > '.join(v)}" for k, v in parts.items())


class OuterField(Expr):
    """A field of the outer row in a correlated query."""

    def __init__(self, name: str):
        self.name = name

    def column(self, df: DataFrame) -> Column:
        return S.col(f"__l.`{self.name}`").outer()


class _Outer:
    """Stands for the outer row while a selector builds a correlated query."""

    def __getattr__(self, name: str) -> OuterField:
        if name.startswith("__"):
            raise AttributeError(name)
        return OuterField(name)

    def __getitem__(self, name: str) -> OuterField:
        return OuterField(name)


def correlated(p: Any) -> tuple[list[tuple[Expr, str]], Any]:
    """(expressions that equal a field of the outer row, with its name; the conjunction of all else, or None)."""
    same, rest = [], []
    for x in p.parts if isinstance(p, And) else [p]:
        sides = [x.left, x.right] if isinstance(x, Compare) and x.op == "==" else []
        outer = [s for s in sides if isinstance(s, OuterField)]
        inner = [s for s in sides if isinstance(s, Expr) and not isinstance(s, OuterField)]
        if len(outer) == len(inner) == 1:
            same.append((inner[0], outer[0].name))
        else:
            rest.append(x)
    return same, And(*rest) if rest and same else None


def _python(fn: Callable, names: Sequence[str], kind: str) -> Column:
    """A callable of a row as a UDF of some of its columns, in Arrow batches."""
    row = Row(*names)

    def run(*values: Any) -> Any:
        return _safe(fn, row(*values)) if kind == "boolean" else fn(row(*values))

    return S.udf(run, kind, useArrow=True)(*(f"`{c}`" for c in names))


def _safe(fn: Callable, row: Any) -> bool:
    """A predicate that fails on a row doesn't hold for it."""
    try:
        return bool(fn(row))
    except Exception:
        return False


@dataclass(frozen=True)
class Grouped:
    """A grouping that waits for select() to say what it computes."""

    query: Query
    key: Any
    element: Any = None

    def _keys(self) -> dict[str, Column]:
        key = self.key if isinstance(self.key, dict) else {"key": self.key}
        return {k: self.query._column(v) for k, v in key.items()}

    def select(self, outputs: dict[str, Any]) -> Query:
        q, keys = self.query, self._keys()
        aggs, names = [], []
        for out, v in outputs.items():
            v = v if isinstance(v, (Expr, Column)) else trace(v)
            if isinstance(v, GroupFunction) and v.kind == "key":
                names.append((out, S.col("key") if "key" in keys else S.struct(*keys)))
            elif isinstance(v, GroupFunction):
                aggs.append(v.aggregate(q.df, self.element if self.element is not None else S.col("value") if q.scalar else None).alias(f"__{out}"))
                names.append((out, S.col(f"__{out}")))
            elif isinstance(v, Column):
                aggs.append(v.alias(f"__{out}"))
                names.append((out, S.col(f"__{out}")))
            else:
                names.append((out, as_column(v, q.df)))
        grouped = q.df.groupBy(*(c.alias(k) for k, c in keys.items()))
        df = grouped.agg(*aggs) if aggs else q.df.select(*(c.alias(k) for k, c in keys.items())).distinct()
        return q._next(df.select(*(c.alias(n) for n, c in names)), "group_by", scalar=False)

    def elements(self) -> Query:
        """Each key with all its elements; meant for small groups, as an array holds them."""
        q = self.query
        e = S.struct("*") if self.element is None else q._column(self.element)
        return q._next(q.df.groupBy(*(c.alias(k) for k, c in self._keys().items())).agg(S.collect_list(e).alias("elements")), "group_by", scalar=False)


__all__ = ["F", "Grouped", "Query", "from_collection", "Iterable", "T", "field"]
