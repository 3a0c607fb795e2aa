"""Symbolic expressions that become native Columns once a DataFrame's schema is known.

Comparisons are two-valued: a null operand never satisfies an ordering, `==` and `!=` are null-safe, and a negation
is computed from the two-valued form. Positive leaves stay bare, so that Parquet can push them down.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import ValidationError
from tessera.functions import vectors as V


def type_of(df: DataFrame, c: Column) -> T.DataType:
    return df.select(c).schema[0].dataType


class Expr:
    """A value computed from a row."""

    def column(self, df: DataFrame) -> Column:
        raise NotImplementedError

    def __eq__(self, other):  # type: ignore[override]
        return Compare("==", self, other)

    def __ne__(self, other):  # type: ignore[override]
        return Compare("!=", self, other)

    __hash__ = object.__hash__

    def __gt__(self, other):
        return Compare(">", self, other)

    def __ge__(self, other):
        return Compare(">=", self, other)

    def __lt__(self, other):
        return Compare("<", self, other)

    def __le__(self, other):
        return Compare("<=", self, other)

    def __add__(self, other):
        return Arith("+", self, other)

    def __radd__(self, other):
        return Arith("+", other, self)

    def __sub__(self, other):
        return Arith("-", self, other)

    def __rsub__(self, other):
        return Arith("-", other, self)

    def __mul__(self, other):
        return Arith("*", self, other)

    def __rmul__(self, other):
        return Arith("*", other, self)

    def __truediv__(self, other):
        return Arith("/", self, other)

    def __bool__(self):
        raise TypeError("an expression has no truth value; combine with & | ~")

    def _no_value(self, *_):
        raise TypeError("an expression has no value before it runs")

    # a callable that asks for these can't be traced
    __str__ = __iter__ = __format__ = __len__ = _no_value

    def divide_or_one(self, other):
        """Division in which a null or zero on either side gives 1."""
        return Arith("/1", self, other)

    def in_(self, values):
        return In(self, values)

    def contains(self, value):
        return Contains(self, value)

    def startswith(self, prefix):
        return Mapped(self, lambda c, t: F.coalesce(c, F.lit("")).startswith(prefix), predicate=True)

    def endswith(self, suffix):
        return Mapped(self, lambda c, t: F.coalesce(c, F.lit("")).endswith(suffix), predicate=True)

    def between(self, lo, hi, inclusive: bool | tuple[bool, bool] = True):
        left, right = inclusive if isinstance(inclusive, tuple) else (inclusive, inclusive)
        return Between(self, lo, hi, left, right)

    def between_closed(self, lo, hi):
        return Between(self, lo, hi, True, True)

    def between_open(self, lo, hi):
        return Between(self, lo, hi, False, False)

    def between_left_open(self, lo, hi):
        return Between(self, lo, hi, False, True)

    def between_right_open(self, lo, hi):
        return Between(self, lo, hi, True, False)

    def range(self, lo, hi, bounds: str = "[]"):
        if bounds not in BOUNDS:
            raise ValidationError(f"bounds must be one of {sorted(BOUNDS)}")
        return Between(self, lo, hi, *BOUNDS[bounds])

    def is_true(self):
        return Truthy(self)

    def is_none(self):
        return Mapped(self, lambda c, t: c.isNull(), predicate=True)

    def not_none(self):
        return Mapped(self, lambda c, t: c.isNotNull(), predicate=True)

    def near(self, query: Sequence[float], threshold: float, metric: str = "cosine"):
        return Near(self, query, threshold, metric)

    def lower(self):
        return Mapped(self, lambda c, t: F.lower(F.coalesce(c, F.lit(""))))

    def upper(self):
        return Mapped(self, lambda c, t: F.upper(F.coalesce(c, F.lit(""))))

    def length(self):
        return Mapped(self, lambda c, t: F.coalesce(F.size(c) if isinstance(t, (T.ArrayType, T.MapType)) else F.length(c), F.lit(0)))

    def abs(self):
        return Mapped(self, lambda c, t: F.abs(F.coalesce(c, F.lit(0).cast(t))))

    def apply(self, fn: Callable[[Column], Column]):
        """Any native function of one Column."""
        return Mapped(self, lambda c, t: fn(c))


BOUNDS = {"[]": (True, True), "()": (False, False), "(]": (False, True), "[)": (True, False)}


def as_column(value: Any, df: DataFrame) -> Column:
    if isinstance(value, Expr):
        return value.column(df)
    return value if isinstance(value, Column) else F.lit(value)


class Field(Expr):
    """A column by name; attributes and items go into nested fields."""

    def __init__(self, path: str):
        self._path = path

    def __getattr__(self, name: str) -> Field:
        if name.startswith("__"):
            raise AttributeError(name)
        return Field(f"{self._path}.{name}")

    def __getitem__(self, name: str) -> Field:
        return Field(f"{self._path}.{name}")

    def column(self, df: DataFrame) -> Column:
        return F.col(".".join(f"`{p.strip('`')}`" for p in self._path.split(".")))


class Arith(Expr):
    """Null-tolerant arithmetic: a null number counts as 0 and a null string as empty; division by zero gives null."""

    def __init__(self, op: str, left: Any, right: Any):
        self.op, self.left, self.right = op, left, right

    def column(self, df: DataFrame) -> Column:
        a, b = as_column(self.left, df), as_column(self.right, df)
        if self.op == "+" and any(isinstance(type_of(df, x), T.StringType) for x in (a, b)):
            return F.concat(*(F.coalesce(x.cast("string"), F.lit("")) for x in (a, b)))
        if self.op == "/1":
            bad = a.isNull() | b.isNull() | (a == 0) | (b == 0)
            return F.when(bad, F.lit(1.0)).otherwise(F.try_divide(a, b))
        if self.op == "/":
            return F.try_divide(a, b)
        a, b = F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0))
        return {"+": a + b, "-": a - b, "*": a * b}[self.op]


class Predicate(Expr):
    """column() may be null where the predicate fails; strict() never is."""

    def strict(self, df: DataFrame) -> Column:
        return F.coalesce(self.column(df), F.lit(False))

    def __and__(self, other):
        return And(self, other)

    def __or__(self, other):
        return Or(self, other)

    def __invert__(self):
        return Not(self)


class Compare(Predicate):
    def __init__(self, op: str, left: Any, right: Any):
        self.op, self.left, self.right = op, left, right

    def column(self, df: DataFrame) -> Column:
        a, b = as_column(self.left, df), as_column(self.right, df)
        if self.op == "==":
            return a.eqNullSafe(b)
        if self.op == "!=":
            return ~a.eqNullSafe(b)
        return {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[self.op]


class Between(Predicate):
    def __init__(self, source: Any, lo: Any, hi: Any, left: bool, right: bool):
        self.source, self.lo, self.hi, self.left, self.right = source, lo, hi, left, right

    def column(self, df: DataFrame) -> Column:
        if self.lo is None or self.hi is None:
            return F.lit(False)
        if not isinstance(self.lo, (Expr, Column)) and not isinstance(self.hi, (Expr, Column)):
            try:
                if self.lo > self.hi:
                    return F.lit(False)
            except TypeError:
                return F.lit(False)
        c, lo, hi = (as_column(x, df) for x in (self.source, self.lo, self.hi))
        return (c >= lo if self.left else c > lo) & (c <= hi if self.right else c < hi)


class In(Predicate):
    def __init__(self, source: Any, values: Any):
        self.source, self.values = source, values

    def column(self, df: DataFrame) -> Column:
        c = as_column(self.source, df)
        if isinstance(self.values, str):
            return F.contains(F.lit(self.values), c)
        if isinstance(self.values, (Expr, Column)):
            return F.array_contains(as_column(self.values, df), c)
        known = [v for v in self.values if v is not None]
        found = c.isin(known) if known else F.lit(False)
        return found | c.isNull() if len(known) < len(list(self.values)) else found


class Contains(Predicate):
    def __init__(self, source: Any, value: Any):
        self.source, self.value = source, value

    def column(self, df: DataFrame) -> Column:
        c, v = as_column(self.source, df), as_column(self.value, df)
        kind = type_of(df, c)
        if isinstance(kind, T.ArrayType):
            return F.array_contains(c, v) if self.value is not None else F.exists(c, lambda x: x.isNull())
        if isinstance(kind, T.MapType):
            return F.map_contains_key(c, v)
        return F.contains(c.cast("string"), v.cast("string"))


class Truthy(Predicate):
    def __init__(self, source: Any):
        self.source = source

    def column(self, df: DataFrame) -> Column:
        c = as_column(self.source, df)
        kind = type_of(df, c)
        if isinstance(kind, T.BooleanType):
            return F.coalesce(c, F.lit(False))
        if isinstance(kind, T.NumericType):
            return F.coalesce(c != 0, F.lit(False))
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.length(c) > 0, F.lit(False))
        if isinstance(kind, (T.ArrayType, T.MapType)):
            return F.coalesce(F.size(c) > 0, F.lit(False))
        return c.isNotNull()


class Near(Predicate):
    def __init__(self, source: Any, query: Sequence[float], threshold: float, metric: str = "cosine"):
        if metric not in ("cosine", "l2"):
            raise ValidationError(f"unknown metric {metric!r}")
        self.source, self.query, self.threshold, self.metric = source, V.check_vector(query), threshold, metric

    def column(self, df: DataFrame) -> Column:
        c = as_column(self.source, df)
        hit = V.cosine(c, self.query) >= self.threshold if self.metric == "cosine" else V.l2(c, self.query) <= self.threshold
        return F.when(V.usable(c, len(self.query)), hit).otherwise(F.lit(False))


class Mapped(Predicate):
    """A native function of one expression; also usable as a predicate where it yields a boolean."""

    def __init__(self, source: Any, fn: Callable[[Column, T.DataType], Column], predicate: bool = False):
        self.source, self.fn, self.predicate = source, fn, predicate

    def column(self, df: DataFrame) -> Column:
        c = as_column(self.source, df)
        return self.fn(c, type_of(df, c))


class Native(Predicate):
    """A Column given as it is, or a constant."""

    def __init__(self, c: Column | bool):
        self.c = c

    def column(self, df: DataFrame) -> Column:
        return self.c if isinstance(self.c, Column) else F.lit(bool(self.c))


def _flat(kind: type, parts: Sequence[Any]) -> list[Predicate]:
    out: list[Predicate] = []
    for p in parts:
        p = p if isinstance(p, Expr) else Native(p)
        out.extend(p.parts if type(p) is kind else [p])
    return out


class And(Predicate):
    def __init__(self, *parts: Any):
        self.parts = _flat(And, parts)

    def column(self, df: DataFrame) -> Column:
        return reduce(lambda a, b: a & b, (p.column(df) for p in self.parts)) if self.parts else F.lit(True)

    def strict(self, df: DataFrame) -> Column:
        return reduce(lambda a, b: a & b, (strict(p, df) for p in self.parts)) if self.parts else F.lit(True)


class Or(Predicate):
    def __init__(self, *parts: Any):
        self.parts = _flat(Or, parts)

    def column(self, df: DataFrame) -> Column:
        return reduce(lambda a, b: a | b, (p.column(df) for p in self.parts)) if self.parts else F.lit(False)

    def strict(self, df: DataFrame) -> Column:
        return reduce(lambda a, b: a | b, (strict(p, df) for p in self.parts)) if self.parts else F.lit(False)


class Not(Predicate):
    def __init__(self, part: Any):
        self.part = part if isinstance(part, Expr) else Native(part)

    def column(self, df: DataFrame) -> Column:
        return ~strict(self.part, df)

    strict = column


def strict(p: Expr, df: DataFrame) -> Column:
    return p.strict(df) if isinstance(p, Predicate) else F.coalesce(p.column(df), F.lit(False))


TrueTerm, FalseTerm = Native(True), Native(False)
