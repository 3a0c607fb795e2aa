"""`F`: fields and group functions for the fluent API, and the tracing of lambdas into native expressions."""

from __future__ import annotations

import ast
import inspect
import textwrap
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as S

from tessera.plans.expr import And, Between, Compare, Expr, Field, In, Not, Or, as_column


class GroupFunction(Expr):
    """A function of a group; it has meaning only in the select() that follows group_by()."""

    def __init__(self, kind: str, selector: Any = None):
        self.kind, self.selector = kind, selector

    def aggregate(self, df: DataFrame, element: Any) -> Column:
        if self.kind == "count":
            return S.count(S.lit(1))
        value = self.selector if self.selector is not None else element
        c = as_column(trace(value), df)
        if self.kind == "sum":
            return S.coalesce(S.sum(S.coalesce(c, S.lit(0))), S.lit(0))
        if self.kind == "average":
            return S.coalesce(S.avg(S.coalesce(c, S.lit(0)).cast("double")), S.lit(0.0))
        return {"min": S.min, "max": S.max, "list": S.collect_list}[self.kind](c)


class _F:
    """F.name is a field; F['name'] reaches names that are functions here."""

    def __getitem__(self, name: str) -> Field:
        return Field(name)

    def __getattr__(self, name: str) -> Field:
        if name.startswith("__"):
            raise AttributeError(name)
        return Field(name)

    def key(self) -> GroupFunction:
        return GroupFunction("key")

    def count(self) -> GroupFunction:
        return GroupFunction("count")

    def sum(self, selector: Any = None) -> GroupFunction:
        return GroupFunction("sum", selector)

    def average(self, selector: Any = None) -> GroupFunction:
        return GroupFunction("average", selector)

    def min(self, selector: Any = None) -> GroupFunction:
        return GroupFunction("min", selector)

    def max(self, selector: Any = None) -> GroupFunction:
        return GroupFunction("max", selector)


F = _F()


@dataclass(frozen=True)
class Typed:
    """A callable over a row with the Spark type of what it returns."""

    fn: Callable
    returns: str

    def __call__(self, *args: Any) -> Any:
        return self.fn(*args)


def typed(fn: Callable, returns: str) -> Typed:
    return Typed(fn, returns)


# The Spark types of Python's annotations.
TYPES = {int: "long", float: "double", str: "string", bool: "boolean", bytes: "binary", list[int]: "array<long>", list[float]: "array<double>", list[str]: "array<string>"}


def returns_of(fn: Callable) -> str | None:
    """The Spark type that a callable says it returns, or None."""
    if isinstance(fn, Typed):
        return fn.returns
    try:
        said = inspect.get_annotations(fn, eval_str=True).get("return")
    except (TypeError, NameError):
        return None
    return said if isinstance(said, str) else TYPES.get(said)


def touched(fn: Callable) -> list[str] | None:
    """The fields of the row that a callable of one argument reads, or None where its source doesn't show them all."""
    fn = fn.fn if isinstance(fn, Typed) else fn
    try:
        tree = ast.parse(textwrap.dedent(inspect.getsource(fn)).strip().lstrip("."))
    except (OSError, TypeError, SyntaxError, IndentationError):
        return None
    found = [n for n in ast.walk(tree) if isinstance(n, (ast.Lambda, ast.FunctionDef))]
    if len(found) != 1 or len(found[0].args.args) != 1:
        return None
    arg, names = found[0].args.args[0].arg, []
    uses = sum(isinstance(n, ast.Name) and n.id == arg for n in ast.walk(found[0]))
    called = {id(n.func) for n in ast.walk(found[0]) if isinstance(n, ast.Call)}  # methods of the row
    for n in ast.walk(found[0]):
        if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id == arg and id(n) not in called:
            names.append(n.attr)
        elif isinstance(n, ast.Subscript) and isinstance(n.value, ast.Name) and n.value.id == arg and isinstance(n.slice, ast.Constant) and isinstance(n.slice.value, str):
            names.append(n.slice.value)
    return list(dict.fromkeys(names)) if names and len(names) == uses else None


class Untraceable(Exception):
    """The callable can't be turned into native expressions."""


class _Row:
    """Stands for the row while a callable is traced."""

    def _no_value(self, *_):
        raise TypeError("a row has no values before the query runs")

    __str__ = __iter__ = __format__ = __len__ = _no_value

    def __getattr__(self, name: str) -> Field:
        if name.startswith("__"):
            raise AttributeError(name)
        return Field(name)

    def __getitem__(self, name: str) -> Field:
        return Field(name)


def trace(value: Any) -> Any:
    """Fields, columns and constants as they are; callables as the expression that they compute, or Untraceable."""
    if isinstance(value, str) or not callable(value) or isinstance(value, (Expr, Column)):
        return value
    if isinstance(value, Typed):
        raise Untraceable("its type is given")
    if (found := _from_source(value)) is not None:
        return found
    try:
        out = value(_Row())
    except Exception as e:
        raise Untraceable(str(e)) from e
    if isinstance(out, (Expr, Column)) or out is None or isinstance(out, (int, float, str, bool)):
        return out
    if isinstance(out, dict):
        return {k: trace(v) for k, v in out.items()}
    raise Untraceable(f"it returned {type(out).__name__}")


def _from_source(fn: Callable) -> Expr | None:
    """Chained comparisons, and/or/not and `in` can't be overloaded; they are read from the lambda's source."""
    try:
        tree = ast.parse(textwrap.dedent(inspect.getsource(fn)).strip().lstrip("."))
    except (OSError, TypeError, SyntaxError, IndentationError):
        return None
    lambdas = [n for n in ast.walk(tree) if isinstance(n, ast.Lambda)]
    if len(lambdas) != 1 or len(lambdas[0].args.args) != 1:
        return None
    body, arg = lambdas[0].body, lambdas[0].args.args[0].arg
    if not any(isinstance(n, (ast.BoolOp, ast.Not)) or isinstance(n, ast.Compare) and (len(n.ops) > 1 or isinstance(n.ops[0], (ast.In, ast.NotIn))) for n in ast.walk(body)):
        return None
    scope = dict(fn.__globals__) | inspect.getclosurevars(fn).nonlocals
    try:
        return _node(body, arg, scope)
    except Untraceable:
        return None


COMPARE = {ast.Eq: "==", ast.NotEq: "!=", ast.Gt: ">", ast.GtE: ">=", ast.Lt: "<", ast.LtE: "<="}


def _node(n: ast.AST, arg: str, scope: dict) -> Any:
    if isinstance(n, ast.BoolOp):
        return (And if isinstance(n.op, ast.And) else Or)(*(_node(v, arg, scope) for v in n.values))
    if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.Not):
        return Not(_node(n.operand, arg, scope))
    if isinstance(n, ast.Compare):
        sides = [_node(v, arg, scope) for v in (n.left, *n.comparators)]
        kinds = [type(o) for o in n.ops]
        if kinds[0] in (ast.In, ast.NotIn) and len(kinds) == 1:
            found = In(sides[0], sides[1])
            return found if kinds[0] is ast.In else Not(found)
        if len(kinds) == 2 and set(kinds) <= {ast.Lt, ast.LtE} and isinstance(sides[1], Expr) and not isinstance(sides[0], Expr) and not isinstance(sides[2], Expr):
            return Between(sides[1], sides[0], sides[2], kinds[0] is ast.LtE, kinds[1] is ast.LtE)
        if not set(kinds) <= set(COMPARE):
            raise Untraceable("comparison")
        parts = [Compare(COMPARE[k], a, b) for k, a, b in zip(kinds, sides, sides[1:])]
        return parts[0] if len(parts) == 1 else And(*parts)
    try:
        return eval(compile(ast.Expression(n), "<lambda>", "eval"), scope, {arg: _Row()})  # the caller's own lambda body, on a symbolic row
    except Exception as e:
        raise Untraceable(str(e)) from e
