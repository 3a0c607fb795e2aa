"""Joins with keys inferred from the schema, explicit conditions, and the side-listing join kinds."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as S

from tessera.errors import ValidationError

# The join kinds.
KINDS = ("inner", "left", "right", "full", "semi", "anti", "external", "external_left", "external_right", "outer")
SPARK = {"semi": "left_semi", "anti": "left_anti", "full": "full_outer"}


def key_of(left: DataFrame, right: DataFrame, left_alias: str, right_alias: str) -> tuple[str, str]:
    """The implicit key: left.{right_alias}_id = right.id, or else left.id = right.{left_alias}_id."""
    if f"{right_alias}_id" in left.columns and "id" in right.columns:
        return f"{right_alias}_id", "id"
    if "id" in left.columns and f"{left_alias}_id" in right.columns:
        return "id", f"{left_alias}_id"
    raise ValidationError(f"no key joins {left_alias} and {right_alias}: give on=")


def join(left: DataFrame, right: DataFrame, how: str = "inner", on: Any = None, left_alias: str = "left", right_alias: str = "right", null_safe: bool | None = None) -> DataFrame:
    """Rows with each side as a struct under its alias. Null keys match each other where null_safe says so: by default for
    the implicit key only, as with on= all rows without a key would meet in one task and multiply.

    on: a name, a list of names or of (left, right) pairs, or a Column over {alias}.{name}. `external` gives the cross
    product and each side's rows alone (so it is for small tables), `outer` each side's rows alone without pairs.
    """
    if how not in KINDS:
        raise ValidationError(f"unknown join kind {how!r}")
    a, b = (df.select(S.struct("*").alias(n)) for df, n in ((left, left_alias), (right, right_alias)))
    if how.startswith("external") or how == "outer":
        parts = [] if how == "outer" else [a.crossJoin(b)]
        parts += [a] * (how in ("external", "external_left", "outer")) + [b] * (how in ("external", "external_right", "outer"))
        return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    if isinstance(on, Column):
        condition = on
    else:
        pairs = [key_of(left, right, left_alias, right_alias)] if on is None else [(p, p) if isinstance(p, str) else p for p in ([on] if isinstance(on, str) else on)]
        equal = Column.eqNullSafe if (on is None if null_safe is None else null_safe) else Column.__eq__
        condition = reduce(lambda x, y: x & y, (equal(S.col(f"{left_alias}.{x}"), S.col(f"{right_alias}.{y}")) for x, y in pairs))
    return a.join(b, condition, SPARK.get(how, how))
