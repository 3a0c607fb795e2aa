"""Vector arithmetic as native Columns (no Python on executors) and a few driver-side helpers."""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import ValidationError


def _doubles(v: Column | Sequence[float]) -> Column:
    if isinstance(v, Column):
        return v.cast("array<double>")
    return F.lit([float(x) for x in check_vector(v)]).cast("array<double>")


def check_vector(v: Sequence[float]) -> list[float]:
    """The vector as floats; null, NaN and infinite components are refused."""
    out = []
    for x in v:
        if x is None or not math.isfinite(float(x)):
            raise ValidationError("vector components must be finite numbers")
        out.append(float(x))
    return out


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def usable(a: Column, dim: int | None = None) -> Column:
    """True where the vector is not null, has only finite components and the wanted dimension."""
    ok = a.isNotNull() & F.forall(_doubles(a), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    if dim is not None:
        ok = ok & (F.size(a) == dim)
    return F.coalesce(ok, F.lit(False))


def cosine(a, b) -> Column:
    """Cosine similarity in double precision; zero vectors score 0, unusable ones null."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(n, F.lit(0.0)))


def l2(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def normalized(a) -> Column:
    n = norm(a)
    return F.when(n == 0, _doubles(a)).otherwise(F.transform(_doubles(a), lambda x: x / F.nullif(n, F.lit(0.0))))


def vector_to_bytes(v: Sequence[float]) -> bytes:
    """Little-endian float64 components."""
    v = check_vector(v)
    return struct.pack(f"<{len(v)}d", *v)


def vector_from_bytes(data: bytes) -> list[float]:
    if len(data) % 8:
        raise ValidationError("length is not a multiple of 8")
    return list(struct.unpack(f"<{len(data) // 8}d", data))


def require_dim(a: Column, dim: int) -> Column:
    """The vector as array<float>; a row of another dimension fails the job."""
    return F.when(F.size(a) == dim, a.cast("array<float>")).otherwise(F.raise_error(F.lit(f"vector dimension is not {dim}")).cast("array<float>"))
