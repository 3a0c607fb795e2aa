"""Sets of hashes as bitmaps of fixed size: built by aggregation, small enough to broadcast, never wrong by omission."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26  # 8 MB, a power of two
BUCKET = 32768  # bits of one of Spark's bitmaps
SHIFTS = (0, 19, 38)  # each hash sets the bits that these shifts of it name


def collect_bits(df: DataFrame, hash_column: str, bits: int = BITS) -> np.ndarray:
    """The bitmap of the hashes, as bytes; at most bits / 32768 rows of 4 KB reach the driver."""
    each = F.explode(F.array(*[F.pmod(F.shiftrightunsigned(hash_column, k), F.lit(bits)) for k in SHIFTS]))
    rows = df.select(each.alias("n")).select(F.floor(F.col("n") / BUCKET).cast("int").alias("b"), (F.col("n") % BUCKET).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m"))
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.collect():
        out[r.b * (BUCKET // 8) : (r.b + 1) * (BUCKET // 8)] = np.frombuffer(bytes(r.m), np.uint8)
    return out


def has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """True for every hash that is in the set, and for a few others."""
    out = np.ones(len(hashes), bool)
    for k in SHIFTS:
        n = ((hashes.astype(np.int64).view(np.uint64) >> np.uint64(k)) & np.uint64(len(bitmap) * 8 - 1)).astype(np.int64)
        out &= (bitmap[n >> 3] >> (n & 7).astype(np.uint8)) & 1 == 1
    return out
