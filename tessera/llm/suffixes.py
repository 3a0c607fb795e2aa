"""Removal of repeated strings with sorted suffixes: every byte that a `LENGTH`-byte string covers which also starts
anywhere else is removed (bucket-pointer refinement).

Windows of LENGTH bytes are dealt by their minimizer, the smallest hash of a short q-gram in them: equal windows have
the same one at the same offset, so they meet in one bucket. Consecutive windows with one minimizer travel as one
stretch. Stretches are counted by content first (partial aggregation; copies collapse there): a stretch that occurs
twice is repeated as a whole, and one whose minimizer occurs in no other stretch is not repeated at all. Only the rest
needs comparing: their bytes are dealt by minimizer, and their suffixes are sorted by bucket-pointer refinement (see
`refine`): the initial buckets are 8-byte q-grams, a bucket is refined by sorting on the bucket identifiers of later
offsets, and updates are reused at once by the buckets refined next. Minimizers with more than `HOT` different stretches (near copies in huge groups) are not
gathered: their windows are dealt and counted one by one.

Null and empty texts have no bytes; texts shorter than LENGTH keep all. Copies of a text lose all their bytes where they
are long enough, the first one too; so do rows given twice. Inside, a row goes by a hash of doc_id and text, which is never
null: null and repeated doc_ids may be any rows', and rows that share it have one text and lose the same bytes. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.arrow import flat, small, texts
from tessera.llm.words import BYTE, mix
from tessera.sources.stage import staged

U = np.uint64
LENGTH = 200
Q = 32
HOT = 4000
BATCH = 1 << 20
PIECE = 1 << 16  # suffixes that are refined at a time
STRETCH = "mini long, a long, b long, row long, n_bytes int, at int, n int"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def minimizers(data: np.ndarray, length: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the minimizer of each window of one text: the smallest q-gram hash, the leftmost of equals."""
    h = BYTE[data]
    span, k = 1, 0x9E3779B97F4A7C15
    while span < q:
        step = min(span, q - span)
        h = h[: len(h) - step] * U(k | 1) + h[step:]
        span, k = span + step, (k * 0xD1342543DE82EF95 + 1) & (2**64 - 1)
    h = mix(h)
    w = length - q + 1
    out_h, out_p = [], []
    piece = 1 << 19
    for a in range(0, len(h) - w + 1, piece):
        b = min(a + piece, len(h) - w + 1)
        part = h[a : b + w - 1]
        m = part & U(0xFFFFFFFFFFF00000) | np.arange(len(part), dtype=U)
        n = 1
        while 2 * n <= w:
            m = np.minimum(m[: len(m) - n], m[n:])
            n *= 2
        if n < w:
            m = np.minimum(m[: len(m) - (w - n)], m[w - n :])
        p = (m & U(0xFFFFF)).astype(np.int64)
        out_h.append(part[p])
        out_p.append(p + a)
    return np.concatenate(out_h), np.concatenate(out_p)


def stretches(data: np.ndarray, length: int, q: int) -> Iterator[tuple[int, int, int]]:
    """(minimizer hash, first window, number of windows) of one text."""
    h, p = minimizers(data, length, q)
    first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    n = np.diff(np.append(first, len(p)))
    return zip(h[first].view(np.int64).tolist(), first.tolist(), n.tolist())


def scan(docs: DataFrame, length: int, q: int) -> DataFrame:
    """Every stretch of every (row, text) with a 128-bit hash of its content and of where its minimizer lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blake = hashlib.blake2b
        for batch in small(batches):
            data, offsets = flat(batch.column(1))
            ids = batch.column(0).to_pylist()
            cols: list[list] = [[] for _ in range(6)]
            for d, doc in enumerate(ids):
                lo, hi = offsets[d], offsets[d + 1]
                if hi - lo < length:
                    continue
                raw = data[lo:hi].tobytes()
                for m, at, n in stretches(data[lo:hi], length, q):
                    cols[0].append(m)
                    cols[1].append(blake(raw[at : at + n + length - 1], digest_size=16).digest())
                    cols[2].append(doc)
                    cols[3].append(hi - lo)
                    cols[4].append(at)
                    cols[5].append(n)
                if len(cols[0]) > 50_000:
                    yield _batch(cols)
                    cols = [[] for _ in range(6)]
            if cols[0]:
                yield _batch(cols)

    def _batch(c):
        k = np.frombuffer(b"".join(c[1]), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.int32()), pa.array(c[5], pa.int32())], names=["mini", "a", "b", "row", "n_bytes", "at", "n"])

    return docs.mapInArrow(run, STRETCH)


def refine(text: np.ndarray, valid: np.ndarray, length: int) -> np.ndarray:
    """For each start in `valid` (ascending) whether its `length` bytes also start at another one; text is padded.

    Bucket-pointer refinement. Buckets are ranges of the suffix array, a bucket's identifier is where it begins, and each
    knows how many bytes its suffixes share: 8 at first. A bucket of shared depth d is refined by sorting its suffixes on
    the identifiers of the suffixes d bytes later; those that meet in one bucket there share its depth too. Identifiers and
    depths are updated in place, so the buckets refined next, in the same pass, sort on what has just been refined. Buckets
    of one suffix, or of depth `length`, are done.
    """
    n = len(text)
    key = np.zeros(n, U)
    for j in range(8):
        key[: n - j] |= text[j:].astype(U) << U(8 * (7 - j))
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    sizes = np.diff(np.append(starts, n))
    # identifiers count from 1; 0 stands for the zeros without end behind the text
    bucket, depth = np.zeros(n + length, np.int64), np.zeros(n + 1, np.int64)
    bucket[order] = np.repeat(starts + 1, sizes)
    depth[starts + 1], depth[0] = 8, length
    while True:
        open_ = (sizes > 1) & (depth[starts + 1] < length)
        starts, sizes = starts[open_], sizes[open_]
        if not len(starts):
            break
        ends, found, a = np.cumsum(sizes), [], 0
        while a < len(starts):
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PIECE, "right")))
            found.append(_refined(order, bucket, depth, starts[a:z], sizes[a:z]))
            a = z
        starts, sizes = (np.concatenate(x) for x in zip(*found))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    own = np.argsort(rank[valid])
    x, y = valid[own[:-1]], valid[own[1:]]
    # neighbours of one bucket share all bytes; others may yet, as buckets can be split at a greater depth
    equal = bucket[x] == bucket[y]
    near = ~equal
    if length >= 8:
        near &= (key[x] == key[y]) & (key[x + length - 8] == key[y + length - 8])
    near = np.flatnonzero(near)
    windows = np.lib.stride_tricks.sliding_window_view(text, length)
    for a in range(0, len(near), 20_000):
        k = near[a : a + 20_000]
        equal[k] = (windows[x[k]] == windows[y[k]]).all(1)
    out = np.zeros(len(valid), bool)
    out[own[:-1]] |= equal
    out[own[1:]] |= equal
    return out


def _refined(order: np.ndarray, bucket: np.ndarray, depth: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The beginnings and sizes of what some buckets are refined to; the three arrays are updated in place."""
    which = np.repeat(np.arange(len(starts)), sizes)
    at = np.arange(len(which)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    shared = depth[starts + 1][which]
    later = bucket[order[at] + shared]
    by = np.argsort(which * np.int64(len(depth)) + later, kind="stable")
    order[at], later = order[at][by], later[by]
    first = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (later[1:] != later[:-1])]))
    n = np.diff(np.append(first, len(at)))
    bucket[order[at]] = np.repeat(at[first] + 1, n)
    depth[at[first] + 1] = shared[first] + depth[later[first]]
    return at[first], n


def compare(rows: list[tuple[bytes, int]], length: int) -> list[list[int]]:
    """For stretches given as (bytes, number of windows): the windows of each that occur more than once among them, as
    runs [first, end, ...]."""
    gap = np.cumsum([0] + [len(r[0]) + 8 for r in rows])
    text = np.zeros(int(gap[-1]) + 8, np.uint8)
    for (raw, _), g in zip(rows, gap):
        text[g : g + len(raw)] = np.frombuffer(raw, np.uint8)
    starts = np.concatenate([g + np.arange(n) for (_, n), g in zip(rows, gap)])
    again = refine(text, starts, length)
    bounds = np.cumsum([0] + [n for _, n in rows])
    out = []
    for a, b in zip(bounds, bounds[1:]):
        f = np.concatenate([[0], again[a:b].view(np.int8), [0]])
        out.append(np.flatnonzero(np.diff(f)).tolist())
    return out


def repeated_runs(docs: DataFrame, length: int, q: int, hot: int) -> DataFrame:
    """(row, n_bytes, runs array<int>) of window runs [first, end, ...] that are repeated, for docs (row, text); several rows a
    document."""
    found = staged(scan(docs, length, q).groupBy("a", "b").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("row", "n_bytes", "at", "n", "mini")).alias("one")), "stretches")
    found = found.select("a", "b", "times", "one.*")
    minis = found.groupBy("mini").agg(F.count(F.lit(1)).alias("kinds"))
    alone = found.join(minis.where("kinds > 1"), "mini")
    shared = staged(alone.where("times = 1 or kinds > 1").select("mini", "kinds", "a", "b", "times", "row", "n_bytes", "at", "n"), "shared")
    todo = shared.groupBy("row", "n_bytes").agg(F.collect_list(F.struct("mini", "kinds", "a", "b", "at", "n", "times")).alias("cuts"))
    keyed = docs.withColumn("n_bytes", F.octet_length("text")).join(todo, ["row", "n_bytes"])

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            out = []
            for raw, cuts in zip(b.column(0), b.column(1).to_pylist()):
                raw = raw.as_py().encode()
                for c in cuts:
                    piece = raw[c["at"] : c["at"] + c["n"] + length - 1]
                    k = np.frombuffer(hashlib.blake2b(piece, digest_size=16).digest(), np.int64)
                    if (k[0], k[1]) == (c["a"], c["b"]):
                        out.append((c["mini"], c["kinds"], c["a"], c["b"], c["n"], c["times"], piece))
            out = out or [()] * 0
            cols = list(zip(*out)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["mini", "kinds", "a", "b", "n", "times", "raw"])

    cut = keyed.select("text", "cuts").mapInArrow(slices, "mini long, kinds long, a long, b long, n int, times long, raw binary")
    if shared.where(F.col("kinds") > hot).isEmpty():
        warm, many = cut, None
    else:
        cut = staged(cut, "cut")
        warm, many = cut.where(F.col("kinds") <= hot), cut.where(F.col("kinds") > hot)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mini, keys, rows, size = [], [], [], 0

        def flush():
            runs = compare(rows, length)
            a, b = zip(*keys)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(runs, pa.list_(pa.int32()))], names=["a", "b", "runs"])

        for batch in batches:
            for m, a, b, n, raw in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if size > BATCH and mini[-1] != m:
                    yield flush()
                    mini, keys, rows, size = [], [], [], 0
                mini.append(m)
                keys.append((a, b))
                rows.append((raw, n))
                size += len(raw)
        if rows:
            yield flush()

    dealt = warm.select("mini", "a", "b", "n", "raw").repartition("mini").sortWithinPartitions("mini")
    runs = dealt.mapInArrow(sort, "a long, b long, runs array<int>")
    if many is not None:
        runs = runs.unionByName(_one_by_one(many, length))
    whole = found.where("times > 1").select("a", "b")
    runs = staged(runs.where(F.size("runs") > 0).join(whole, ["a", "b"], "left_anti").unionByName(whole.withColumn("runs", F.lit(None).cast("array<int>"))), "runs")
    places = scan(docs, length, q).join(runs, ["a", "b"])
    return places.select("row", "n_bytes", F.when(F.col("runs").isNull(), F.array("at", F.col("at") + F.col("n"))).otherwise(F.transform("runs", lambda r: r + F.col("at"))).alias("runs"))


def _one_by_one(cut: DataFrame, length: int) -> DataFrame:
    """The windows of stretches with a very frequent minimizer, counted by a hash of each: groups of any size."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, n, raw in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 6))):
                k = np.frombuffer(b"".join(hashlib.blake2b(raw[i : i + length], digest_size=16).digest() for i in range(n)), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(np.full(n, a)), pa.array(np.full(n, b)), pa.array(np.arange(n, dtype=np.int32))], names=["x", "y", "a", "b", "i"])

    w = cut.mapInArrow(explode, "x long, y long, a long, b long, i int")
    twice = w.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    hit = w.join(twice, ["x", "y"]).groupBy("a", "b").agg(F.array_sort(F.collect_set("i")).alias("i"))
    return hit.select("a", "b", F.flatten(F.transform("i", lambda i: F.array(i, i + 1))).alias("runs"))


def remove(docs: DataFrame, length: int = LENGTH, q: int | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, text_bytes kept, and the removed runs, for every document: the operator's full output."""
    docs = texts(docs).withColumn("text", F.coalesce("text", F.lit("")))
    q = min(Q, max(4, length // 4)) if q is None else q
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    # a set, as rows that share a hash say the same runs over and over
    runs = repeated_runs(docs.select("row", "text"), length, q, hot).groupBy("row", "n_bytes").agg(F.flatten(F.collect_set("runs")).alias("runs"))
    keyed = docs.withColumn("n_bytes", F.octet_length("text")).join(runs, ["row", "n_bytes"], "left").select("doc_id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            data, offsets = flat(b.column(1))
            kept, spans = [], []
            for d, r in enumerate(b.column(2)):
                own = data[offsets[d] : offsets[d + 1]]
                if not r.is_valid or not len(r):
                    kept.append(own.tobytes())
                    spans.append([])
                    continue
                r = r.values.to_numpy().reshape(-1, 2)
                mark = np.zeros(len(own) + 1, np.int32)
                np.add.at(mark, r[:, 0], 1)
                np.add.at(mark, np.minimum(r[:, 1] + length - 1, len(own)), -1)
                gone = np.cumsum(mark[:-1]) > 0
                kept.append(own[~gone].tobytes())
                spans.append(np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets)), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.int32()))], names=["doc_id", "n_bytes", "kept", "spans"])

    return keyed.mapInArrow(run, "doc_id long, n_bytes long, kept binary, spans array<int>")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
