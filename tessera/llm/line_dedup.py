"""Line deduplication by a deletion-neighbourhood join.

A line is removed if any earlier line (by doc_id, then line number, of the input) is equal, or within one edit (insert,
delete or replace one code point). Lines are what "\\n" parts; only lines of `EXACT` characters or more are compared for
equality, and of `NEAR` or more within an edit; shorter ones and empty ones stay.

1. Two lines within one edit share the first or the second half of the shorter one. Hashed halves are counted with the
   smallest and largest line hash (partial aggregation); halves of two different lines set bits of a bitmap.
2. Different lines with such a half are staged once each, with their earliest place. The other half is cut into pieces (about
   the square root of the length), and the line without one piece is a finer key, counted in the same way. Lines with such a
   key emit their deletion neighbourhood in the piece as hashed keys: with its place (equal keys: one replacement) and
   without (a line and a neighbour with equal keys: one insertion).
3. Equal keys are met by minimum: each key keeps the earliest line, each line the earliest of its keys. So a key that
   very many lines share costs one aggregation, and no pairs are made. The found pairs' edit distance is verified.
4. Lines equal to an earlier one, or with a verified neighbour that is earlier, go.

Null texts have no lines and stay null; an empty text has one empty line. Rows given twice count as earlier and later by
doc_id and line only, so copies of one row (same doc_id) are kept alike. Extra columns pass through; an input column named
n_lines or n_removed is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bits
from tessera.llm.arrow import texts, tidied
from tessera.llm.words import mix
from tessera.sources.stage import staged

EXACT = 10
NEAR = 20
U = np.uint64
B = 0x9E3779B97F4A7C15
B_INVERSE = pow(B, -1, 2**64)
CANDIDATES = "line_hash long, doc_id long, line int, text string, halves int"
NEIGHBOURS = "key long, kind int, line_hash long, doc_id long, line int"
SELF, DELETED, REPLACED = 0, 1, 2


def lines(docs: DataFrame) -> DataFrame:
    return docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "l")).withColumn("size", F.length("l"))


def half_keys(l, size):  # noqa: E741
    """The four half keys of a line: both halves, taken as the shorter and as the longer one of a pair."""
    out = []
    for s in (size, size - 1):
        p = F.floor(s / 2).cast("int")
        out.append(F.concat(F.lit("p"), s.cast("string"), F.lit("|"), F.substr(l, F.lit(1), p)))
        out.append(F.concat(F.lit("s"), s.cast("string"), F.lit("|"), F.substr(l, size - (s - p) + 1, s - p)))
    return F.array(*[F.xxhash64(k) for k in out])


def _halves(s: str) -> list[int]:
    """The same keys."""
    n, keys = len(s), []
    for m in (n, n - 1):
        p = m // 2
        keys.append(xxhash.xxh64_intdigest(f"p{m}|{s[:p]}".encode(), 42))
        keys.append(xxhash.xxh64_intdigest(f"s{m}|{s[n - (m - p) :]}".encode(), 42))
    return keys


_powers = np.ones(1, U)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.concatenate([[U(1)], np.cumprod(np.full(max(n, 2 * len(_powers)), U(B)))])
    return _powers[:n]


def sums(s: str) -> np.ndarray:
    """Sums over the characters before each place, from which the hash of a line without some of them follows."""
    c = mix(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U) + U(0x51ED270B))
    return np.concatenate([[U(0)], np.cumsum(c * powers(len(c)))])


def neighbours(total: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the line, hashes of the line without the character at each wanted place)."""
    n = len(total) - 1
    gone = total[wanted] + (total[-1] - total[wanted + 1]) * U(B_INVERSE)
    return mix(total[-1:] + U(n)), mix(gone + U(n - 1))


def pieces(total: np.ndarray, halves: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key of the line without a piece, where the piece begins, where it ends, whether the line is the longer one of a pair)
    for each piece of the halves that a shared half leaves. Lines within one edit have the key of the piece with the edit in
    common; pieces are counted in the shorter line, so that both have the same."""
    n, out = len(total) - 1, []
    for k, m in ((0, n), (2, n - 1)):
        many = max(2, 1 << (m.bit_length() // 2))
        cuts = np.arange(many + 1) * m // many
        first, second = (halves >> (k + 1)) & 1, (halves >> k) & 1
        i = np.arange(0 if first else many // 2, many if second else many // 2)
        end = cuts[i + 1] + (n - m)
        h = total[cuts[i]] + (total[-1] - total[end]) * U(1 if m == n else B_INVERSE)
        out.append((mix(h ^ mix(i.astype(U) + U(m << 20))), cuts[i], end, np.full(len(i), m < n)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _candidates(docs: DataFrame, bitmap: np.ndarray, near: int) -> DataFrame:
    """The different lines with a shared half, with their earliest place and a bit for each of their half keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first: dict[str, tuple[int, int]] = {}
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                for i, s in enumerate(text.split("\n") if text is not None else []):
                    if len(s) >= near and ((old := first.get(s)) is None or (doc, i) < old):
                        first[s] = (doc, i)
            own = list(first)
            for a in range(0, len(own), 2000):
                part = own[a : a + 2000]
                hit = bits.has(bitmap, np.array([k for s in part for k in _halves(s)], U).view(np.int64)).reshape(-1, 4) @ np.array([1, 2, 4, 8])
                at = np.flatnonzero(hit)
                part = [part[i] for i in at]
                lh = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in part], U).view(np.int64)
                docs_, lines_ = [first[s][0] for s in part], [first[s][1] for s in part]
                yield pa.RecordBatch.from_arrays([pa.array(lh), pa.array(docs_, pa.int64()), pa.array(lines_, pa.int32()), pa.array(part, pa.string()), pa.array(hit[at].astype(np.int32))], names=["line_hash", "doc_id", "line", "text", "halves"])

    found = docs.mapInArrow(tidied("line_dedup", run), CANDIDATES)
    one = found.groupBy("line_hash").agg(F.min(F.struct("doc_id", "line")).alias("own"), F.min("text").alias("text"), F.min("halves").alias("halves"))
    return one.select("line_hash", "own.doc_id", "own.line", "text", "halves")


def _pieces(candidates: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lh, s, halves in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                key = pieces(sums(s.as_py()), halves)[0].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), lh))], names=["key", "h"])

    return candidates.select("line_hash", "text", "halves").mapInArrow(_gather(run), "key long, h long")


def _emit(candidates: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """Replacements where the piece can be one of a line as long, deletions where it can be one of a shorter line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lh, doc, i, s, halves in zip(*(b.column(k).to_pylist() for k in range(5))):
                total = sums(s)
                key, begin, end, longer = pieces(total, halves)
                hit = bits.has(bitmap, key.view(np.int64))
                if not hit.any():
                    continue
                marks = np.zeros((2, len(s)), bool)
                for a, z, k in zip(begin[hit], end[hit], longer[hit].astype(int)):
                    marks[k, a:z] = True
                at = [np.flatnonzero(x) for x in marks]
                whole, gone = neighbours(total, at[1])
                _, replaced = neighbours(total, at[0])
                replaced = mix(replaced ^ mix(at[0].astype(U) + U(1)) ^ U(len(s)))
                out = np.concatenate([whole, gone, replaced]).view(np.int64)
                kind = np.repeat(np.array([SELF, DELETED, REPLACED], np.int32), [1, len(gone), len(replaced)])
                m = len(out)
                yield pa.RecordBatch.from_arrays([pa.array(out), pa.array(kind), pa.array(np.full(m, lh)), pa.array(np.full(m, doc)), pa.array(np.full(m, i, np.int32))], names=["key", "kind", "line_hash", "doc_id", "line"])

    return candidates.select("line_hash", "doc_id", "line", "text", "halves").mapInArrow(_gather(run), NEIGHBOURS)


def _shared(keys: DataFrame) -> DataFrame:
    """The keys that two different lines have."""
    return keys.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("z")).where("a <> z")


def _gather(run):
    """Small batches joined to larger ones."""

    def out(batches):
        held, rows = [], 0
        for b in run(batches):
            held.append(b)
            rows += b.num_rows
            if rows > 50_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return out


def near_lines(docs: DataFrame, near: int) -> DataFrame:
    """(line_hash, first): lines with an earlier line within one edit, and that line's place."""
    rows = lines(docs).where(F.col("size") >= near)
    keys = rows.select(F.xxhash64("l").alias("h"), F.explode(half_keys(F.col("l"), F.col("size"))).alias("key"))
    found = staged(_candidates(docs, bits.collect_bits(_shared(keys), "key"), near), "candidates")
    v = staged(_emit(found, bits.collect_bits(_shared(_pieces(found)), "key")), "neighbours")
    # a line can have a key of deletion twice (equal characters on end); either copy says the same
    v = v.select("key", "kind", "line_hash", F.struct("doc_id", "line", "line_hash").alias("own"))
    of = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("own")))
    g = v.groupBy("key").agg(of(SELF).alias("of_self"), of(DELETED).alias("of_deleted"), of(REPLACED).alias("of_replaced"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = F.when(F.col("kind") == SELF, F.col("of_deleted")).when(F.col("kind") == DELETED, F.col("of_self")).otherwise(F.col("of_replaced"))
    pairs = v.join(g, "key").select("line_hash", "own", first.alias("first")).where(F.col("first") < F.col("own"))
    # the earliest of each line's neighbours; verified below on the texts
    pairs = pairs.groupBy("line_hash").agg(F.min("first").alias("first"))
    text = found.select("line_hash", "text")
    other = text.select(F.col("line_hash").alias("other"), F.col("text").alias("other_text"))
    checked = pairs.withColumn("other", F.col("first.line_hash")).join(text, "line_hash").join(other, "other")
    return checked.where(F.levenshtein("text", "other_text", 1) >= 0).select("line_hash", F.struct("first.doc_id", "first.line").alias("first"))


def removed_lines(docs: DataFrame, exact: int = EXACT, near: int = NEAR) -> DataFrame:
    """(doc_id, gone array<int>): the removed line numbers of documents that lose any."""
    rows = lines(docs).where(F.col("size") >= exact).select("doc_id", "line", F.xxhash64("l").alias("h"), F.xxhash64(F.lit("second"), "l").alias("h2"))
    one = rows.groupBy("h", "h2").agg(F.min(F.struct("doc_id", "line")).alias("own"), F.count(F.lit(1)).alias("times"))
    near_by = near_lines(docs, near).withColumnRenamed("line_hash", "h")
    known = one.join(near_by, "h", "left").select("h", "h2", "own", F.coalesce(F.col("first") < F.col("own"), F.lit(False)).alias("near"), "times").where("times > 1 or near")
    gone = rows.join(known.select("h", "h2", "own", "near"), ["h", "h2"]).where(F.col("near") | (F.struct("doc_id", "line") != F.col("own")))
    return gone.groupBy("doc_id").agg(F.collect_set("line").alias("gone"))


def dedup(docs: DataFrame, exact: int = EXACT, near: int = NEAR) -> DataFrame:
    """Every row of docs with the text that is left, and n_lines, n_removed."""
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    docs = docs.drop("n_lines", "n_removed")
    names = docs.columns
    gone = removed_lines(slim, exact, near).select(F.col("doc_id").alias("key"), F.col("gone").alias("drop"))
    place, key = names.index("text"), names.index("doc_id")
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn(f"c{place}", F.col(f"c{place}").cast("string"))
    joined = inner.join(gone, F.col(f"c{key}") == F.col("key"), "left").drop("key")
    schema = ", ".join(f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema) + ", n_lines long, n_removed long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, n, k = [], [], []
            for t, g in zip(b.column(place), b.column(len(names))):
                t = t.as_py()
                parts = t.split("\n") if t is not None else []
                drop = set(g.as_py()) if g.is_valid else ()
                out.append(t if not drop else "\n".join([x for i, x in enumerate(parts) if i not in drop]))
                n.append(len(parts))
                k.append(len(drop))
            cols = [pa.array(out, pa.string()) if i == place else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(k, pa.int64())], names=[*names, "n_lines", "n_removed"])

    return joined.mapInArrow(tidied("line_dedup", run), schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(texts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL_LINES = """
l as (select doc_id, i as line, x as l, length(x) as n from (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)),
u as (select l, n, min((doc_id, line)) as own from l where n >= 10 group by all),
k as (select u.*, s, t, case t when 'p' then substr(l, 1, s // 2) else right(l, s - s // 2) end as h from u, (values ('p'), ('s')) v(t), lateral (select unnest([n, n - 1]) as s) where n >= 20),
c as (select distinct a.l as x, a.own as own, b.l as y, b.own as first from k a join k b using (s, t, h) where a.l <> b.l and b.own < a.own and abs(a.n - b.n) <= 1),
e as (select distinct own from c where case when length(x) = length(y) then len(list_filter(range(1, length(x) + 1), lambda i: substr(x, i, 1) <> substr(y, i, 1))) = 1
      when length(x) > length(y) then len(list_filter(range(0, length(x)), lambda i: substr(x, 1, i) || substr(x, i + 2) = y)) > 0
      else len(list_filter(range(0, length(y)), lambda i: substr(y, 1, i) || substr(y, i + 2) = x)) > 0 end),
r as (select l.doc_id, l.line, l.l, u.own is not null and ((l.doc_id, l.line) <> u.own or e.own is not null) as gone from l left join u on l.l = u.l left join e on u.own = e.own)
"""
SQL = f"with {SQL_LINES} select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_removed, sha256(coalesce(string_agg(l, chr(10) order by line) filter (where not gone), '')) as kept_sha256 from r group by doc_id"
