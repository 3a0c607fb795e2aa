"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Documents are sets of distinct 5-word shingles; two link at a Jaccard similarity of 3/4 or more. Equal sets are one node.
Shingles are ordered by how many documents hold them (a count-min table of fixed size, over all documents), rare first.
By the prefix principle two similar sets share a shingle in their first n - ceil(3n/4) + 1, and share m shingles in
prefixes that are m - 1 longer. Each document chooses its m by estimated cost: a longer prefix means more list entries
to scan, more required matches mean fewer candidates to verify. Two documents then share min(m, m') prefix shingles.

Each set has an odd sketch: about one bit for each shingle, each the parity of how many shingles hash to it. Bits that
differ never outnumber the shingles that only one of two sets has, so a pair with too many of them can't be similar.

1. Prefix postings are packed in numpy and dealt by shingle, those of frequent shingles also by a salt of the node.
   Entries without a partner in their list that can be similar, by sizes and places, drop out. (Salted lists stay whole.)
2. Each list offers its members two hubs of other components; of those that pass the place, size and sketch bounds each
   member keeps a few; these pairs are verified and give first components. So a group of thousands of near copies costs a
   few pairs for each copy, not all pairs. Then only entries stay that have a partner of another component which passes
   the bounds, usually few, and with wider sketches and other hubs this is done again as long as it links many.
3. Only pairs of different components remain: lists emit those that pass the same bounds; pairs with too few common
   shingles in the prefixes drop out, the rest is verified on the full sets, and components are final. Lists over
   `BLOCK` entries are split into pairs of blocks, the largest component of a list apart from the others.

The number of turns changes the work, not the result. Links inside a component that step 2 found are implied, none
between different components is lost. Null and empty texts and texts without words have empty sets and link with nothing;
texts under 5 words are one shingle. Rows given twice are equal sets. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import bits
from tessera.llm.arrow import chunks, flat, partitions, texts, tidied
from tessera.llm.components import components
from tessera.llm.words import SPACE_WORDS, mix, shingles, tokens
from tessera.sources.stage import release, staged

U = np.uint64
K = 5
COUNTERS = 1 << 24
SLICES = 64
MATCHES = 4
VERIFY_COST = 30.0
HUBS = 3
TURNS = 3
SALTED = 600  # documents a list, beyond which it is salted
BLOCK = 1000
SKETCH_BITS = 1 << 15  # of the longest sketch
WIDE = 8  # bits of a wide sketch for each bit of the other
SETS = "doc_id long, n_shingles long, node long, node2 long, text_key long, sketch binary"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Staged; its shuffle files go at once."""
    return staged(df, name, tidy=True)


def sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle) sorted and distinct, and the set size of each text."""
    doc, s = shingles(*tokens(data, offsets, SPACE_WORDS), k)
    n = len(offsets) - 1
    order = np.lexsort((s, doc)) if n > 4096 else np.argsort((doc.astype(U) << U(52)) | (s >> U(12)), kind="stable")
    doc, s = doc[order], s[order]
    if len(s):
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (s[1:] != s[:-1])])
        doc, s = doc[new], s[new]
    return doc, s, np.bincount(doc, minlength=n)


def nodes(doc: np.ndarray, s: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that say which set a text has."""
    a, b = np.zeros(len(size), U), np.zeros(len(size), U)
    if len(s):
        at = np.concatenate([[0], np.cumsum(size)[:-1]])
        full = size > 0
        a[full] = np.add.reduceat(mix(s), at[full])
        b[full] = np.add.reduceat(mix(s ^ U(0xA5A5A5A5A5A5A5A5)), at[full])
    return mix(a + size.astype(U)), mix(b)


def sketches(doc: np.ndarray, s: np.ndarray, size: np.ndarray, times: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(bytes on end, offsets) of the odd sketch of each set, of about `times` bits for each shingle."""
    bits_ = np.where(size > 0, times * np.minimum(SKETCH_BITS, np.maximum(64, 2 ** np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))), 0)
    ends = np.cumsum(bits_)
    at = (ends - bits_)[doc] + (mix(s ^ U(0x5851F42D4C957F2D)).astype(np.int64) & (bits_[doc] - 1))
    odd = (np.bincount(at, minlength=int(ends[-1]) if len(ends) else 0) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little"), np.append(0, ends // 8)


def _each(batches: Iterator[pa.RecordBatch], k: int):
    for b in batches:
        data, offsets = flat(b.column(1))
        for a, z in chunks(offsets):
            doc, s, size = sets(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a], k)
            yield b.slice(a, z - a), doc, s, size, nodes(doc, s, size)


def _sketch(doc: np.ndarray, s: np.ndarray, size: np.ndarray, times: int = 1) -> pa.Array:
    data, offsets = sketches(doc, s, size, times)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def set_keys(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_shingles, the node of its set (two 64-bit halves), a hash of the text, and the set's sketch."""

    def run(batches):
        for b, doc, s, size, (x, y) in _each(batches, k):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size.astype(np.int64)), pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), b.column(2), _sketch(doc, s, size)], names=["doc_id", "n_shingles", "node", "node2", "text_key", "sketch"])

    return docs.mapInArrow(tidied("ngram_join", run), SETS)


def counter(s: np.ndarray) -> np.ndarray:
    return (s >> U(20)).astype(np.int64) & (COUNTERS - 1)


#: About how many documents a level stands for: eight levels for each power of two.
COUNT_OF = np.exp2(np.arange(256) / 8) - 1


def frequencies(docs: DataFrame, k: int) -> np.ndarray:
    """How many documents hold the shingles of each counter, as levels of one byte; COUNTERS bytes, whatever the corpus."""

    def run(batches):
        total = np.zeros(COUNTERS, "<u4")
        for _, _, s, _, _ in _each(batches, k):
            np.add.at(total, counter(s), np.uint32(1))
        if total.any():
            for i, part in enumerate(total.reshape(SLICES, -1)):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([_squeeze(part)], pa.binary())], names=["slice", "counts"])

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1)):
                held[i] = held.get(i, 0) + _spread(raw.as_py()).astype(np.int64)
        for i, h in held.items():
            level = np.minimum(255, np.rint(8 * np.log2(1 + h))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["slice", "levels"])

    out = np.zeros((SLICES, COUNTERS // SLICES), np.uint8)
    levels = kept(docs.mapInArrow(tidied("ngram_join", run), "slice int, counts binary").repartition(SLICES, "slice").mapInArrow(tidied("ngram_join", add), "slice int, levels binary"), "levels")
    for r in levels.collect():  # COUNTERS bytes
        out[r[0]] = np.frombuffer(bytes(r[1]), np.uint8)
    release(levels)
    return out.reshape(-1)


def _squeeze(x: np.ndarray) -> bytes:
    import zlib

    return zlib.compress(x.tobytes(), 1)


def _spread(raw: bytes) -> np.ndarray:
    import zlib

    return np.frombuffer(zlib.decompress(raw), "<u4")


def least_overlap(n: np.ndarray) -> np.ndarray:
    """The fewest shingles that a set of n shares with any set similar to it."""
    return -(-3 * n // 4)


def prefixes(doc: np.ndarray, s: np.ndarray, size: np.ndarray, levels: np.ndarray, noise: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index into s of the prefix shingles, chosen number of matches of each text, place of each prefix shingle, about
    how many documents hold it)."""
    if not len(s):
        return np.empty(0, np.int64), np.ones(len(size), np.int64), np.empty(0, np.int64), np.empty(0)
    est = np.maximum(1.0, COUNT_OF[levels[counter(s)]] - noise)
    rank = np.minimum(np.log2(est), 30).astype(U)
    # frequent shingles last; the document in the top bits keeps texts apart
    order = np.argsort((doc.astype(U) << U(52)) | (rank << U(47)) | (s >> U(17)), kind="stable") if len(size) <= 4096 else np.lexsort((s, rank, doc))
    cost = np.concatenate([[0.0], np.cumsum(est[order])])
    begin = np.cumsum(size) - size
    t = least_overlap(size)
    best, chosen = np.full(len(size), np.inf), np.ones(len(size), np.int64)
    for m in range(1, MATCHES + 1):
        length = np.minimum(size, size - t + m)
        scan = cost[begin + length] - cost[begin]
        c = np.where((m <= t) & (size > 0), scan + VERIFY_COST * scan / m**2, np.inf)
        chosen = np.where(c < best, m, chosen)
        best = np.minimum(c, best)
    length = np.where(size > 0, np.minimum(size, size - t + chosen), 0)
    at = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())
    return order[at], chosen, at - np.repeat(begin, length), est[order[at]]


#: size holds the matches in its top 4 bits, place a mark of salted lists in its top bit
POSTING = np.dtype([("token", "<u4"), ("node", "<i8"), ("size", "<u4"), ("place", "<u4")])
LISTS = "token long, salt int, salted boolean, node long, size long, matches int, place int"


def postings(docs: DataFrame, levels: np.ndarray, k: int, buckets: int) -> DataFrame:
    """(bucket, entries): packed prefix postings; the bucket of salted ones is salt * buckets more."""
    noise = float(COUNT_OF[int(np.median(levels))]) * 1.5 + 2

    def run(batches):
        for _, doc, s, size, (node, _) in _each(batches, k):
            at, m, place, held = prefixes(doc, s, size, levels, noise)
            if not len(at):
                continue
            rows = np.empty(len(at), POSTING)
            h, own = mix(s[at]), doc[at]
            rows["token"] = (h & U(0xFFFFFFFF)).astype(np.uint32)
            rows["node"] = node.view(np.int64)[own]
            rows["size"] = np.minimum(size[own], (1 << 28) - 1) | (m[own] << 28)
            salts = np.ceil(held / SALTED).astype(np.int64)
            rows["place"] = place | ((salts > 1) << 31)
            bucket = (h >> U(32)).astype(np.int64) % buckets
            bucket += buckets * ((mix(node[own] ^ h) >> U(1)).astype(np.int64) % np.maximum(salts, 1))
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            parts = [p.tobytes() for p in np.split(rows, first[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array(parts, pa.binary())], names=["bucket", "entries"])

    return docs.mapInArrow(tidied("ngram_join", run), "bucket long, entries binary")


def alike(a: np.ndarray, b: np.ndarray, place_a: np.ndarray, place_b: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which pairs of sets of a <= b shingles can be similar by size and by the places of a common shingle, how many
    shingles similar ones can have apart)."""
    # a similar pair has at least so many common shingles, so the first n - common + need of both hold `need` of them
    common = -(-3 * (a + b) // 7)
    return (3 * b <= 4 * a) & (place_a < a - common + need) & (place_b < b - common + need), a + b - 2 * common


def pairs_in(group: np.ndarray, size: np.ndarray, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of each two entries of one group, i the smaller set and j at most 4/3 of it, about `most` pairs at a time."""
    order = np.lexsort((size, group))
    g, s = group[order].astype(np.int64), size[order].astype(np.int64)
    top = 2 * int(s.max()) + 2
    n = np.maximum(0, np.searchsorted(g * top + s, g * top + s * 4 // 3, "right") - np.arange(len(order)) - 1)
    ends, a = np.cumsum(n), 0
    while a < len(order):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        m = n[a:z]
        i = np.repeat(np.arange(a, z), m)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m)
        yield order[i], order[j]
        a = z


def lists(packed: DataFrame, parts: int, buckets: int) -> DataFrame:
    """The entries of shingles that have a partner in the list which can be similar; of salted lists all."""

    def flush(held: list[bytes], bucket: int):
        rows = np.frombuffer(b"".join(held), POSTING)
        order = np.lexsort((rows["node"], rows["token"]))
        rows = rows[order]
        new = np.concatenate([[True], (rows["token"][1:] != rows["token"][:-1]) | (rows["node"][1:] != rows["node"][:-1])])
        rows = rows[new]
        group = np.cumsum(np.concatenate([[0], rows["token"][1:] != rows["token"][:-1]]))
        salted = rows["place"] >> 31 > 0
        at = np.flatnonzero((np.bincount(group) > 1)[group] & ~salted)
        kept = salted.copy()
        size, place, need = (rows["size"] & ((1 << 28) - 1)).astype(np.int64), rows["place"].astype(np.int64), (rows["size"] >> 28).astype(np.int64)
        for i, j in pairs_in(group[at], size[at]) if len(at) else ():
            i, j = at[i], at[j]
            ok, _ = alike(size[i], size[j], place[i], place[j], np.minimum(need[i], need[j]))
            kept[i[ok]] = kept[j[ok]] = True
        rows = rows[kept]
        token = (np.int64(bucket % buckets) << 32) | rows["token"].astype(np.int64)
        for a in range(0, len(rows), 100_000):
            r = rows[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(token[a : a + 100_000]), pa.array(np.full(len(r), bucket // buckets, np.int32)), pa.array(r["place"] >> 31 > 0), pa.array(r["node"]), pa.array((r["size"] & ((1 << 28) - 1)).astype(np.int64)), pa.array((r["size"] >> 28).astype(np.int32)), pa.array((r["place"] & ((1 << 31) - 1)).astype(np.int32))], names=["token", "salt", "salted", "node", "size", "matches", "place"])

    def run(batches):
        held, bucket = [], -1
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1)):
                if i != bucket and held:
                    yield from flush(held, bucket)
                    held = []
                bucket = i
                held.append(raw.as_py())
        if held:
            yield from flush(held, bucket)

    return packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(tidied("ngram_join", run), LISTS)


def _once(docs: DataFrame, keys: DataFrame, ends: DataFrame, k: int, column: str, value) -> DataFrame:
    """(node, column): value(doc, s, size) of the sets of the nodes in ends (and a few more), once for each node. Only the
    texts whose hashes are in a bitmap are looked at."""
    chosen = keys.join(ends, "node", "left_semi").groupBy("node").agg(F.min("text_key").alias("text_key"))
    wanted = bits.collect_bits(chosen, "text_key")

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            b = b.filter(pa.array(bits.has(wanted, b.column(2).to_numpy())))
            for _, doc, s, size, (node, _) in _each([b], k):
                out = [i for i in np.flatnonzero(size > 0).tolist() if int(node[i]) not in seen]
                if len(seen) < 200_000:
                    seen.update(int(node[i]) for i in out)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)[out]), value(doc, s, size).take(pa.array(out, pa.int64()))], names=["node", column])

    return docs.mapInArrow(tidied("ngram_join", run), f"node long, {column} binary").groupBy("node").agg(F.first(column).alias(column))


def full_sets(docs: DataFrame, keys: DataFrame, ends: DataFrame, k: int) -> DataFrame:
    """(node, shingles): the packed sorted sets of the nodes in ends, and of a few more."""

    def packed(doc, s, size):
        begin = np.cumsum(size) - size
        return pa.array([s[a : a + n].tobytes() for a, n in zip(begin, size)], pa.binary())

    return _once(docs, keys, ends, k, "shingles", packed)


def wide_shapes(docs: DataFrame, keys: DataFrame, ends: DataFrame, k: int) -> DataFrame:
    """(node, sketch): the wide sketches of the nodes in ends, and of a few more."""
    return _once(docs, keys, ends, k, "sketch", lambda doc, s, size: _sketch(doc, s, size, WIDE))


def verified(pairs: DataFrame, docs: DataFrame, keys: DataFrame, k: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar. pairs is a staged table."""
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    own = full_sets(docs, keys, ends, k)
    a, b = own.select(F.col("node").alias("u"), F.col("shingles").alias("x")), own.select(F.col("node").alias("v"), F.col("shingles").alias("y"))

    def run(batches):
        for t in batches:
            ok = []
            for x, y in zip(t.column(2), t.column(3)):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                if 4 * min(len(x), len(y)) < 3 * max(len(x), len(y)):
                    ok.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= 75 * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return kept(pairs.join(a, "u").join(b, "v").select("u", "v", "x", "y").mapInArrow(tidied("ngram_join", run), "u long, v long"), "links")


def labelled(found: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The list entries with their nodes' components so far."""
    if labels is None:
        return found.withColumn("label", F.col("node"))
    return found.join(labels, "node", "left").select(*found.columns, F.coalesce("component", "node").alias("label"))


def _mixed(rows: DataFrame, by: list[str]) -> DataFrame:
    """The entries of lists that hold two components or more."""
    mixed = rows.groupBy(*by).agg(F.min("label").alias("a"), F.max("label").alias("z")).where("a <> z").select(*by)
    return rows.join(mixed, by)


class Entries:
    """Entries of whole groups: number of the group, and the columns node, size, matches, place, label, sketch."""

    def __init__(self, t: pa.Table, group: np.ndarray):
        self.group = group
        self.node, self.size, self.matches, self.place = (t.column(c).to_numpy() for c in ("node", "size", "matches", "place"))
        self.label = t.column("label").to_numpy() if "label" in t.column_names else self.node
        sketch = t.column("sketch").combine_chunks().cast(pa.large_binary())
        _, off, data = sketch.buffers()
        offsets = np.frombuffer(off, np.int64, len(sketch) + 1, sketch.offset * 8)
        self.flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(U)
        self.at = (offsets[:-1] - offsets[0]) // 8
        self.words = np.diff(offsets) // 8

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs can be similar by size, by the places of the common shingle, and by their sketches."""
        swap = self.size[i] > self.size[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        out, apart = alike(self.size[i], self.size[j], self.place[i], self.place[j], np.minimum(self.matches[i], self.matches[j]))
        at = np.flatnonzero(out)
        out[at] = self._odd(i[at], j[at]) <= apart[at]
        return out

    def _odd(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many bits of the sketches differ, the longer one folded; i has the smaller sets."""
        out = np.zeros(len(i), np.int64)
        row = np.zeros(len(self.words), np.int64)
        for w in np.unique(self.words[i]).tolist():
            pick = np.flatnonzero(self.words[i] == w)
            same, twice = np.flatnonzero(self.words == w), np.flatnonzero(self.words == 2 * w)
            row[same], row[twice] = np.arange(len(same)), len(same) + np.arange(len(twice))
            folded = self.flat[self.at[twice][:, None] + np.arange(2 * w)].reshape(-1, 2, w)
            table = np.concatenate([self.flat[self.at[same][:, None] + np.arange(w)], folded[:, 0] ^ folded[:, 1]])
            step = max(1, (1 << 18) // w)
            for a in range(0, len(pick), step):
                p = pick[a : a + step]
                out[p] = np.bitwise_count(table[row[i[p]]] ^ table[row[j[p]]]).sum(1, dtype=np.int64)
        return out


def _grouped(batches: Iterator[pa.RecordBatch], by: list[str], most_rows: int = 20_000, most_bytes: int = 4 << 20) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, with the number of each row's group; rows come sorted by the columns `by`."""
    held: list[pa.RecordBatch] = []

    def cut(last: bool):
        t = pa.Table.from_batches(held)
        new = np.full(len(t), False)
        for c in by:
            x = t.column(c).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        starts = np.flatnonzero(new)
        z = len(t) if last else int(starts[-1]) if len(starts) else 0
        held.clear()
        if z < len(t):
            held.extend(t.slice(z).combine_chunks().to_batches())
        if z:
            yield t.slice(0, z).combine_chunks(), np.cumsum(new[:z])

    for b in batches:
        step = max(1, most_rows * len(b) // max(most_rows, len(b), most_rows * b.nbytes // most_bytes))
        for a in range(0, len(b), step):
            held.append(b.slice(a, step))
            if sum(map(len, held)) >= most_rows or sum(x.nbytes for x in held) >= most_bytes:
                yield from cut(False)
    if sum(map(len, held)):
        yield from cut(True)


def sifted(found: DataFrame, labels: DataFrame | None, shapes: DataFrame, parts: int) -> DataFrame:
    """The entries that have a partner of another component in their list which passes the bounds; of salted lists all."""
    kept = ["token", "salt", "node", "size", "matches", "place"]

    def run(batches):
        for t, group in _grouped(batches, ["token", "salt"]):
            e, ok = Entries(t, group), t.column("salted").to_numpy().copy()
            at = np.flatnonzero(~ok)
            for i, j in pairs_in(group[at], e.size[at]) if len(at) else ():
                other = e.label[at[i]] != e.label[at[j]]
                i, j = at[i[other]], at[j[other]]
                near = e.near(i, j)
                ok[i[near]] = ok[j[near]] = True
            yield from t.select(kept).filter(pa.array(ok)).combine_chunks().to_batches()

    rows = _mixed(labelled(found, labels), ["token"])
    dealt = rows.join(shapes, "node").select(*kept, "salted", "label", "sketch").repartition(parts, "token", "salt").sortWithinPartitions("token", "salt")
    return dealt.mapInArrow(tidied("ngram_join", run), LISTS.replace(" salted boolean,", ""))


ENTRY = ["node", "size", "matches", "place", "label", "sketch"]


def stars(found: DataFrame, labels: DataFrame | None, shapes: DataFrame, turn: int, parts: int) -> DataFrame:
    """For each node up to HUBS partners of other components that pass the bounds. Each list that holds two components or
    more has two hubs of different components, those with the smallest hash of node and turn."""
    rows = labelled(found, labels)
    if labels is not None:
        rows = _mixed(rows, ["token", "salt"])

    def run(batches):
        for t, group in _grouped(batches, ["token", "salt"]):
            e = Entries(t, group)
            draw = mix(e.node.view(U) + U(turn * 0x9E3779B97F4A7C15 % 2**64)) >> U(1)
            order = np.lexsort((e.node, draw, group))
            first = order[np.concatenate([[True], group[order][1:] != group[order][:-1]])]  # a group's hub, by its number
            other = order[e.label[order] != e.label[first[group[order]]]]
            second = np.full(len(first), -1)
            if len(other):
                second[group[other][::-1]] = other[::-1]
            member, hub = np.concatenate([np.arange(len(group))] * 2), np.concatenate([first[group], second[group]])
            ok = (hub >= 0) & (e.label[member] != e.label[hub])
            member, hub = member[ok], hub[ok]
            ok = e.near(member, hub)
            member, hub = member[ok], hub[ok]
            _, once = np.unique(np.stack([e.node[member], e.node[hub]], 1), axis=0, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(e.node[member[once]]), pa.array(e.node[hub[once]]), pa.array(draw[hub[once]].view(np.int64))], names=["node", "hub", "draw"])

    dealt = rows.join(shapes, "node").select("token", "salt", *ENTRY).repartition(parts, "token", "salt").sortWithinPartitions("token", "salt")
    met = dealt.mapInArrow(tidied("ngram_join", run), "node long, hub long, draw long").distinct()
    best = met.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy("draw", "hub"))).where(F.col("n") <= HUBS)
    return best.select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v")).distinct()


def rest(found: DataFrame, labels: DataFrame | None, shapes: DataFrame, parts: int) -> DataFrame:
    """Pairs of nodes of different components that pass the bounds and share enough prefix shingles."""
    rows = labelled(found, labels)
    sizes = rows.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"))
    info = sizes.groupBy("token").agg(F.sum("c").alias("all"), F.max(F.struct("c", "label")).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    info = info.select("token", F.col("top.label").alias("main"), F.when(F.col("all") > BLOCK, blocks(F.col("top.c"))).otherwise(0).alias("main_blocks"), F.when(F.col("all") > BLOCK, blocks(F.col("all") - F.col("top.c"))).otherwise(0).alias("blocks"))
    # the sketches come last, and only to lists that hold two components or more
    rows = rows.join(info, "token").join(shapes, "node")
    # (first block, second block, side): each pair of entries meets under one key, on different sides or, side 2, in one block
    key = lambda a, z, side: F.struct(a.cast("int").alias("a"), z.cast("int").alias("z"), side.cast("int").alias("side"))
    own = lambda n: F.pmod(F.xxhash64("node", "token"), F.greatest(n, F.lit(1))).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    b = own(F.col("blocks"))
    among = F.transform(upto(F.col("blocks")), lambda x: key(F.least(x, b), F.greatest(x, b), F.when(x == b, 2).when(x < b, 1).otherwise(0)))
    across = F.transform(upto(F.col("main_blocks")), lambda x: key(b, F.col("blocks") + x, F.lit(0)))
    of_main = F.transform(upto(F.col("blocks")), lambda x: key(x, F.col("blocks") + own(F.col("main_blocks")), F.lit(1)))
    keys = F.when(F.col("blocks") == 0, F.array(key(F.lit(0), F.lit(0), F.lit(2)))).when(F.col("label") == F.col("main"), of_main).otherwise(F.concat(among, across))
    dealt = rows.select("token", F.explode(keys).alias("k"), *ENTRY).select("token", "k.a", "k.z", "k.side", *ENTRY).repartition(parts, "token", "a", "z").sortWithinPartitions("token", "a", "z")

    def run(batches):
        for t, group in _grouped(batches, ["token", "a", "z"]):
            e, side = Entries(t, group), t.column("side").to_numpy()
            for i, j in pairs_in(group, e.size):
                ok = (e.label[i] != e.label[j]) & ((side[i] == 2) | (side[i] != side[j]))
                i, j = i[ok], j[ok]
                ok = e.near(i, j)
                i, j = i[ok], j[ok]
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(e.node[i], e.node[j])), pa.array(np.maximum(e.node[i], e.node[j])), pa.array(np.minimum(e.matches[i], e.matches[j]))], names=["u", "v", "need"])

    pairs = dealt.mapInArrow(tidied("ngram_join", run), "u long, v long, need int")
    return pairs.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("need")).where("n >= need").select("u", "v")


def join(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    docs = texts(docs).withColumn("text_key", F.xxhash64("text"))
    parts = partitions(docs)
    keys = staged(set_keys(docs, k), "sets")
    every = kept(lists(postings(docs, frequencies(docs, k), k, 4 * parts), parts, 4 * parts), "lists")
    ends = every.select("node").distinct()
    shapes = kept(keys.where("n_shingles > 0").join(ends, "node", "left_semi").groupBy("node").agg(F.first("sketch").alias("sketch")), "shapes")
    found, first, links = every, None, []
    for turn in range(TURNS):
        pairs = kept(stars(found, first, shapes, turn, parts), "pairs")
        links.append(verified(pairs, docs, keys, k))
        offered, new = pairs.count(), links[-1].count()
        release(pairs)
        if new:
            release(first)
            first = components(_all(links))
        if not turn:
            found = kept(sifted(every, first, shapes, parts), "sifted")
            release(every, shapes)
            shapes = kept(wide_shapes(docs, keys, found.select("node").distinct(), k), "shapes")
        elif 4 * new < offered or not new:
            break
    pairs = kept(rest(found, first, shapes, parts), "pairs")
    links.append(verified(pairs, docs, keys, k))
    labels = components(_all(links))
    release(pairs, found, shapes, first, *links)
    same = keys.where("n_shingles > 0").groupBy("node", "node2").agg(F.min("doc_id").alias("rep"))
    named = same.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node"))
    smallest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    reps = named.join(smallest, "label").select("node", "node2", "component_id")
    out = keys.where("n_shingles > 0").join(reps, ["node", "node2"]).select("doc_id", "n_shingles", "component_id")
    return out.unionByName(keys.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
