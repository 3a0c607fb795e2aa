"""Benchmark decontamination with a positional inverted index of the training texts.

The index is partitioned by document: each training document keeps, for the words of the test items, its postings as
(term, position) sorted by term. A window of a test item is found by starting from the list of its rarest term (by counts
over all documents), shifting the positions by the term's offset, and intersecting with the lists of the next rarer
terms. Nothing is shuffled by term, so a frequent word or a passage that a third of the documents share costs its own
documents only. Documents without the rarest term of any window have no match and store no postings.

Proximity: all different words of an item within a number of words of a document, in any order; lists are joined from the
item's rarest word, and only documents with all its words are looked at.

Null texts have no words and no hits; empty items have no windows; equal items are found each under its own id, items
without an id can't be named and are left out; equal documents are matched each, whatever their doc_id; extra columns are
ignored; without items every document is clean. Item ids that occur more than once are one item with several texts. The
test set is broadcast in blocks of at most `block_bytes` of text, for which a task holds about five times as much.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.arrow import chunks, flat, texts, tidied
from tessera.llm.words import ALNUM_WORDS, tokens
from tessera.sources.stage import staged

WINDOW = 13
BLOCK_BYTES = 4 << 20
SPREAD = 2  # an item is near where its different words stand within so many times their number
INDEX = "doc_id long, row long, n_words long, terms array<int>, positions array<int>"
HITS = "doc_id long, row long, n_words long, items array<string>, starts array<int>, ends array<int>, near array<string>"
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near long"


def ids(vocabulary: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The term of each word hash, its place in the sorted vocabulary, or -1."""
    if not len(vocabulary):
        return np.full(len(h), -1, np.int32)
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    return np.where(vocabulary[at] == h, at, -1).astype(np.int32)


@dataclass
class Items:
    """A block of test items: sorted word hashes, the items' names, and their words as terms on end."""

    vocabulary: np.ndarray
    item: list[str]
    words: np.ndarray
    bounds: np.ndarray

    @staticmethod
    def of(rows: list[tuple[str, str | None]]) -> Items:
        h, counts = tokens(*flat(pa.array([t for _, t in rows], pa.string())), ALNUM_WORDS)
        vocabulary, term = np.unique(h, return_inverse=True)
        return Items(vocabulary, [i for i, _ in rows], term.astype(np.int32), np.append(0, np.cumsum(counts)))


@dataclass
class Plan:
    """Windows sorted by anchor, the rarest term; for each the offsets of its terms from rare to frequent."""

    first: np.ndarray  # of each term: where its windows begin
    item: np.ndarray
    size: np.ndarray
    start: np.ndarray  # of each window: where it begins in words
    order: np.ndarray  # windows x window offsets, -1 beyond the size
    words: np.ndarray

    @staticmethod
    def of(items: Items, counts: np.ndarray, window: int) -> Plan:
        lens = np.diff(items.bounds)
        n = np.where(lens > 0, np.maximum(1, lens - window + 1), 0)
        item = np.repeat(np.arange(len(lens)), n).astype(np.int32)
        start = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(items.bounds[:-1], n)).astype(np.int32)
        size = np.minimum(window, lens[item]).astype(np.int8)
        if len(item):
            # a window that an item has more than once is sought once
            padded = np.append(items.words, np.full(window, -1, np.int32))
            rows = np.empty((len(item), window + 1), np.int32)
            rows[:, 0] = item
            for k in range(window):
                rows[:, k + 1] = np.where(k < size, padded[start + k], -1)
            _, once = np.unique(rows.view(np.dtype((np.void, rows.itemsize * (window + 1)))).ravel(), return_index=True)
            item, start, size = item[once], start[once], size[once]
        order, anchor = np.full((len(item), window), -1, np.int8), np.empty(len(item), np.int32)
        for a in range(0, len(item), 100_000):
            own = slice(a, a + 100_000)
            off = np.arange(window)
            inside = off < size[own, None]
            held = np.where(inside, counts[items.words[np.minimum(start[own, None] + off, len(items.words) - 1)]], np.iinfo(np.int64).max)
            by = np.argsort(held, axis=1, kind="stable")
            order[own] = np.where(inside, by, -1)
            anchor[own] = items.words[start[own] + by[:, 0]]
        by = np.argsort(anchor, kind="stable")
        return Plan(np.searchsorted(anchor[by], np.arange(len(items.vocabulary) + 1)), item[by], size[by], start[by], order[by], items.words)


@dataclass
class Near:
    """What proximity needs: items sorted by their rarest word, their different words, and their spans."""

    first: np.ndarray  # of each term: where the items begin of which it is the rarest
    item: np.ndarray
    words: np.ndarray
    bounds: np.ndarray
    span: np.ndarray

    @staticmethod
    def of(items: Items, counts: np.ndarray, span: int | None = None) -> Near:
        each = [np.unique(items.words[a:b]) for a, b in zip(items.bounds, items.bounds[1:])]
        rare = np.array([w[np.argmin(counts[w])] if len(w) else -1 for w in each], np.int64)
        by = np.flatnonzero(rare >= 0)
        by = by[np.argsort(rare[by], kind="stable")]
        each = [each[i] for i in by]
        lens = np.array([len(w) for w in each], np.int64)
        return Near(np.searchsorted(rare[by], np.arange(len(items.vocabulary) + 1)), by, np.concatenate([np.empty(0, np.int32), *each]), np.append(0, np.cumsum(lens)), np.full(len(by), span) if span else SPREAD * lens)

    def find(self, terms: np.ndarray, positions: np.ndarray, present: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, start, length) of the first place of each item; present is a scratch array, one false for each term."""
        own = terms[np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]]))]
        count = self.first[own + 1] - self.first[own]
        k = np.repeat(self.first[own], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        if not len(k):
            return
        n = self.bounds[k + 1] - self.bounds[k]
        present[own] = True
        at = np.repeat(self.bounds[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        whole = np.logical_and.reduceat(present[self.words[at]], np.cumsum(n) - n)
        present[own] = False
        for i in k[whole].tolist():
            w = self.words[self.bounds[i] : self.bounds[i + 1]]
            a, b = np.searchsorted(terms, w), np.searchsorted(terms, w, "right")
            if got := cover([positions[x:y] for x, y in zip(a, b)], int(self.span[i])):
                yield int(self.item[i]), *got


def blocks(benchmark: DataFrame, key: str, text: str, most: int) -> Iterator[list[tuple[str, str | None]]]:
    """The test items in blocks of a bounded size, so that any number of them can be searched."""
    block, size = [], 0
    for r in benchmark.select(F.col(key).cast("string"), F.col(text).cast("string")).where(F.col(key).isNotNull()).toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1] or "")
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def term_counts(docs: DataFrame, items: Items) -> np.ndarray:
    """Occurrences of each term over all documents; one row for each term and task is shuffled."""
    vocabulary, n = items.vocabulary, len(items.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for b in batches:
            data, offsets = flat(b.column(1))
            for a, z in chunks(offsets):
                h, _ = tokens(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a], ALNUM_WORDS)
                t = ids(vocabulary, h)
                total += np.bincount(t[t >= 0], minlength=n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["term", "n"])

    out = np.zeros(n, np.int64)
    for r in docs.mapInArrow(tidied("decontaminate", run), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r[0]] = r[1]
    return out


def build_index(docs: DataFrame, items: Items, first: np.ndarray) -> DataFrame:
    """doc_id, row, n_words, and the postings of the document's test words, terms ascending and positions ascending in each;
    none where no term begins a range in `first`."""
    vocabulary, anchor = items.vocabulary, np.diff(first) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = flat(b.column(1))
            for a, z in chunks(offsets):
                h, counts = tokens(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a], ALNUM_WORDS)
                t = ids(vocabulary, h)
                ends = np.cumsum(counts)
                hot = np.flatnonzero((t >= 0) & anchor[t]) if len(anchor) else np.empty(0, np.int64)
                wanted = np.unique(np.searchsorted(ends, hot, "right"))
                terms, positions = [None] * (z - a), [None] * (z - a)
                for d in wanted:
                    own = t[ends[d] - counts[d] : ends[d]]
                    p = np.flatnonzero(own >= 0).astype(np.int32)
                    p = p[np.argsort(own[p], kind="stable")]
                    terms[d], positions[d] = own[p], p
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), b.column(2).slice(a, z - a), pa.array(counts), pa.array(terms, pa.list_(pa.int32())), pa.array(positions, pa.list_(pa.int32()))], names=["doc_id", "row", "n_words", "terms", "positions"])

    return docs.mapInArrow(tidied("decontaminate", run), INDEX)


def match(terms: np.ndarray, positions: np.ndarray, n_words: int, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of every exact occurrence in one document, by intersecting its lists from the rarest term on."""
    count = plan.first[terms + 1] - plan.first[terms]
    if not count.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    place = np.repeat(positions.astype(np.int64), count)
    begin = np.repeat(plan.first[terms], count)
    step = np.arange(len(begin)) - np.repeat(np.cumsum(count) - count, count)
    w = begin + step
    start = place - plan.order[w, 0]
    ok = (start >= 0) & (start + plan.size[w] <= n_words)
    w, start = w[ok], start[ok]
    key = terms.astype(np.int64) << 32 | positions
    for k in range(1, plan.order.shape[1]):
        if not len(w):
            break
        off = plan.order[w, k].astype(np.int64)
        want = plan.words[plan.start[w] + np.maximum(off, 0)].astype(np.int64) << 32 | (start + off)
        at = np.minimum(np.searchsorted(key, want), len(key) - 1)
        ok = (off < 0) | (key[at] == want)
        w, start = w[ok], start[ok]
    return w, start


def hits(index: DataFrame, items: Items, plan: Plan, near: Near) -> DataFrame:
    """doc_id, row, n_words, the items with the merged word ranges that their windows cover (no ranges: empty arrays), and the
    items whose words stand near each other."""
    names, terms_ = items.item, len(items.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present = np.zeros(terms_, bool)
        for b in batches:
            out_i, out_s, out_e, out_n = [], [], [], []
            for n, t, p in zip(b.column(2).to_pylist(), b.column(3), b.column(4)):
                i, s, e, close = [], [], [], []
                if t.is_valid and len(t):
                    t, p = t.values.to_numpy(), p.values.to_numpy()
                    w, start = match(t, p, n, plan)
                    for item in np.unique(plan.item[w]):
                        own = plan.item[w] == item
                        for x, y in union(start[own], start[own] + plan.size[w[own]]):
                            i.append(names[item])
                            s.append(x)
                            e.append(y)
                    close = [names[item] for item, _, _ in near.find(t, p, present)]
                out_i.append(i)
                out_s.append(s)
                out_e.append(e)
                out_n.append(close)
            texts_, ints = pa.list_(pa.string()), pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out_i, texts_), pa.array(out_s, ints), pa.array(out_e, ints), pa.array(out_n, texts_)], names=["doc_id", "row", "n_words", "items", "starts", "ends", "near"])

    return index.mapInArrow(tidied("decontaminate", run), HITS)


def union(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(zip(np.asarray(starts).tolist(), np.asarray(ends).tolist())):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a hash of both, never null: rows that share it have the same hits."""
    return texts(docs).withColumn("row", F.xxhash64("doc_id", "text"))


def phrase_matches(docs: DataFrame, benchmark: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """One DataFrame of hits for each block of test items, each over all documents."""
    docs, out = _rows(docs), []
    for rows in blocks(benchmark, key, text, block_bytes):
        items = Items.of(rows)
        counts = term_counts(docs, items)
        plan = Plan.of(items, counts, window)
        out.append(hits(staged(build_index(docs, items, plan.first), "postings"), items, plan, Near.of(items, counts)))
    if not out:
        items, counts = Items.of([]), np.zeros(0, np.int64)
        plan = Plan.of(items, counts, window)
        out.append(hits(build_index(docs, items, plan.first), items, plan, Near.of(items, counts)))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document: n_words, n_hit (words inside found windows), n_items, their digest, contaminated, and
    n_near (items whose different words stand within SPREAD times their number)."""
    found = phrase_matches(docs, benchmark, window=window, block_bytes=block_bytes)
    all_hits = found[0]
    if len(found) > 1:
        lists = {"items": "array<string>", "starts": "array<int>", "ends": "array<int>", "near": "array<string>"}
        more = None
        for f in found[1:]:
            # rows that share a hash say the same
            f = f.where((F.size("items") > 0) | (F.size("near") > 0)).groupBy("row").agg(*(F.first(c).alias(c) for c in lists))
            more = f if more is None else more.unionByName(f)
        more = more.groupBy("row").agg(*(F.flatten(F.collect_list(c)).alias(f"m_{c}") for c in lists))
        all_hits = all_hits.join(more, "row", "left").select("doc_id", "row", "n_words", *(F.concat(c, F.coalesce(f"m_{c}", F.array().cast(t))).alias(c) for c, t in lists.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_hit, n_items, digest, bad, close = [], [], [], [], []
            for n, i, s, e, c in zip(*(b.column(k).to_pylist() for k in range(2, 7))):
                names = sorted(set(i))
                n_hit.append(sum(y - x for x, y in union(np.array(s), np.array(e))))
                n_items.append(len(names))
                digest.append(hashlib.sha256(",".join(names).encode()).hexdigest())
                bad.append(n_hit[-1] > 0 and 20 * n_hit[-1] >= n)
                close.append(len(set(c)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest, pa.string()), pa.array(bad, pa.bool_()), pa.array(close, pa.int64())], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near"])

    # staged, as a task with two maps keeps two workers, which live on into other operators with caches of their own
    return staged(all_hits, "hits").mapInArrow(tidied("decontaminate", run), RESULT)


def proximity_matches(docs: DataFrame, benchmark: DataFrame, span: int, key: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, start, length: the first place where all words of an item stand within `span` words, in any order."""
    docs, parts = _rows(docs), []
    for rows in blocks(benchmark, key, text, block_bytes):
        items = Items.of(rows)
        near, names, n = Near.of(items, term_counts(docs, items), span), items.item, len(items.vocabulary)

        def run(batches, near=near, names=names, n=n):
            present = np.zeros(n, bool)
            for b in batches:
                out = []
                for doc, t, p in zip(b.column(0).to_pylist(), b.column(3), b.column(4)):
                    if t.is_valid and len(t):
                        out += [(doc, names[i], a, z) for i, a, z in near.find(t.values.to_numpy(), p.values.to_numpy(), present)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.string(), pa.int32(), pa.int32()))], names=["doc_id", "item_id", "start", "length"])

        parts.append(staged(build_index(docs, items, near.first), "postings").mapInArrow(tidied("decontaminate", run), "doc_id long, item_id string, start int, length int"))
    out = parts[0] if parts else docs.sparkSession.createDataFrame([], "doc_id long, item_id string, start int, length int")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cover(lists: list[np.ndarray], span: int) -> tuple[int, int] | None:
    """The first interval of at most span words that has a position of every list."""
    place = np.concatenate(lists)
    which = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    order = np.argsort(place, kind="stable")
    have, missing, left = [0] * len(lists), len(lists), 0
    for i in order:
        have[which[i]] += 1
        missing -= have[which[i]] == 1
        while missing == 0 and have[which[order[left]]] > 1:
            have[which[order[left]]] -= 1
            left += 1
        j = order[left]
        if missing == 0 and place[i] - place[j] < span:
            return int(place[j]), int(place[i] - place[j] + 1)
    return None


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
