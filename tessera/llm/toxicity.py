"""Toxicity: a support vector machine over a subsequence string kernel with Nystroem landmarks.

The kernel of two words sums, over all triples of letters that both hold as subsequences, the product of decay^span of
their occurrences (spans up to `SPAN` letters), so that gaps and inserted characters lower a match but don't end it.
Letters are lower-cased, punctuation is skipped, runs of single letters set apart by spaces are read as one word, and
every word has a mark at its begin and its end, which count as letters; words of one or two letters don't count.

A text's probability is logistic in the machine's values of its `WORST` worst different words and in the logarithm of
how many different words it has (the worst of many is higher by chance), the latter held to the range seen in training.

Training takes at most `MAX_TRAIN` labelled texts of either class, of at most `MAX_BYTES` of different words together
(documented bounds; texts beyond them are passed over in the order of a hash of doc_id), reduced to their different
words on the executors. Words that toxic texts hold far more often than chance has it are guilty, and so is the word of
each toxic text that the machine of the round before found worst. As the Nystroem model is linear in the landmarks'
subsequences, it folds into one weight for each letter triple, a table of fixed size that is broadcast; scoring is a map
over the documents in numpy, each different word of a chunk once.

Null and empty texts get the score of a text without words. Labels that are null, or without a text, are left out;
of several texts with one labelled doc_id one is learnt from. Without labels of both classes every text scores next to 0. Copies
score alike; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.arrow import chunks, small, texts, tidied, trim
from tessera.llm.words import BYTE, POWER, mix
from tessera.sources.stage import staged

LETTERS = 80
FIRST, LAST = 78, 79
SPAN = 6
DECAY = 0.7
MAX_TRAIN = 3000
MAX_BYTES = 24_000_000
SURE = 16.0
WORST = 3
FLOOR = -2.0  # value of the words that a text lacks
LANDMARKS = 150
NEGATIVES = 6_000
ROUNDS = 5
RESULT = "doc_id long, score double, predicted int"
PAIRS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def _classes() -> np.ndarray:
    """Letter class of each code point below 65536: 0 skipped, 1 space, 2.. letters; more code points share classes."""
    t = np.zeros(65536, np.uint8)
    for c in range(65536):
        s = chr(c)
        if s.isspace():
            t[c] = 1
        elif s.isalnum():
            low = s.lower()[0]
            if "a" <= low <= "z":
                t[c] = 2 + ord(low) - 97
            elif "0" <= low <= "9":
                t[c] = 28 + ord(low) - 48
            elif 0xDF <= ord(low) < 0x100:
                t[c] = 38 + ord(low) - 0xDF
            else:
                t[c] = 71 + ord(low) % 9
    return t


CLASS = _classes()
# sum of squared weights of all triples of a word of each length: the kernel's normalizer
NORM = np.array([max(1e-9, sum(max(0, n - b) * DECAY ** (2 * (b + 1)) for a, b in PAIRS)) ** 0.5 for n in range(256)])


def words(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all words on end, the words' starts, and each word's text; from code points and the texts' offsets."""
    c = np.where(points < 65536, CLASS[points & 0xFFFF], 0)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    kept = c > 0
    c, doc = c[kept], doc[kept]
    if not len(c):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.empty(len(c) + 1, bool)  # a text begins here
    edge[0] = edge[-1] = True
    edge[1:-1] = doc[1:] != doc[:-1]
    space = c == 1
    # a letter that stands alone: spaces or edges on both sides
    before = np.empty(len(c), bool)
    before[0] = True
    before[1:] = space[:-1]
    before |= edge[:-1]
    after = np.empty(len(c), bool)
    after[-1] = True
    after[:-1] = space[1:]
    after |= edge[1:]
    alone = ~space & before & after
    joint = np.zeros(len(c), bool)
    joint[1:-1] = space[1:-1] & alone[:-2] & alone[2:] & ~edge[1:-2] & ~edge[2:-1]
    kept = ~joint
    c, doc, space = c[kept], doc[kept], space[kept]
    begin = ~space
    begin[1:] &= space[:-1] | (doc[1:] != doc[:-1])
    letters = np.flatnonzero(~space)
    starts = np.searchsorted(letters, np.flatnonzero(begin))
    # every word begins and ends with a mark, so that the kernel sees where in a word letters stand
    n, lens = len(letters), np.diff(np.append(starts, len(letters)))
    out = np.full(n + 2 * len(starts), LAST, np.int64)
    rank = np.repeat(np.arange(len(starts)), lens)
    out[np.arange(n) + 2 * rank + 1] = c[letters].astype(np.int64) - 2
    starts = starts + 2 * np.arange(len(starts))
    out[starts] = FIRST
    return out, starts, doc[np.flatnonzero(begin)]


def triples(letters: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(places, triple ids, weight) of each offset pair, within words."""
    n = len(letters)
    room = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n))) - np.arange(n)
    for a, b in PAIRS:
        at = np.flatnonzero(room > b)
        yield at, (letters[at] * LETTERS + letters[at + a]) * LETTERS + letters[at + b], DECAY ** (b + 1)


def word_scores(letters: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.empty(0)
    total = np.zeros(len(letters), np.float64)
    for at, ids, w in triples(letters, starts):
        total[at] += weights[ids] * w
    lens = np.minimum(np.diff(np.append(starts, len(letters))), 255)
    return np.add.reduceat(total, starts) / NORM[lens]


class Words:
    """Words of the training sample, scored on end, and the sparse rows over letter triples of some of them."""

    def __init__(self, vocabulary: list[str]):
        self.letters, self.starts, self.doc = words(*_points(vocabulary))
        self.n, self.ends = len(vocabulary), np.append(self.starts, len(self.letters))

    def score(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        out[self.doc] = word_scores(self.letters, self.starts, weights)
        return out

    def rows(self, which: np.ndarray) -> Rows:
        at = np.searchsorted(self.doc, which)
        lens = self.ends[at + 1] - self.ends[at]
        starts = np.cumsum(lens) - lens
        take = np.repeat(self.ends[at] - starts, lens) + np.arange(lens.sum())
        return Rows(self.letters[take], starts)


class Rows:
    def __init__(self, letters: np.ndarray, starts: np.ndarray):
        lens = np.diff(np.append(starts, len(letters)))
        word = np.repeat(np.arange(len(starts)), lens)
        row, col, val = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        for at, ids, w in triples(letters, starts):
            row.append(word[at])
            col.append(ids)
            val.append(w / NORM[np.minimum(lens[word[at]], 255)])
        self.n, row, col, val = len(starts), np.concatenate(row), np.concatenate(col), np.concatenate(val)
        order = np.argsort(row, kind="stable")
        self.row, self.col, self.val = row[order], col[order], val[order]
        self.bounds = np.searchsorted(self.row, np.arange(self.n + 1))

    def weights(self, i: int) -> np.ndarray:
        out = np.zeros(LETTERS**3, np.float32)
        s = slice(self.bounds[i], self.bounds[i + 1])
        np.add.at(out, self.col[s], self.val[s])
        return out

    def apply(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.col] * self.val, self.n) if len(self.row) else np.zeros(self.n)


def _points(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lens = np.array([len(s) for s in strings], np.int64)
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum(lens)])


def train(samples: Iterable[tuple[str, int]], seed: int = 7) -> dict:
    """The model of labelled texts: triple weights, and the slope and intercept of its probability."""
    return learn(((" ".join(sorted(_split(t))), y) for t, y in samples), seed)


def learn(samples: Iterable[tuple[str, int]], seed: int = 7) -> dict:
    """The same of each text's distinct words, separated by blanks. Equal sets of words with equal labels count once."""
    rng = np.random.default_rng(seed)
    place: dict[str, int] = {}
    seen: set[bytes] = set()
    bags: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
    for t, y in samples:
        own = np.array(sorted(place.setdefault(w, len(place)) for w in t.split() if len(w) > 2), np.int32)
        key = hashlib.blake2b(own.tobytes(), digest_size=12, salt=b"01"[int(y) :][:1]).digest()
        if key not in seen:
            seen.add(key)
            bags[int(y)].append(own)
    neg, pos = bags
    if not pos or not neg:
        return {"weights": np.zeros(LETTERS**3, np.float32), "bias": 0.0, "by": np.zeros(WORST + 1), "lengths": (0.0, 0.0), "slope": 0.0, "offset": -800.0}
    in_pos, in_neg = (np.bincount(np.concatenate(b), minlength=len(place)).astype(float) for b in (pos, neg))
    f = Words(list(place))
    held = np.where(in_neg > 0, in_neg, in_pos)  # texts that hold a word
    strong = _strong(in_pos, in_neg, len(pos), len(neg))
    clean = (in_neg > 0) & ~strong
    suspects = [own[~clean[own]] for own in pos]
    guilty = strong.copy()
    if not guilty.any():
        odds = np.log((in_pos + 0.1) / (in_neg * len(pos) / len(neg) + 0.5))
        for own in pos:
            if len(own):
                guilty[own[np.argmax(odds[own])]] = True
    negatives = np.flatnonzero(clean)
    pool = rng.choice(negatives, min(NEGATIVES, len(negatives)), replace=False)
    weights, bias = None, 0.0
    for k in range(ROUNDS):
        weights, bias = _machine(f, np.flatnonzero(guilty), pool, held, rng)
        s = f.score(weights) + bias
        pool = np.union1d(pool, negatives[np.argsort(-s[negatives])[:1000]])
        if k < ROUNDS - 1:
            fresh = np.full(len(place), False)
            for own in suspects:
                if len(own):
                    fresh[own[np.argmax(s[own])]] = True
            guilty = strong | fresh & (s > -0.5) | guilty & (s > -0.9)
            if not guilty.any():
                break
    x = np.array([_features(s[own]) for own in pos + neg])
    y = np.array([1.0] * len(pos) + [0.0] * len(neg))
    lo, hi = float(x[:, -1].min()), float(x[:, -1].max())
    by, offset = _logistic(x, y)
    return {"weights": weights.astype(np.float32), "bias": bias, "by": by, "lengths": (lo, hi), "slope": float(by[0]), "offset": offset}


def _features(values: np.ndarray) -> np.ndarray:
    """The highest values of a text's words, and the logarithm of their number."""
    worst = np.full(WORST, FLOOR)
    top = np.sort(values)[::-1][:WORST]
    worst[: len(top)] = np.maximum(top, FLOOR)
    return np.append(worst, np.log1p(len(values)))


def _strong(in_pos: np.ndarray, in_neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Words that toxic texts hold far more often than chance has it: by the log-likelihood ratio, and twenty times the rate."""
    n = in_pos + in_neg
    share = n_pos / (n_pos + n_neg)
    both = in_pos * np.log(np.maximum(in_pos, 1e-9) / (n * share)) + in_neg * np.log(np.maximum(in_neg, 1e-9) / (n * (1 - share)))
    return (2 * both >= SURE) & (in_pos / n_pos >= 20 * in_neg / n_neg)


def _machine(f: Words, bad: np.ndarray, good: np.ndarray, held: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Landmarks, Nystroem features, and a linear machine with squared hinge loss; folded into triple weights."""
    r, guilty = f.rows(np.concatenate([bad, good])), f.rows(bad)
    often = np.argsort(-held[bad], kind="stable")[: LANDMARKS // 3]
    marks = np.concatenate([np.union1d(often, _spread(guilty, LANDMARKS // 3, rng)), len(bad) + rng.choice(len(good), min(LANDMARKS // 3, len(good)), replace=False)])
    k = np.stack([r.apply(r.weights(i)) for i in marks], axis=1)
    km = k[marks]
    val, vec = np.linalg.eigh((km + km.T) / 2)
    ok = val > 1e-6 * val.max()
    fold = vec[:, ok] / np.sqrt(val[ok])
    z = np.hstack([k @ fold, np.ones((r.n, 1))])
    y = np.where(np.arange(r.n) < len(bad), 1.0, -1.0)
    c = 200 * np.concatenate([held[bad] / held[bad].sum(), 4 * (1 + np.log(held[good])) / len(good)])
    w = np.zeros(z.shape[1])
    reg = np.eye(z.shape[1])
    reg[-1, -1] = 1e-3
    for _ in range(30):  # Newton on the active set
        act = y * (z @ w) < 1
        za = z[act]
        new = np.linalg.solve(reg + za.T @ (za * c[act, None]), za.T @ (c[act] * y[act]))
        done = np.allclose(new, w, atol=1e-6)
        w = new
        if done:
            break
    out = np.zeros(LETTERS**3)
    for i, b in zip(marks, fold @ w[:-1]):
        at = slice(r.bounds[i], r.bounds[i + 1])
        np.add.at(out, r.col[at], b * r.val[at])
    return out, float(w[-1])


def _spread(r: Rows, n: int, rng: np.random.Generator) -> np.ndarray:
    """Landmarks far from each other: each next one is the word least like those chosen."""
    if r.n <= n:
        return np.arange(r.n)
    picked = [int(rng.integers(r.n))]
    near = r.apply(r.weights(picked[0]))
    while len(picked) < n:
        picked.append(int(np.argmin(near)))
        near = np.maximum(near, r.apply(r.weights(picked[-1])))
    return np.array(picked)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients and offset of the probability; no value of a word may lower it, nor a smaller number of words."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    middle, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.hstack([(x - middle) / spread, np.ones((len(x), 1))])
    sign = np.array([1.0] * WORST + [-1.0])
    used = np.full(x.shape[1] + 1, True)
    while True:
        w = np.zeros(z.shape[1])
        zs = z[:, used]
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = np.maximum(p * (1 - p), 1e-9)
            d = np.linalg.solve((zs * h[:, None]).T @ zs + 1e-2 * np.eye(zs.shape[1]), zs.T @ (p - target) + 1e-2 * w[used])
            w[used] -= d / max(1, np.abs(d).max() / 2)
            if np.abs(d).max() < 1e-6:
                break
        wrong = used.copy()
        wrong[:-1] &= w[:-1] * sign < 0
        wrong[-1] = False
        if not wrong.any():
            by = w[:-1] / spread
            return by, float(w[-1] - by @ middle)
        used &= ~wrong


_SKIPPED = re.compile("[^\\w\\s]|_|[\U00010000-\U0010ffff]")
_RUNS = re.compile(r"(?<!\S)\S(?: \S)+(?!\S)")


def _split(text: str) -> set[str]:
    """The words of one text as the scorer reads them."""
    text = _SKIPPED.sub("", text).lower()
    return set(_RUNS.sub(lambda m: m[0].replace(" ", ""), text).split())


def sample(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, room: int = MAX_BYTES) -> list[tuple[str, int]]:
    """(different words, label) of at most `most` labelled training texts of either class, in the order of a hash of
    doc_id; a text whose words don't fit into what is left of its class's half of `room` bytes is passed over."""
    rows = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).distinct()
    picked = None
    for y in (0, 1):
        part = rows.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 200):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([" ".join(sorted(w for w in _split(t.as_py()) if len(w) > 2)) for t in b.column(2)], pa.string())], names=["doc_id", "toxic", "words"])

    # at most 2 * most rows of two integers
    found = texts(docs).where("text is not null").join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", "text").mapInArrow(tidied("toxicity", run), "doc_id long, toxic int, words string")
    found = staged(found.groupBy("doc_id", "toxic").agg(F.min("words").alias("words")), "sample")
    out = []
    for y in (0, 1):
        left = room // 2
        for r in found.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").select("words").toLocalIterator():
            if len(r.words) <= left:
                left -= len(r.words)
                out.append((r.words, y))
    return out


def distinct(letters: np.ndarray, starts: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The letters and starts of the different words, and (text, number of the word) of the different words of each text."""
    lens = np.diff(np.append(starts, len(letters)))
    place = np.arange(len(letters)) - np.repeat(starts, lens)
    h = mix(np.add.reduceat(BYTE[letters] * POWER[place % len(POWER)] + (place // len(POWER)).astype(np.uint64), starts) + lens.astype(np.uint64))
    long = lens > 4
    h, starts, doc, lens = h[long], starts[long], doc[long], lens[long]
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    pairs = np.unique(doc.astype(np.int64) * max(1, len(first)) + number)
    own = lens[first]
    begin = np.cumsum(own) - own
    take = np.repeat(starts[first] - begin, own) + np.arange(own.sum())
    return letters[take], begin, pairs // max(1, len(first)), pairs % max(1, len(first))


def probabilities(strings: list[str], model: dict) -> np.ndarray:
    """The score of each text."""
    n = len(strings)
    x = np.full((n, WORST + 1), FLOOR)
    x[:, -1] = 0
    letters, starts, doc = words(*_points(strings))
    if len(starts):
        letters, starts, doc, number = distinct(letters, starts, doc)
        s = np.maximum(word_scores(letters, starts, model["weights"])[number] + model["bias"], FLOOR) if len(starts) else np.empty(0)
        order = np.lexsort((-s, doc))
        count = np.bincount(doc, minlength=n)
        place = np.arange(len(order)) - np.repeat(np.cumsum(count) - count, count)
        top = place < WORST
        x[doc[order[top]], place[top]] = s[order[top]]
        x[:, -1] = np.log1p(count)
    x[:, -1] = np.clip(x[:, -1], *model["lengths"])
    return 1 / (1 + np.exp(-np.clip(x @ model["by"] + model["offset"], -700, 700)))


def _scores(column: pa.Array, model: dict) -> np.ndarray:
    lens = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
    return np.concatenate([np.empty(0), *(probabilities([t or "" for t in column.slice(a, z - a).to_pylist()], model) for a, z in chunks(bounds, 1 << 19))])


def clean(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text scores under 0.5."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield b.filter(pa.array(_scores(b.column(at).cast(pa.string()), model) < 0.5))

    return docs.mapInArrow(tidied("toxicity", run), docs.schema)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score, predicted of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            p = _scores(b.column(1), model)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return texts(docs).mapInArrow(tidied("toxicity", run), RESULT)


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    model = learn(sample(docs, labels))
    trim()
    return model


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return score(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")
