import hashlib
import random

import numpy as np

from tessera.llm import suffixes


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for i, b in enumerate(raw):
        for p in range(len(b) - length + 1):
            seen.setdefault(b[p : p + length], []).append((i, p))
    gone = [np.zeros(len(b) + 1, bool) for b in raw]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                gone[i][p : p + length] = True
    out = []
    for b, g in zip(raw, gone):
        runs = int(np.sum(np.diff(np.concatenate([[0], g[:-1].astype(int), [0]])) == 1))
        kept = bytes(x for x, y in zip(b, g) if not y)
        out.append((len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


def cases(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcé \n") for _ in range(r.randint(0, 400))) for _ in range(12)]
    out = [None, "", "x", "ab" * 300, "a" * 250, "a" * 199]
    for _ in range(40):
        t = "".join(b[r.randint(0, len(b)) :][: r.randint(0, 300)] if (b := r.choice(base)) and r.random() < 0.7 else "".join(r.choice("abc") for _ in range(r.randint(0, 60))) for _ in range(r.randint(1, 4)))
        out.append(t)
    out += [out[8], out[9], out[9] + "z", "y" + out[9]]
    return out


def check(spark, texts, length, hot):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, a string, n int").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans) // 2, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffixes.remove(df, length, hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, length)


def test_against_brute_force(spark):
    check(spark, cases(1), 200, suffixes.HOT)
    check(spark, cases(2), 40, suffixes.HOT)


def test_hot_minimizers(spark):
    check(spark, cases(3), 50, 1)


def test_null_and_repeated_ids(spark):
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    shared, other, third = word(200), word(300), word(260)
    own = [word(n) for n in (50, 70, 70, 90, 90, 400, 400)]
    rows = [(None, own[0] + shared), (1, shared + own[3]), (None, own[5]), (None, own[5]), (None, own[1] + other), (4, other[40:260] + own[4]), (7, own[2] + third), (7, own[6][:330]), (8, third[20:240]), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((x.doc_id, x.n_bytes, x.n_bytes - len(x.kept), len(x.spans) // 2, hashlib.sha256(bytes(x.kept)).hexdigest()) for x in suffixes.remove(df).collect()), key=str)
    assert got == sorted(((i, *b) for (i, _), b in zip(rows, brute([t for _, t in rows], 200))), key=str)


def test_refinement_alone():
    """Suffix buckets against counting, on periodic, random and near-equal texts, in pieces of one bucket and of many."""
    r = random.Random(8)
    for length in (5, 8, 9, 20, 64):
        for trial in range(6):
            alphabet = "ab" if trial % 2 else "abcdefgh"
            rows = ["".join(r.choice(alphabet) for _ in range(r.randint(length, 3 * length))) for _ in range(6)] + ["ab" * length, "a" * (2 * length)]
            rows += [rows[0][3:] + "x" * length, "y" * 3 + rows[1], rows[2]]
            given = [(t.encode(), len(t) - length + 1) for t in rows if len(t) >= length]
            count = {}
            for raw, n in given:
                for i in range(n):
                    count[raw[i : i + length]] = count.get(raw[i : i + length], 0) + 1
            for piece in (1, 50, 1 << 16):
                suffixes.PIECE, kept = piece, suffixes.PIECE
                try:
                    got = suffixes.compare(given, length)
                finally:
                    suffixes.PIECE = kept
                for (raw, n), runs in zip(given, got):
                    hit = {i for a, b in zip(runs[::2], runs[1::2]) for i in range(a, b)}
                    assert hit == {i for i in range(n) if count[raw[i : i + length]] > 1}


def test_empty(spark):
    assert suffixes.remove(spark.createDataFrame([], "doc_id long, text string")).count() == 0
