import random
import re

from tessera.llm import ngram_join

KIND = "doc_id long, text string, node string, n_shingles int"


def brute(rows):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= 75 * len(sets[x] | sets[y]):
                    a, b = root(x), root(y)
                    parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed, n=260):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["É", "the", "The"]
    passage = [r.choice(words) for _ in range(40)]
    out = []
    for i in range(n):
        kind = r.random()
        if out and kind < 0.6:
            t = list(r.choice(out)[1].split(" ")) if r.random() < 0.6 else list(out[0][1].split(" "))
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
                if t:
                    t[r.randrange(len(t))] = r.choice(words)
        else:
            t = [r.choice(words) for _ in range(r.choice([1, 3, 4, 5, 6, 20, 60, 120]))]
            if r.random() < 0.3:
                t = t + passage
        out.append((i * 2 + 1, " ".join(t), "x", 1))
    return out + [(9001, None, "x", 1), (9002, "", "x", 1), (9003, " \n ", "x", 1), (9004, "a b", "x", 1), (9005, "A\tb", "x", 1)]


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(spark.createDataFrame(rows, KIND).repartition(5)).collect()}
        assert got == brute(rows)


def test_empty(spark):
    assert ngram_join.join(spark.createDataFrame([], KIND)).count() == 0


def near_copies(seed, n=250):
    """One group of near copies of a passage, most of them linked with most others, among other texts."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(60)]
    out = []
    for i in range(n):
        t = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            t[r.randrange(len(t))] = f"x{r.randrange(10_000)}"
        out.append((i, " ".join(t), "x", 1))
    return out + [(n + i, " ".join(f"o{r.randrange(400)}" for _ in range(30)), "x", 1) for i in range(50)]


def test_large_group_in_blocks(spark, monkeypatch):
    rows = near_copies(3)
    want = brute(rows)
    df = spark.createDataFrame(rows, KIND).repartition(6)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df).collect()} == want
    # lists are salted and split, with the sizes of the fixture
    monkeypatch.setattr(ngram_join, "SALTED", 20)
    monkeypatch.setattr(ngram_join, "BLOCK", 30)
    for turns in (2,):
        monkeypatch.setattr(ngram_join, "TURNS", turns)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df).collect()} == want


def test_odd_sketches_never_exceed_the_difference():
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(5)
    pool = r.integers(0, 2**63, 3000, dtype=np.uint64)
    sets = [np.sort(r.choice(pool, n, replace=False)) for n in (5, 40, 64, 65, 100, 129, 300, 700, 900, 1025)]
    doc, s, size = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets), np.array([len(x) for x in sets])
    data, at = ngram_join.sketches(doc, s, size)
    n = len(sets)
    zero = pa.array(np.zeros(n, np.int64))
    t = pa.table({"node": zero, "size": pa.array(size), "matches": zero, "place": zero, "label": zero, "sketch": pa.array([data[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())})
    e = ngram_join.Entries(t, np.zeros(n, np.int64))
    pairs = [(i, j) for i in range(n) for j in range(n) if size[i] <= size[j] and e.words[j] in (e.words[i], 2 * e.words[i])]
    i, j = map(np.array, zip(*pairs))
    odd = e._odd(i, j)
    for a, b, d in zip(i, j, odd):
        assert d <= len(np.setxor1d(sets[a], sets[b])) and (a != b or d == 0)


def test_shared_passages_and_repeated_rows(spark):
    """A long passage in many texts, equal rows, null and repeated ids."""
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(i, f"{passage} " + " ".join(f"o{i}x{k}" for k in range(12 + i % 9)), "x", 1) for i in range(150)]
    rows += [(5, rows[5][1], "x", 1), (None, rows[7][1], "x", 1), (None, "alone in the world of words", "x", 1), (700, passage, "x", 1), (701, passage.upper(), "x", 1)]
    got = ngram_join.join(spark.createDataFrame(rows, KIND).repartition(5)).collect()
    assert len(got) == len(rows)
    want = brute([r for r in rows if r[0] is not None])
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == sorted([str(want[7][1]), "None"])


def shuffled(spark):
    """The shuffle files that lie on this machine's disk."""
    import glob

    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in dirs for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}


def test_shuffle_files_go_as_soon_as_a_table_is_staged(spark):
    from tessera.sources.stage import CLEANUP, staged

    before, at = spark.conf.get(CLEANUP, None), shuffled(spark)
    plain = spark.range(20_000).repartition(3)
    staged(plain, "plain")
    assert shuffled(spark) - at
    at = shuffled(spark)
    out = ngram_join.kept(spark.range(20_000).repartition(5), "rows")
    assert not shuffled(spark) - at and out.count() == 20_000
    assert spark.conf.get(CLEANUP, None) == before


def test_wide_sketches_only_of_sets_that_are_asked_for(spark):
    """Before, they were staged with every document."""
    import numpy as np
    from pyspark.sql import functions as F

    from tessera.llm.arrow import texts

    docs = texts(spark.createDataFrame(near_copies(5, 40), KIND)).withColumn("text_key", F.xxhash64("text"))
    keys = ngram_join.set_keys(docs)
    assert "wide" not in keys.columns
    some = keys.where("doc_id in (3, 60)").select("node").distinct()
    got = {r.node: bytes(r.sketch) for r in ngram_join.wide_shapes(docs, keys, some, 5).collect()}
    assert set(got) == {r.node for r in some.collect()}
    data, at = zip(*[(t.encode(), len(t.encode())) for i, t, *_ in near_copies(5, 40) if i in (3, 60)])
    doc, s, size = ngram_join.sets(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum(at)]), 5)
    bits, ends = ngram_join.sketches(doc, s, size, ngram_join.WIDE)
    node = ngram_join.nodes(doc, s, size)[0].view(np.int64)
    assert got == {int(n): bits[a:z].tobytes() for n, a, z in zip(node, ends, ends[1:])}
