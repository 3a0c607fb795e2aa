import hashlib
import random
import re

from tessera.llm import decontaminate as D

KIND = "doc_id long, text string, n_words int"


def words(t):
    return [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))]


def brute(docs, bench):
    out = {}
    for i, t, *_ in docs:
        w = words(t)
        hit, items = set(), set()
        for b, bt, *_ in bench:
            x = words(bt)
            for win in [x[k : k + 13] for k in range(max(1, len(x) - 12))] if x else []:
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        items.add(str(b))
        out[i] = (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def data():
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(40)] + ["É", "naïve", "x9"]
    bench = [(k, " ".join(r.choice(vocab) for _ in range(r.choice([1, 2, 5, 13, 14, 30]))), 1) for k in range(25)] + [(90, None, 1), (91, " - ", 1), (92, "W1 w1 W1", 1), (93, "w1,w1;w1", 1)]
    docs = []
    for i in range(80):
        t = [r.choice(vocab) for _ in range(r.randint(0, 60))]
        if r.random() < 0.5:
            b = words(r.choice(bench)[1])
            a = r.randint(0, max(0, len(b) - 13))
            t += b[a : a + r.randint(10, 30)] + [r.choice(vocab)] * r.randint(0, 300)
        docs.append((i, (r.choice([" ", "\n", ", ", "A-"])).join(t), 1))
    return docs + [(200, None, 1), (201, "", 1), (202, "w1 w1 w1 w1", 1)], bench


def test_against_brute_force_and_blocks(spark):
    docs, bench = data()
    d, b = spark.createDataFrame(docs, KIND).repartition(3), spark.createDataFrame(bench, "item_id long, text string, doc_id int")
    want = brute(docs, bench)
    for block in (D.BLOCK_BYTES, 200):
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in D.contamination(d, b, block_bytes=block).collect()}
        assert got == want


def test_repeated_and_null_ids_over_blocks(spark):
    docs, bench = data()
    docs = [(i if i % 3 else None, t, n) if i % 2 else (7, t, n) for i, t, n in docs] + docs[3:6] + docs[3:6]
    bench = bench + [(None, "w1 w2 w3", 1), (0, bench[1][1], 1)]
    d, b = spark.createDataFrame(docs, KIND).repartition(3), spark.createDataFrame(bench, "item_id long, text string, doc_id int")
    want = sorted(((i, *brute([(0, t, n)], [x for x in bench if x[0] is not None])[0]) for i, t, n in docs), key=str)
    for block in (D.BLOCK_BYTES, 150):
        got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in D.contamination(d, b, block_bytes=block).collect()), key=str)
        assert got == want


def test_near_items_against_brute_force(spark):
    docs, bench = data()
    d, b = spark.createDataFrame(docs, KIND).repartition(3), spark.createDataFrame(bench, "item_id long, text string, doc_id int")

    def near(text, item):
        w, x = words(text), set(words(item))
        n = D.SPREAD * len(x)
        return bool(x) and any(x <= set(w[k : k + n]) for k in range(max(1, len(w) - n + 1)))

    want = {i: sum(near(t, x) for _, x, _ in bench) for i, t, _ in docs}
    assert any(want.values())
    for block in (D.BLOCK_BYTES, 200):
        assert {r.doc_id: r.n_near for r in D.contamination(d, b, block_bytes=block).collect()} == want


def test_the_plan_stays_in_proportion():
    """What is sent for a block is bounded by its bytes of text."""
    import pickle

    import numpy as np

    r = random.Random(1)
    rows = [(str(i), " ".join(f"w{r.randrange(5000)}" for _ in range(100))) for i in range(2000)]
    items = D.Items.of(rows)
    counts = np.ones(len(items.vocabulary), np.int64)
    sent = sum(len(pickle.dumps(x)) for x in (items.vocabulary, items.item, D.Plan.of(items, counts, 13), D.Near.of(items, counts)))
    assert sent < 7 * sum(len(t) for _, t in rows)


def test_proximity(spark):
    d = spark.createDataFrame([(1, "a x b y c", 1), (2, "c b q q q q a", 1), (3, None, 1)], KIND)
    b = spark.createDataFrame([(7, "a b c", 0), (8, "zz", 0), (9, "q a", 0)], "item_id long, text string, z int")
    got = {(r.doc_id, r.item_id, r.start, r.length) for r in D.proximity_matches(d, b, 5).collect()}
    assert got == {(1, "7", 0, 5), (2, "9", 5, 2)}


def test_empty(spark):
    d, b = spark.createDataFrame([], KIND), spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(d, b).count() == 0
    (r,) = D.contamination(spark.createDataFrame([(1, "a", 1)], KIND), b).collect()
    assert (r.n_words, r.n_hit, r.contaminated) == (1, 0, False)


def test_no_task_needs_two_workers(spark):
    """Two maps in one task keep two Python workers, which the operators after this one fill as well."""
    docs = spark.createDataFrame([(1, "some words of a text")], "doc_id long, text string")
    items = spark.createDataFrame([("a", "words of"), ("b", "other words")], "item_id string, text string")
    plan = D.contamination(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1, plan
