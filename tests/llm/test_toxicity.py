import numpy as np
from pyspark.sql import functions as F

from tessera.llm import toxicity as T

SF = "/root/testdata/sf0.1"


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = T.op4(spark, SF).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out")
    rows = got.select("score", "predicted", "toxic").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.95
    bad, good = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    auc = sum((a > b) + 0.5 * (a == b) for a in bad for b in good) / (len(bad) * len(good))
    assert auc > 0.95
    assert docs.count() == T.op4(spark, SF).count()


def test_gaps_and_insertions():
    bag = ["idiot", "moron", "stupid", "scum", "loser"]
    fill = "the of and lower water other matter within number people idea union motion studio summer".split()
    samples = [(f"{fill[i % 15]} {bag[i % 5]} {fill[(i * 7) % 15]}", 1) for i in range(60)] + [(f"{fill[i % 15]} {fill[(i * 4) % 15]} {fill[(i * 11) % 15]}", 0) for i in range(120)]
    m = T.train(samples)

    def score(s):
        letters, starts, _ = T.words(*T._points([s]))
        x = T.word_scores(letters, starts, m["weights"])
        return m["slope"] * max([0, *x]) + m["offset"]

    clean = max(score(w) for w in fill)
    for s in ("you i.d.i.o.t there", "i d i o t", "idi*ot", "mo-ron", "stuupid", "SCUM!", "loserr"):
        assert score(s) > clean, s
    assert score("") <= clean


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "a b 😀", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (7, 1), (3, None)], "doc_id long, toxic int")
    rows = T.score(df, T.fit(df, labels)).collect()
    assert len(rows) == 3 and all(0 <= r.score <= 1 for r in rows)
    assert T.score(df.limit(0), T.train([])).count() == 0
    assert T.sample(df, labels.where(F.lit(False))) == []


def plain_kernel(x, y):
    """The subsequence kernel of two words by enumeration, with the marks at their ends."""

    def features(w):
        out, s = {}, f"<{w}>"
        for i in range(len(s)):
            for k in range(i + 2, min(len(s), i + T.SPAN)):
                for j in range(i + 1, k):
                    out[s[i] + s[j] + s[k]] = out.get(s[i] + s[j] + s[k], 0) + T.DECAY ** (k - i + 1)
        return out, sum(T.DECAY ** (2 * (k - i + 1)) for i in range(len(s)) for k in range(i + 2, min(len(s), i + T.SPAN)) for _ in range(i + 1, k)) ** 0.5

    (a, na), (b, nb) = features(x), features(y)
    return sum(v * b.get(t, 0) for t, v in a.items()) / (na * nb)


def test_folded_scorer_is_the_kernel():
    marks, coefs = ["idiot", "stupid", "aaaa", "loser"], [1.5, -2.0, 0.7, 3.0]
    probe = ["idiot", "idddiot", "losers", "aaaaaaa", "xyz", "stupidity"]
    rows = T.Words(marks).rows(np.arange(len(marks)))
    folded = sum(b * rows.weights(i) for i, b in enumerate(coefs))
    got = T.Words(probe).score(folded)
    want = [sum(b * plain_kernel(m, w) for m, b in zip(marks, coefs)) for w in probe]
    assert np.allclose(got, want, rtol=1e-5)


def test_texts_are_judged_by_their_different_words():
    bag, fill = ["idiot", "moron", "stupid"], "the of and lower water other matter within number people idea union".split()
    samples = [(f"{fill[i % 12]} {bag[i % 3]} {fill[(i * 7) % 12]}", 1) for i in range(60)] + [(f"{fill[i % 12]} {fill[(i * 5) % 12]} {fill[(i * 11) % 12]}", 0) for i in range(120)]
    m = T.train(samples)
    strings = ["water idiot", "water idiot " * 3, "", "of water", "of water people", " ".join(f"Idea{chr(97 + i % 26)} water" for i in range(30_000)), "no"]
    one = [float(T.probabilities([s], m)[0]) for s in strings]
    assert np.allclose(T.probabilities(strings, m), one) and one[0] == one[1] and one[2] == one[6]
    assert one[0] > 0.5 > one[4]
    brute = []
    for s in strings:
        values = [float(T.Words([w]).score(m["weights"])[0]) + m["bias"] for w in {w for w in T._split(s) if len(w) > 2}]
        x = T._features(np.array(values))
        x[-1] = np.clip(x[-1], *m["lengths"])
        brute.append(1 / (1 + np.exp(-(x @ m["by"] + m["offset"]))))
    assert np.allclose(one, brute)


def test_sample_is_bounded_and_repeated_rows_count_once(spark):
    docs = spark.createDataFrame([(i, f"word{i} same text", "x") for i in range(200)] + [(5, "another text", "y"), (5, "word5 same text", "z"), (None, "lost", "n")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(5, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    rows = T.sample(docs, labels, most=20)
    assert len(rows) == 40 and len(set(rows)) == 40 and T.sample(docs.repartition(7), labels, most=20) == rows
    small = T.sample(docs, labels, most=20, room=100)
    assert sum(len(w) for w, _ in small) <= 100 and {y for _, y in small} == {0, 1}
    assert T.score(docs, T.fit(docs, labels)).count() == docs.count()
    assert all(r.score < 1e-9 for r in T.score(docs, T.fit(docs, labels.limit(0))).collect())
