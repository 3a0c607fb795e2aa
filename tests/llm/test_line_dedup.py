import random

from tessera.llm import line_dedup
from tests.compare import duck, same

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, line int, gone int"


def near(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k:] == b[k + 1 :] or (len(a) == len(b) and a[k + 1 :] == b[k + 1 :])


def brute(rows):
    seen, out = [], {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        kept = []
        for s in (t.split("\n") if t is not None else []):
            gone = len(s) >= line_dedup.EXACT and (s in {x for x in seen} or len(s) >= line_dedup.NEAR and any(len(x) >= line_dedup.NEAR and near(s, x) for x in seen))
            seen.append(s)
            if not gone:
                kept.append(s)
        out[i] = None if t is None else "\n".join(kept)
    return out


def test_against_brute_force(spark):
    r = random.Random(5)
    base = ["".join(r.choice("abé 漢") for _ in range(r.choice([0, 5, 9, 10, 12, 19, 20, 21, 30, 41]))) for _ in range(30)]
    rows = []
    for i in range(60):
        ls = []
        for _ in range(r.randint(0, 6)):
            s = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                k = r.randrange(len(s) + 1)
                op = r.random()
                if op < 0.3:
                    s.insert(k, r.choice("abx"))
                elif s and op < 0.6:
                    del s[min(k, len(s) - 1)]
                elif s:
                    s[min(k, len(s) - 1)] = r.choice("abx")
            ls.append("".join(s))
        rows.append((i, "\n".join(ls), 1, 1))
    rows += [(100, None, 1, 1), (101, "", 1, 1), (102, "\n\n", 1, 1), (103, "q" * 30000, 1, 1), (104, "q" * 29999, 1, 1)]
    got = {x.doc_id: x.text for x in line_dedup.dedup(spark.createDataFrame(rows, KIND).repartition(4)).collect()}
    assert got == brute(rows)


def test_matches_sql(spark):
    same(line_dedup.op9(spark, SF), duck(SF), line_dedup.SQL)


def test_empty(spark):
    assert line_dedup.dedup(spark.createDataFrame([], KIND)).count() == 0
