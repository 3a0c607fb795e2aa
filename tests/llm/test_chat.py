import random

import duckdb

from tessera.llm import chat
from tests.compare import duck, same

SF = "/root/testdata/sf0.001"


def test_matches_sql(spark):
    same(chat.op8(spark, SF), duck(SF), chat.SQL)


def test_trees(spark):
    rows = [
        (1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 2.0), (1, 4, 3, "user", "c", 0.5), (1, 5, 4, "assistant", None, 0.0),
        (2, 1, 9, "user", "orphan", None), (3, 1, 2, "user", "x", 0.0), (3, 2, 1, "user", "circle", 0.0), (4, 1, None, None, "\\<s></s>[INST][/INST]\\s", 0.0),
    ]
    df = spark.createDataFrame(rows, "conv_id long, id long, parent long, role string, text string, score double")
    got = {(r.conv_id, r.leaf): ([(t.role, t.text) for t in r.turns], list(r.loss_texts), r.rank) for r in chat.read_back(chat.format_paths(df, keep=5)).collect()}
    assert got == {
        (1, 2): ([("user", "q"), ("assistant", "a")], ["a"], 2),
        (1, 5): ([("user", "q"), ("assistant", "b"), ("user", "c"), ("assistant", "")], ["b", ""], 1),
        (2, 1): ([("user", "orphan")], [], 1),
        (4, 1): ([("", "\\<s></s>[INST][/INST]\\s")], [], 1),
    }
    assert {(r.conv_id, r.leaf) for r in chat.format_paths(df, keep=1).collect()} == {(1, 5), (2, 1), (4, 1)}


def test_null_conversation(spark, tmp_path):
    rows = [(None, 1, None, "user", "q", 0.0), (None, 2, 1, "assistant", "a", 1.0), (None, 3, 1, "assistant", "b", 2.0), (None, 4, 3, "user", "c", 0.5), (0, 1, None, "user", "zero", 0.0), (0, 2, 1, "assistant", "none", 0.0)]
    df = spark.createDataFrame(rows, "conv_id long, id long, parent long, role string, text string, score double")
    got = {(r.conv_id, r.leaf, r.rank): [t.text for t in r.turns] for r in chat.read_back(chat.format_paths(df, keep=5)).collect()}
    assert got == {(None, 2, 2): ["q", "a"], (None, 4, 1): ["q", "b", "c"], (0, 2, 1): ["zero", "none"]}
    assert {(r.conv_id, r.leaf, r.place, r.id) for r in chat.paths(df, keep=1).collect()} == {(None, 4, 0, 1), (None, 4, 1, 3), (None, 4, 2, 4), (0, 2, 0, 1), (0, 2, 1, 2)}
    conversations = [(c, t, role, f"{role} {t} of {c}") for c in (None, 5, 0) for t, role in enumerate(("user", "assistant", "user"))]
    spark.createDataFrame(conversations, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.execute(chat.SQL).fetchall()
    assert len(want) == 4 and sorted(map(tuple, chat.op8(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)


def test_random_trees_against_brute_force(spark):
    r = random.Random(4)
    rows = []
    for c in range(25):
        n = r.randint(1, 14)
        rows += [(c, i, r.choice([None, *range(i)]) if i else None, r.choice(["user", "assistant", None]), r.choice(["a", "</s>", "[INST]", "\\", None]) or "", r.choice([None, 0.0, 1.0, 2.5])) for i in range(n)]
    want = {}
    for c in {x[0] for x in rows}:
        own = {x[1]: x for x in rows if x[0] == c}
        leaves = [i for i in own if i not in {x[2] for x in own.values()}]
        paths = []
        for leaf in leaves:
            path, i = [], leaf
            while i is not None:
                path.insert(0, own[i])
                i = own[i][2]
            paths.append((-sum(x[5] or 0 for x in path), leaf, path))
        for rank, (_, leaf, path) in enumerate(sorted(paths), 1):
            want[c, leaf] = (rank, [(x[3] or "", x[4]) for x in path], [x[4] for x in path if x[3] == "assistant"])
    df = spark.createDataFrame(rows, "conv_id long, id long, parent long, role string, text string, score double").repartition(5)
    for keep in (None, 1, 2):
        got = {(x.conv_id, x.leaf): (x.rank, [(t.role, t.text) for t in x.turns], list(x.loss_texts)) for x in chat.read_back(chat.format_paths(df, keep)).collect()}
        assert got == {k: v for k, v in want.items() if keep is None or v[0] <= keep}


def test_long_chain_and_empty(spark):
    n = 300
    df = spark.createDataFrame([(7, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(n)], "conv_id long, id long, parent long, role string, text string, score double")
    (r,) = chat.read_back(chat.format_paths(df)).collect()
    assert [t.text for t in r.turns] == [str(i) for i in range(n)]
    assert chat.format_paths(df.limit(0)).count() == 0
