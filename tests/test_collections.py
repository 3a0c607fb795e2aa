"""Edits of lists, multisets, maps and multimaps against Python's own."""

import random

import pytest

from tessera.errors import ValidationError
from tessera.operators import sets
from tessera.operators.sets import Mapping, Multimap, Multiset, PositionalList


def as_list(p):
    return [r.v for r in p.df.orderBy("_pos").collect()]


def test_list_edits_at_random(spark):
    r = random.Random(2)
    p, own = PositionalList(spark.createDataFrame([(i, f"v{i}") for i in range(6)], "_pos long, v string")), [f"v{i}" for i in range(6)]
    for step in range(8):
        kind, i = r.choice(["insert", "remove", "set", "append_last", "append_first"]), r.randint(-len(own), len(own) - 1)
        if kind == "insert":
            p, i = p.insert(i, f"n{step}"), i
            own.insert(i, f"n{step}")
        elif kind == "remove":
            p = p.remove(i)
            own.pop(i)
        elif kind == "set":
            p = p.set(i, f"s{step}")
            own[i] = f"s{step}"
        elif kind == "append_last":
            p = p.append_last(f"a{step}")
            own.append(f"a{step}")
        else:
            p = p.append_first(f"f{step}")
            own.insert(0, f"f{step}")
        p = PositionalList(spark.createDataFrame(p.df.collect(), p.df.schema))
        assert as_list(p) == own, (kind, i)
    assert p.size() == len(own) and p.get(-1).v == own[-1] and p.get(0).v == own[0]
    assert as_list(p.slice(1, -1)) == own[1:-1] and as_list(p.head(2)) == own[:2] and as_list(p.tail(2)) == own[2:] and as_list(p.slice(-3)) == own[-3:]
    assert as_list(p.remove_first()) == own[1:] and as_list(p.remove_last()) == own[:-1] and as_list(p.extend(p.head(1))) == own + own[:1]
    assert p.as_query().where(["v", "==", own[0]]).count() >= 1
    with pytest.raises(ValidationError):
        PositionalList(spark.range(3))


def test_list_of_an_order(spark):
    values = [random.Random(3).randrange(50) for _ in range(300)]
    p = PositionalList.of(spark.createDataFrame([(v,) for v in values], "v int").repartition(7), "v")
    assert as_list(p) == sorted(values) and [x._pos for x in p.df.orderBy("_pos").collect()] == list(range(300))
    assert PositionalList.of(spark.createDataFrame([], "v int"), "v").size() == 0


def test_multiset(spark):
    m = Multiset.of(spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "x string"), "x")
    assert (m.count(), m.total_count(), m.get_count("a"), m.get_count(None), m.get_count("z")) == (3, 4, 2, 1, 0)
    m = m.add("a").remove("b").add("c", 3)
    assert {x.element: x.n for x in m.df.collect()} == {"a": 3, None: 1, "c": 3} and not m.has("b")


def test_map_and_multimap(spark):
    m = Mapping(spark.createDataFrame([(1, "a"), (2, "b")], "key int, value string"))
    m = m.set(2, "B").set(3, "c").remove(1)
    assert {x.key: x.value for x in m.df.collect()} == {2: "B", 3: "c"} and m.get(9) is None and m.has(3)
    mm = Multimap(spark.createDataFrame([(1, "a"), (1, "b")], "key int, value string")).put(2, "c").put(1, "a").remove(1, "a")
    assert sorted((x.key, x.value) for x in mm.df.collect()) == [(1, "a"), (1, "b"), (2, "c")]
    df = spark.createDataFrame([(1, "ab", ["x", "y"]), (2, None, None)], "id int, s string, tags array<string>")
    assert sorted(map(tuple, Multimap.index(df, df.s, "id").df.collect())) == [("ab", 1)]
    assert sorted(map(tuple, Multimap.index(df, df.tags, "id").df.collect())) == [("x", 1), ("y", 1)]


def test_rebase(spark):
    def maps(kind, *each):
        return [Mapping(spark.createDataFrame(list(d.items()), f"key int, value {kind}")) for d in each]

    def said(m):
        return {x.key: x.value for x in m.df.collect()}

    mine, base, now = maps("int", {1: 15, 2: 1, 3: 9, 5: 5}, {1: 10, 2: 1, 3: 3, 4: 4}, {1: 11, 2: 7, 3: 3, 4: 8, 6: 6})
    assert said(mine.rebase(base, now)) == {1: 12, 2: 7, 3: 9, 5: 5, 6: 6}
    assert said(mine.rebase(base, now, numbers="difference")) == {1: 16, 2: 7, 3: 9, 5: 5, 6: 6}
    mine, base, now = maps("string", {1: "x", 2: "b"}, {1: "a", 2: "b"}, {1: "y", 2: "z"})
    assert said(mine.rebase(base, now)) == {1: "x", 2: "z"}
    mine, base, now = maps("array<string>", {1: ["a", "m"], 2: ["q"]}, {1: ["a"], 2: ["q"]}, {1: ["a", "t"], 2: ["r"]})
    got = said(mine.rebase(base, now))
    assert sorted(got[1]) == ["a", "m", "t"] and got[2] == ["r"]
    mine, base, now = maps("map<string,int>", {1: {"n": 5, "o": 1, "new": 2}}, {1: {"n": 3, "o": 1, "gone": 4}}, {1: {"n": 7, "o": 2, "gone": 4}})
    assert said(mine.rebase(base, now)) == {1: {"n": 8, "o": 2, "new": 2}}
    with pytest.raises(ValidationError):
        mine.rebase(base, now, numbers="sum")


def test_sets(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "k string") for xs in (["a", "b", None, "a"], ["b", "c"]))
    values = lambda df: sorted((r.k for r in df.collect()), key=str)
    assert values(sets.union(a, b)) == ["None", "a", "b", "c"] or values(sets.union(a, b)) == [None, "a", "b", "c"]
    assert values(sets.intersection(a, b)) == ["b"] and values(sets.symmetric_difference(a, b)) == [None, "a", "c"]
    assert values(sets.difference(a, b)) == [None, "a"] and sets.has(a, None) and not sets.has(b, None)
    assert values(sets.add(b, "d")) == ["b", "c", "d"] and values(sets.remove(b, "c")) == ["b"]
    assert sets.or_merge([a, b]).count() == 6 and sets.or_merge_count([a, b]).first()[0] == 4
