"""Callables, policies, terminals and correlated collections of the fluent query."""

import pytest

from tessera import F, Policy, from_collection, typed
from tessera.errors import UnsupportedError, ValidationError
from tessera.functions.fields import touched
from tessera.operators import aggregates, nested
from tessera.operators.aggregates import Spec

ROWS = [{"id": i, "n": n, "s": s, "tags": tags} for i, (n, s, tags) in enumerate([(9, "b", ["x", "y"]), (10, "a", []), (100, None, None), (2, "a", ["z"])])]


@pytest.fixture(scope="module")
def q(spark):
    return from_collection(spark.createDataFrame([tuple(r.values()) for r in ROWS], "id int, n int, s string, tags array<string>").repartition(2))


def opaque(r) -> int:
    return int(str(r.n))


def test_an_opaque_key_sorts_by_its_type(q):
    assert q.order_by(opaque).select(F.n).to_list() == [2, 9, 10, 100]
    assert q.order_by(typed(lambda r: float(str(r.n)), "double"), ascending=False).select(F.n).to_list() == [100, 10, 9, 2]
    assert q.select({"n": "n", "x": lambda r: int(str(r.n)) * 2}, x="long").where(F.x > 100).count() == 1
    for refused in (lambda: q.order_by(lambda r: int(str(r.n))), lambda: q.select(lambda r: str(r.n) * 2), lambda: q.distinct(lambda r: [*r])):
        with pytest.raises(ValidationError):
            refused()


def test_an_opaque_callable_reads_only_its_fields(q):
    plan = q.where(lambda r: int(str(r.n)) > 9).df._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython [run(n#" in plan
    some = lambda r: r.n + r["id"]
    whole = lambda r: dict(r.asDict())
    assert touched(some) == ["n", "id"] and touched(whole) is None
    assert q.where(lambda r: len(str(r.n)) + len(r.s) > 2).select(F.id).to_set() == {1}  # a row that fails is dropped


def test_policy(q):
    with pytest.raises(UnsupportedError):
        q.on_unsupported("error").where(lambda r: int(str(r.n)) > 9)
    with pytest.warns(RuntimeWarning):
        q.on_unsupported("warn").where(lambda r: int(str(r.n)) > 9)
    few = q.with_policy(Policy(max_rows_local=3))
    for many in (few.to_list, lambda: list(few), few.to_set, lambda: few.to_dict(F.id)):
        with pytest.raises((RuntimeError, TypeError)):
            many()
    assert len(list(few.take(3))) == 3
    slow = q.with_policy(Policy(timeout_ms=300)).select({"x": typed(_sleep, "int")})
    for late in (lambda: slow.sum(F.x), lambda: slow.max(F.x), slow.to_list, lambda: slow.first(F.x > 0), lambda: slow.any(F.x > 0), lambda: list(slow)):
        with pytest.raises(TimeoutError):
            late()


def _sleep(r):
    import time

    time.sleep(3)
    return int(str(r.n))


def test_terminals(q):
    assert (q.count(), q.count(F.n > 9), q.sum(F.n), q.min(F.n), q.max("n"), q.average(F.n)) == (4, 2, 121, 2, 100, 30.25)
    none = q.where(F.n > 1000)
    assert (none.count(), none.sum(F.n), none.average(F.n), none.first_or_default(7)) == (0, 0, 0.0, 7)
    for fails in (none.first, lambda: none.min(F.n), lambda: none.max(F.n)):
        with pytest.raises(ValueError):
            fails()
    assert q.order_by(F.n).first().n == 2 and q.any(F.n == 9) and not q.any(F.n == 8) and q.all(F.n > 1) and not q.all(F.s == "a")
    assert q.to_dict(F.id, F.n) == {0: 9, 1: 10, 2: 100, 3: 2}
    with pytest.raises(ValidationError):
        q.to_dict(F.s)
    kept = q.persist()
    assert kept.df.is_cached and kept.count() == 4 and not kept.unpersist().df.is_cached
    said = q.where(F.n > 3).explain("dict")
    assert said["plan"] == ["where"] and "Filter" in said["physical"] and "where" in q.where(F.n > 3).explain()


def test_select_many(q, spark):
    assert sorted(q.select_many(lambda r: r.tags).to_list()) == ["x", "y", "z"]
    rows = q.select_many(lambda r: r.tags, result=lambda r, x: {"id": r.id, "tag": x}).to_list()
    assert sorted(map(tuple, rows)) == [(0, "x"), (0, "y"), (3, "z")]
    assert sorted(map(tuple, q.select_many(lambda r: r.tags, how="left", result=lambda r, x: {"id": r.id, "tag": x}).to_list()), key=str) == [(0, "x"), (0, "y"), (1, None), (2, None), (3, "z")]
    child = from_collection(spark.createDataFrame([(0, 1.0, "p"), (0, 3.0, "r"), (0, 2.0, "q"), (3, 5.0, "s")], "owner int, price double, id string"))
    top = q.select_many(lambda r: child.where(F.owner == r.id).order_by(F.price, ascending=False).take(2), result=lambda r, c: {"id": r.id, "of": c.id})
    assert sorted(map(tuple, top.to_list())) == [(0, "q"), (0, "r"), (3, "s")]
    assert [r.id for r in q.select_many(lambda r: child.where(F.owner == r.id)).where(F.price > 2.5).order_by(F.price).to_list()] == ["r", "s"]
    later = q.select_many(lambda r: child.where(lambda c: c.price < 4).where(F.owner == r.id).order_by(F.price).skip(1), how="left", result=lambda r, c: {"id": r.id, "of": c.id})
    assert sorted(map(tuple, later.to_list()), key=str) == [(0, "q"), (0, "r"), (1, None), (2, None), (3, None)]
    cheaper = q.select_many(lambda r: child.where(F.price < r.n).select(F.id))
    assert sorted(cheaper.to_list()) == sorted(x for n in (9, 10, 100, 2) for p, x in ((1, "p"), (3, "r"), (2, "q"), (5, "s")) if p < n)
    first = q.select_many(child, on=[("id", "owner")], n=1)
    assert sorted((r.id, r.price) for r in first.to_list()) == [(0, 1.0), (3, 5.0)]
    with pytest.raises(ValidationError):
        nested.top_n(q.df, child.df, [], [], 1)


def test_arrays_of_any_type(q):
    df = q.df.selectExpr("1 as k", "n", "s", "date'2024-01-01' as d")
    (r,) = aggregates.group(df, ["k"], [Spec("array", c, c) for c in ("n", "s", "d")]).collect()
    assert sorted(r.n) == [2, 9, 10, 100] and sorted(map(str, r.s)) == ["None", "a", "a", "b"] and len(r.d) == 4
    assert aggregates.group(df.limit(0), [], [Spec("sum", "n", "x")]).count() == 0


def test_rows_of_fields_in_joins(q, spark):
    other = spark.createDataFrame([(None, "none"), ("a", "A")], "s string, name string")
    assert q.join(other, on="s").count() == 2 and q.join(other, on="s", null_safe=True).count() == 3
    with pytest.raises(ValidationError):
        q.join(other, how="sideways", on="s")
    with pytest.raises(ValidationError):
        q.join(other)
    assert q.alias("x").where(["x.n", ">", 9]).select({"id": F.x.id}).count() == 2
