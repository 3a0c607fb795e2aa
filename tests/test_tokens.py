"""The prefix grammar against brute force over rows with nulls."""

import itertools

import pytest

from tessera import compile_predicate
from tessera.errors import ValidationError
from tessera.plans.expr import FalseTerm, TrueTerm, strict
from tessera.plans.tokens import split_by_alias

ROWS = [(i, a, b, c) for i, (a, b, c) in enumerate(itertools.product((None, 1, 2), (None, 2, 3), (None, 0, 4)))]
A, B, C = ["a", "==", 1], ["b", "==", 2], ["c", ">", 3]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "id int, a int, b int, c int").cache()


def ids(df, tokens):
    return {r.id for r in df.where(compile_predicate(tokens).column(df)).collect()}


def want(fn):
    return {i for i, a, b, c in ROWS if fn(a == 1, b == 2, c is not None and c > 3)}


@pytest.mark.parametrize(
    "tokens, fn",
    [
        (["|", A, B, C], lambda a, b, c: (a or b) and c),
        (["&", A, B, C], lambda a, b, c: a and b and c),
        (["&", "|", A, B, C], lambda a, b, c: (a or b) and c),
        (["|", "&", A, B, C], lambda a, b, c: (a and b) or c),
        (["|", "a", "==", 1, "b", "==", 2, "c", ">", 3], lambda a, b, c: (a or b) and c),
        ([A, "|", B, C], lambda a, b, c: a and (b or c)),
        (["!", A, B], lambda a, b, c: not a and b),
        (["!", "|", A, B, C], lambda a, b, c: not (a or b) and c),
        (["|", "!", "&", A, B, C], lambda a, b, c: not (a and b) or c),
        ([["|", A, ["&", B, C]]], lambda a, b, c: a or (b and c)),
        ([A, B, C], lambda a, b, c: a and b and c),
        ([], lambda a, b, c: True),
    ],
)
def test_prefix_operators_take_their_operands_only(df, tokens, fn):
    assert ids(df, tokens) == want(fn)


def test_refused():
    for bad in (["&", A], ["|"], ["!"], ["a"], ["a", "~", 1], ["a", "between[]", 1], [7, "==", 1]):
        with pytest.raises(ValidationError):
            compile_predicate(bad)


def test_constants_and_aliases(df):
    assert df.where(strict(FalseTerm, df)).isEmpty() and df.where(strict(TrueTerm, df)).count() == len(ROWS)
    p = compile_predicate([["l.x", "==", 1], ["r.y", "==", 2], ["|", ["l.x", "==", 3], ["r.y", "==", 4]]])
    wide = df.selectExpr("struct(a as x) as l", "struct(b as y) as r")
    left = split_by_alias(p, ["l"])
    assert wide.where(left.column(wide)).count() == sum(a == 1 for _, a, _, _ in ROWS)
    assert wide.where(split_by_alias(p, ["q"]).column(wide)).count() == len(ROWS)
