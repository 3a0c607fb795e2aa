"""The token grammar of predicates: nested prefix lists with an implicit AND at the top.

['age', '>', 26], ['!', [...]], ['&', [...], [...]], ['|', [...], [...]], and lists of these. '!' takes the one operand
after it, '&' and '|' the two after them, which may be terms in the open: ['|', 'a', '==', 1, 'b', '==', 2, 'c', '>', 3]
is (a = 1 or b = 2) and c > 3.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from tessera.errors import ValidationError
from tessera.plans.expr import BOUNDS, And, Between, Compare, Contains, Field, In, Near, Not, Or, Predicate, TrueTerm, Truthy

# Operator tokens and their number of operands.
ARITY = {"==": 1, "!=": 1, ">": 1, ">=": 1, "<": 1, "<=": 1, "contains": 1, "in": 1, "?T": 0, "?!T": 0, "?N": 0, "?!N": 0, "between[]": 2, "between()": 2, "between(]": 2, "between[)": 2, "near[]": 2}


def term(attr: str, op: str, *values: Any) -> Predicate:
    """One leaf; the attribute may be a dotted path."""
    if op not in ARITY:
        raise ValidationError(f"unknown operator {op!r}")
    if len(values) != ARITY[op]:
        raise ValidationError(f"{op!r} takes {ARITY[op]} operands, got {len(values)}")
    f = Field(attr)
    if op.startswith("between"):
        return Between(f, *values, *BOUNDS[op[len("between") :]])
    if op == "near[]":
        return Near(f, *values)
    if op in ("?T", "?!T"):
        return Truthy(f) if op == "?T" else Not(Truthy(f))
    if op in ("?N", "?!N"):
        return f.is_none() if op == "?N" else f.not_none()
    if op == "contains":
        return Contains(f, *values)
    if op == "in":
        return In(f, *values)
    return Compare(op, f, *values)


def compile_predicate(tokens: Sequence[Any]) -> Predicate:
    """The predicate that a token list says; an empty list is true."""
    parts, rest = [], list(tokens)
    while rest:
        p, rest = _take(rest)
        parts.append(p)
    if not parts:
        return TrueTerm
    return parts[0] if len(parts) == 1 else And(*parts)


def _take(tokens: list[Any]) -> tuple[Predicate, list[Any]]:
    head, rest = tokens[0], tokens[1:]
    if isinstance(head, Predicate):
        return head, rest
    if isinstance(head, (list, tuple)):
        return compile_predicate(head), rest
    if head == "!":
        if not rest:
            raise ValidationError("'!' needs an operand")
        p, rest = _take(rest)
        return Not(p), rest
    if head in ("&", "|"):
        parts = []
        for _ in range(2):
            if not rest:
                raise ValidationError(f"{head!r} needs two operands")
            p, rest = _take(rest)
            parts.append(p)
        return (And if head == "&" else Or)(*parts), rest
    if not isinstance(head, str):
        raise ValidationError(f"not an attribute or operator: {head!r}")
    if not rest or not isinstance(rest[0], str) or rest[0] not in ARITY:
        raise ValidationError(f"unknown operator after {head!r}")
    n = ARITY[rest[0]]
    if len(rest) < 1 + n:
        raise ValidationError(f"{rest[0]!r} needs {n} operands")
    return term(head, rest[0], *rest[1 : 1 + n]), rest[1 + n :]


def split_by_alias(p: Predicate, aliases: Sequence[str]) -> Predicate:
    """The conjuncts that touch only fields below the given aliases; what can't be split off is true."""
    if isinstance(p, And):
        return And(*(split_by_alias(x, aliases) for x in p.parts))
    return p if _roots(p) <= set(aliases) else TrueTerm


def _roots(p: Any) -> set[str]:
    if isinstance(p, Field):
        return {p._path.split(".")[0]}
    found: set[str] = set()
    for x in vars(p).values() if hasattr(p, "__dict__") else ():
        for y in x if isinstance(x, list) else [x]:
            if hasattr(y, "column"):
                found |= _roots(y)
    return found
