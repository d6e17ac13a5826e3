"""Predicate trees and their compilation to columns.

Comparisons are three-valued. Values belong to families (text, number, boolean); comparing two families, or an absent
attribute, gives NULL. A row passes where the whole is TRUE. The type check happens here, so nothing is left for ANSI
casts to raise at run time.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from semevra.model import BOOL, DOUBLE, FAMILY, INT, STR, EngineError


@dataclass(frozen=True)
class Col:
    name: str


@dataclass(frozen=True)
class Attr:
    key: str


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Cmp:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class In:
    left: Any
    items: tuple


@dataclass(frozen=True)
class And:
    left: Any
    right: Any


@dataclass(frozen=True)
class Or:
    left: Any
    right: Any


@dataclass(frozen=True)
class Not:
    child: Any


def _family(v: Any) -> str:
    return "bool" if isinstance(v, bool) else "num" if isinstance(v, (int, float)) else "str"


def _forms(node: Any, promoted: dict[str, str]) -> dict[str, Column]:
    """The operand as a column of each family that it can have; an integer and a double form for numbers."""
    if isinstance(node, Lit):
        f = _family(node.value)
        return {f: F.lit(node.value)}
    if isinstance(node, Col):
        if node.name not in FAMILY:
            raise EngineError(f"unknown column {node.name!r}")
        c = F.lit(0.0) if node.name == "score" else F.col(node.name)
        return {FAMILY[node.name]: c}
    if node.key in promoted:
        return {promoted[node.key]: F.col(f"`attr.{node.key}`")}
    a = F.col("attributes")[node.key]
    return {
        "str": F.when(a["tag"] == STR, a["s"]),
        "num": F.when(a["tag"] == INT, a["i"].cast("double")).when(a["tag"] == DOUBLE, a["d"]),
        "bool": F.when(a["tag"] == BOOL, a["b"]),
    }


_OPS = {"=": "__eq__", "<>": "__ne__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


def _compare(op: str, a: dict[str, Column], b: dict[str, Column]) -> Column:
    each = []
    for family in ("str", "num", "bool"):
        if family in a and family in b:
            each.append(getattr(a[family], _OPS[op])(b[family]))
    if not each:
        return F.lit(None).cast("boolean")
    return each[0] if len(each) == 1 else F.coalesce(*each)


def compile_predicate(node: Any, promoted: dict[str, str] | None = None) -> Column:
    """A boolean column, NULL where the predicate is unknown."""
    promoted = promoted or {}
    if isinstance(node, And):
        return compile_predicate(node.left, promoted) & compile_predicate(node.right, promoted)
    if isinstance(node, Or):
        return compile_predicate(node.left, promoted) | compile_predicate(node.right, promoted)
    if isinstance(node, Not):
        return ~compile_predicate(node.child, promoted)
    if isinstance(node, Cmp):
        return _compare(node.op, _forms(node.left, promoted), _forms(node.right, promoted))
    if isinstance(node, In):
        forms = _forms(node.left, promoted)
        hits = []
        for family, c in forms.items():
            same = [x.value for x in node.items if _family(x.value) == family]
            # Items of other families count as unequal; an absent value stays unknown.
            hits.append(c.isin(*same) if same else F.when(c.isNotNull(), F.lit(False)))
        return hits[0] if len(hits) == 1 else F.coalesce(*hits)
    if isinstance(node, Lit):
        if not isinstance(node.value, bool):
            raise EngineError("a bare literal must be TRUE or FALSE")
        return F.lit(node.value)
    if isinstance(node, Col):
        forms = _forms(node, promoted)
        if "bool" not in forms:
            raise EngineError(f"column {node.name!r} is not boolean")
        return forms["bool"]
    if isinstance(node, Attr):
        forms = _forms(node, promoted)
        if "bool" not in forms:
            raise EngineError(f"attribute {node.key!r} is not boolean")
        if len(forms) == 1:
            return forms["bool"]
        tag = F.col("attributes")[node.key]["tag"]
        return F.when(tag.isNull() | (tag == BOOL), forms["bool"]).otherwise(F.raise_error(F.lit(f"attribute {node.key!r} is not boolean")).cast("boolean"))
    raise EngineError(f"not a predicate: {node!r}")


def conjuncts(node: Any) -> list:
    return conjuncts(node.left) + conjuncts(node.right) if isinstance(node, And) else [] if node is None else [node]


def time_bounds(node: Any) -> tuple[int | None, int | None]:
    """Inclusive bounds of event_time that the top-level conjuncts ``event_time op integer`` imply."""
    lo: int | None = None
    hi: int | None = None
    for c in conjuncts(node):
        if isinstance(c, Cmp) and c.left == Col("event_time") and isinstance(c.right, Lit) and isinstance(c.right.value, int) and not isinstance(c.right.value, bool):
            v = c.right.value
            if c.op in ("=", ">=", ">"):
                x = v + (c.op == ">")
                lo = x if lo is None else max(lo, x)
            if c.op in ("=", "<=", "<"):
                x = v - (c.op == "<")
                hi = x if hi is None else min(hi, x)
    return lo, hi


def count_terms(node: Any) -> int:
    """Comparisons in a tree, for the cost estimate."""
    if isinstance(node, (And, Or)):
        return count_terms(node.left) + count_terms(node.right)
    return count_terms(node.child) if isinstance(node, Not) else 0 if node is None else 1
