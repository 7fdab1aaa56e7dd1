"""Predicates: comparisons, IN, AND, OR, NOT over columns and nested records, in two-valued logic.

Null equals null and sorts below every number, so `!=` keeps nulls and numeric `<` and `<=` match them; ranges of strings never do.
Every leaf compiles to a column that is never null, in forms that push down to Parquet; so NOT is exact. null_mode "sql" gives
SQL's logic instead. Zone filters are made from the negation normal form: a file is skipped only if no row of it can match.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import TEXTUAL, TableSchema, encoded_literal

_NOT = {"==": "!=", "!=": "==", "<": ">=", "<=": ">", ">": "<=", ">=": "<"}


class Predicate:
    def __and__(self, other: Predicate) -> Predicate:
        return And(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return Or(self, other)

    def __invert__(self) -> Predicate:
        return Not(self)

    def bound(self, schema: TableSchema) -> Predicate:
        """With paths resolved to leaves and literals checked."""
        raise NotImplementedError

    def nnf(self, negated: bool = False) -> Predicate:
        """With negations at the leaves only, where they are folded in."""
        raise NotImplementedError

    def to_column(self, null_mode: str = "two-valued") -> Column:
        raise NotImplementedError

    def may_match(self, stats: dict) -> bool:
        """Whether a file of these statistics may hold a matching row; for bound predicates in normal form."""
        return True


@dataclass(frozen=True)
class Always(Predicate):
    value: bool

    def bound(self, schema):
        return self

    def nnf(self, negated=False):
        return Always(self.value != negated)

    def to_column(self, null_mode="two-valued"):
        return F.lit(self.value)

    def may_match(self, stats):
        return self.value

    def __str__(self):
        return "All" if self.value else "Result:  {}"


@dataclass(frozen=True)
class And(Predicate):
    left: Predicate
    right: Predicate

    def bound(self, schema):
        return And(self.left.bound(schema), self.right.bound(schema))

    def nnf(self, negated=False):
        a, b = self.left.nnf(negated), self.right.nnf(negated)
        return simplified(Or(a, b) if negated else And(a, b))

    def to_column(self, null_mode="two-valued"):
        return self.left.to_column(null_mode) & self.right.to_column(null_mode)

    def may_match(self, stats):
        return self.left.may_match(stats) and self.right.may_match(stats)

    def __str__(self):
        return f"({self.left}) && ({self.right})"


@dataclass(frozen=True)
class Or(Predicate):
    left: Predicate
    right: Predicate

    def bound(self, schema):
        return Or(self.left.bound(schema), self.right.bound(schema))

    def nnf(self, negated=False):
        a, b = self.left.nnf(negated), self.right.nnf(negated)
        return simplified(And(a, b) if negated else Or(a, b))

    def to_column(self, null_mode="two-valued"):
        return self.left.to_column(null_mode) | self.right.to_column(null_mode)

    def may_match(self, stats):
        return self.left.may_match(stats) or self.right.may_match(stats)

    def __str__(self):
        return f"({self.left}) || ({self.right})"


@dataclass(frozen=True)
class Not(Predicate):
    inner: Predicate

    def bound(self, schema):
        return Not(self.inner.bound(schema))

    def nnf(self, negated=False):
        return self.inner.nnf(not negated)

    def to_column(self, null_mode="two-valued"):
        return ~self.inner.to_column(null_mode)

    def __str__(self):
        return f"!({self.inner})"


@dataclass(frozen=True)
class Compare(Predicate):
    path: str
    op: str
    value: object
    kind: T.DataType | None = None

    def bound(self, schema):
        leaves = schema.leaves(self.path)
        if leaves == [self.path]:
            field = schema.field(self.path)
            if self.value is None:
                if self.op not in ("==", "!="):
                    raise ValueError(f"{self.path} {self.op} null")
                return Compare(self.path, self.op, None, field.dataType)
            return Compare(self.path, self.op, encoded_literal(field, self.value), field.dataType)
        if self.op not in ("==", "!="):
            raise ValueError(f"{self.path} is not a single column")
        parts = reduce(And, [Compare(x, "==", _under(self.value, x[len(self.path) + 1 :])).bound(schema) for x in leaves])
        return parts if self.op == "==" else Not(parts)

    def nnf(self, negated=False):
        return Compare(self.path, _NOT[self.op], self.value, self.kind) if negated and not self._split() else Not(self) if negated else self

    def _split(self) -> bool:
        """Ranges of strings match no null either way, so their negation isn't the opposite range."""
        return self.op not in ("==", "!=") and isinstance(self.kind, TEXTUAL)

    def to_column(self, null_mode="two-valued"):
        c, v = F.col(self.path), self.value
        if null_mode == "sql":
            return {"==": c == v, "!=": c != v, "<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[self.op] if v is not None else F.lit(None).cast("boolean")
        if v is None:
            return c.isNull() if self.op == "==" else c.isNotNull()
        v = F.lit(v).cast(self.kind) if self.kind is not None else F.lit(v)
        if self.op in ("==", "!="):
            return c.eqNullSafe(v) if self.op == "==" else ~c.eqNullSafe(v)
        found = {"<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[self.op]
        if self.op in ("<", "<=") and self.kind is not None and not isinstance(self.kind, TEXTUAL):
            return found | c.isNull()
        return c.isNotNull() & found

    def may_match(self, stats):
        s = stats.get(self.path)
        if s is None:
            return True
        lo, hi, nulls, rows = s
        v = self.value
        if v is None:
            return nulls > 0 if self.op == "==" else nulls < rows
        if nulls and (self.op == "!=" or self.op in ("<", "<=") and not isinstance(self.kind, TEXTUAL)):
            return True
        if nulls == rows or lo is None:
            return nulls < rows if self.op == "!=" else nulls < rows and lo is None
        return {"==": lo <= v <= hi, "!=": lo != v or hi != v, "<": lo < v, "<=": lo <= v, ">": hi > v, ">=": hi >= v}[self.op]

    def __str__(self):
        return f"v[{self.path}] {self.op} {self.value}"


@dataclass(frozen=True)
class In(Predicate):
    path: str
    values: tuple
    negated: bool = False
    kind: T.DataType | None = None

    def bound(self, schema):
        field = schema.field(schema.one_leaf(self.path))
        return In(self.path, tuple(dict.fromkeys(None if v is None else encoded_literal(field, v) for v in self.values)), self.negated, field.dataType)

    def nnf(self, negated=False):
        p = In(self.path, self.values, self.negated != negated, self.kind)
        return Always(p.negated) if not self.values else p

    def to_column(self, null_mode="two-valued"):
        c = F.col(self.path)
        values = [F.lit(v).cast(self.kind) if self.kind is not None else F.lit(v) for v in self.values if v is not None]
        if null_mode == "sql":
            found = c.isin(values) if len(values) == len(self.values) else c.isin(values) | F.lit(None).cast("boolean")
        else:
            found = (c.isNotNull() & c.isin(values)) if values else F.lit(False)
            if None in self.values:
                found = found | c.isNull()
        return ~found if self.negated else found

    def may_match(self, stats):
        s = stats.get(self.path)
        if s is None or self.negated:
            return True
        lo, hi, nulls, rows = s
        if None in self.values and nulls:
            return True
        return lo is None and nulls < rows or lo is not None and any(lo <= v <= hi for v in self.values if v is not None)

    def __str__(self):
        return f"v[{self.path}] in {{{', '.join(map(str, self.values))}}}"


def simplified(p: Predicate) -> Predicate:
    if isinstance(p, And):
        for a, b in ((p.left, p.right), (p.right, p.left)):
            if isinstance(a, Always):
                return b if a.value else a
    if isinstance(p, Or):
        for a, b in ((p.left, p.right), (p.right, p.left)):
            if isinstance(a, Always):
                return a if a.value else b
    return p


def _under(value, path: str):
    for part in path.split("."):
        value = value[part] if isinstance(value, dict) else getattr(value, part)
    return value


class P:
    """Builders of predicates."""

    all = staticmethod(lambda: Always(True))
    none = staticmethod(lambda: Always(False))
    eq = staticmethod(lambda path, value: Compare(path, "==", value))
    ne = staticmethod(lambda path, value: Compare(path, "!=", value))
    lt = staticmethod(lambda path, value: Compare(path, "<", value))
    le = staticmethod(lambda path, value: Compare(path, "<=", value))
    gt = staticmethod(lambda path, value: Compare(path, ">", value))
    ge = staticmethod(lambda path, value: Compare(path, ">=", value))
    isin = staticmethod(lambda path, values: In(path, tuple(values)))
    notin = staticmethod(lambda path, values: In(path, tuple(values), True))
