"""The query builder: immutable, lazy, over one table. It ends in a DataFrame, so anything Spark does can follow.

Order of calls: where, then order_by and then_by, then take. Sorts are ascending with nulls first, or descending with nulls last;
a stored table's record id breaks ties, so take(n) after a sort is the same every time.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicate import Always, In, Predicate
from ..functions.schema import FILE, RECORD_ID, TableSchema


@dataclass(frozen=True)
class Query:
    """source(predicate, query) gives the rows to filter; it may leave out what cannot match, and has the record id column."""

    source: object
    schema: TableSchema
    predicate: Predicate = Always(True)
    projection: tuple[str, ...] | None = None
    sort: tuple[tuple[str, bool], ...] = ()
    limit: int | None = None
    tag: str | None = None
    scope: str = "all"
    ignore_deleted: bool = False
    null_mode: str = "two-valued"
    deleter: object = None
    counter: object = None
    inline: int = 1000
    with_files: bool = False
    cached: bool = False

    # building

    def where(self, predicate: Predicate) -> Query:
        if self.sort or self.limit is not None:
            raise ValueError("where comes before order_by and take")
        return replace(self, predicate=predicate if self.predicate == Always(True) else self.predicate & predicate)

    def with_predicate(self, predicate: Predicate) -> Query:
        """Replaces the predicate."""
        return replace(self, predicate=predicate)

    def select(self, *columns: str | int) -> Query:
        """Columns by name or ordinal, in any order and as often as asked; the ordinal after the last is the record id."""
        names = [*[f.name for f in self.schema.struct.fields], RECORD_ID]
        return replace(self, projection=tuple(names[c] if isinstance(c, int) else c for c in columns))

    def _sorted(self, path: str, down: bool, first: bool) -> Query:
        if self.limit is not None:
            raise ValueError("order_by comes before take")
        if first and self.sort or not first and not self.sort:
            raise ValueError("then_by follows order_by" if not first else "order_by was given")
        return replace(self, sort=(*self.sort, (path if path == RECORD_ID else self.schema.one_leaf(path), down)))

    def order_by(self, path: str) -> Query:
        return self._sorted(path, False, True)

    def order_by_desc(self, path: str) -> Query:
        return self._sorted(path, True, True)

    def then_by(self, path: str) -> Query:
        return self._sorted(path, False, False)

    def then_by_desc(self, path: str) -> Query:
        return self._sorted(path, True, False)

    def with_sort(self, *keys: tuple[str, bool]) -> Query:
        """Sort keys as (path, descending)."""
        return replace(self, sort=tuple((self.schema.one_leaf(p), d) for p, d in keys))

    def take(self, n: int) -> Query:
        if self.limit is not None:
            raise ValueError("take was given")
        if n < 0:
            raise ValueError("take needs a number of 0 or more")
        return replace(self, limit=n)

    def with_tag(self, tag: str) -> Query:
        return replace(self, tag=tag)

    def within_transaction_only(self) -> Query:
        return replace(self, scope="none" if self.scope == "committed" else "pending")

    def with_committed_only(self) -> Query:
        return replace(self, scope="none" if self.scope == "pending" else "committed")

    def within_delta_only(self) -> Query:
        """Only committed files that no rewrite has made yet."""
        return replace(self, scope="delta" if self.scope in ("all", "committed") else "none")

    def with_cache(self) -> Query:
        """Keeps the files this query scans in memory for later ones."""
        return replace(self, cached=True)

    def with_ignore_deleted(self) -> Query:
        return replace(self, ignore_deleted=True)

    def with_null_mode(self, mode: str) -> Query:
        return replace(self, null_mode=mode)

    # running

    def _rows(self) -> DataFrame:
        bound = self.predicate.bound(self.schema)
        flat = bound.nnf()
        df = self.source(flat, self)
        if flat != Always(True):
            big = [p for p in _conjuncts(flat) if isinstance(p, In) and len(p.values) > self.inline and None not in p.values and self.null_mode != "sql"]
            for p in big:
                df = _listed(df, p)
            rest = [p for p in _conjuncts(flat) if p not in big] if big else [bound]
            for p in rest:
                df = df.where(p.to_column(self.null_mode))
        return df

    def _ordered(self) -> DataFrame:
        df = self._rows()
        if self.sort:
            keys = [F.desc(p) if down else F.asc(p) for p, down in self.sort]
            df = df.orderBy(*keys, *([F.asc(RECORD_ID)] if RECORD_ID in df.columns and all(p != RECORD_ID for p, _ in self.sort) else []))
        return df if self.limit is None else df.limit(self.limit)

    def df(self) -> DataFrame:
        """The result as a DataFrame; the record id shows only if projected."""
        if self.projection is not None and not self.projection:
            raise ValueError("nothing is projected")
        columns = self.projection or [f.name for f in self.schema.struct.fields]
        return self._ordered().select(*[F.col(c) for c in columns])

    def record_ids(self) -> DataFrame:
        """Record id and file of the rows."""
        return replace(self, with_files=True)._ordered().select(RECORD_ID, FILE)

    def rows_with_files(self) -> DataFrame:
        """The rows with record id and file, unsorted."""
        return replace(self, with_files=True)._rows()

    def late(self) -> DataFrame:
        """The result of a sort and take, wide columns read last: the sort sees keys and record ids alone, and only the files of its
        survivors are read again. For wide rows; it needs record ids that are unique, as stored tables have them."""
        if not self.sort or self.limit is None:
            raise ValueError("late needs order_by and take")
        ids = self._ordered().select(RECORD_ID)
        keys = F.broadcast(ids) if self.limit <= 1_000_000 else ids
        again = replace(self, sort=(), limit=None, projection=None)._rows().join(keys, RECORD_ID, "left_semi")
        sort = [F.desc(p) if down else F.asc(p) for p, down in self.sort]
        columns = self.projection or [f.name for f in self.schema.struct.fields]
        return again.orderBy(*sort, F.asc(RECORD_ID)).select(*[F.col(c) for c in columns])

    def count(self) -> int:
        if self.predicate == Always(True) and self.counter and (n := self.counter(self)) is not None:
            return n if self.limit is None else min(n, self.limit)
        rows = self._rows() if self.limit is None else self._rows().limit(self.limit)
        return rows.count()

    def delete(self) -> int:
        """Deletes the rows, the first n of the sort if both were given. Returns how many."""
        if self.deleter is None:
            raise ValueError(f"{self.schema.name} can't be deleted from")
        return self.deleter(self)

    def collect(self) -> list:
        """Objects of a typed table, rows otherwise."""
        rows = self.df().collect()
        return [self.schema.to_object(r) for r in rows] if self.projection is None else rows

    def first(self):
        got = (self if self.limit is not None else self.take(1)).collect()
        return got[0] if got else None

    def any(self) -> bool:
        return not self._rows().isEmpty()


def _conjuncts(p: Predicate) -> list[Predicate]:
    from ..functions.predicate import And

    return _conjuncts(p.left) + _conjuncts(p.right) if isinstance(p, And) else [p]


def _listed(df: DataFrame, p: In) -> DataFrame:
    """A long IN list as a semi- or anti-join."""
    keys = df.sparkSession.createDataFrame([(v,) for v in p.values], df.sparkSession.range(0).select(F.lit(None).cast(p.kind).alias("key_")).schema)
    return df.join(F.broadcast(keys) if len(p.values) <= 1_000_000 else keys, F.col(p.path) == F.col("key_"), "left_anti" if p.negated else "left_semi")
