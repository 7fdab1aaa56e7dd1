"""Table schemas: typed columns, keys, triggers, index opt-out, and the mapping of dataclasses to rows.

Types: short, int, long, string, bool, timestamp (no zone), Uri (a string) and enums (an int ordinal, ordered by it; names in the
field's metadata). Double, date and decimal are accepted as an extension. Nested dataclasses become structs.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import decimal
import enum
import types
import typing

from pyspark.sql import Row
from pyspark.sql import types as T

RECORD_ID = "_record_id"
#: Name of the data file a row was read from, where a scan is asked for it.
FILE = "_file"


class Uri(str):
    """A string column marked as a URI."""


class Short(int):
    """A 16-bit integer column."""


class Long(int):
    """A 64-bit integer column."""


_SIMPLE = {bool: T.BooleanType(), Short: T.ShortType(), int: T.IntegerType(), Long: T.LongType(), str: T.StringType(), Uri: T.StringType(), float: T.DoubleType(), dt.datetime: T.TimestampNTZType(), dt.date: T.DateType(), decimal.Decimal: T.DecimalType(38, 18)}
ALLOWED = (T.ShortType, T.IntegerType, T.LongType, T.StringType, T.BooleanType, T.TimestampNTZType, T.DoubleType, T.DateType, T.DecimalType, T.StructType)
#: Types whose range comparisons never match null; others sort null below every value.
TEXTUAL = (T.StringType,)


def _field(name: str, hint) -> T.StructField:
    nullable = hint in (str, Uri)
    if typing.get_origin(hint) in (typing.Union, types.UnionType):
        inner = [a for a in typing.get_args(hint) if a is not type(None)]
        if len(inner) != 1:
            raise TypeError(f"{name}: only optional types may be unions")
        hint, nullable = inner[0], True
    if isinstance(hint, type) and issubclass(hint, enum.Enum):
        return T.StructField(name, T.IntegerType(), nullable, {"logical": "enum", "names": [m.name for m in hint]})
    if dataclasses.is_dataclass(hint):
        return T.StructField(name, struct_of(hint), nullable)
    if hint not in _SIMPLE:
        raise TypeError(f"{name}: type {hint} is not supported")
    return T.StructField(name, _SIMPLE[hint], nullable, {"logical": "uri"} if hint is Uri else None)


def struct_of(cls) -> T.StructType:
    hints = typing.get_type_hints(cls)
    return T.StructType([_field(f.name, hints[f.name]) for f in dataclasses.fields(cls)])


@dataclasses.dataclass(frozen=True)
class TableSchema:
    name: str
    struct: T.StructType
    cls: type | None = None
    primary_key: tuple[str, ...] = ()
    partition_key: tuple[str, ...] = ()
    triggers: tuple = ()
    unindexed: frozenset[str] = frozenset()

    @staticmethod
    def of(name: str, struct: T.StructType) -> TableSchema:
        """An untyped table."""
        if name.startswith(("$", "_")):
            raise ValueError(f"table name {name} is reserved")
        names = [f.name for f in struct.fields]
        for n in names:
            if n.startswith(("$", "_")):
                raise ValueError(f"column name {n} is reserved")
        if len(set(names)) < len(names):
            raise ValueError(f"{name}: duplicate column names")
        for f in struct.fields:
            if not isinstance(f.dataType, ALLOWED):
                raise TypeError(f"{name}.{f.name}: type {f.dataType.simpleString()} is not supported")
        return TableSchema(name, struct)

    @staticmethod
    def from_dataclass(cls, name: str | None = None) -> TableSchema:
        """A typed table; columns follow the dataclass."""
        return dataclasses.replace(TableSchema.of(name or cls.__name__, struct_of(cls)), cls=cls)

    def leaves(self, path: str) -> list[str]:
        """Leaf columns under a dotted path; the path itself if it is one."""
        kind: T.DataType = self.struct
        for part in path.split("."):
            if not isinstance(kind, T.StructType) or part not in kind.fieldNames():
                raise KeyError(f"{self.name} has no column {path}")
            kind = kind[part].dataType
        if isinstance(kind, T.StructType):
            return [x for f in kind.fields for x in self.leaves(f"{path}.{f.name}")]
        return [path]

    def all_leaves(self) -> list[str]:
        return [x for f in self.struct.fields for x in self.leaves(f.name)]

    def field(self, leaf: str) -> T.StructField:
        found = T.StructField("", self.struct)
        for part in leaf.split("."):
            found = found.dataType[part]
        return found

    def one_leaf(self, path: str) -> str:
        found = self.leaves(path)
        if len(found) != 1 or found[0] != path:
            raise ValueError(f"{path} is not a single column")
        return path

    def _keyed(self, which: str, path: str) -> TableSchema:
        more = tuple(self.leaves(path))
        if set(more) & set(getattr(self, which)):
            raise ValueError(f"{path} is in the key twice")
        return dataclasses.replace(self, **{which: getattr(self, which) + more})

    def with_primary_key(self, path: str) -> TableSchema:
        return self._keyed("primary_key", path)

    def with_partition_key(self, path: str) -> TableSchema:
        return self._keyed("partition_key", path)

    def with_trigger(self, action) -> TableSchema:
        """action(db, tx) runs at commit when rows of this table were inserted or deleted."""
        return dataclasses.replace(self, triggers=(*self.triggers, action))

    def without_index(self, path: str) -> TableSchema:
        return dataclasses.replace(self, unindexed=self.unindexed | set(self.leaves(path)))

    def stored_struct(self) -> T.StructType:
        return T.StructType([*self.struct.fields, T.StructField(RECORD_ID, T.LongType(), False)])

    # rows

    def to_row(self, record) -> Row | tuple:
        """A record (dataclass object, tuple, list or dict) as values in column order; arity and nulls are checked."""
        if dataclasses.is_dataclass(record):
            values = [getattr(record, f.name) for f in self.struct.fields]
        elif isinstance(record, dict):
            values = [record[f.name] for f in self.struct.fields]
        else:
            values = list(record)
        if len(values) != len(self.struct.fields):
            raise ValueError(f"{self.name} has {len(self.struct.fields)} columns; {len(values)} were given")
        return tuple(_encoded(self.name, f, v) for f, v in zip(self.struct.fields, values, strict=True))

    def to_object(self, row: Row):
        return _decoded(self.cls, row) if self.cls else row


def _encoded(table: str, field: T.StructField, v):
    if v is None:
        if not field.nullable or isinstance(field.dataType, T.StructType):
            raise ValueError(f"{table}.{field.name} may not be null")
        return None
    if isinstance(field.dataType, T.StructType):
        values = [getattr(v, f.name) for f in field.dataType.fields] if dataclasses.is_dataclass(v) else [v[f.name] for f in field.dataType.fields] if isinstance(v, dict) else list(v)
        return tuple(_encoded(table, f, x) for f, x in zip(field.dataType.fields, values, strict=True))
    return encoded_literal(field, v)


def encoded_literal(field: T.StructField, v):
    """A Python value as the column stores it; a value of another type is an error, nothing is cast."""
    kind, names = field.dataType, (field.metadata or {}).get("names")
    if names is not None:
        if isinstance(v, enum.Enum):
            v = v.name
        if isinstance(v, str) and v in names:
            return names.index(v)
        if isinstance(v, int) and not isinstance(v, bool) and 0 <= v < len(names):
            return v
        raise TypeError(f"{field.name}: {v!r} is none of {names}")
    ok = {T.BooleanType: bool, T.StringType: str, T.DoubleType: (float, int), T.TimestampNTZType: dt.datetime, T.DateType: dt.date, T.DecimalType: (decimal.Decimal, int)}
    if isinstance(kind, (T.ShortType, T.IntegerType, T.LongType)):
        bits = 16 if isinstance(kind, T.ShortType) else 32 if isinstance(kind, T.IntegerType) else 64
        if isinstance(v, int) and not isinstance(v, bool) and -(1 << bits - 1) <= v < 1 << bits - 1:
            return int(v)
    elif isinstance(v, ok[type(kind)]) and not (isinstance(v, bool) and not isinstance(kind, T.BooleanType)):
        return str(v) if isinstance(kind, T.StringType) else float(v) if isinstance(kind, T.DoubleType) else v
    raise TypeError(f"{field.name} is {kind.simpleString()}; {v!r} isn't")


def _decoded(cls, row):
    hints = typing.get_type_hints(cls)
    out = {}
    for f in dataclasses.fields(cls):
        hint, v = hints[f.name], row[f.name]
        if typing.get_origin(hint) in (typing.Union, types.UnionType):
            hint = next(a for a in typing.get_args(hint) if a is not type(None))
        if v is not None and isinstance(hint, type) and issubclass(hint, enum.Enum):
            v = list(hint)[v]
        elif v is not None and dataclasses.is_dataclass(hint):
            v = _decoded(hint, v)
        elif v is not None and hint in (Uri, Short, Long):
            v = hint(v)
        out[f.name] = v
    return cls(**out)
