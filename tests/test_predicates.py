"""F1-F17, Q1-Q3, Q12-Q14, Q21: every predicate over nulls and values, against a plain evaluation; zone filters never lose a row."""

import itertools

import pytest
from pyspark.sql import types as T

from tidemark import P, TableSchema

ROWS = [(1, None, "a"), (2, 5, None), (3, 7, "b"), (4, None, None), (5, 9, "c"), (6, 5, "B")]
SCHEMA = TableSchema.of("t", T.StructType([T.StructField("id", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("s", T.StringType())]))
TESTS = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b}


def plain(op, column, v):
    def test(r):
        x = r[{"n": 1, "s": 2}[column]]
        if op in ("eq", "ne"):
            return TESTS[op](x, v)
        if x is None:
            return column == "n" and op in ("lt", "le")
        return TESTS[op](x, v)

    return test


LEAVES = [(getattr(P, op)(c, v), plain(op, c, v)) for op in TESTS for c, v in (("n", 5), ("s", "b"))] + [
    (P.isin("n", [5, None]), lambda r: r[1] in (5, None)), (P.notin("n", [5]), lambda r: r[1] != 5), (P.isin("n", []), lambda r: False), (P.notin("s", []), lambda r: True),
    (P.eq("n", None), lambda r: r[1] is None), (P.ne("s", None), lambda r: r[2] is not None), (P.all(), lambda r: True), (P.none(), lambda r: False),
]
PAIRS = list(itertools.combinations(range(len(LEAVES)), 2))
CASES = LEAVES + [(~p, lambda r, t=t: not t(r)) for p, t in LEAVES] + [(~(LEAVES[a][0] & LEAVES[b][0]) | LEAVES[b][0], lambda r, a=a, b=b: not (LEAVES[a][1](r) and LEAVES[b][1](r)) or LEAVES[b][1](r)) for a, b in PAIRS[::9]]


def test_all_predicates_match_plain_evaluation(spark):
    df = spark.createDataFrame(ROWS, SCHEMA.struct).cache()
    columns = [b for p, _ in CASES for b in (p.bound(SCHEMA).to_column(), p.bound(SCHEMA).nnf().to_column())]
    got = df.select("id", *[c.alias(f"c{k}") for k, c in enumerate(columns)]).collect()
    for r in got:
        row = next(x for x in ROWS if x[0] == r["id"])
        for k, (p, t) in enumerate(CASES):
            assert r[f"c{2 * k}"] == r[f"c{2 * k + 1}"] == t(row), (str(p), row)


def test_zone_filter_is_sound():
    for size in (1, 2, 3):
        for rows in itertools.combinations(ROWS, size):
            stats = {}
            for leaf, k in (("n", 1), ("s", 2)):
                v = [r[k] for r in rows if r[k] is not None]
                stats[leaf] = (min(v, default=None), max(v, default=None), size - len(v), size)
            for p, t in CASES:
                if any(t(r) for r in rows):
                    assert p.bound(SCHEMA).nnf().may_match(stats), (str(p), rows)
    assert not P.gt("n", 9).bound(SCHEMA).nnf().may_match({"n": (1, 9, 0, 3)})
    assert not P.isin("n", [10]).bound(SCHEMA).nnf().may_match({"n": (1, 9, 2, 3)})


def test_literals_and_paths_are_checked():
    with pytest.raises(TypeError):
        P.eq("n", "5").bound(SCHEMA)
    with pytest.raises(TypeError):
        P.eq("n", True).bound(SCHEMA)
    with pytest.raises(ValueError):
        P.lt("n", None).bound(SCHEMA)
    with pytest.raises(KeyError):
        P.eq("x", 1).bound(SCHEMA)
    nested = TableSchema.of("t", T.StructType([T.StructField("k", SCHEMA.struct)]))
    with pytest.raises(ValueError):
        P.lt("k", 1).bound(nested)
    with pytest.raises(ValueError):
        P.isin("k", [1]).bound(nested)


def test_text_form():
    assert str(P.eq("a", 1) & ~P.isin("b", [1, 2])) == "(v[a] == 1) && (!(v[b] in {1, 2}))"
