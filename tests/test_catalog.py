"""Every query of the catalog against its SQL in DuckDB."""

import os
from functools import partial

import duckdb
import pytest

from tidemark import Policies
from tidemark.plans import catalog
from tidemark.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for n in os.listdir(SF):
        c.execute(f"CREATE VIEW {n.split('.')[0]} AS SELECT * FROM '{SF}/{n}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = sorted((tuple(r[c] for c in names) for r in got.collect()), key=str)
    assert rows == sorted(want.fetchall(), key=str)


def test_awaited_life_cycle_with_a_file_over_half_the_target(spark, monkeypatch):
    """The large range is no small file then, and stays beside the merged ones; or is rewritten for its deletes into more than one."""
    for percent, files in ((50, 2), (20, 6)):
        made = []
        ranged = catalog._ranged
        monkeypatch.setattr(catalog, "Policies", partial(Policies, file_rows=2000, deleted_percent=percent))
        monkeypatch.setattr(catalog, "_ranged", lambda *a, ranged=ranged, made=made: made.append(ranged(*a)) or made[-1])
        got = catalog.awaited_life_cycle(spark, "/root/testdata/sf0.01")
        monkeypatch.undo()
        assert got.select("due_before", "settled", "merged").distinct().collect() == [(True, True, True)]
        assert got.count() == catalog.read(spark, "/root/testdata/sf0.01", "orders").where("o_orderstatus <> 'F'").count()
        assert len(made[0].manifest.snapshot().of("orders")) == files


@pytest.mark.parametrize("name", ["checkpoint_policy", "deletes_by_file", "integrity", "partial_hard_delete", "query_audit", "delta_only_scan"])
def test_no_rows_are_sorted_for_statistics(spark, monkeypatch, name):
    frame, plans = type(spark.range(0)), []
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda df: (collect(df), plans.append(df._jdf.queryExecution().executedPlan().toString()))[0])
    QUERIES[name](spark, SF)
    monkeypatch.undo()
    taken = [p for p in plans if "file_name" in p]
    assert taken and not any("SortAggregate" in p for p in taken)
