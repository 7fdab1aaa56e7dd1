"""Storage-backed behaviour over the states a table can be in: pending, committed, optimised, tombstoned and hard-deleted."""

import datetime as dt
import enum
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from tidemark import Database, P, Policies, TableSchema, Uri, external
from tidemark.functions.schema import RECORD_ID, Long, Short
from tidemark.lifecycle import Lease
from tidemark.plans.catalog import store_root
from tidemark.streaming.changes import changes, count_trigger, stream, summary_trigger


class State(enum.Enum):
    Open = 0
    Close = 1
    Waiting = 2


@dataclass
class Name:
    First: str
    Last: str


@dataclass
class Key:
    Version: int
    Full: Name


@dataclass
class Item:
    Id: int
    Size: int | None
    State: State
    When: dt.datetime
    Link: Uri
    Key: Key


@dataclass
class Entity:
    Name: str
    Category: str
    Value: int


@dataclass
class Total:
    Category: str
    Sum: int


@dataclass
class Fired:
    Count: int


def item(k, size=None, state=State.Open):
    return Item(k, size, state, dt.datetime(2024, 1, 1) + dt.timedelta(k), Uri(f"http://x/{k}"), Key(k % 2, Name(f"f{k % 3}", "l")))


ITEMS = [item(1), item(2, 5, State.Close), item(3), item(4, 6, State.Waiting), item(5, 5, State.Close), item(6, 9)]
STATES = ("pending", "committed", "optimised", "tombstoned", "hard-deleted", "reopened")


@pytest.fixture
def make(spark):
    def made(*schemas, policies=None):
        return Database(spark, store_root(spark), list(schemas), policies)

    return made


def prepared(make, state):
    schema = TableSchema.from_dataclass(Item).with_primary_key("Id").without_index("Link")
    db = make(schema)
    t = db.table("Item", Item)
    tx = None
    if state == "pending":
        tx = db.transaction()
        t.append_many(ITEMS, tx)
    else:
        t.append_many(ITEMS[:3])
        t.append_many(ITEMS[3:])
    if state in ("tombstoned", "hard-deleted"):
        t.append_many([item(20), item(21, 5)])
        assert t.query().where(P.ge("Id", 20)).delete() == 2
    if state == "optimised":
        assert db.optimize() == 1 and len(db.manifest.snapshot().files) == 1
    if state == "hard-deleted":
        db.hard_delete()
        assert not db.manifest.snapshot().tombstones
        assert db.vacuum(0, 0) > 0
    if state == "reopened":
        db.checkpoint()
        db = Database(db.spark, db.root, [schema])
        t = db.table("Item", Item)
    return db, t, tx


@pytest.mark.parametrize("state", STATES)
def test_queries_answer_alike_in_every_state(make, state):
    """S1 S2 S5 S6 S8 F1-F12 O1-O9 A1 P1-P5 Q1"""
    db, t, tx = prepared(make, state)
    q = t.query(tx)
    ids = lambda x: sorted(r.Id for r in x.collect())
    assert ids(q) == [1, 2, 3, 4, 5, 6]
    assert ids(q.where(P.ne("Size", 5))) == [1, 3, 4, 6]
    assert ids(q.where(P.lt("Size", 6))) == [1, 2, 3, 5]
    assert ids(q.where(P.eq("State", State.Close) | P.eq("Link", Uri("http://x/1")))) == [1, 2, 5]
    assert ids(q.where(P.isin("When", [dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 5)]))) == [2, 4]
    assert ids(q.where(P.eq("Key", Key(1, Name("f1", "l"))))) == [1]
    assert ids(q.where(P.ne("Key.Full", Name("f1", "l")))) == [2, 3, 5, 6]
    assert [r.Id for r in q.order_by("Size").then_by_desc("Id").take(3).collect()] == [3, 1, 5]
    assert [r.Size for r in q.order_by_desc("Size").take(6).collect()] == [9, 6, 5, 5, None, None]
    assert [r.Id for r in q.order_by("State").take(4).collect()] == [1, 3, 6, 2]
    assert q.count() == 6 and q.where(P.eq("Size", 5)).count() == 2 and q.take(4).count() == 4
    assert q.take(0).collect() == [] and q.where(P.gt("Size", 100)).first() is None and q.any()
    assert sorted(t.query(tx).collect(), key=lambda r: r.Id) == ITEMS
    assert q.within_transaction_only().count() == (6 if state == "pending" else 0)
    assert q.with_committed_only().count() == (0 if state == "pending" else 6)
    assert q.with_committed_only().within_transaction_only().count() == 0
    assert q.with_ignore_deleted().count() == (8 if state == "tombstoned" else 6)
    assert q.select(0, 6, 0).df().columns == ["Id", RECORD_ID, "Id"]


@pytest.mark.parametrize("state", STATES)
def test_delete_and_update_in_every_state(make, state):
    """D5-D8 F18 Q8 Q10"""
    db, t, tx = prepared(make, state)
    assert t.query(tx).order_by_desc("Size").take(1).delete() == 1
    assert t.update(item(2), item(2, 77), tx) == 1
    assert t.update(item(50), item(51, 1), tx) == 0
    rows = sorted((r.Id, r.Size) for r in t.query(tx).collect())
    assert rows == [(1, None), (2, 77), (3, None), (4, 6), (5, 5), (51, 1)]
    if tx:
        tx.complete()
    assert sorted((r.Id, r.Size) for r in t.query().collect()) == rows
    assert t.query().take(2).delete() == 2 and t.query().count() == 4
    assert t.query().delete() == 4 and t.query().count() == 0
    assert db.check_integrity().count() == 0


def test_builder_rules(spark):
    """O10 O11 P2 Q9"""
    q = external(spark.range(3).selectExpr("id", "struct(id as x) as s"))
    for wrong in (lambda: q.order_by("id").where(P.eq("id", 1)), lambda: q.take(1).order_by("id"), lambda: q.order_by("id").order_by("id"), lambda: q.then_by("id"), lambda: q.take(1).take(1), lambda: q.take(-1), lambda: q.select().df(), lambda: q.order_by("s"), lambda: q.delete()):
        with pytest.raises(ValueError):
            wrong()


def test_schema_rules():
    """1.3 D3 D4"""
    s = TableSchema.from_dataclass(Item)
    assert s.all_leaves() == ["Id", "Size", "State", "When", "Link", "Key.Version", "Key.Full.First", "Key.Full.Last"]
    assert s.with_primary_key("Key.Full").primary_key == ("Key.Full.First", "Key.Full.Last")
    assert s.with_partition_key("Id").partition_key == ("Id",)
    for wrong in (lambda: s.with_primary_key("Key").with_primary_key("Key.Version"), lambda: TableSchema.of("$x", s.struct), lambda: s.to_row((1, 2)), lambda: s.to_row(Item(None, *[None] * 5))):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(TypeError):
        s.to_row(Item(1, "x", State.Open, dt.datetime(2024, 1, 1), Uri(""), Key(1, Name("", ""))))

    @dataclass
    class Small:
        A: Short
        B: Long

    assert [f.dataType.simpleString() for f in TableSchema.from_dataclass(Small).struct.fields] == ["smallint", "bigint"]


def test_lookup(make):
    """S14"""
    db = make(TableSchema.from_dataclass(Fired))
    with pytest.raises(TypeError):
        db.table("Fired", Item)
    with pytest.raises(KeyError):
        db.table("None")
    with pytest.raises(ValueError):
        db.table("$tombstone")


def test_transactions(make):
    """X1-X8 Q11 Q15: snapshots, read your writes, rollback, racing commits, ids"""
    db = make(TableSchema.from_dataclass(Fired))
    t = db.table("Fired")
    assert t.append_many([Fired(1), Fired(2), Fired(3)]) == [1, 2, 3]
    one, two = db.transaction(), db.transaction()
    t.append(Fired(10), one)
    assert t.query(one).count() == 4 and t.query(two).count() == 3
    t.append(Fired(20), two)
    assert t.query(two).where(P.le("Count", 2)).delete() == 2
    assert t.query(one).where(P.eq("Count", 1)).delete() == 1
    one.complete()
    two.complete()
    assert sorted(r.Count for r in t.query().collect()) == [3, 10, 20]
    got = t.query().select("Count", RECORD_ID).df().collect()
    assert len({r[RECORD_ID] for r in got}) == 3
    with pytest.raises(RuntimeError):
        two.complete()
    with pytest.raises(KeyError), db.transaction() as tx:
        t.append(Fired(5), tx)
        raise KeyError
    with db.transaction() as tx:
        t.append(Fired(6), tx)
        tx.rollback()
    assert t.query().count() == 3
    # a compaction between a snapshot and its commit
    late = db.transaction()
    t.query(late).where(P.eq("Count", 3)).delete()
    db.hard_delete()
    late.complete()
    assert sorted(r.Count for r in t.query().collect()) == [10, 20]
    assert db.as_of("Fired", 1).count() == 3


def test_triggers(make):
    """T1-T5 A9"""
    entity = TableSchema.from_dataclass(Entity).with_trigger(count_trigger("Fired")).with_trigger(summary_trigger("Entity", "Total", ["Category"], "Value", "Sum"))
    db = make(entity, TableSchema.from_dataclass(Total), TableSchema.from_dataclass(Fired))
    t = db.table("Entity")
    t.append_many([Entity("a", "x", 74), Entity("b", "y", 42)])
    t.append(Entity("c", "x", 10))
    t.append(Entity("d", "x", 16))
    assert sorted((r.Category, r.Sum) for r in db["Total"].query().collect()) == [("x", 100), ("y", 42)]
    t.query().where(P.eq("Value", 10)).delete()
    assert sorted((r.Category, r.Sum) for r in db["Total"].query().collect()) == [("x", 90), ("y", 42)]
    assert db["Fired"].query().count() == 4
    db.optimize()
    with db.transaction(run_triggers=False) as tx:
        t.append(Entity("e", "y", 1), tx)
    assert db["Fired"].query().count() == 4
    feed = changes(db, "Entity").groupBy("change").count().collect()
    assert {r["change"]: r["count"] for r in feed} == {"insert": 5, "delete": 1}


def test_failing_trigger_rolls_back(make):
    def fail(db, tx):
        raise ArithmeticError

    db = make(TableSchema.from_dataclass(Fired).with_trigger(fail))
    with pytest.raises(ArithmeticError):
        db["Fired"].append(Fired(1))
    assert db["Fired"].query().count() == 0


def test_pruning_audit_statistics(make, spark):
    """S3 S10-S12 X10 A10 A11"""
    db = make(TableSchema.of("n", spark.range(0).withColumn("v", F.lit(1.0)).schema))
    for k in range(4):
        db["n"].append_df(spark.range(k * 100, k * 100 + 100).withColumn("v", F.lit(float("nan")) if k == 3 else F.lit(float(k))).coalesce(1))
    q = db["n"].query().where(P.ge("id", 120) & P.lt("id", 180)).with_tag("range")
    assert q.count() == 60
    assert [r["pruned"] for r in db.query_execution().orderBy("iteration").collect()] == [True, False, True, True]
    assert db["n"].query().where(P.gt("v", 5.0)).count() == 100  # NaN sorts above all
    s = db.statistics().first()
    assert (s["files"], s["rows"], s["tombstones"]) == (4, 400, 0)
    assert db.manifest_df("n").count() == 4
    plan = db["n"].query().where(P.ge("id", 120)).df()._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThanOrEqual(id,120)]" in plan


def test_partial_upkeep(make, spark):
    """X15 X16 X17 X18 X22"""
    db = make(TableSchema.of("n", spark.range(0).schema), policies=Policies(file_rows=100, checkpoint_commits=2))
    db["n"].append_df(spark.range(300).repartition(3))
    assert db.optimize() == 0
    held = db.transaction()
    db["n"].query().where(P.lt("id", 200)).delete()
    assert db.optimize() == 1
    assert sum(f.rows for f in db.manifest.snapshot().of("n")) <= 300
    assert db["n"].query().count() == 100
    db.vacuum(0, 0)
    assert db["n"].query(held).count() == 300
    held.rollback()
    db.hard_delete()
    db.vacuum(0, 0)
    assert db["n"].query().count() == 100 and db.manifest.versions()[1]


def test_a_slow_writer_never_loses_its_version(make):
    """X23 D13: what is written aside is no commit, the first to publish a version keeps it, and nobody deletes it"""
    db = make(TableSchema.from_dataclass(Fired))
    db["Fired"].append(Fired(1))
    name = "_log/%020d.json" % 2
    aside = db.files.write_aside(name, '{"add": [')  # a writer that stops here
    again = Database(db.spark, db.root, list(db.schemas.values()))
    assert again["Fired"].query().count() == 1
    again["Fired"].append(Fired(2))
    with pytest.raises(FileExistsError):
        db.files.publish(aside, name)  # it wakes up: its version is taken, and it knows
    assert not db.files.exists(aside)
    assert sorted(r.Count for r in db["Fired"].query().collect()) == [1, 2]


def test_commits_on_a_store_without_hard_links(spark, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.far.link./x", f"file://{tmp_path}")
    db = Database(spark, "viewfs://far/x/db", [TableSchema.from_dataclass(Fired)])
    db["Fired"].append_many([Fired(1), Fired(2)])
    assert db["Fired"].query().where(P.eq("Count", 1)).delete() == 1
    with pytest.raises(FileExistsError):
        db.files.create("_log/%020d.json" % 2, "another")
    assert [r.Count for r in db["Fired"].query().collect()] == [2]
    assert not [n for n in db.files.list("_log") if n.startswith(".")]


def test_racing_processes_keep_every_commit(make):
    """X7 X8: two databases over one folder, each unaware of the other's commits"""
    import threading

    db = make(TableSchema.from_dataclass(Fired))
    other = Database(db.spark, db.root, list(db.schemas.values()))
    work = [threading.Thread(target=lambda d=d, k=k: [d["Fired"].append(Fired(10 * k + j)) for j in range(4)]) for k, d in enumerate((db, other, db, other))]
    for w in work:
        w.start()
    for w in work:
        w.join()
    again = Database(db.spark, db.root, list(db.schemas.values()))
    assert sorted(r.Count for r in again["Fired"].query().collect()) == [10 * k + j for k in range(4) for j in range(4)]
    assert again.manifest.snapshot().version == 16
    ids = [r[RECORD_ID] for r in again["Fired"].query().select("Count", RECORD_ID).df().collect()]
    assert len(set(ids)) == 16


def test_a_commit_that_fails_ends_its_transaction(make, monkeypatch):
    db = make(TableSchema.from_dataclass(Fired), policies=Policies(commit_attempts=1))
    tx = db.transaction()
    db["Fired"].append(Fired(1), tx)
    monkeypatch.setattr(db.manifest, "commit", lambda *_: (_ for _ in ()).throw(FileExistsError("taken")))
    with pytest.raises(RuntimeError):
        tx.complete()
    assert tx.state == "rolled back" and not db.open and not db.pins
    monkeypatch.undo()
    assert db["Fired"].query().count() == 0


def test_group_commit(make):
    """X3 X21: transactions that wait together are one version; the future is done when they are durable"""
    db = make(TableSchema.from_dataclass(Fired), policies=Policies(group_seconds=1.0))
    txs = [db.transaction() for _ in range(5)]
    for k, tx in enumerate(txs):
        db["Fired"].append_many([Fired(k), Fired(k + 10)], tx)
    done = [tx.complete_async() for tx in txs]
    with pytest.raises(RuntimeError):
        txs[0].complete()
    assert len({f.result(60) for f in done}) < 5
    again = Database(db.spark, db.root, list(db.schemas.values()))
    rows = again["Fired"].query().select("Count", RECORD_ID).df().collect()
    assert sorted(r["Count"] for r in rows) == sorted([*range(5), *range(10, 15)]) and len({r[RECORD_ID] for r in rows}) == 10
    assert all(tx.state == "complete" for tx in txs)
    db.close()


def test_lease(make):
    """X20"""
    db = make(TableSchema.from_dataclass(Fired))
    one, two = Lease(db, 60), Lease(db, 60)
    assert one.acquire() and one.held() and not two.acquire() and one.acquire()
    one.release()
    with two:
        assert two.held() and not one.acquire()
    later = db.now() + 1000
    assert one.acquire()
    db.now = lambda: later
    assert not one.held() and two.acquire() and two.held()


def test_deletes_are_kept_by_file(make, spark):
    """X14 F19: files without deleted rows are read as they are, however many rows others lost"""
    db = make(TableSchema.of("n", spark.range(0).schema), policies=Policies(broadcast_tombstones=0))
    for k in range(3):
        db["n"].append_df(spark.range(k * 100, k * 100 + 100).coalesce(1))
    assert db["n"].query().where(P.ge("id", 250)).delete() == 50
    snap = db.manifest.snapshot()
    assert [n for t in snap.dead("n") for n in t.files.values()] == [50] and len(snap.worn("n")) == 1
    plan = lambda q: q.df()._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan(db["n"].query().where(P.lt("id", 200)))
    assert "LeftAnti" in plan(db["n"].query())
    assert db["n"].query().count() == 250
    # a rewrite of one file leaves what is said of others
    assert db["n"].query().where(P.lt("id", 10)).delete() == 10
    worn = {f.name for f in snap.of("n") if f.name in snap.worn("n")}
    assert db.optimize("n", names=worn) == 1
    assert sum(t.rows for t in db.manifest.snapshot().dead("n")) == 10 and db["n"].query().count() == 240
    assert db.check_integrity().count() == 0


def test_deletes_of_files_that_were_rewritten_meanwhile(make, spark):
    db = make(TableSchema.of("n", spark.range(0).schema))
    for k in range(2):
        db["n"].append_df(spark.range(k * 100, k * 100 + 100).coalesce(1))
    tx = db.transaction()
    assert db["n"].query(tx).where(P.lt("id", 30)).delete() == 30
    assert db.optimize() == 1
    tx.complete()
    assert db.manifest.snapshot().stray("n") and db["n"].query().count() == 170
    assert db["n"].query().where(P.lt("id", 50)).count() == 20
    db.hard_delete()
    assert not db.manifest.snapshot().tombstones and db["n"].query().count() == 170


def test_life_cycle(make, spark):
    """X11 X12 X13 X15 X22"""
    policies = Policies(file_rows=1000, small_files=2, deleted_seconds=50.0, checkpoint_commits=1000, checkpoint_rows=100, checkpoint_percent=40, vacuum_seconds=0.0, keep_versions=1)
    db = make(TableSchema.of("n", spark.range(0).schema), policies=policies)
    for k in range(4):
        db["n"].append_df(spark.range(k * 100, k * 100 + 100).coalesce(1))
    assert [(t, why) for t, why, _ in db.life.due()] == [("n", "merge")] and not db.life.due(2.0)
    db.await_life_cycle()
    assert len(db.manifest.snapshot().of("n")) == 1 and not db.life.due()
    assert db["n"].query().where(P.lt("id", 100)).delete() == 100
    assert not db.life.due()
    now = db.now()
    db.now = lambda: now + 60
    assert [why for _, why, _ in db.life.due()] == ["old"]
    db.now = lambda: now
    assert not db.manifest.versions()[1]
    assert db["n"].query().where(P.lt("id", 250)).delete() == 150
    assert [why for _, why, _ in db.life.due()] == ["share"]
    assert db.manifest.versions()[1]  # 250 of 400 rows are gone: a checkpoint
    db.life.start(0.2)
    import time

    until = time.time() + 60
    while db.life.due() and time.time() < until:
        time.sleep(0.2)
    db.close()
    assert not db.manifest.snapshot().tombstones and db["n"].query().count() == 150


def test_log_expires_behind_a_checkpoint(make, monkeypatch):
    db = make(TableSchema.from_dataclass(Fired))
    for k in range(6):
        db["Fired"].append(Fired(k))
    db.checkpoint()
    db["Fired"].append(Fired(6))
    assert db.manifest.expire(6, 600.0) == 0
    assert db.manifest.expire(6, 0.0) == 5
    again = Database(db.spark, db.root, list(db.schemas.values()))
    assert again["Fired"].query().count() == 7 and again.as_of("Fired", 6).count() == 6
    with pytest.raises(KeyError):
        again.as_of("Fired", 3)
    again["Fired"].append(Fired(7))
    assert db["Fired"].query().count() == 8


def test_streamed_changes(make, spark, tmp_path):
    """T6: micro-batches over the log, each version once, also after a restart"""
    db = make(TableSchema.from_dataclass(Fired))
    seen = []
    run = lambda: stream(db, "Fired", lambda df, n: seen.extend((r["version"], r["change"], r["Count"]) for r in df.collect()), f"file://{tmp_path}/c", once=True).awaitTermination()
    db["Fired"].append_many([Fired(1), Fired(2)])
    run()
    assert sorted(seen) == [(1, "insert", 1), (1, "insert", 2)]
    db["Fired"].append(Fired(3))
    db["Fired"].query().where(P.eq("Count", 1)).delete()
    db.hard_delete()
    run()
    run()
    assert sorted(seen[2:]) == [(2, "insert", 3), (3, "delete", 1)]


def test_partition_key_orders_files(make, spark):
    db = make(TableSchema.of("n", spark.range(0).withColumn("k", F.col("id")).schema).with_partition_key("k"), policies=Policies(file_rows=50))
    db["n"].append_df(spark.range(200).withColumn("k", (F.col("id") * 77) % 200))
    db.optimize(force=True)
    spans = sorted(f.stats["k"][:2] for f in db.manifest.snapshot().of("n"))
    assert len(spans) > 1 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert db["n"].query().where(P.eq("k", 5)).count() == 1


def test_one_file_is_written_apart_from_the_join(make, spark, monkeypatch):
    """A shuffle lies between the join with tombstones and the task that writes the file."""
    db = make(TableSchema.of("n", spark.range(0).schema))
    db["n"].append_df(spark.range(0, 200, 1, 4))
    db["n"].query().where(P.lt("id", 150)).delete()
    plans = []
    write = type(spark.range(0)).write
    monkeypatch.setattr(type(spark.range(0)), "write", property(lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write.fget(df)))
    db.hard_delete()
    monkeypatch.undo()
    before, join, _ = plans[0].partition("Join")
    assert join and "Exchange" in before and "Coalesce" not in before
    assert [f.rows for f in db.manifest.snapshot().of("n")] == [50]
    assert sorted(r.id for r in db["n"].query().df().collect()) == list(range(150, 200))


def test_summary_is_grouped_apart_from_its_one_file(make, spark, monkeypatch):
    rows = spark.range(0, 300, 1, 4).selectExpr("cast(id % 100 as int) k", "id")
    db = make(TableSchema.of("n", rows.schema).with_trigger(summary_trigger("n", "sums", ["k"], "id")), TableSchema.of("sums", rows.selectExpr("k", "id total").schema))
    db["n"].append_df(rows)
    frame, plans = type(rows), []
    write = frame.write
    monkeypatch.setattr(frame, "write", property(lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write.fget(df)))
    db["n"].append_df(rows.where("id < 50"))
    monkeypatch.undo()
    plan = next(p for p in plans if "Union" in p and "Aggregate" in p)
    assert "Coalesce" not in plan and "Exchange SinglePartition, REPARTITION" in plan.partition("Aggregate")[0]
    assert len(db.manifest.snapshot().of("sums")) == 2
    want = {k: sum(i for i in range(300) if i % 100 == k) + (k if k < 50 else 0) for k in range(100)}
    assert {r.k: r.total for r in db["sums"].query().df().collect()} == want


def test_statistics_of_files_are_taken_without_a_sort(make, spark, monkeypatch):
    text = "if(id = 7, null, repeat(char(97 + id % 26), 1 + id % 90))"
    rows = spark.range(0, 30000, 1, 3).selectExpr("id", "if(id % 9 = 0, null, concat('s', id * 7919 % 30011)) s", f"struct({text} as t, if(id = 29999, double('nan'), nullif(id / 2, 1D)) as x) u")
    db = make(TableSchema.of("n", rows.schema))
    frame, plans = type(rows), []
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda df: (collect(df), plans.append(df._jdf.queryExecution().executedPlan().toString()))[0])
    db["n"].append_df(rows)
    monkeypatch.undo()
    assert "Aggregate" in plans[0] and "Sort" not in plans[0]
    files = sorted(db.manifest.snapshot().of("n"), key=lambda f: f.first)
    assert [f.rows for f in files] == [10000] * 3
    for k, f in enumerate(files):
        part = rows.where(f"id div 10000 = {k}").collect()
        for leaf, values in {"id": [r.id for r in part], "s": [r.s for r in part], "u.t": [r.u.t for r in part], "u.x": [r.u.x for r in part]}.items():
            some = [v for v in values if v is not None]
            if k == 2 and leaf == "u.x":
                assert leaf not in f.stats
            else:
                assert f.stats[leaf] == (min(some), max(some), len(values) - len(some), len(values))


def test_late_sort_cache_and_delta(make, spark):
    """O7 X19 S7"""
    db = make(TableSchema.of("n", spark.range(0).withColumn("v", F.lit("")).schema))
    rows = spark.range(100).withColumn("v", F.concat(F.lit("x"), F.col("id") % 7))
    db["n"].append_df(rows.where("id < 60"))
    db.optimize(force=True)
    db["n"].append_df(rows.where("id >= 60"))
    q = db["n"].query().order_by_desc("v").then_by("id").take(9)
    assert q.late().collect() == q.df().collect()
    assert q.with_cache().df().collect() == q.df().collect() and len(db.scans) == 1
    db["n"].query().where(P.lt("id", 10)).delete()
    assert db["n"].query().with_cache().count() == 90
    assert db["n"].query().within_delta_only().count() == 40


def test_long_in_list_is_a_join(spark):
    q = external(spark.range(5000))
    assert q.where(P.isin("id", range(0, 4000, 2))).count() == 2000
    assert q.where(P.notin("id", range(0, 4000, 2)) & P.lt("id", 10)).count() == 5
