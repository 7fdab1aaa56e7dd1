"""Transactions: a pinned snapshot, own appends staged as files, own deletes, and the commit."""

from __future__ import annotations

import uuid
from concurrent.futures import Future
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.schema import FILE, RECORD_ID
from ..sources.manifest import DataFile, Snapshot, Tombstones


@dataclass
class Staged:
    """A folder of Parquet this transaction wrote: rows with provisional record ids, and the entries of its files."""

    path: str
    entries: list[DataFile]

    @property
    def rows(self) -> int:
        return sum(f.rows for f in self.entries)


@dataclass
class Pending:
    rows: list = field(default_factory=list)
    ids: list = field(default_factory=list)
    staged: list = field(default_factory=list)
    dead: list = field(default_factory=list)


class Transaction:
    """Sees its snapshot and its own changes. Use as a context manager: commits at the end, rolls back on an error."""

    def __init__(self, db, snapshot: Snapshot, run_triggers: bool = True):
        self.db, self.snapshot, self.run_triggers = db, snapshot, run_triggers
        self.state = "open"
        self.pending: dict[str, Pending] = {}
        self.next_id = dict(snapshot.next_id)
        db.pins[id(self)] = snapshot.version
        db.open[id(self)] = self

    # state

    def _open(self) -> None:
        if self.state != "open":
            raise RuntimeError(f"the transaction is {self.state}")

    def __enter__(self):
        return self

    def __exit__(self, kind, *_):
        if self.state == "open":
            self.complete() if kind is None else self.rollback()

    def _end(self, state: str) -> None:
        self.state = state
        self.db.pins.pop(id(self), None)
        self.db.open.pop(id(self), None)

    def rollback(self) -> None:
        self._open()
        try:
            for p in self.pending.values():
                for s in [*p.staged, *p.dead]:
                    self.db.files.delete(s.path)
        finally:
            self._end("rolled back")

    def _prepared(self) -> dict:
        """Runs triggers; what the commit holds. Rolls back if that fails."""
        self._open()
        try:
            if self.run_triggers:
                for schema in list(self.db.schemas.values()):
                    if schema.triggers and self.changed(schema.name):
                        for action in schema.triggers:
                            action(self.db, self)
            return self._content()
        except BaseException:
            self.rollback()
            raise

    def complete(self) -> int:
        """Runs triggers, then commits; returns the version, which is durable then. Other commits since the snapshot don't conflict:
        appends get later record ids, deletes of rows already deleted do nothing. A commit that fails rolls back."""
        return self._settle(self._prepared(), self.db.commit_rebased)

    def complete_async(self) -> Future:
        """Runs triggers now and commits in the background, with what else is waiting as one version; the version, once durable."""
        content = self._prepared()
        self.state = "completing"
        out: Future = Future()

        def run(commit) -> None:
            try:
                out.set_result(self._settle(content, commit))
            except BaseException as e:
                out.set_exception(e)

        self.db.background.put(self.snapshot, content, run)
        return out

    def _settle(self, content: dict, commit) -> int:
        try:
            some = content["add"] or content["tombstones"]
            version = commit(self.snapshot, content) if some else self.snapshot.version
        except BaseException:
            self.state = "open"
            self.rollback()
            raise
        self._end("complete")
        self.db.after_commit(content)
        return version

    def _of(self, table: str) -> Pending:
        self._open()
        self.db.schema(table)
        return self.pending.setdefault(table, Pending())

    # changes

    def new_ids(self, table: str, n: int) -> int:
        first = self.next_id.get(table, 1)
        self.next_id[table] = first + n
        return first

    def append_rows(self, table: str, rows: list[tuple]) -> list[int]:
        p = self._of(table)
        first = self.new_ids(table, len(rows))
        ids = list(range(first, first + len(rows)))
        p.rows += rows
        p.ids += ids
        return ids

    def append_df(self, table: str, df: DataFrame) -> int:
        """Rows of a DataFrame with the table's columns, written by the executors in one pass; only a partition key makes a shuffle.
        Record ids ascend within a task and leave gaps between tasks. One more pass takes the files' statistics."""
        schema = self.db.schema(table)
        p = self._of(table)
        missing = [f.name for f in schema.struct.fields if f.name not in df.columns]
        if missing or len(df.columns) != len(schema.struct.fields):
            raise ValueError(f"{table} has columns {schema.struct.fieldNames()}, not {df.columns}")
        df = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.struct.fields])
        for f in schema.struct.fields:
            if not f.nullable:
                wrong = F.raise_error(F.lit(f"{table}.{f.name} may not be null")).cast(f.dataType)
                df = df.withColumn(f.name, F.when(F.col(f.name).isNull(), wrong).otherwise(F.col(f.name)))
        if schema.partition_key:
            # files hold ranges of the key, which their statistics show to the pruning
            df = df.repartitionByRange(*schema.partition_key).sortWithinPartitions(*schema.partition_key)
        first = self.next_id.get(table, 1)
        stage = self._written(table, df.withColumn(RECORD_ID, self._task_ids(table, first)))
        if stage.entries:
            span = self.db.policies.task_ids
            tasks = -(-(max(f.first + f.rows for f in stage.entries) - first) // span)
            self.next_id[table] = max(f.first + f.rows for f in stage.entries) if tasks == 1 else first + tasks * span
        p.staged.append(stage)
        return stage.rows

    def _task_ids(self, table: str, first: int):
        """Ids from `first` on, a span for each task."""
        span = self.db.policies.task_ids
        row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        over = F.raise_error(F.lit(f"a task appends more than {span} rows to {table}")).cast("long")
        return F.when(row < span, F.spark_partition_id().cast("long") * span + row + F.lit(first)).otherwise(over)

    def _written(self, table: str, df: DataFrame) -> Staged:
        path = f"data/{table}/{uuid.uuid4().hex}"
        df.write.parquet(self.db.where(path))
        return Staged(path, self.db.described(self.db.schema(table), path))

    def _flush(self, table: str) -> None:
        p = self.pending.get(table)
        if p and p.rows:
            schema = self.db.schema(table)
            path = f"data/{table}/{uuid.uuid4().hex}"
            df = self.db.spark.createDataFrame([(*r, i) for r, i in zip(p.rows, p.ids, strict=True)], schema.stored_struct())
            df.coalesce(1).write.parquet(self.db.where(path))
            p.staged.append(Staged(path, self.db.described_rows(schema, path, p.rows, p.ids)))
            p.rows, p.ids = [], []

    def inserted(self, table: str, with_file: bool = False) -> DataFrame:
        """Rows this transaction appended and did not delete, with their record ids."""
        self._flush(table)
        p = self.pending.get(table)
        return self.db.read_files(self.db.schema(table), [f for s in p.staged for f in s.entries] if p else [], with_file)

    def tombstones(self, table: str) -> DataFrame | None:
        p = self.pending.get(table)
        return self.db.spark.read.parquet(*[self.db.where(t.path) for t in p.dead]) if p and p.dead else None

    def deleted(self, table: str) -> DataFrame:
        """Committed rows this transaction deleted; only the files that held them are read."""
        schema, dead = self.db.schema(table), self.tombstones(table)
        if dead is None:
            return self.db.read_files(schema, [])
        names = {n for t in self.pending[table].dead for n in t.files}
        rows = self.db.live_rows(self.snapshot, table, [f for f in self.snapshot.of(table) if f.name in names])
        return rows.join(dead.select(RECORD_ID), RECORD_ID, "left_semi")

    def changed(self, table: str) -> bool:
        p = self.pending.get(table)
        return bool(p and (p.rows or any(s.rows for s in p.staged) or any(t.rows for t in p.dead)))

    def delete_ids(self, table: str, ids: DataFrame) -> int:
        """ids: record id and file of rows this transaction sees. Own rows go at once; committed ones get tombstones."""
        self._flush(table)
        p = self._of(table)
        path = f"tombstones/{table}/{uuid.uuid4().hex}"
        seen = Observation()
        ids.select(F.col(RECORD_ID).cast("long").alias(RECORD_ID), FILE).observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(self.db.where(path))
        if not seen.get.get("n"):
            self.db.files.delete(path)
            return 0
        found = self.db.spark.read.schema(f"{RECORD_ID} long, {FILE} string").parquet(self.db.where(path))
        hit = {r[FILE]: r["n"] for r in found.groupBy(FILE).agg(F.count("*").alias("n")).collect()}  # a row per file
        own = {f.name for s in p.staged for f in s.entries} & set(hit)
        staged = []
        for s in p.staged:
            if not own.intersection(f.name for f in s.entries):
                staged.append(s)
                continue
            left = self.db.read_files(self.db.schema(table), s.entries).join(found, RECORD_ID, "left_anti")
            staged.append(self._written(table, left))
            self.db.files.delete(s.path)
        p.staged = [s for s in staged if s.rows]
        committed = {name: n for name, n in hit.items() if name not in own}
        if own and committed:
            rest = f"tombstones/{table}/{uuid.uuid4().hex}"
            found.where(~F.col(FILE).isin(*own)).write.parquet(self.db.where(rest))
            self.db.files.delete(path)
            path = rest
        if committed:
            p.dead.append(Tombstones(table, path, sum(committed.values()), committed, self.db.now()))
        else:
            self.db.files.delete(path)
        return sum(hit.values())

    def _content(self) -> dict:
        for table in list(self.pending):
            self._flush(table)
        add = [f.to_json() for p in self.pending.values() for s in p.staged for f in s.entries]
        dead = [t.to_json() for p in self.pending.values() for t in p.dead]
        ids = {t: self.next_id[t] for t in self.pending if t in self.next_id}
        return {"add": add, "remove": [], "tombstones": dead, "next_id": ids}
