"""Incremental maintenance: triggers that keep a summary table, and the change log as rows or as a stream of versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.schema import FILE, RECORD_ID
from ..operators.verbs import signed_totals
from ..sources.manifest import DataFile, Tombstones


def summary_trigger(source: str, target: str, keys: list[str], value: str | None = None, into: str = "total", compact: bool = True):
    """A trigger for `source` that keeps sums of value (or counts) by keys in `target`.

    A commit's inserted and deleted rows give signed partial sums. compact replaces the touched keys' rows; without it the
    differences are appended, and readers add them up.
    """

    def run(db, tx) -> None:
        delta = signed_totals(tx.inserted(source), tx.deleted(source), keys, value, "delta_")
        schema = db.schema(target)
        kind = schema.field(into).dataType
        if compact:
            held = db.table(target).query(tx).rows_with_files()
            keyed = delta.select(*[F.col(k).alias(f"{k}_") for k in keys])
            touched = held.join(keyed, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys], "left_semi")
            old = touched.select(*keys, F.col(into).alias("delta_"))
            fresh = old.unionByName(delta.select(*keys, "delta_")).groupBy(*keys).agg(F.sum("delta_").alias(into)).where(F.col(into) != 0)
            # `touched` keeps to the files there were before the new rows; the one file's task neither joins nor groups
            tx.append_df(target, fresh.select(*keys, F.col(into).cast(kind).alias(into)).repartition(1))
            tx.delete_ids(target, touched.select(RECORD_ID, FILE))
        else:
            tx.append_df(target, delta.select(*keys, F.col("delta_").cast(kind).alias(into)))

    return run


def count_trigger(target: str):
    """A trigger that appends one row of 1 to `target` each time it fires."""

    def run(db, tx) -> None:
        tx.append_rows(target, [(1,)])

    return run


def changes(db, table: str, after: int = 0, until: int | None = None) -> DataFrame:
    """Rows inserted or deleted by each user commit after a version: the table's columns, change and version, in commit order.

    Each commit's own lists say what to read: files it added, and of the tombstones it added the files they touch. Rewrites change no
    rows and don't show. Versions whose files vacuum removed can't be read.
    """
    schema = db.schema(table)
    commits, _ = db.manifest.versions()
    wanted = [c for c in commits if c > after and (until is None or c <= until)]
    added: list[tuple] = []
    dead: list[tuple] = []
    held: dict[str, DataFile] = {}
    rewritten = False
    snap = db.manifest.snapshot(wanted[0] - 1) if wanted else None
    for v in wanted:
        content = db.manifest.commit_of(v)
        if content.get("rewrite"):
            rewritten = True
        else:
            added += [(v, DataFile.from_json(f)) for f in content["add"] if f["table"] == table]
            fresh = [Tombstones(**t) for t in content["tombstones"] if t["table"] == table]
            if fresh:
                dead += [(v, t) for t in fresh]
                names = {n for t in fresh for n in t.files}
                held |= {f.name: f for f in snap.of(table) if f.name in names}
        snap = snap.with_commit(v, content)
    marked = lambda df, kind: df.withColumn("change", F.lit(kind))
    # one scan of all files; a file's name tells its version
    versions = db.spark.createDataFrame([(f.name, v) for v, f in added], "file_ string, version long")
    inserts = db.read_files(schema, [f for _, f in added], True).join(F.broadcast(versions), F.col(FILE) == F.col("file_")).drop("file_", FILE)
    out = marked(inserts, "insert")
    if dead:
        ids = None
        for v, t in dead:
            one = db.spark.read.schema(f"{RECORD_ID} long").parquet(db.where(t.path)).withColumn("version", F.lit(v).cast("long"))
            ids = one if ids is None else ids.unionByName(one)
        # a row deleted by two commits went with the first
        ids = ids.groupBy(RECORD_ID).agg(F.min("version").alias("version"))
        gone = db.read_files(schema, list(held.values()))
        # a rewrite in between may have left a row in two of the files
        gone = gone.dropDuplicates([RECORD_ID]) if rewritten else gone
        out = out.unionByName(marked(gone.join(ids, RECORD_ID), "delete"))
    return out


def watch(db, table: str, action, after: int = 0):
    """Runs action(changes, version) once for what is new since a version; the version to go on from."""
    now = db.manifest.snapshot().version
    if now > after:
        action(changes(db, table, after, now), now)
    return now


def stream(db, table: str, action, checkpoint: str, once: bool = False):
    """A structured streaming query over the change log: action(changes, batch) runs for the commits of each micro-batch, in order.

    The log's version files are the stream's source, so offsets, restarts and the trigger are Spark's own; a micro-batch collects the
    versions' numbers only. A batch that is run again after a failure has the same versions. Start it before versions expire.
    """
    log = db.spark.readStream.format("text").schema("value string").option("wholetext", True).option("pathGlobFilter", "*.json").load(db.where("_log"))
    numbered = log.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)\.json$", 1).cast("long").alias("version"))

    def run(batch: DataFrame, number: int) -> None:
        versions = sorted(r["version"] for r in batch.collect())
        if versions:
            found = changes(db, table, versions[0] - 1, versions[-1])
            action(found.where(F.col("version").isin(versions)) if len(versions) <= versions[-1] - versions[0] else found, number)

    writer = numbered.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
