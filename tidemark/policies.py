"""Settings of a database."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Policies:
    #: Rows a data file is filled up to by optimize(); files of fewer than a half are merged.
    file_rows: int = 5_000_000
    #: Record ids set aside for each task of an append; a task may not write more rows.
    task_ids: int = 1 << 26
    #: Tombstones up to this many are broadcast to readers; more are joined by shuffle, with the rows of the files they touch.
    broadcast_tombstones: int = 1_000_000
    #: IN lists longer than this are semi-joined instead of written into the plan.
    inline_values: int = 1_000
    #: A file is rewritten when at least this percentage of its rows is deleted,
    deleted_percent: int = 50
    #: or when some have been for this many seconds;
    deleted_seconds: float = 120.0
    #: a table's files with deleted rows all are when it has more tombstones than this.
    tombstone_rows: int = 10_000_000
    #: Small files of a table are merged when there are more than this many.
    small_files: int = 16
    #: A checkpoint is due after this many commits,
    checkpoint_commits: int = 50
    #: or once this many rows were appended, and rows deleted were this percentage of them.
    checkpoint_rows: int = 100_000
    checkpoint_percent: int = 40
    #: Attempts of a commit that others overtake.
    commit_attempts: int = 100
    #: Seconds for which background commits wait for others to share a version with.
    group_seconds: float = 0.05
    #: Versions before the newest that vacuum leaves readable, and that stay in the log.
    keep_versions: int = 10
    #: Files younger than this are never vacuumed: a transaction of another process may have staged them.
    vacuum_seconds: float = 3600.0
    #: Audit rows held in memory before they are written to a file.
    audit_rows: int = 1_000
    #: Scans that are kept in memory at a time, of queries that ask for it.
    cached_scans: int = 4
