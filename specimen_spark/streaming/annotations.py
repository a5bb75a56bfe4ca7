"""Continuous annotation state as a log of newest edits.

Each micro-batch adds a folder with its newest edit per (processid, kind) to a commit log; the newest
in the whole log, by (time, event id), is the state. So a batch writes as much as it changes, nothing is held in
memory between batches, a batch that a failure repeats changes nothing, and an edit that comes late
loses against a newer one. Cleared values stand in the log as tombstones.

Folders are merged in levels: COMPACT folders of a level become one of the next, and once all of them
hold as many bytes as the base, they and the base become the new base. Each edit is so rewritten a
number of times that grows with the logarithm of the state.

With ``lateness`` (seconds) edits older than the newest one seen by more than that are not taken, and a
merge into the base leaves out tombstones as old, which nothing can come after any more. Without it none is.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from specimen_spark.functions.commitlog import CommitLog
from specimen_spark.functions.windows import first_per_key
from specimen_spark.operators.annotate import drop_cleared, flatten_edits

KEYS = ["processid", "kind"]
EDITS = "event_id long, ts timestamp, processid string, kind string, value string, user string"
# Folders of a level that are merged into one of the next.
COMPACT = 100
BASE = -1


def newest(log: DataFrame) -> DataFrame:
    return first_per_key(log, KEYS, [F.col("ts").desc(), F.col("event_id").desc()])


def add_edits(log: CommitLog, events: DataFrame, label: str, lateness: float | None = None) -> None:
    """Commit the newest edits of a batch, then merge folders if it is time."""
    edits, facts = flatten_edits(events), {}
    if lateness is not None:
        edits = edits.filter(F.col("ts") >= _limit(log, lateness))
    entry = log.write(newest(edits), label, level=0)
    if lateness is not None:
        last = log.frame(EDITS, names=[entry["name"]]).agg(F.max(F.unix_micros("ts"))).first()[0]
        facts = {"newest": max(x for x in (last, log.record()["facts"].get("newest"), -(1 << 62)) if x is not None)}
    log.commit([entry], facts=facts)
    merge_folders(log, lateness)


def _limit(log: CommitLog, lateness: float):
    """Times before this are too late."""
    return F.timestamp_micros(F.lit(max(log.record()["facts"].get("newest", -(1 << 62)) - int(lateness * 1e6), -(1 << 55))))


def merge_folders(log: CommitLog, lateness: float | None = None) -> None:
    while True:
        folders = log.record()["folders"]
        base = sum(f["bytes"] for f in folders if f["level"] == BASE)
        others = [f for f in folders if f["level"] != BASE]
        full = [k for k in {f["level"] for f in others} if sum(f["level"] == k for f in others) >= COMPACT]
        if not full:
            return
        if sum(f["bytes"] for f in others) >= base:
            chosen, level = folders, BASE
        else:
            chosen, level = [f for f in others if f["level"] == min(full)], min(full) + 1
        names = [f["name"] for f in chosen]
        merged = newest(log.frame(EDITS, names=names))
        if level == BASE and lateness is not None:
            merged = merged.filter((F.col("ts") >= _limit(log, lateness)) | _holds())
        log.commit([log.write(merged, "merged", level=level)], names)
        log.clean()


def _holds():
    """Not a tombstone."""
    return F.when(F.col("kind") == "selected", F.lower("value") == "true").otherwise(F.col("value") != "")


def _start(events, path, checkpoint, trigger, lateness, retain_seconds, label) -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            add_edits(CommitLog(batch.sparkSession, path, retain_seconds), batch, f"{label}-{batch_id}", lateness)

    return (
        events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**trigger).start()
    )


def stream_annot_fold(
    events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None,
    lateness: float | None = None, retain_seconds: float = 3600,
) -> StreamingQuery:
    """Keep a log of newest edits below ``path``; read it with ``read_folded``.

    A reader that has opened the log can go on reading for ``retain_seconds``, whatever is merged.
    """
    return _start(events, path, checkpoint, trigger or {"processingTime": "10 seconds"}, lateness, retain_seconds, "batch")


def read_folded(spark: SparkSession, path: str) -> DataFrame:
    """Current state from the log: newest edit per key, cleared ones left out."""
    return _state(CommitLog(spark, path))


def _state(log: CommitLog, version: int | None = None) -> DataFrame:
    return drop_cleared(newest(log.frame(EDITS, version))).select(*KEYS, "value", "user", "ts")


def stream_snapshot(
    events: DataFrame, path: str, checkpoint: str, interval: str = "60 seconds",
    trigger: dict | None = None, lateness: float | None = None, retain_seconds: float = 3600,
) -> StreamingQuery:
    """Persist the annotation state once per interval in which there were edits.

    Each snapshot is a version of the log: it writes that interval's changes and names the folders that
    make up the whole state. The newest is the state to resume from.
    """
    return _start(events, path, checkpoint, trigger or {"processingTime": interval}, lateness, retain_seconds, "snapshot")


def snapshots(spark: SparkSession, path: str) -> list[int]:
    """Versions that can be read, oldest first."""
    return sorted(CommitLog(spark, path).versions())


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest snapshot, or an earlier one whose folders are still there."""
    return _state(CommitLog(spark, path), version)
