"""Commit log, annotation state under failures, and scoring with late images."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from specimen_spark.functions import commitlog
from specimen_spark.functions.commitlog import CommitLog
from specimen_spark.operators import annotate, score
from specimen_spark.streaming import annotations as stream
from specimen_spark.streaming.score import latest_scores, read_scores, stream_score, stream_score_log
from tests.helpers import FULL, SPECIMEN, TEXT
from tests.test_annotations import EDITS, EDIT_SCHEMA

ONCE = {"availableNow": True}


class Stop(Exception):
    pass


def edits(spark, rows):
    return spark.createDataFrame(rows, EDIT_SCHEMA).coalesce(1)


def state(df):
    return {(r["processid"], r["kind"]): (r["value"], r["user"], r["ts"]) for r in df.collect()}


def batch_state(spark, rows):
    return state(annotate.annot_fold(edits(spark, rows)))


def random_edits(n, seed=5, first=0):
    rng = random.Random(seed)
    kinds = ["selected", "flag", "curator_notes"]
    return [(first + i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randint(0, 500)), f"P{rng.randint(0, 12)}", rng.choice(kinds),
             rng.choice(["true", "", "data_issue", "false"]), f"u{rng.randint(0, 3)}") for i in range(n)]


def test_commits_are_whole_and_old_versions_stay_readable(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path))
    assert log.record()["version"] == -1 and log.frame(EDIT_SCHEMA).count() == 0
    a = log.write(edits(spark, EDITS[:2]), "a")
    assert log.frame(EDIT_SCHEMA).count() == 0  # no record names it yet
    log.commit([a])
    b = log.write(edits(spark, EDITS[:5]), "b")
    log.commit([b], [a["name"]], {"seen": 1})
    assert log.frame(EDIT_SCHEMA).count() == 5 and log.frame(EDIT_SCHEMA, version=0).count() == 2
    assert log.record()["facts"] == {"seen": 1} and log.versions() == [0, 1]
    with pytest.raises(RuntimeError, match="another writer"):
        log._write_record({"version": 1})
    short = CommitLog(spark, str(tmp_path), retain_seconds=0)
    short.write(edits(spark, EDITS[:1]), "orphan")
    short.commit([])
    short.clean()
    assert {p.name for p in tmp_path.iterdir()} == {"_commits", b["name"]}
    assert short.frame(EDIT_SCHEMA).count() == 5


@pytest.mark.parametrize("cut", ["before the record", "after the record", "merged folder written", "merge committed", "cleaning"])
def test_a_batch_cut_anywhere_and_replayed(spark, tmp_path, monkeypatch, cut):
    """Every batch fails once at the cut and is run again, as Spark does with a batch it has not committed."""
    monkeypatch.setattr(stream, "COMPACT", 3)
    rows = random_edits(90)
    log = CommitLog(spark, str(tmp_path), retain_seconds=0)
    real_commit, real_merge, real_clean = CommitLog.commit, stream.merge_folders, CommitLog.clean
    broken = {"at": None}

    def commit(self, add, drop=(), facts=None):
        merging = bool(drop)
        if broken["at"] == ("merged folder written" if merging else "before the record"):
            raise Stop
        version = real_commit(self, add, drop, facts)
        if broken["at"] == ("merge committed" if merging else "after the record"):
            raise Stop
        return version

    def clean(self):
        if broken["at"] == "cleaning":
            raise Stop
        real_clean(self)

    monkeypatch.setattr(CommitLog, "commit", commit)
    monkeypatch.setattr(CommitLog, "clean", clean)
    assert stream.merge_folders is real_merge
    failures = 0
    for n in range(9):
        batch = edits(spark, rows[10 * n : 10 * n + 10])
        broken["at"] = cut
        try:
            stream.add_edits(log, batch, f"batch-{n}")
        except Stop:
            failures += 1
            broken["at"] = None
            stream.add_edits(log, batch, f"batch-{n}")
        assert state(stream.read_folded(spark, str(tmp_path))) == batch_state(spark, rows[: 10 * n + 10])
    assert failures >= 2
    assert len(log.record()["folders"]) <= 6


def test_a_reader_outlives_merges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream, "COMPACT", 2)
    log = CommitLog(spark, str(tmp_path))
    rows = random_edits(40)
    stream.add_edits(log, edits(spark, rows[:10]), "batch-0")
    opened = stream.read_folded(spark, str(tmp_path))
    want = batch_state(spark, rows[:10])
    for n in range(1, 4):
        stream.add_edits(log, edits(spark, rows[10 * n : 10 * n + 10]), f"batch-{n}")
    assert state(opened) == want
    assert state(stream.read_folded(spark, str(tmp_path))) == batch_state(spark, rows)


@pytest.mark.parametrize("fold", [True, False])
def test_streams_merge_and_resume(spark, tmp_path, monkeypatch, fold):
    monkeypatch.setattr(stream, "COMPACT", 2)
    rows = random_edits(70)
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(EDIT_SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for part in range(2):
        for i in range(3):
            mine = rows[30 * part + 10 * i : 30 * part + 10 * i + 10]
            edits(spark, mine).write.parquet(str(tmp_path / "in" / f"{part}{i}"))
        if fold:
            stream.stream_annot_fold(source, out, checkpoint, ONCE).awaitTermination()
            got = stream.read_folded(spark, out)
        else:
            stream.stream_snapshot(source, out, checkpoint, trigger=ONCE).awaitTermination()
            got = stream.read_snapshot(spark, out)
        assert state(got) == batch_state(spark, rows[: 30 * part + 30])
    record = CommitLog(spark, out).record()
    assert record["version"] >= 5 and any(f["name"].startswith("merged-") for f in record["folders"])
    assert stream.snapshots(spark, out)[-1] == record["version"]


def test_a_snapshot_writes_what_changed(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path))
    when = dt.datetime(2024, 1, 1)
    many = spark.range(50_000).selectExpr(
        "id event_id", "timestamp'2024-01-01' ts", "concat('P', id) processid", "'curator_notes' kind", "concat('note ', sha2(string(id), 256)) value", "'u' user")
    stream.add_edits(log, many, "snapshot-0")
    stream.add_edits(log, edits(spark, [(60_000, when, "P1", "flag", "data_issue", "u")]), "snapshot-1")
    first, second = (f["bytes"] for f in log.record()["folders"])
    assert second < 10_000 < first / 100
    assert stream.read_snapshot(spark, str(tmp_path)).count() == 50_001
    assert stream.read_snapshot(spark, str(tmp_path), 0).count() == 50_000


def test_tombstones_expire_after_the_lateness(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream, "COMPACT", 2)
    log = CommitLog(spark, str(tmp_path))
    at = lambda minute: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)
    batches = [[(0, at(0), "A", "flag", "data_issue", "u"), (1, at(0), "B", "flag", "data_issue", "u")],
               [(2, at(5), "A", "flag", "", "u"), (3, at(3), "C", "selected", "true", "u")],
               [(4, at(60), "D", "flag", "data_issue", "u"), (5, at(4), "A", "flag", "data_issue", "late")],
               [(6, at(3), "A", "flag", "data_issue", "too late"), (7, at(61), "C", "selected", "false", "u")]]
    for n, rows in enumerate(batches):
        stream.add_edits(log, edits(spark, rows), f"batch-{n}", lateness=600)
    kept = {(r.processid, r.kind): r.value for r in stream.newest(log.frame(stream.EDITS)).collect()}
    # A's tombstone is older than 61 minutes less ten; C's is not.
    assert kept == {("B", "flag"): "data_issue", ("D", "flag"): "data_issue", ("C", "selected"): "false"}
    assert set(state(stream.read_folded(spark, str(tmp_path)))) == {("B", "flag"), ("D", "flag")}


def rows_at(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("order", list(itertools.permutations(range(3)))[:4])
def test_scores_with_images_in_any_order(spark, tmp_path, order):
    when = dt.datetime(2024, 1, 1, 12)
    specimens = [[{"processid": "P1"}, {"processid": "P2", "species": "Aus sp."}], [{"processid": "P3"}, {"processid": "P1"}], [{"processid": "P4", "nuc_basecount": "n/a"}]]
    images = [["P3", ""], ["P1", "P1", None], ["P9", "P4"]]
    schema = SPECIMEN.simpleString()[len("struct<"):-1].replace(":", " ").replace(",", ", ") + ", arrived timestamp"
    for part, mine in enumerate(specimens):
        rows = [tuple({**FULL, **r}[c] for c in TEXT) + (when + dt.timedelta(minutes=part),) for r in mine]
        rows_at(spark, rows, schema).coalesce(1).write.parquet(str(tmp_path / "specimens" / str(part)))
    for at, part in enumerate(order):
        rows_at(spark, [(p, "1", when + dt.timedelta(minutes=10 * at)) for p in images[part]], "processid string, objectid string, arrived timestamp").coalesce(1).write.parquet(
            str(tmp_path / "images" / str(at)))

    def arriving(name, fields):
        return spark.readStream.schema(fields).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / name))

    scored = stream_score(arriving("specimens", schema), arriving("images", "processid string, objectid string, arrived timestamp"))
    (scored.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(**ONCE)
     .start(str(tmp_path / "out")).awaitTermination())
    rows = spark.read.parquet(str(tmp_path / "out"))
    got = latest_scores(rows)
    batch = score.process_specimens(
        spark.read.option("recursiveFileLookup", True).schema(schema).parquet(str(tmp_path / "specimens")).dropDuplicates(["processid"]),
        spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "images")))
    columns = ["processid", "has_image", "quality_score", "criteria_met", "rank"]
    key = lambda df: sorted(tuple(r) for r in df.select(*columns).collect())
    assert key(got) == key(batch)
    assert rows.filter("processid = 'P1'").count() == 2 and rows.filter("processid = 'P2'").count() == 1


@pytest.mark.parametrize("order", list(itertools.permutations(range(3)))[2:5])
def test_logged_scores_with_images_in_any_order(spark, tmp_path, order):
    """As the joined streams, without rows in memory: a batch at a time, some of them by a second start."""
    when = dt.datetime(2024, 1, 1, 12)
    specimens = [[{"processid": "P1"}, {"processid": "P2", "species": "Aus sp."}], [{"processid": "P3"}, {"processid": "P1", "nuc": ""}], [{"processid": "P4", "nuc_basecount": "n/a"}]]
    images = [["P3", ""], ["P1", "P1", None], ["P9", "P4"]]
    schema = SPECIMEN.simpleString()[len("struct<"):-1].replace(":", " ").replace(",", ", ") + ", arrived timestamp"
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def arriving(name, fields):
        return spark.readStream.schema(fields).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / name))

    def start():
        return stream_score_log(arriving("specimens", schema), arriving("images", "processid string, arrived timestamp"), out, checkpoint, trigger=ONCE)

    for part, mine in enumerate(specimens):
        rows = [tuple({**FULL, **r}[c] for c in TEXT) + (when + dt.timedelta(minutes=part),) for r in mine]
        rows_at(spark, rows, schema).coalesce(1).write.parquet(str(tmp_path / "specimens" / str(part)))
        rows_at(spark, [(p, when + dt.timedelta(minutes=10 * part)) for p in images[order[part]]], "processid string, arrived timestamp").coalesce(1).write.parquet(
            str(tmp_path / "images" / str(part)))
        if part:
            start().awaitTermination()
    rows = read_scores(spark, out)
    first = spark.read.option("recursiveFileLookup", True).schema(schema).parquet(str(tmp_path / "specimens")).filter("not (processid = 'P1' and nuc = '')")
    batch = score.process_specimens(first, spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "images")))
    columns = ["processid", "has_image", "quality_score", "criteria_met", "rank"]
    key = lambda df: sorted(tuple(r) for r in df.select(*columns).collect())
    assert key(latest_scores(rows)) == key(batch)
    assert rows.groupBy("processid", "has_image").count().filter("count > 1").count() == 0
    assert rows.filter("processid = 'P2'").count() == 1 and not rows.filter("processid = 'P1' and has_image").isEmpty()


def test_logged_rows_are_let_go(spark, tmp_path):
    """Folders that nothing can meet any more go, late rows are not taken, and far images are no images."""
    when = dt.datetime(2024, 1, 1, 12)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    batches = [([("P1", 0)], [("P7", 0)]), ([("P2", 90)], [("P1", 70)]), ([("P3", 300)], [("P2", 120)]), ([("P4", 310), ("L", 20)], [("P3", 290)]), ([("P5", 600)], [("P5", 610)])]
    full = SPECIMEN.simpleString()[len("struct<"):-1].replace(":", " ").replace(",", ", ") + ", arrived timestamp"
    for n, (mine, pictures) in enumerate(batches):
        at = lambda m: when + dt.timedelta(minutes=m)
        rows_at(spark, [tuple({**FULL, "processid": p}[c] for c in TEXT) + (at(m),) for p, m in mine], full).write.parquet(str(tmp_path / "specimens" / str(n)))
        rows_at(spark, [(p, at(m)) for p, m in pictures], "processid string, arrived timestamp").write.parquet(str(tmp_path / "images" / str(n)))
        read = lambda name, fields: spark.readStream.schema(fields).option("recursiveFileLookup", True).parquet(str(tmp_path / name))
        stream_score_log(read("specimens", full), read("images", "processid string, arrived timestamp"), out, checkpoint, trigger=ONCE).awaitTermination()
    got = {(r.processid, r.has_image) for r in read_scores(spark, out).collect()}
    assert got == {("P1", False), ("P2", False), ("P2", True), ("P3", False), ("P3", True), ("P4", False), ("P5", True)}
    assert {f["batch"] for f in CommitLog(spark, checkpoint + "/state/log").record()["folders"]} == {2, 3, 4}
