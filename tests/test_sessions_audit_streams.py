import datetime as dt

from pyspark.sql import functions as F

from specimen_spark.operators import annotate, audit, score, sessions
from specimen_spark.streaming import annotations as stream
from specimen_spark.streaming.score import stream_score
from tests.helpers import SPECIMEN, by_key, full_specimens, one, values
from tests.test_annotations import EDITS, EDIT_SCHEMA

ONCE = {"availableNow": True}
WHO = {"email": "Curator@X.org", "name": "Ann Lee", "orcid": "0000-1"}


def test_session_round_trip(spark, tmp_path):
    root = str(tmp_path)
    assert sessions.load_session(spark, root, "s1") is None
    assert sessions.read_sessions(spark, root).count() == 0
    df = full_specimens(spark, {}, {"species": None}).select("processid", "species")
    sessions.save_session(root, "s1", {"specimen_data": df, "bags_grades": None}, WHO, "2024-01-01T00:00:00", spark)
    sessions.save_session(root, "s1", {"specimen_data": df.filter("processid = 'P1'")}, WHO, "2024-02-01T00:00:00", spark)
    sessions.save_session(root, "s2", {}, {}, "2024-03-01T00:00:00", spark)
    state = sessions.load_session(spark, root, "s1")
    assert set(state) == {"metadata", "specimen_data"} and state["specimen_data"].count() == 1
    meta = one(state["metadata"])
    assert (meta["created_at"], meta["updated_at"]) == ("2024-01-01T00:00:00", "2024-02-01T00:00:00")
    assert (meta["specimen_count"], meta["species_count"]) == (1, 1)
    listed = sessions.list_sessions(sessions.read_sessions(spark, root))
    assert [r["session_id"] for r in listed.collect()] == ["s2", "s1"]
    assert sessions.expire_sessions(spark, root, "2024-03-15T00:00:00", 30) == 1
    assert sessions.load_session(spark, root, "s1") is None
    assert values(sessions.read_sessions(spark, root), "session_id") == ["s2"]
    assert not list((tmp_path / "tables").glob("*/session_id=s1"))


def test_a_session_is_saved_from_its_own_tables(spark, tmp_path):
    root = str(tmp_path)
    df = full_specimens(spark, {}, {"species": None}, {}).select("processid", "species")
    who = {**WHO, "search_taxa": ["Aus bus", "Cus"]}
    sessions.save_session(root, "s1", {"specimen_data": df}, who, "2024-01-01T00:00:00", spark)
    for n in (2, 1, 0):
        state = sessions.load_session(spark, root, "s1")
        assert state["search_taxa"] == ["Aus bus", "Cus"]
        kept = state["specimen_data"].limit(n)
        sessions.save_session(root, "s1", {"specimen_data": kept}, who, f"2024-02-0{3 - n}T00:00:00", spark)
        assert sessions.load_session(spark, root, "s1")["specimen_data"].count() == n
    bad = df.withColumn("species", F.raise_error(F.lit("no")))
    try:
        sessions.save_session(root, "s1", {"bags_grades": df, "specimen_data": bad}, who, "2024-03-01T00:00:00", spark)
        raise AssertionError("the save must fail")
    except Exception as error:
        assert "no" in str(error)
    assert set(sessions.load_session(spark, root, "s1")) == {"metadata", "specimen_data", "search_taxa"}
    assert one(sessions.read_sessions(spark, root))["updated_at"] == "2024-02-03T00:00:00"


def test_expiry_of_many_sessions(spark, tmp_path):
    """Jobs, driver calls and rewritten buckets do not grow with the sessions."""
    root = str(tmp_path)
    for name, day in (("kept", "2024-03-10"), ("edge", "2024-02-14"), ("gone", "2024-02-01")):
        sessions.save_session(root, name, {"specimen_data": spark.range(3).selectExpr("string(id) species")}, WHO, f"{day}T00:00:00", spark)
    many = spark.range(100_000).selectExpr(
        "'2024-01-01T00:00:00' created_at", "concat('2024-01-0', 1 + id % 9, 'T00:00:00') updated_at", "'' user_email", "'' user_name", "'' user_orcid",
        "0L specimen_count", "0L species_count", "'' search_taxa", "string(id) version", "concat('2024-01-0', 1 + id % 9) day", "concat('s', id) session_id")
    many.withColumn("bucket", sessions._bucket(F.col("session_id"))).write.mode("append").partitionBy("bucket").parquet(f"{root}/sessions")
    calls, real = [], sessions.delete
    sessions.delete = lambda s, p: (calls.append(p), real(s, p))
    try:
        assert sessions.expire_sessions(spark, root, "2024-03-15T00:00:00", 30) == 100_001
    finally:
        sessions.delete = real
    assert len(calls) == 1
    assert sorted(values(sessions.read_sessions(spark, root), "session_id")) == ["edge", "kept"]
    assert sessions.load_session(spark, root, "gone") is None and sessions.load_session(spark, root, "kept")["specimen_data"].count() == 3
    assert sessions.expire_sessions(spark, root, "2024-03-15T00:00:00", 30) == 0
    assert sessions.expire_sessions(spark, root, "2030-01-01T00:00:00", 30) == 2
    assert sessions.read_sessions(spark, root).count() == 0 and not list((tmp_path / "tables").iterdir())


def test_a_failed_save_between_two_keeps_the_earlier_version(spark, tmp_path):
    root, df = str(tmp_path), spark.range(4).selectExpr("string(id) species")
    sessions.save_session(root, "s", {"specimen_data": df}, WHO, "2024-01-01T00:00:00", spark)
    read = sessions.load_session(spark, root, "s")["specimen_data"]
    try:
        sessions.save_session(root, "s", {"specimen_data": df.withColumn("species", F.raise_error(F.lit("no")))}, WHO, "2024-01-02T00:00:00", spark)
    except Exception as error:
        assert "no" in str(error)
    sessions.save_session(root, "s", {"specimen_data": df.limit(1)}, WHO, "2024-01-03T00:00:00", spark)
    assert read.count() == 4 and sessions.load_session(spark, root, "s")["specimen_data"].count() == 1


def test_filter_by_user(spark):
    md5 = spark.sql("select md5('ann lee')").first()[0]
    rows = [("a", "curator@x.org", "Zed", ""), ("b", "", "ann lee ", ""), ("c", "", "", "0000-1"), (md5, "", "", ""), ("d", "", "", "")]
    df = spark.createDataFrame(rows, "session_id string, user_email string, user_name string, user_orcid string")
    find = lambda **k: set(values(sessions.filter_sessions_by_user(df, **k), "session_id"))
    assert find(email=" Curator@X.org") == {"a"} and find(orcid="0000-1 ") == {"c"}
    assert find(name="Ann Lee") == {"b", md5} and find(email="curator@x.org", orcid="0000-1") == {"a", "c"}
    assert find() == set() and find(email=" ") == set()


def test_expiry_is_strict(spark):
    df = spark.createDataFrame([("a", "2024-01-01T00:00:00"), ("b", "2023-12-31T23:59:59")], "session_id string, updated_at string")
    assert values(sessions.expired_sessions(df, "2024-01-31T00:00:00", 30), "session_id") == ["b"]


def test_audit(spark):
    t = lambda d: dt.datetime(2024, 1, d, 12)
    rows = [(t(1), "EXPORT", "tsv", "tsv", 10, 1024 * 1024, True), (t(2), "EXPORT", "excel", "xlsx", 5, 3 * 1024 * 1024, False),
            (t(3), "EXPORT", "tsv", "tsv", 1, 0, True), (t(3), "INFO", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "timestamp timestamp, level string, export_type string, format string, record_count long, file_size long, success boolean")
    assert audit.audit_filter(df, "INFO").count() == 1 and audit.audit_filter(df).count() == 4
    assert [r["timestamp"].day for r in audit.export_history(df).collect()] == [3, 2, 1]
    assert audit.export_history(df, "2024-01-02", "2024-01-02").count() == 1
    assert audit.export_history(df, export_type="tsv", format="All").count() == 2
    assert audit.export_history(df, limit=1).count() == 1
    assert one(audit.export_stats(df)) == {
        "total_exports": 3, "successful_exports": 2, "success_rate": 66.7, "total_records_exported": 16, "avg_size_mb": 1.33,
    }
    assert one(audit.export_stats(df, "2030-01-01"))["success_rate"] is None


def _edit_batches(spark, tmp_path):
    """The edits in three files, late ones last."""
    for i, part in enumerate((EDITS[1:2] + EDITS[4:6], EDITS[6:8] + EDITS[9:], EDITS[0:1] + EDITS[2:4] + EDITS[8:9])):
        spark.createDataFrame(part, EDIT_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    return (
        spark.readStream.schema(EDIT_SCHEMA).option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    )


def _state(df):
    return {(r["processid"], r["kind"]): r["value"] for r in df.collect()}


def test_stream_fold_equals_batch_fold(spark, tmp_path):
    events = _edit_batches(spark, tmp_path)
    stream.stream_annot_fold(events, str(tmp_path / "out"), str(tmp_path / "cp"), ONCE).awaitTermination()
    assert len(list((tmp_path / "out").glob("batch-*"))) == 3
    want = _state(annotate.annot_fold(spark.createDataFrame(EDITS, EDIT_SCHEMA)))
    assert _state(stream.read_folded(spark, str(tmp_path / "out"))) == want
    # later edits continue from the checkpoint; a late edit does not revive a cleared value
    late = [(20, dt.datetime(2023, 1, 1), "P2", "selected", "true", "u"), (21, dt.datetime(2025, 1, 1), "P1", "flag", "", "u")]
    spark.createDataFrame(late, EDIT_SCHEMA).write.parquet(str(tmp_path / "in" / "9"))
    stream.stream_annot_fold(events, str(tmp_path / "out"), str(tmp_path / "cp"), ONCE).awaitTermination()
    want.pop(("P1", "flag"))
    assert _state(stream.read_folded(spark, str(tmp_path / "out"))) == want


def test_snapshot(spark, tmp_path):
    events = _edit_batches(spark, tmp_path)
    stream.stream_snapshot(events, str(tmp_path / "out"), str(tmp_path / "cp"), trigger=ONCE).awaitTermination()
    want = _state(annotate.annot_fold(spark.createDataFrame(EDITS, EDIT_SCHEMA)))
    assert _state(stream.read_snapshot(spark, str(tmp_path / "out"))) == want


def test_snapshot_of_cleared_state_is_empty(spark, tmp_path):
    set_ = [(0, dt.datetime(2023, 1, 1), "P1", "flag", "data_issue", "u")]
    spark.createDataFrame(set_, EDIT_SCHEMA).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(EDIT_SCHEMA).parquet(str(tmp_path / "in"))
    stream.stream_snapshot(events, str(tmp_path / "out"), str(tmp_path / "cp"), trigger=ONCE).awaitTermination()
    assert _state(stream.read_snapshot(spark, str(tmp_path / "out"))) == {("P1", "flag"): "data_issue"}
    cleared = [(1, dt.datetime(2024, 1, 1), "P1", "flag", "", "u")]
    spark.createDataFrame(cleared, EDIT_SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
    stream.stream_snapshot(events, str(tmp_path / "out"), str(tmp_path / "cp"), trigger=ONCE).awaitTermination()
    assert stream.read_snapshot(spark, str(tmp_path / "out")).count() == 0


def test_stream_score_equals_batch(spark, tmp_path):
    df = full_specimens(spark, {}, {"nuc_basecount": "n/a"}, {"species": "Aus sp."})
    df.write.parquet(str(tmp_path / "in"))
    images = spark.createDataFrame([("P1", "1")], "processid string, objectid string")
    arriving = spark.readStream.schema(SPECIMEN).parquet(str(tmp_path / "in"))
    (
        stream_score(arriving, images).writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(**ONCE).start(str(tmp_path / "out")).awaitTermination()
    )
    assert by_key(spark.read.parquet(str(tmp_path / "out"))) == by_key(score.process_specimens(df, images))


def test_export_log_pages_and_days(spark, tmp_path):
    from specimen_spark.operators import sinks

    log = str(tmp_path / "log")
    rows = [(dt.datetime(2024, 1, 1 + i // 4, 10, i % 2), "EXPORT", f"f{i:02d}", "tsv", "tsv", i, 1, True, dt.date(2024, 1, 1 + i // 4)) for i in range(20)]
    frame = spark.createDataFrame(rows, "timestamp timestamp, level string, file_name string, export_type string, format string, record_count long, file_size long, success boolean, day date")
    frame.write.partitionBy("day").parquet(log)
    sinks.append_export_log(spark, log, {"timestamp": dt.datetime(2024, 1, 6, 9), "file_name": "last", "export_type": "tsv", "format": "tsv", "success": True})
    stored = sinks.read_export_log(spark, log)
    assert stored.count() == 21
    ranged = audit.export_history(stored, "2024-01-02", "2024-01-03", tie="file_name")
    plan = ranged._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and ranged.count() == 8
    seen, key = [], None
    while True:
        page = audit.export_history(stored, limit=6, tie="file_name", after=key)
        found = values(page, "file_name")
        if not found:
            break
        seen += found
        key = audit.page_key(page, "file_name")
    assert seen == values(audit.export_history(stored, tie="file_name"), "file_name") and len(seen) == 21
    assert audit.page_key(stored.limit(0)) is None
