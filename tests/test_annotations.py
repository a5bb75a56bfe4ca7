import datetime as dt

import pytest
from pyspark.sql import functions as F

from specimen_spark import rules
from specimen_spark.operators import annotate, filters, sinks
from specimen_spark.sources import dumps
from tests.helpers import by_key, full_specimens, lit_frame, one, values

STRUCT = [
    ("P1", "flag", '{"flag": "misidentification", "timestamp": "2025-01-01", "user": "c@x.org"}'),
    ("P3", "flag", '{"flag": "data_issue", "timestamp": "2025-01-02", "user": "c@x.org"}'),
    ("P2", "curator_notes", '{"text": "Check voucher image", "user": "c@x.org"}'),
    ("P4", "curator_notes", '{"note": "Possible hybrid"}'),
    ("P1", "selected", '{"selected": "true", "quality_score": 14}'),
    ("P5", "updated_id", '{"text": "Aus bus"}'),
]
BARE = [
    ("P1", "flag", "misidentification"), ("P3", "flag", "data_issue"),
    ("P2", "curator_notes", "Check voucher image"), ("P4", "curator_notes", "Possible hybrid"),
    ("P1", "selected", "true"), ("P5", "updated_id", "Aus bus"),
]
SCHEMA = "processid string, kind string, value string"


def _specimens(spark):
    return full_specimens(spark, *[{} for _ in range(5)]).withColumn("quality_score", F.lit(10.0))


@pytest.mark.parametrize("value,fields,want", [
    (None, ["flag"], ""), ('{"flag": "a", "user": "u"}', ["flag", "value"], "a"),
    ('{"value": "b"}', ["flag", "value"], "b"), ('{"user": "u"}', ["flag", "value"], ""),
    ("c", ["flag"], "c"), ("42", ["flag"], "42"), ('{"flag": null, "value": "d"}', ["flag", "value"], "d"),
    ('{"note": "n"}', ["text", "note", "value"], "n"), ("{no json", ["flag"], "{no json"),
])
def test_extract(spark, value, fields, want):
    df = lit_frame(spark, value=value).withColumn("value", F.col("value").cast("string"))
    assert df.select(annotate.annot_extract("value", fields)).first()[0] == want


@pytest.mark.parametrize("rows", [STRUCT, BARE])
def test_merge(spark, rows):
    got = by_key(annotate.annot_merge(_specimens(spark), spark.createDataFrame(rows, SCHEMA)))
    assert {k: v["flag"] for k, v in got.items()} == {"P1": "misidentification", "P2": "", "P3": "data_issue", "P4": "", "P5": ""}
    assert got["P2"]["curator_notes"] == "Check voucher image" and got["P4"]["curator_notes"] == "Possible hybrid"
    assert got["P1"]["selected"] is True and got["P2"]["selected"] is False
    assert got["P5"]["updated_id"] == "Aus bus" and got["P1"]["identification"] is None


def test_merge_without_annotations_and_order(spark):
    none = spark.createDataFrame([], SCHEMA)
    df = annotate.annot_merge(_specimens(spark), none)
    assert df.columns[: len(rules.CURATOR_COLUMNS)] == rules.CURATOR_COLUMNS
    row = df.first()
    assert (row["selected"], row["flag"], row["updated_id"], row["curator_notes"]) == (False, "", "", "")
    unknown = spark.createDataFrame([("NOBODY", "flag", "data_issue")], SCHEMA)
    assert set(values(annotate.annot_merge(_specimens(spark), unknown), "flag")) == {""}


def test_merge_export(spark):
    df = _specimens(spark).withColumn("site", F.lit("<b>x</b> & <i>y</i>")).withColumn(
        "tags", F.array(F.lit("a"), F.lit("b"))
    )
    full = annotate.annot_merge_export(df, spark.createDataFrame(STRUCT, SCHEMA))
    assert full.columns[:6] == rules.EXPORT_ANNOTATION_COLUMNS
    got = by_key(full)
    assert (got["P1"]["flag_user"], got["P1"]["flag_timestamp"]) == ("c@x.org", "2025-01-01")
    assert (got["P2"]["flag_user"], got["P2"]["flag_timestamp"]) == ("", "")
    assert got["P1"]["site"] == "x & y" and got["P1"]["tags"] == "a; b"
    bare = by_key(annotate.annot_merge_export(df, spark.createDataFrame(BARE, SCHEMA)))
    assert bare["P1"]["flag"] == "misidentification" and bare["P1"]["flag_user"] == ""
    again = annotate.annot_merge_export(full, spark.createDataFrame(STRUCT, SCHEMA))
    assert again.columns == full.columns and by_key(again) == got
    display = by_key(annotate.annot_merge(df, spark.createDataFrame(STRUCT, SCHEMA)))
    assert {k: v["flag"] for k, v in display.items()} == {k: v["flag"] for k, v in got.items()}


def _edit(i, minute, pid, kind, value):
    return (i, dt.datetime(2024, 1, 1, 0, minute), pid, kind, value, "u")


EDITS = [
    _edit(1, 1, "P1", "flag", "data_issue"), _edit(2, 3, "P1", "flag", '{"flag": "synonym"}'),
    _edit(3, 2, "P1", "flag", "other_issue"), _edit(4, 1, "P2", "selected", "true"),
    _edit(5, 2, "P2", "selected", ""), _edit(6, 1, "P3", "curator_notes", "a"),
    _edit(7, 1, "P3", "curator_notes", "b"), _edit(8, 4, "P4", "updated_id", '{"text": ""}'),
    _edit(9, 1, "P4", "updated_id", "Aus"), _edit(10, 1, "P5", "selected", '{"selected": true}'),
]
EDIT_SCHEMA = "event_id long, ts timestamp, processid string, kind string, value string, user string"


def test_fold(spark):
    state = annotate.annot_fold(spark.createDataFrame(EDITS, EDIT_SCHEMA))
    assert {(r["processid"], r["kind"]): r["value"] for r in state.collect()} == {
        ("P1", "flag"): "synonym", ("P3", "curator_notes"): "b", ("P5", "selected"): "true",
    }
    assert {r["kind"]: r["specimens"] for r in annotate.annot_counts(state).collect()} == {
        "flag": 1, "curator_notes": 1, "selected": 1,
    }
    assert annotate.has_annotations(state) and not annotate.has_annotations(state.filter("false"))


def test_validate_and_labels(spark):
    rows = [("P1", "flag", "bogus"), ("P2", "flag", "synonym"), ("P1", "curator_notes", "x" * 1001),
            ("P2", "curator_notes", "x" * 1000), ("P9", "selected", "true"), ("P1", "selected", "true")]
    ann = spark.createDataFrame(rows, SCHEMA)
    bad = annotate.annot_validate(ann, _specimens(spark))
    assert {(r["processid"], r["kind"]) for r in bad.collect()} == {("P1", "flag"), ("P1", "curator_notes"), ("P9", "selected")}
    labels = {r["flag"]: r["label"] for r in annotate.annot_flag_labels(ann).collect()}
    assert labels == {"bogus": "bogus", "synonym": "Synonym"}
    assert annotate.flag_options(spark).count() == 6


def test_filters(spark):
    ann = spark.createDataFrame(BARE, SCHEMA)
    df = _specimens(spark)
    assert values(filters.filter_selected(df, ann), "processid") == ["P1"]
    assert sorted(values(filters.filter_annotated(df, ann), "processid")) == ["P1", "P2", "P3", "P4", "P5"]
    only_selected = ann.filter("kind = 'selected'")
    assert filters.filter_annotated(df, only_selected).count() == 0


def test_scored_filters(spark):
    df = spark.createDataFrame(
        [("a", 1, 9.0, "SITE; COORD"), ("b", 2, 3.0, "SITE"), ("c", 2, 0.0, ""), ("d", 7, 1.0, None)],
        "processid string, rank int, quality_score double, criteria_met string",
    )
    assert filters.filter_rank(df, 2).count() == 2 and filters.filter_rank(df, "All").count() == 4
    assert filters.filter_min_score(df, 3).count() == 2 and filters.filter_min_score(df, 0).count() == 4
    assert values(filters.filter_criteria(df, ["COORD", "SITE"]), "processid") == ["a"]
    assert filters.filter_criteria(df, []).count() == 4
    wide = df.withColumns({"species": F.when(F.col("rank") == 1, "x"), "bin_uri": F.when(F.col("rank") < 7, F.lit(""))})
    assert one(filters.filtered_metrics(wide)) == {
        "total_specimens": 4, "unique_species": 2, "unique_bins": 1, "avg_quality": 3.25, "bin_coverage": 0.0,
    }


def test_annotation_source(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{"processid": "P1", "kind": "flag", "value": {"flag": "synonym", "user": "u", "timestamp": "2025-01-01"}}\n'
        '{"processid": "P2", "kind": "flag", "value": "data_issue"}\n'
        '{"processid": "P3", "kind": "curator_notes", "value": 42}\n'
    )
    got = by_key(dumps.read_annotations(spark, str(tmp_path)))
    assert (got["P1"]["value"], got["P1"]["user"], got["P1"]["ts"]) == ("synonym", "u", "2025-01-01")
    assert (got["P2"]["value"], got["P2"]["user"], got["P2"]["ts"]) == ("data_issue", "", "")
    assert got["P3"]["value"] == "42"


def test_exports(spark, tmp_path):
    df = _specimens(spark).withColumns(
        {"identification": F.when(F.col("processid") == "P1", "Aus aus"), "sampleid": F.lit("S"),
         "site": F.lit("a\tb\nc"), "nuc": F.when(F.col("processid") != "P5", F.lit("ACGT")).otherwise("")}
    )
    ann = spark.createDataFrame(STRUCT, SCHEMA)
    sinks.write_tsv(sinks.tsv_all(df, ann), str(tmp_path / "all"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "all").glob("part-*")))
    lines = text.strip("\n").split("\n")
    header = lines[0].split("\t")
    assert header[:6] == rules.EXPORT_ANNOTATION_COLUMNS and "country.ocean" in header
    body = [l.split("\t") for l in lines if not l.startswith("selected\t")]
    assert len(body) == 5 and all(len(l) == len(header) for l in body)
    assert {l[0] for l in body} == {"TRUE", "FALSE"} and body[0][header.index("site")] == "a b c"
    assert sinks.tsv_selected(df, ann).count() == 1 and sinks.tsv_annotated(df, ann).count() == 5
    assert sinks.curation_report(df, ann).columns == rules.REPORT_COLUMNS
    assert sinks.curation_report(df.drop("sampleid"), ann).columns == rules.REPORT_COLUMNS[1:]
    assert "nuc" not in sinks.export_columns(df).columns and "nuc" in sinks.export_columns(df, True).columns
    assert "institution" in sinks.export_columns(df).columns
    records = sorted(values(sinks.fasta(df), "record"))
    assert records[0] == ">P1|Aus aus\nACGT" and records[1] == ">P2|Unknown\nACGT" and len(records) == 4
    assert sinks.fasta(df.drop("identification")).first()[0].startswith(">P1|Homo sapiens")
    assert sinks.fasta(df.drop("nuc")).count() == 0
    assert values(sinks.fasta_selected(df, ann), "record") == [">P1|Aus aus\nACGT"]
    full = sinks.fasta_full(df.withColumn("bin_uri", F.lit(None).cast("string"))).first()[0]
    assert full == ">P1|Homo sapiens|NA|Canada|2020-01-01\nACGT"
    sinks.write_fasta(sinks.fasta(df), str(tmp_path / "fa"))
    assert spark.read.text(str(tmp_path / "fa")).count() == 8


def test_bundle_and_log(spark, tmp_path):
    df = _specimens(spark)
    manifest = sinks.write_bundle({"Specimens": df, "Summary": None, "BAGS_Summary": df.limit(2)}, str(tmp_path / "b"))
    assert {r["table"]: r["records"] for r in manifest.collect()} == {"Specimens": 5, "BAGS_Summary": 2}
    assert spark.read.parquet(str(tmp_path / "b" / "Specimens")).count() == 5
    with pytest.raises(ValueError):
        sinks.write_bundle({"Summary": None}, str(tmp_path / "c"))
    log = str(tmp_path / "log")
    ok = sinks.logged_export(spark, log, sinks.write_csv, df, str(tmp_path / "csv"), export_type="csv", format="csv", file_name="x.csv")

    def fail(frame, path):
        raise IOError("disk full")

    bad = sinks.logged_export(spark, log, fail, df, str(tmp_path / "no"), export_type="tsv", format="tsv", file_name="y.tsv")
    assert ok and not bad
    rows = by_key(spark.read.parquet(log), "file_name")
    assert rows["x.csv"]["record_count"] == 5 and rows["x.csv"]["file_size"] > 0 and rows["x.csv"]["success"]
    assert rows["y.tsv"]["error_message"] == "disk full" and rows["y.tsv"]["record_count"] == 0
