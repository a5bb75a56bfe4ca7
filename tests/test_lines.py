"""Specimens are moved and stored as lines; their wide text is derived where it is read."""

import pytest
from pyspark.sql import functions as F

from specimen_spark.operators import annotate
from specimen_spark.plans import catalog
from specimen_spark.plans import fixture as fx
from specimen_spark.sources import retrieval, store

SF = "/root/testdata/sf0.001"


def optimized(df):
    """The plan with all columns in its text."""
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", "1000")
    text = df._jdf.queryExecution().optimizedPlan().toString()
    df.sparkSession.conf.unset("spark.sql.debug.maxToStringFields")
    return text


@pytest.mark.parametrize("name", ["src_by_dataset", "src_by_processid", "filter_selected", "filter_annotated"])
def test_semi_joins_meet_lines(spark, name):
    text = optimized(catalog.QUERIES[name](spark, SF))
    assert text.index("AS notes#") < text.index("Join LeftSemi")


@pytest.mark.parametrize("name", ["dedupe_processid", "process_import", "merge_sources"])
def test_duplicates_go_while_rows_are_lines(spark, name):
    text = optimized(catalog.QUERIES[name](spark, SF))
    assert text.index("AS notes#") < text.index("Window")


def test_exports_join_lines(spark):
    text = optimized(catalog.QUERIES["annot_merge_export"](spark, SF))
    assert text.index("taxonomy_notes#") < text.index("Join LeftOuter")


def test_widened_exports_are_the_same(spark):
    notes = catalog.annotations(spark, SF)
    lines = catalog.scored_lines(spark, SF)
    for merge in (annotate.annot_merge, annotate.annot_merge_export):
        early, late = merge(fx.widen(lines), notes), merge(lines, notes, fx.widen)
        assert early.columns == late.columns and early.count() == late.count()
        assert early.exceptAll(late).isEmpty()


def test_stored_lines_give_records(spark, tmp_path):
    lines = fx.lines(spark, SF)
    held = store.write_universe(lines, str(tmp_path / "universe"), 4, widen=fx.widen)
    assert set(spark.table(held.table).columns) == {*fx.BASE, store.PLACE}
    got, want = held.by_recordsets(["PRJ1", "PRJ3"]), retrieval.by_projects(fx.widen(lines), ["PRJ1", "PRJ3"])
    assert got.count() == want.count() > 0 and want.exceptAll(got).isEmpty()


def test_held_columns_stay(spark):
    lines = fx.lines(spark, SF).withColumns({"species": F.lit("kept"), "more": F.lit(1)})
    row = fx.widen(lines).first()
    assert row["species"] == "kept" and row["more"] == 1 and row["genus"] != "kept"


def test_streamed_state_holds_lines(spark, tmp_path):
    """The state's schema in the checkpoint names no text column."""
    held = set()
    run = catalog.new_path
    try:
        catalog.new_path = lambda s, name: str(tmp_path / name)
        assert catalog.QUERIES["stream_score_images"](spark, SF).count() > 0
    finally:
        catalog.new_path = run
    for file in (tmp_path / "score-checkpoint" / "state").rglob("*"):
        if file.is_file() and "schema" in str(file):
            held.add(b"taxonomy_notes" in file.read_bytes())
    assert held == {False}
