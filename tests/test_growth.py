"""What grows with the specimens is moved once and sorted in parts that fit in memory."""

import pytest
from pyspark.sql import functions as F

from specimen_spark.functions import session, storage
from specimen_spark.plans import catalog
from specimen_spark.plans import fixture as fx
from tests.test_lines import SF, optimized
from tests.test_plans import plan


def test_lines_meet_parts_without_a_sort(spark):
    text = plan(fx.join_lines(session.tune(spark), SF))
    assert "ShuffledHashJoin" in text and "SortMergeJoin" not in text


def test_a_scored_line_is_shuffled_once(spark, monkeypatch):
    monkeypatch.setattr(catalog, "written_once", lambda s, name, source, build: build())
    text = optimized(catalog.scored_lines(spark, SF))
    assert text.index("AS _line#") < text.index("Window")
    assert "_line#" not in text[text.index("Window"):]


def test_shuffle_parts_follow_the_input(spark):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    asked = int(spark.conf.get("spark.sql.shuffle.partitions"))
    session.tune(spark, 4 << 30)
    many = int(spark.conf.get(key))
    session.tune(spark, 1)
    assert many == 512 and int(spark.conf.get(key)) == asked


def test_a_small_side_is_hashed(spark):
    """The larger side of a join that shuffles is not sorted."""
    session.tune(spark)
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in keys:
        spark.conf.set(key, "-1")
    try:
        left, right = spark.range(100_000).withColumn("v", F.col("id") * 2), spark.range(0, 100_000, 7)
        text = plan(left.join(right, "id", "left_semi"))
    finally:
        for key in keys:
            spark.conf.unset(key)
    assert "ShuffledHashJoin" in text and "SortMergeJoin" not in text


def test_written_files_are_small(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(storage, "FILE_ROWS", 100)
    got = storage.written_once(spark, "small-files", str(tmp_path), lambda: spark.range(1000).coalesce(1))
    assert got.count() == 1000 and len(got.inputFiles()) == 10


@pytest.mark.parametrize("name", ["filter_selected", "filter_annotated", "out_tsv_selected", "out_tsv_annotated"])
def test_found_specimens_alone_are_scored(spark, monkeypatch, name):
    """The filter by key goes below the join with the parts; no table of all lines or scores is made for it."""
    monkeypatch.setattr(storage, "written_once", None)
    monkeypatch.setattr(catalog, "written_once", None)
    monkeypatch.setattr(fx, "written_once", None)
    text = optimized(catalog.QUERIES[name](spark, SF))
    assert text.index("p_partkey#") < text.rindex("Join LeftSemi")
    assert text.index("Window") < text.rindex("Join LeftSemi")


def test_lines_meet_edited_keys_in_one_plan_for_every_size(spark):
    text = plan(catalog.QUERIES["filter_selected"](spark, SF))
    assert "ShuffledHashJoin [processid" in text and "LeftSemi" in text and "SortMergeJoin" not in text
