"""Texts are not moved to meet small tables of marks, whatever Spark's own limit for a broadcast."""

import contextlib

import pytest
from pyspark.sql import functions as F

from specimen_spark.llm import common, jaccard, linededup
from tests.test_plans import plan


@contextlib.contextmanager
def nothing_small(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in keys:
        spark.conf.set(key, "-1")
    try:
        yield
    finally:
        for key in keys:
            spark.conf.unset(key)


@pytest.fixture()
def docs(spark):
    lines = F.concat_ws("\n", F.concat(F.lit("a line of words that all the documents share "), F.col("id") % 7), F.col("id").cast("string"))
    return spark.range(40).select(F.col("id").alias("doc_id"), lines.alias("text"))


def test_marks_go_to_the_rows(spark, docs, monkeypatch):
    bad = common.staged(docs.filter("doc_id % 3 = 0").select("doc_id"), "bad")
    with nothing_small(spark):
        out = common.without(docs, "row.doc_id", bad)
        text = plan(out)
        monkeypatch.setattr(common, "few", lambda written, most=0: written)
        moved = common.without(docs, "row.doc_id", bad)
        assert "BroadcastHashJoin" in text and "hashpartitioning" not in text
        assert out.exceptAll(moved).isEmpty() and moved.exceptAll(out).isEmpty() and out.count() == 26


def test_many_marks_meet_the_rows_in_a_join(spark):
    written = spark.range(10)
    with nothing_small(spark):
        assert "BroadcastHashJoin" in plan(spark.range(5).join(common.few(written, 10), "id"))
        assert "BroadcastHashJoin" not in plan(spark.range(5).join(common.few(written, 9), "id"))


def test_lost_lines_go_to_the_documents(spark, docs):
    with nothing_small(spark):
        out = linededup.dedup_lines(docs)
        assert "hashpartitioning" not in plan(out)
        assert out.agg(F.sum("n_removed")).first()[0] > 0


def test_needed_sets_are_made_where_the_texts_are(spark, docs, monkeypatch):
    seen, real = [], jaccard.packed_sets

    def watched(docs, needed, shingle):
        out = real(docs, needed, shingle)
        seen.append(plan(out))
        return out

    monkeypatch.setattr(jaccard, "packed_sets", watched)
    with nothing_small(spark):
        assert jaccard.linked(docs).count() == 40
    assert seen and all("hashpartitioning" not in text for text in seen)
