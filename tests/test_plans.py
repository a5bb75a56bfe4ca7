"""Plans stay on the JVM, prune columns, combine before shuffling and share shuffles."""

import re

import pytest
from pyspark.sql import functions as F

from specimen_spark.functions.windows import first_per_key
from specimen_spark.operators import bins, geo, grade, score, species
from specimen_spark.sources import lists
from tests.helpers import full_specimens


def plan(df):
    df.toArrow()  # runs it, so the adaptive plan is the final one
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    df = full_specimens(spark, *[{"species": f"Aus s{i % 5}", "bin_uri": f"b{i % 7}"} for i in range(40)])
    df = df.withColumns({"family": F.lit("F"), "order": F.lit("O"), "genus": F.lit("Aus"), "rec_key": F.col("processid")})
    path = str(tmp_path_factory.mktemp("plans") / "scored")
    score.process_specimens(df).write.parquet(path)
    return spark.read.parquet(path)


def test_scoring_needs_no_shuffle_and_no_python(table):
    text = plan(score.process_specimens(table.drop("quality_score", "criteria_met", "rank")))
    assert "Exchange" not in text and "Python" not in text and "BatchEval" not in text


def test_first_per_key_is_limited_before_the_shuffle(table):
    text = plan(first_per_key(table, "processid", [F.col("rec_key")]))
    assert len(re.findall("WindowGroupLimit", text)) == 2
    assert text.index("WindowGroupLimit") < text.index("Exchange") < text.rindex("WindowGroupLimit")


def test_grades_read_three_columns_once(table):
    text = plan(grade.bags_grades(table))
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", text)
    assert len(scans) == 1 and "ReusedExchange" in text
    assert len(scans[0].split(",")) == 3


def test_content_is_combined_before_the_shuffle(table):
    text = plan(bins.bin_content(table))
    assert "partial_count(1)" in text and "Cartesian" not in text and "NestedLoop" not in text


def test_no_cross_join_in_reports(table):
    groups = lists.taxon_groups(table.select(F.monotonically_increasing_id().alias("line_no"), F.col("species").alias("text")))
    for df in (
        species.species_checklist(table, grade.bags_grades(table)), species.family_summary(table),
        species.gap_analysis(groups, table), score.quality_metrics(table), geo.search_metrics(table),
        geo.size_gate(table), score.criteria_coverage(table),
    ):
        text = plan(df)
        assert "Cartesian" not in text and "NestedLoop" not in text and "Python" not in text


def test_filters_reach_the_scan(table):
    text = plan(grade.auto_select(table))
    assert "PushedFilters" in text and "IsNotNull(bin_uri)" in text
