"""Registered queries against their check SQL, on the smallest tables.

The whole list runs with ``python tests/check_queries.py``.
"""

import pytest

import __spark_entry__ as entry_point
from specimen_spark.plans import catalog, oracle
from tests.check_queries import compare, oracle_connection

SF_DIR = "/root/testdata/sf0.001"
NAMES = [
    "src_bin_expand", "src_by_project", "merge_sources", "process_import", "validate_search_terms",
    "process_specimens", "criteria_coverage", "bags_grades", "auto_select", "group_order",
    "group_caption", "bin_content", "species_checklist", "gap_analysis", "family_summary",
    "annot_merge_export", "out_tsv_annotated", "out_bundle", "sess_list", "audit_export_history",
    "stream_annot_fold", "stream_score",
]


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF_DIR)


def test_every_query_has_check_sql():
    assert set(catalog.QUERIES) == set(oracle.oracle_sql())
    assert len(catalog.QUERIES) >= 119
    assert set(entry_point.queries()) >= set(catalog.QUERIES) and set(entry_point.oracle_sql()) >= set(catalog.QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    problems, rows = compare(
        spark, con, SF_DIR, name, entry_point.queries()[name], entry_point.oracle_sql()[name]
    )
    assert not problems and rows > 0


def test_entry(spark):
    df = entry_point.entry(spark)
    grades = {r["bags_grade"] for r in df.select("bags_grade").distinct().collect()}
    assert grades == {"A", "B", "C", "D", "E"}
