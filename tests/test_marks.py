"""Requests are marks on one frame, so rows move once however many requests there are."""

import re

import pytest

from specimen_spark.operators import merge
from specimen_spark.plans import catalog, curation
from specimen_spark.sources import retrieval
from tests.test_lines import SF, optimized

ROWS = [
    ("P1", "r1", "DS-A", "Aus", "Aus bus"), ("P1", "r0", "PRJ1", "Cus", "Cus dus"), ("P2", "r2", "PRJ1", "Cus", "Cus dus"),
    ("P3", "r4", "X", "Aus", "Aus bus"), ("P3", "r3", "X", "Eus", None), ("P4", "r5", "X", "Eus", None),
    (None, "r6", "X", "Aus", "Aus bus"), (None, "r7", "DS-A, PRJ1", "Eus", ""), ("P5", "r8", None, None, None),
]


@pytest.mark.parametrize("broadcast", [0, 1_000_000])
def test_marked_requests_give_what_a_union_of_them_gives(spark, monkeypatch, broadcast):
    monkeypatch.setattr(retrieval, "MAX_BROADCAST", broadcast)
    u = spark.createDataFrame(ROWS, f"processid string, rec_key string, {retrieval.RECORDSET_COLUMN} string, genus string, species string")
    names = spark.createDataFrame([(" aus bus ",), ("Nomen absens",)], "name string")
    sources = [retrieval.by_datasets(u, ["DS-A"]), retrieval.by_projects(u, ["PRJ1"]), retrieval.by_taxa(u, names)]
    for asked in ((0, 1, 2), (0,), (1, 2), (2,)):
        given = {k: v for i, (k, v) in enumerate([("datasets", ["DS-A"]), ("projects", ["PRJ1"]), ("taxa", names)]) if i in asked}
        got = curation.merged(u, tie=["rec_key"], **given)
        want = merge.merge_sources([sources[i] for i in asked], tie=["rec_key"])
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_lines_are_not_repeated_per_request(spark):
    text = optimized(catalog.QUERIES["merge_sources"](spark, SF))
    assert "Union" not in text and "LeftSemi" not in text


def test_expansion_and_duplicates_take_one_window(spark):
    text = optimized(catalog.QUERIES["retrieve_specimens"](spark, SF))
    assert "LeftAnti" not in text and len(re.findall(r"Window \[", text)) == 1
