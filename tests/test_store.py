"""The stored universe gives what retrieval from the plain one gives, from fewer files."""

import re

import pytest
from pyspark.sql import functions as F

from specimen_spark.sources import retrieval, store

SCHEMA = ("processid string, bin_uri string, order string, family string, genus string, species string, "
          "bold_recordset_code_arr string, seq long")


@pytest.fixture(scope="module")
def universe(spark):
    rows = []
    for i in range(2000):
        g = i % 40
        bin_uri = None if i % 17 == 0 else "" if i % 19 == 0 else f"BIN:{i % 200}"
        codes = {0: "DS-A, PRJ1", 1: " PRJ1", 2: None, 3: ""}.get(i % 500, f"DS-{i % 7}")
        rows.append((f"P{i // 2 if i < 60 else i}", bin_uri, f"Order{g % 3}", f"Family{g % 9}", f"Genus{g}", None if i % 23 == 0 else f"Genus{g} s{i % 80}", codes, i))
    rows += [(None, "BIN:1", "Order1", "Family1", "Genus1", "Genus1 s1", "DS-A", -1), ("P9999", "BIN:7", None, None, None, None, None, -2)]
    return spark.createDataFrame(rows, SCHEMA).repartition(8).cache()


@pytest.fixture(scope="module")
def stored(universe, tmp_path_factory):
    return store.write_universe(universe, str(tmp_path_factory.mktemp("store") / "u"), 16)


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert a.columns == b.columns


def test_recordsets(spark, universe, stored):
    for codes in (["DS-A"], [" PRJ1 ", "DS-3"], ["nothing"], []):
        frame = spark.createDataFrame([(c,) for c in codes], "code string")
        same(stored.by_recordsets(frame), retrieval.by_datasets(universe, frame))
    assert stored.by_recordsets(["DS-A"]).count() > 0


def test_taxa_with_all_records_of_their_processids(spark, universe, stored):
    for names in (["genus3 s3"], ["Order1", "family2"], ["absent", "  "], ["GENUS7"]):
        frame = spark.createDataFrame([(n,) for n in names], "name string")
        same(stored.by_taxa(frame), retrieval.by_taxa(universe, frame))
    one = spark.createDataFrame([("genus2 s2",)], "name string")
    pids = {r[0] for r in stored.by_taxa(one).select("processid").collect()}
    assert any(r.species != "Genus2 s2" for r in stored.by_taxa(one).collect()) and "P1" in pids


def test_expand_bins(universe, stored):
    for condition in ("bin_uri = 'BIN:5' and seq < 900", "seq < 3", "seq = 17", "false"):
        current = universe.filter(condition)
        same(stored.expand_bins(current), retrieval.expand_bins(current, universe))


def test_a_short_list_reads_few_files(spark, stored):
    everything = len(stored.records().inputFiles())
    few = stored.records(stored.buckets_of(store.NAME, spark.createDataFrame([("Genus3 s3",)], "c string")))
    assert 0 < len(few.inputFiles()) <= everything / 3
    wanted = {b for b in range(16)} - {r[0] for r in stored.records([2, 5]).select(store.bucket_of(store.PLACE, 16)).distinct().collect()}
    assert wanted == set(range(16)) - {2, 5}


def test_bin_membership_does_not_move_the_universe(spark, universe, stored):
    seeds = universe.filter("seq < 500")
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(key, "-1")
    try:
        bins = seeds.filter("bin_uri <> ''").select(F.col("bin_uri").alias(store.PLACE)).distinct()
        members = stored.records().filter("bin_uri <> ''").join(bins, store.PLACE, "left_semi")
        plan = members._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(key)
    assert "SortMergeJoin" in plan
    side = plan[: plan.index("FileScan parquet")]
    assert "Exchange" not in side.split("SortMergeJoin", 1)[1]
    assert re.search(r"Bucketed: true", plan)


def test_a_store_is_opened_by_another_session(spark, universe, stored):
    spark.sql(f"drop table {stored.table}")
    again = store.StoredUniverse(spark, stored.path, 16)
    assert again.records().count() == universe.count()
    about = {r.col_name: r.data_type for r in spark.sql(f"describe extended {again.table}").collect()}
    assert about["Num Buckets"] == "16" and store.PLACE in about["Bucket Columns"]
