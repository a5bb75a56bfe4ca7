import random

import pytest
from pyspark.sql import functions as F

from specimen_spark.functions.windows import with_position
from specimen_spark.operators import grade, groups
from tests.helpers import by_key, one, species_bins


def _with_other(spark, df, rows):
    extra = spark.createDataFrame(
        [(p, s, b, r, q) for p, s, b, r, q in rows],
        "processid string, species string, bin_uri string, identification_rank string, quality_score double",
    )
    return df.unionByName(extra)


def test_members(spark):
    df = _with_other(
        spark,
        species_bins(spark, {"Aus aus": ["b1", "b1", "b1", None], "Bus bus": ["b2"]}),
        [("G1", "Aus", "b1", "genus", 1.0), ("G2", None, "b1", None, 1.0),
         ("G3", None, "b2", "genus", 1.0), ("G4", None, "", "genus", 1.0),
         ("S1", "Aus", "b1", "species", 1.0)],
    )
    grades = grade.bags_grades(df)
    got = by_key(groups.grade_members(df, grades, "B"))
    # a row without a BIN is left out, and so is a species-rank row with a one-word name
    assert set(got) == {"Aus aus_0", "Aus aus_1", "Aus aus_2", "G1", "G2"}
    everything = groups.grade_members(df, grades)
    assert everything.count() == 7
    assert groups.grade_members(df.drop("identification_rank"), grades, "B").count() == 0


def test_group_by_species(spark):
    df = _with_other(
        spark, species_bins(spark, {"Aus aus": ["b1", "b1"], "Bus bus": ["b2"], "Sp": ["b3"]}),
        [("G1", "Aus", "b1", "genus", 9.0), ("G2", None, "b9", "genus", 1.0)],
    )
    got = groups.group_by_species(df)
    assert {(r["group_key"], r["processid"]) for r in got.collect()} == {
        ("Aus aus", "Aus aus_0"), ("Aus aus", "Aus aus_1"), ("Aus aus", "G1"), ("Bus bus", "Bus bus_0"),
    }
    info = by_key(groups.group_info(got, "A"), "group_key")
    assert info["Aus aus"]["specimen_count"] == 3
    text = by_key(groups.group_caption(groups.group_info(got, "A"), "A"), "group_key")
    assert text["Bus bus"]["caption"] == "Species: Bus bus (>10 specimens, single BIN)"
    order = groups.group_order(got.filter("group_key = 'Aus aus'")).orderBy("pos")
    assert [r["processid"] for r in order.collect()] == ["G1", "Aus aus_1", "Aus aus_0"]


def test_group_by_species_bin(spark):
    df = _with_other(
        spark, species_bins(spark, {"Aus aus": ["b1", "b2"], "Bus bus": ["b3", "b4", "b4"]}),
        [("G1", None, "b4", "genus", 9.0)],
    )
    got = groups.group_by_species_bin(df)
    info = by_key(groups.group_info(got, "C"), "group_key")
    assert {k: v["specimen_count"] for k, v in info.items()} == {
        "Aus aus_b1": 1, "Aus aus_b2": 1, "Bus bus_b3": 1, "Bus bus_b4": 3,
    }
    text = by_key(groups.group_caption(groups.group_info(got, "C"), "C"), "group_key")
    assert text["Aus aus_b1"]["caption"] == "Species: Aus aus - BIN: b1"


def test_group_by_shared_bin(spark):
    df = species_bins(spark, {"Sp a": ["s1", "u1"], "Sp b": ["s1", "u2"], "Alpha": ["s2"], "Beta": ["s2"]})
    got = groups.group_by_shared_bin(df)
    # one-word names are no species, so s2 is not shared
    assert {r["group_key"] for r in got.collect()} == {"s1"}
    info = groups.group_info(got, "E")
    assert one(info)["species_count"] == 2 and one(info)["group_species"] == "Sp a, Sp b"
    assert one(groups.group_caption(info, "E"))["caption"] == "Shared BIN: s1 (2 species)"
    assert one(groups.group_caption(info, "Z"))["caption"] == ""


def test_group_by_shared_bin_none(spark):
    assert groups.group_by_shared_bin(species_bins(spark, {"Sp a": ["x"], "Sp b": ["y"]})).count() == 0


def test_metrics_count_null_as_a_value(spark):
    df = spark.createDataFrame(
        [("Aus aus", "Peru", 2.0), (None, None, 4.0), (None, "Peru", None)],
        "species string, country_ocean string, quality_score double",
    )
    assert one(groups.grade_metrics(df)) == {
        "total_species": 2, "total_specimens": 3, "avg_quality": 3.0, "countries": 2,
    }
    assert one(groups.grade_metrics(df.filter("false"))) == {
        "total_species": 0, "total_specimens": 0, "avg_quality": 0.0, "countries": 0,
    }


def test_positions_of_a_hot_group(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else None if i % 30 == 3 else f"g{i % 30}", rng.choice([1.0, 2.0, 2.0, 5.0, None]), f"P{i:04d}") for i in range(900)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, score double, k string")
    got = {(r["g"], r["k"]): r["pos"] for r in with_position(df, "g", "score", "k").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        members = [r for r in rows if r[0] == g]
        members.sort(key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        want.update({(g, r[2]): i + 1 for i, r in enumerate(members)})
    assert got == want
