import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from specimen_spark import rules
from specimen_spark.operators import grade, merge
from specimen_spark.functions.text import blank_to_null, import_name
from specimen_spark.plans import fixture as fx
from tests.helpers import by_key, one, species_bins

CASES = [
    (11, 1, False, "A"), (50, 1, False, "A"), (3, 1, False, "B"), (10, 1, False, "B"),
    (5, 2, False, "C"), (20, 3, False, "C"), (1, 1, False, "D"), (2, 1, False, "D"),
    (50, 1, True, "E"), (1, 1, True, "E"), (None, 1, False, "E"), (5, None, False, "E"),
    (-1, 1, False, "E"), (5, -1, False, "E"), (1, 2, False, "C"), (50, 5, False, "C"),
    (50, 3, True, "E"), (4, 1, None, "B"), (12, 0, False, "A"), (2, 0, False, "D"),
]


def test_grade_rule_boundaries(spark):
    df = spark.createDataFrame(CASES, "n int, bins int, shared boolean, want string")
    got = df.withColumn("got", grade.grade_rule(F.col("n"), F.col("bins"), F.col("shared")))
    assert got.filter("got <> want").count() == 0


def test_grades_of_small_frames(spark):
    df = species_bins(
        spark,
        {
            "Aus aus": ["b1"] * 12, "Bus bus": ["b2"] * 5, "Cus cus": ["b3", "b4", "b4"],
            "Dus dus": ["b5", "b5"], "Eus eus": ["b6", "b6"], "Fus fus": ["b6"],
            "Gus gus": ["b7", "", None, "b7"], "Hus": ["b8"] * 4,
        },
    )
    got = by_key(grade.bags_grades(df), "species")
    assert {k: v["bags_grade"] for k, v in got.items()} == {
        "Aus aus": "A", "Bus bus": "B", "Cus cus": "C", "Dus dus": "D", "Eus eus": "E",
        "Fus fus": "E", "Gus gus": "B",
    }
    assert got["Gus gus"]["specimen_count"] == 4 and got["Gus gus"]["bin_count"] == 1
    assert got["Fus fus"]["shared_bins"] is True and got["Aus aus"]["shared_bins"] is False


def test_species_without_bins_is_graded_on_counts(spark):
    got = by_key(grade.bags_grades(species_bins(spark, {"Aus aus": [None] * 11, "Bus bus": [""] * 3})), "species")
    assert got["Aus aus"]["bags_grade"] == "A" and got["Aus aus"]["bin_count"] == 0
    assert got["Bus bus"]["bags_grade"] == "B"
    assert not got["Aus aus"]["shared_bins"]


def test_rank_filter_and_absent_rank_column(spark):
    df = species_bins(spark, {"Aus aus": ["b1"] * 3}).withColumn("identification_rank", F.lit("genus"))
    assert grade.bags_grades(df).count() == 0
    assert grade.bags_grades(df.drop("identification_rank")).count() == 1


def test_other_rank_rows_do_not_share_a_bin(spark):
    df = species_bins(spark, {"Aus aus": ["b1"] * 3, "Bus bus": ["b1"]})
    df = df.withColumn(
        "identification_rank",
        F.when(F.col("species") == "Bus bus", "genus").otherwise(F.col("identification_rank")),
    )
    assert by_key(grade.bags_grades(df), "species")["Aus aus"]["bags_grade"] == "B"


def test_check_grades(spark):
    good = spark.createDataFrame(
        [("Aus aus", "A", 12, 1, False)],
        "species string, bags_grade string, specimen_count long, bin_count long, shared_bins boolean",
    )
    assert one(grade.check_grades(good)) == {"valid": True, "message": ""}
    assert "not one of A to E" in one(grade.check_grades(good.withColumn("bags_grade", F.lit("X"))))["message"]
    assert "a specimen count is below 0" in one(grade.check_grades(good.withColumn("specimen_count", F.lit(-1))))["message"]
    assert "absent columns: bin_count" in one(grade.check_grades(good.drop("bin_count")))["message"]
    assert one(grade.check_grades(good.filter("false"))) == {"valid": False, "message": "there are no grades"}


def test_published_grade_numbers(spark):
    """Record and grade counts of a fixed sample of the sf0.01 tables, known beforehand."""
    d = "/root/testdata/sf0.01"
    src = (
        fx.table(spark, d, "lineitem").join(fx.table(spark, d, "part"), F.expr("l_partkey = p_partkey"))
        .filter("l_orderkey % (1+l_partkey%16) = 0")
    )
    genus = "concat(upper(substr(p_type,1,1)), lower(substr(p_type,2)))"
    epithet = "concat(translate(cast(l_partkey as string),'0123456789','abcdefghij'),'us')"
    sample = src.select(
        F.expr(dict(fx.SPECIMEN)["processid"]).alias("processid"),
        F.expr(
            f"case when l_linenumber=6 and l_partkey%2=0 then null when l_linenumber=6 then {genus} "
            f"when l_linenumber=5 and l_partkey%11=0 then concat({genus},' cf. ',{epithet}) "
            f"when l_linenumber=5 and l_partkey%11=1 then concat({genus},' sp. ',cast(l_partkey as string)) "
            f"when l_linenumber=5 and l_partkey%11=2 then concat({genus},' nr ',{epithet}) "
            f"when l_linenumber=4 and l_partkey%13=0 then concat(' ',{genus},' ',{epithet},' ') "
            f"else concat({genus},' ',{epithet}) end"
        ).alias("species"),
        F.expr("case when l_linenumber=6 then 'genus' when l_partkey%17=0 then 'subspecies' else 'species' end").alias("identification_rank"),
        F.expr(
            "case when l_linenumber=7 and l_partkey%3=0 then '' when l_linenumber=7 and l_partkey%3=1 then null "
            "when l_partkey%10=7 then concat('BIN:',lpad(cast(l_partkey-1 as string),7,'0')) "
            "when l_partkey%10=3 and l_suppkey%2=1 then concat('BIN:',lpad(cast(l_partkey+5000000 as string),7,'0')) "
            "else concat('BIN:',lpad(cast(l_partkey as string),7,'0')) end"
        ).alias("bin_uri"),
        F.expr(dict(fx.SPECIMEN)["rec_key"]).alias("rec_key"),
    )
    df = merge.dedupe_processid(sample, ["rec_key"]).withColumns(
        {"species": import_name("species"), "bin_uri": blank_to_null("bin_uri")}
    )
    assert df.count() == 11606
    grades = grade.bags_grades(df)
    counts = {r["bags_grade"]: r["species"] for r in grade.grade_counts(grades).collect()}
    assert counts == {"A": 150, "B": 619, "C": 102, "D": 584, "E": 444}
    assert grades.filter("bags_grade = 'D' and bin_count = 0").count() == 47


def test_auto_select(spark):
    rows = [
        ("P1", "Aus aus", "b1", "Canada", 5.0), ("P2", "Aus aus", "b1", "Canada", 9.0),
        ("P3", "Aus aus", "b1", "Canada", 9.0), ("P4", "Aus aus", "b1", None, 3.0),
        ("P5", "Aus aus", "b1", "", 4.0), ("P6", "Aus aus", "", "Canada", 9.0),
        ("P7", None, "b1", "Peru", 9.0), ("P8", "Aus aus", "b1", "Unknown", 1.0),
    ]
    df = spark.createDataFrame(rows, "processid string, species string, bin_uri string, country_ocean string, quality_score double")
    got = by_key(grade.auto_select(df))
    assert set(got) == {"P2", "P5"}
    assert got["P2"]["user"] == "auto" and got["P2"]["selected"] is True
    chosen = spark.createDataFrame([("P1",)], "processid string")
    assert grade.auto_select_if_empty(df, chosen).collect() == chosen.collect()
    assert grade.auto_select_if_empty(df, chosen.filter("false")).count() == 2
    assert grade.auto_select_if_empty(df, None).count() == 2


def test_representative_per_species(spark):
    picks = spark.createDataFrame(
        [("P1", "Aus aus", 1), ("P2", "Aus aus", 3), ("P3", "Aus aus", 2), ("P4", "Bus bus", 1)],
        "processid string, species string, ts int",
    )
    assert set(by_key(grade.representative_per_species(picks))) == {"P2", "P4"}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(
    st.sampled_from(["Aus aus", "Bus bus", "Cus cus", "Dus"]),
    st.lists(st.sampled_from(["b1", "b2", "b3", "", None]), min_size=1, max_size=14), min_size=1,
))
def test_grades_cover_every_species_once(spark, content):
    got = grade.bags_grades(species_bins(spark, content)).collect()
    named = {s for s in content if " " in s}
    assert sorted(r["species"] for r in got) == sorted(named)
    for r in got:
        bins = {b for b in content[r["species"]] if b}
        others = {b for s in named - {r["species"]} for b in content[s] if b}
        assert r["specimen_count"] == len(content[r["species"]])
        assert r["bin_count"] == len(bins)
        assert r["shared_bins"] == bool(bins & others)
        assert r["bags_grade"] in rules.GRADES
