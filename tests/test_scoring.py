import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from specimen_spark import rules
from specimen_spark.operators import score, validate
from tests.helpers import TEXT, by_key, full_specimens, one, specimens, values


def test_flags(spark):
    df = specimens(
        spark,
        {"processid": "P1", "species": "Homo sapiens", "bin_uri": "BIN:1"},
        {"processid": "P3", "species": "Rattus sp.", "bin_uri": ""},
        {"processid": "P4", "species": "", "bin_uri": None},
        {"processid": "P5", "species": None, "bin_uri": "BIN:2"},
    )
    got = by_key(validate.validate_flags(df))
    flags = {k: (v["valid_species"], v["species_id"], v["valid_bin"]) for k, v in got.items()}
    assert flags == {
        "P1": (True, True, True), "P3": (False, True, False), "P4": (False, False, False),
        "P5": (False, False, True),
    }
    assert one(validate.validate_counts(validate.validate_flags(df))) == {
        "total": 4, "valid_species": 1, "species_id": 2, "valid_bin": 2,
    }


def _met(spark, name, **change):
    df = score.score_specimens(full_specimens(spark, change))
    return name in df.first()["criteria_met"].split("; ")


@pytest.mark.parametrize("name,change,want", [
    ("SPECIES_ID", {"species": "Aus nr bus"}, False),
    ("SPECIES_ID", {"species": "Aus SP. 4"}, False),
    ("SPECIES_ID", {"species": "Aus subsp. bus"}, False),
    ("SPECIES_ID", {"species": "Aus nrbus"}, True),
    ("TYPE_SPECIMEN", {"voucher_type": "Type series"}, True),
    ("TYPE_SPECIMEN", {"voucher_type": "x", "notes": "HOLOTYPE"}, True),
    ("TYPE_SPECIMEN", {"voucher_type": "x", "notes": "type locality"}, False),
    ("SEQ_QUALITY", {"nuc_basecount": "500"}, True),
    ("SEQ_QUALITY", {"nuc_basecount": "499"}, False),
    ("SEQ_QUALITY", {"nuc_basecount": " 5e2 "}, True),
    ("SEQ_QUALITY", {"bin_uri": "None"}, False),
    ("PUBLIC_VOUCHER", {"voucher_type": "DNA in museum"}, True),
    ("PUBLIC_VOUCHER", {"voucher_type": "DNA voucher"}, False),
    ("PUBLIC_VOUCHER", {"voucher_type": "pinned"}, True),
    ("IDENTIFIER", {"identified_by": "bold engine"}, False),
    ("IDENTIFIER", {"identified_by": "Leopold Boldt"}, True),
    ("ID_METHOD", {"identification_method": "DNA barcoding"}, False),
    ("ID_METHOD", {"identification_method": "morphology and DNA barcode"}, False),
    ("ID_METHOD", {"identification_method": "some unknown method"}, True),
    ("COLLECTION_DATE", {"collection_date_start": None}, True),
    ("COLLECTION_DATE", {"collection_date_start": "NA", "collection_date_end": " "}, False),
    ("INSTITUTION", {"inst": "Mined from GenBank"}, False),
    ("MUSEUM_ID", {"museumid": " none "}, False),
    ("SECTOR", {"sector": "\t"}, False),
])
def test_criteria(spark, name, change, want):
    assert _met(spark, name, **change) is want


def test_empty_words_score_zero(spark):
    rows = []
    for word in ("None", "NA"):
        rows.append({c: word for c in TEXT} | {"processid": word, "identification_rank": "species",
                    "nuc_basecount": "658", "nuc": "ATCG", "taxonomy_notes": "", "short_note": "",
                    "collection_notes": "", "notes": ""})
    rows.append({"processid": "null"})
    assert set(values(score.score_specimens(specimens(spark, *rows)), "quality_score")) == {0.0}


def test_unreadable_base_count_zeroes_the_record(spark):
    df = score.process_specimens(
        full_specimens(spark, {"nuc_basecount": "n/a"}, {"nuc_basecount": "n/a", "bin_uri": ""},
                       {"nuc_basecount": ""}, {"nuc_basecount": "900d"})
    )
    got = by_key(df)
    assert (got["P1"]["quality_score"], got["P1"]["criteria_met"], got["P1"]["rank"]) == (0.0, "", 7)
    assert got["P2"]["quality_score"] > 10 and got["P3"]["quality_score"] > 10
    assert got["P4"]["quality_score"] == 0.0


def test_ranks(spark):
    df = full_specimens(
        spark, {"voucher_type": "holotype"}, {}, {"collectors": ""},
        {"identified_by": ""}, {"country_ocean": ""}, {"bin_uri": None}, {"species": ""},
        {"inst": "", "voucher_type": "none", "museumid": "M"},
    ).withColumn("has_image", F.lit(True))
    got = by_key(score.process_specimens(df))
    assert [got[f"P{i}"]["rank"] for i in range(1, 9)] == [1, 2, 3, 4, 5, 6, 7, 2]
    again = by_key(score.rank_specimens(score.score_specimens(df)))
    assert {k: v["rank"] for k, v in again.items()} == {k: v["rank"] for k, v in got.items()}


def test_missing_columns_fail_their_criterion_only(spark):
    df = spark.createDataFrame([("P1", "Homo sapiens")], "processid string, species string").withColumn(
        "bin_uri", F.lit("BIN:1")
    )
    row = score.process_specimens(df).first()
    assert row["criteria_met"] == "SPECIES_ID" and row["quality_score"] == 1.0 and row["rank"] == 6
    assert row["has_image"] is False


def test_own_rule(spark):
    scoring = {**rules.SCORING, "HAS_SEQUENCE": {"fields": ["nuc"], "positive": "^[ACGT]+$"}}
    row = score.score_specimens(full_specimens(spark, {}), scoring).first()
    assert "HAS_SEQUENCE" in row["criteria_met"]


def test_fill_defaults_and_checks(spark):
    df = spark.createDataFrame(
        [("a", None, None, None), ("b", 17.0, 2, "X"), ("c", 3.0, 3, "Y")],
        "processid string, quality_score double, rank int, criteria_met string",
    )
    assert one(score.check_scores(df)) == {"missing_scores": 1, "invalid_scores": 1, "valid": False}
    row = by_key(score.fill_defaults(df))["a"]
    assert (row["quality_score"], row["rank"], row["criteria_met"]) == (0.0, 7, "")
    bare = score.fill_defaults(df.select("processid")).first()
    assert (bare["quality_score"], bare["rank"]) == (0.0, 7)


def test_metrics(spark):
    df = spark.createDataFrame(
        [("Aus aus", 1.0, "A; B"), ("Aus aus", 2.0, ""), (None, 9.0, "SITE"), ("", None, None)],
        "species string, quality_score double, criteria_met string",
    ).withColumn("rank", F.lit(3))
    assert one(score.quality_metrics(df)) == {
        "total_specimens": 4, "avg_quality_score": 4.0, "median_quality_score": 2.0, "species_count": 3,
    }
    cover = {r["criterion"]: r for r in score.criteria_coverage(df).collect()}
    assert len(cover) == 16 and cover["SITE"]["count"] == 1 and cover["COORD"]["count"] == 0
    assert cover["SITE"]["avg_criteria_per_specimen"] == 0.75
    assert one(score.rank_distribution(df)) == {"rank": 3, "count": 4}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dictionaries(
    st.sampled_from(TEXT[1:]),
    st.sampled_from(["", "NA", "none ", "holotype", "Homo sapiens", "n/a", "700", "DNA", "x"]),
), min_size=1, max_size=8))
def test_score_is_the_number_of_listed_criteria(spark, rows):
    rows = [{**r, "processid": str(i)} for i, r in enumerate(rows)]
    for r in score.process_specimens(specimens(spark, *rows)).collect():
        listed = [c for c in r["criteria_met"].split("; ") if c]
        assert r["quality_score"] == len(listed)
        assert listed == [c for c in rules.SCORING if c in listed]
        assert 1 <= r["rank"] <= 7 and (r["rank"] < 7) == ("SPECIES_ID" in listed)
