from pyspark.sql import functions as F

from specimen_spark.operators import bins, species
from specimen_spark.sources import lists
from tests.helpers import by_key, one


def _frame(spark, rows, columns="bin_uri species genus family order country_ocean"):
    names = columns.split()
    return spark.createDataFrame(
        [tuple(list(r) + [None] * (len(names) - len(r))) for r in rows],
        ", ".join(f"`{c}` string" for c in names),
    )


def test_content_without_higher_taxa(spark):
    df = spark.createDataFrame(
        [("P1", "AAA", "Species A", "Canada"), ("P2", "AAA", "Species A", "USA"),
         ("P3", "BBB", "Species B", "Canada"), ("P4", "BBB", "Species C", "Mexico"),
         ("P5", "CCC", "Species D", "Canada"), ("P6", "", "Species D", "Canada"), ("P7", None, None, None)],
        "processid string, bin_uri string, species string, country_ocean string",
    )
    got = by_key(bins.bin_content(df), "bin_uri")
    assert set(got) == {"AAA", "BBB", "CCC"}
    assert got["AAA"]["concordance"] == "Concordant" and got["AAA"]["unique_species"] == 1
    assert got["BBB"]["concordance"] == "Discordant" and got["BBB"]["species_list"] == "Species B; Species C"
    assert got["AAA"]["countries"] == "Canada; USA" and got["AAA"]["concordant_bins"] == 1.0
    assert abs(got["BBB"]["bin_coverage"] - 2 / 7) < 1e-12
    assert one(bins.bin_summary(bins.bin_content(df))) == {
        "total_bins": 3, "concordant_bins": 2, "discordant_bins": 1, "shared_bins": 1,
    }
    assert bins.bin_content(df.filter("false")).count() == 0


def test_concordance_rules(spark):
    cases = {
        # digits are allowed, sp. and cf. names are no valid species
        "digits": ([("Aus aus",), ("Aus aus2",)], False),
        "sp": ([("Aus aus",), ("Aus sp.",)], True),
        "blank": ([("Aus aus",), ("",), (None,)], True),
        # a cf. name never conflicts
        "cf": ([("Aus aus",), ("Aus cf. bus",)], True),
        # an aff. name needs the valid name right after it
        "aff": ([("Aus aus",), ("Aus aff. aus",)], False),
        "aff_at_once": ([("Aus aus",), ("Aus aff.Aus aus",)], True),
        "aff_cf": ([("Aus aus",), ("Aus aff. cf. bus",)], True),
        "aff_several": ([("Aus aus",), ("Aus aff.Aus aus",), ("Bus aff.Aus aus x",), ("Zus aff.Aus aus",)], True),
        "aff_between": ([("Aus aus",), ("Aus aff.Aus aus",), ("Bus aff.Aus b",), ("Zus aff.Aus aus",)], False),
        "aff_twice": ([("Aus aus",), ("Xus aff. aff.Aus aus",), ("Zus aff.Aus aus aff. c",)], True),
        "aff_twice_not": ([("Aus aus",), ("Xus aff.Aus aus",), ("Zus aff.Cus aff. c",)], False),
        "aff_only": ([("Aus aff. bus",), ("Bus aff. cus",)], True),
        "genus": ([(None, "Aus"), (None, "Bus")], False),
        "genus_with_species": ([("Aus aus", "Aus"), ("Aus aus", "Bus")], False),
        "family": ([(None, None, "F1"), (None, "", "F2")], False),
        "family_hidden": ([(None, "Aus", "F1"), (None, "Aus", "F2")], True),
        "order": ([(None, None, None, "O1"), (None, None, "", "O2")], False),
        "order_hidden": ([(None, None, "F", "O1"), (None, None, "F", "O2")], True),
        # the valid name is plain text, not a pattern
        "plain": ([("Aus (x",), ("Aus aff.Aus (x",)], True),
    }
    rows = [(name, *r) for name, (members, _) in cases.items() for r in members]
    got = by_key(bins.bin_concordance(_frame(spark, rows)), "bin_uri")
    assert {k: v["concordance"] == "Concordant" for k, v in got.items()} == {
        k: want for k, (_, want) in cases.items()
    }


def test_species_list_keeps_qualified_names(spark):
    df = _frame(spark, [("b", "Aus cf. aus"), ("b", "Aus sp. 1"), ("b", "Aus subsp. x"), ("b", "Aus aff. b")])
    assert by_key(bins.bin_content(df), "bin_uri")["b"]["species_list"] == "Aus aff. b; Aus cf. aus"


def _scored(spark):
    return spark.createDataFrame(
        [("Aus aus", "b2", "Peru", "F1", "O1", 8.0), ("Aus aus", "b1", "Peru", "F1", "O1", 9.0),
         ("Aus aus", "b1", "", "F1", "O1", 8.0), ("Bus bus", None, None, "F1", "O1", None),
         ("", "b3", "Chile", "F2", None, 1.0), (None, "b4", "Chile", None, "O2", 2.0)],
        "species string, bin_uri string, country_ocean string, family string, `order` string, quality_score double",
    )


def test_checklist(spark):
    grades = spark.createDataFrame([("Aus aus", "C")], "species string, bags_grade string")
    df = species.species_checklist(_scored(spark), grades)
    rows = df.collect()
    assert [r["species"] for r in rows] == ["", "Aus aus", "Bus bus"]
    got = {r["species"]: r.asDict() for r in rows}
    assert got["Aus aus"] == {
        "species": "Aus aus", "specimen_count": 3, "bin_count": 2, "bin_uris": "b1; b2",
        "bags_grade": "C", "countries": "Peru", "mean_quality_score": 8.33,
    }
    assert got["Bus bus"]["bags_grade"] == "" and got["Bus bus"]["mean_quality_score"] is None
    assert one(species.checklist_summary(df)) == {
        "total_species": 3, "species_with_bins": 2, "species_without_bins": 1,
    }


def test_family_summary(spark):
    rows = species.family_summary(_scored(spark)).collect()
    assert [r["family"] for r in rows] == ["F1", "F2"]
    assert rows[0].asDict() == {
        "family": "F1", "order": "O1", "species_count": 2, "specimen_count": 4, "bin_count": 2,
        "mean_quality_score": 8.33, "countries": 2,
    }


def test_gap_analysis(spark):
    lines = spark.createDataFrame(
        [(1, "aus AUS"), (2, "Nomen, Bus bus, Aus aus"), (3, "Cus cus"), (4, " ,, "), (5, "Bus bus,Aus aus")],
        "line_no long, text string",
    )
    groups = lists.taxon_groups(lines)
    df = species.gap_analysis(groups, _scored(spark))
    got = by_key(df, "group_id")
    assert set(got) == {1, 2, 3, 5}
    assert (got[1]["status"], got[1]["matched_species"], got[1]["specimen_count"], got[1]["notes"]) == ("Found", "Aus aus", 3, "")
    assert got[2]["notes"] == "Matched via synonym: Bus bus" and got[2]["specimen_count"] == 1
    assert got[3]["status"] == "Missing" and got[3]["specimen_count"] == 0
    assert got[5]["matched_species"] == "Bus bus" and got[5]["input_taxon"] == "Bus bus, Aus aus"
    assert one(species.gap_summary(df)) == {"found": 3, "total": 4}
    empty = by_key(species.gap_analysis(groups, _scored(spark).filter("false")), "group_id")
    assert {r["status"] for r in empty.values()} == {"Missing"}


def test_gaps_of_no_specimens_say_so(spark):
    groups = lists.taxon_groups(spark.createDataFrame([(1, "Aus bus, Aus cus"), (2, "Bus bus")], "line_no long, text string"))
    empty = spark.createDataFrame([], "species string")
    rows = species.gap_analysis(groups, empty).collect()
    assert {(r.status, r.notes, r.specimen_count) for r in rows} == {("Missing", species.NO_SPECIMENS, 0)} and len(rows) == 2
    some = spark.createDataFrame([("Aus cus",)], "species string")
    assert {r.input_taxon: r.notes for r in species.gap_analysis(groups, some).collect()} == {"Aus bus, Aus cus": "Matched via synonym: Aus cus", "Bus bus": ""}
