import pytest
from pyspark.sql import functions as F

from specimen_spark import rules, schema
from specimen_spark.operators import clean, geo, merge, score, validate
from specimen_spark.plans import curation
from specimen_spark.sources import dumps, lists, retrieval
from tests.helpers import by_key, full_specimens, one, specimens, values


def _keyed(spark, rows):
    return spark.createDataFrame(rows, "processid string, species string, rec_key string")


def test_clean_names(spark):
    names = [" Aus aus\t", "", "  ", "Rattus sp.", "sp. 1", "sp", "Aus spp. x", "Aus 7", "Aus cf. b", "Aus aff. b", "SP. x", None, "Aus subsp. b"]
    df = _keyed(spark, [(str(i), n, "") for i, n in enumerate(names)])
    got = {int(r["processid"]): r["species"] for r in clean.clean_species(df).collect()}
    assert {i: v for i, v in got.items() if v} == {0: "Aus aus", 3: "Rattus sp.", 10: "SP. x", 12: "Aus subsp. b"}


def test_process_import(spark):
    df = specimens(
        spark,
        {"processid": "P1", "species": " Aus aus ", "bin_uri": " ", "country_ocean": "\tPeru "},
        {"processid": "P1", "species": "Bus bus", "bin_uri": "b"},
        {"processid": "P2", "species": "Bus 9", "bin_uri": " b ", "country_ocean": ""},
    ).withColumn("rec_key", F.coalesce("country_ocean", F.lit("z")))
    got = by_key(clean.process_import(df))
    assert set(got) == {"P1", "P2"}
    assert (got["P1"]["species"], got["P1"]["bin_uri"], got["P1"]["country_ocean"]) == ("Aus aus", None, "Peru")
    assert (got["P2"]["species"], got["P2"]["bin_uri"], got["P2"]["country_ocean"]) == (None, "b", None)
    assert got["P2"]["data_source"] == "BOLD" and got["P2"]["import_date"] is not None


def test_merge(spark):
    a = _keyed(spark, [("P1", "a", "1"), ("P2", "a", "1"), (None, "a", "1")])
    b = _keyed(spark, [("P2", "b", "0"), ("P3", "b", "2"), ("P3", "c", "1"), (None, "b", "0")])
    assert merge.merge_first_wins(None, b) is b and merge.merge_first_wins(a, None) is a
    joined = merge.merge_first_wins(a, b)
    assert sorted(map(str, values(joined, "processid"))) == ["None", "P1", "P2", "P3", "P3"]
    assert merge.merge_first_wins(joined, b).count() == joined.count()
    got = {r["processid"]: r["species"] for r in merge.merge_sources([a, None, b], tie=["rec_key"]).collect()}
    assert got == {"P1": "a", "P2": "a", "P3": "c", None: "a"}


def test_checks(spark):
    df = full_specimens(spark, {}, {"bin_uri": None})
    assert one(validate.check_required(df)) == {"valid": True, "message": ""}
    assert "BIN" in one(validate.check_required(df.filter("bin_uri is null")))["message"]
    assert one(validate.check_required(df.filter("false")))["message"] == "the table has no rows"
    assert one(validate.check_required(df.drop("species")))["message"] == "absent columns: species"
    assert one(validate.check_results(df)) == {"valid": True, "message": ""}
    blank = df.withColumn("processid", F.when(F.col("processid") == "P1", ""))
    assert one(validate.check_results(blank)) == {"valid": False, "message": "2 rows have no processid"}
    assert one(validate.check_results(df.filter("false")))["message"] == "nothing was retrieved"


def test_search_terms(spark):
    terms = spark.createDataFrame(
        [("taxon", "Species A-b_c. d"), ("taxon", "A#"), ("taxon", "x" * 101), ("dataset", " DS-TEST1 "),
         ("dataset", "DS-test"), ("project", "PRO-J_1"), ("project", "P 1"), ("country", "Canada"),
         ("country", "Atlantis"), ("country", " ")],
        "kind string, term string",
    )
    got = by_key(validate.validate_search_terms(terms, lists.continents(spark)), "term")
    assert {k for k, v in got.items() if not v["valid"]} == {"A#", "DS-test", "P 1"}
    assert "is long" in got["x" * 101]["message"] and got["Atlantis"]["message"] == "unknown country: Atlantis"
    assert got["Canada"]["message"] == "" and len(got) == 9
    assert not validate.has_search_terms() and validate.has_search_terms(taxa=["a"])


def test_geography(spark):
    dim = lists.continents(spark)
    assert dim.select("continent").distinct().count() == 7
    assert dim.count() == sum(len(v) for v in rules.CONTINENTS.values())
    chosen = geo.geo_countries(dim, ["Oceania"], ["Peru", "Fiji"])
    assert chosen.count() == 15
    listed = spark.createDataFrame([("Peru",), ("Mali",), ("Nowhere",)], "country string")
    assert sorted(values(geo.continents_of_countries(dim, listed), "continent")) == ["Africa", "South America"]
    df = full_specimens(spark, {"country_ocean": "Fiji"}, {"country_ocean": " Fiji"}, {"country_ocean": "fiji"}, {"country_ocean": None})
    assert values(geo.filter_geo(df, chosen), "processid") == ["P1"]
    assert geo.filter_geo(df, None).count() == 4
    assert geo.filter_geo(df, chosen.filter("false")).count() == 4
    assert one(geo.geo_report(df, chosen)) == {"records_before": 4, "records_after": 1, "records_removed": 3}


def test_size_gate_and_metrics(spark):
    df = full_specimens(spark, {"bin_uri": "b1"}, {"bin_uri": "b2"}, {"bin_uri": ""}, {"bin_uri": None, "species": None})
    assert one(geo.size_gate(df)) == {"records": 4, "bins": 2, "over_limit": False}
    assert one(geo.size_gate(df, max_records=4, max_bins=2))["over_limit"] is False
    assert one(geo.size_gate(df, max_bins=1))["over_limit"] is True
    assert one(geo.search_metrics(df)) == {"total_records": 4, "unique_species": 1, "unique_bins": 3, "countries": 1}
    assert one(geo.search_metrics(df.filter("false"))) == {"total_records": 0, "unique_species": 0, "unique_bins": 0, "countries": 0}


def _universe(spark):
    rows = [
        ("P1", "Aus aus", "Aus", "b1", "DS-A, PRJ1", "Peru"), ("P2", "Aus aus", "Aus", "b1", "PRJ2", "Fiji"),
        ("P3", "Bus bus", "Bus", "b2", "DS-AB", "Peru"), ("P4", None, "Aus", None, "DS-A", "Chile"),
        ("P5", "Cus cus", "Cus", "b2", None, "Mali"), ("P6", "Dus dus", "Dus", "", "PRJ1", "Peru"),
    ]
    return spark.createDataFrame(
        rows, "processid string, species string, genus string, bin_uri string, bold_recordset_code_arr string, country_ocean string"
    ).withColumn("rec_key", F.col("processid"))


def test_retrieval(spark):
    u = _universe(spark)
    assert sorted(values(retrieval.by_datasets(u, ["DS-A"]), "processid")) == ["P1", "P4"]
    codes = spark.createDataFrame([(" PRJ1",), ("PRJ2",), ("",)], "code string")
    assert sorted(values(retrieval.by_projects(u, codes), "processid")) == ["P1", "P2", "P6"]
    names = spark.createDataFrame([(" aus",), ("bus bus",), ("nobody",)], "name string")
    assert sorted(values(retrieval.by_taxa(u, names), "processid")) == ["P1", "P2", "P3", "P4"]
    ids = spark.createDataFrame([("P3",), ("P3",), ("P9",)], "processid string")
    assert values(retrieval.by_processids(u, ids), "processid") == ["P3"]


def test_expansion_is_one_hop(spark):
    u = _universe(spark)
    current = u.filter("processid in ('P3', 'P6')")
    assert sorted(values(retrieval.expand_bins(current, u), "processid")) == ["P3", "P5", "P6"]


def test_retrieve_filters_geography_before_expansion(spark):
    peru = spark.createDataFrame([("Peru",)], "country string")
    got = curation.retrieve(_universe(spark), datasets=["DS-A", "DS-AB"], countries=peru)
    assert sorted(values(got, "processid")) == ["P1", "P2", "P3", "P5"]
    with pytest.raises(ValueError):
        curation.retrieve(_universe(spark))


def test_lists(spark, tmp_path):
    path = tmp_path / "taxa.txt"
    path.write_text("Aus aus, Bus bus ,,\n\n , \nCus cus\n")
    groups = lists.read_taxon_groups(spark, str(path))
    rows = sorted(groups.collect(), key=lambda r: (r["group_id"], r["pos"]))
    assert [(r["label"], r["pos"], r["name"]) for r in rows] == [
        ("Aus aus, Bus bus", 0, "Aus aus"), ("Aus aus, Bus bus", 1, "Bus bus"), ("Cus cus", 0, "Cus cus"),
    ]
    assert lists.search_names(groups).count() == 3
    lines = spark.createDataFrame([(0, " Canada \nUSA\n\nMexico "), (1, " Mexico")], "line_no long, text string")
    assert sorted(values(lists.code_list(lines, dedupe=True), "code")) == ["Canada", "Mexico", "USA"]
    assert lists.code_list(lines).count() == 4


@pytest.mark.parametrize("format", ["parquet", "json", "csv", "tsv", "orc"])
def test_dump_formats(spark, tmp_path, format):
    from specimen_spark.operators import sinks

    df = full_specimens(spark, {"species": 'A "q", x'}, {"species": None, "site": "", "notes": " pad "})
    df = df.withColumn("has_image", F.col("processid") == "P1")
    path = str(tmp_path / format)
    if format == "csv":
        sinks.write_csv(df, path)
    elif format == "tsv":
        sinks.write_tsv(df, path)
    else:
        schema.to_file_names(df).write.format(format).save(path)
    back = dumps.read_specimens(spark, path, format, columns=df.columns, multiline=True)
    assert back.schema["has_image"].dataType.simpleString() == "boolean"
    assert sorted(back.collect(), key=str) == sorted(df.collect(), key=str)


def test_conform(spark):
    df = spark.createDataFrame([("P1",)], "processid string")
    full = schema.conform(df)
    assert set(full.columns) == set(schema.SPECIMEN_SCHEMA.fieldNames())
    assert full.schema["rank"].dataType.simpleString() == "int"
    with pytest.raises(ValueError):
        schema.conform(df.toDF("x"))


def test_images(spark):
    df = full_specimens(spark, {}, {}, {})
    images = spark.createDataFrame([("P1", "1"), ("P1", "2"), ("P3", "3"), ("", "4")], "processid string, objectid string")
    got = {r["processid"]: r["has_image"] for r in dumps.with_images(df, images).collect()}
    assert got == {"P1": True, "P2": False, "P3": True}
    complete = df.withColumn("has_image", F.col("processid") == "P2")
    assert dumps.with_images_if_needed(complete, images) is complete
    gaps = df.withColumn("has_image", F.when(F.col("processid") == "P2", True))
    assert {r["processid"]: r["has_image"] for r in dumps.with_images_if_needed(gaps, images).collect()} == got
    assert {r["processid"]: r["has_image"] for r in dumps.with_images_if_needed(df, images).collect()} == got
    scored = score.process_specimens(gaps, images, check_images=True)
    assert {r["processid"]: r["has_image"] for r in scored.collect()} == got


def test_image_json(spark, tmp_path):
    (tmp_path / "i.json").write_text('[{"processid": "P1", "objectid": "7"}, {"processid": "P2", "objectid": "8"}]')
    assert sorted(values(dumps.read_images(spark, str(tmp_path)), "processid")) == ["P1", "P2"]


def test_curate(spark):
    df = full_specimens(spark, {}, {}, {"species": "Bus bus"})
    groups = lists.taxon_groups(spark.createDataFrame([(1, "Bus bus")], "line_no long, text string"))
    out = curation.curate(df, taxa=groups)
    assert out["specimen_data"].count() == 3 and out["bags_grades"].count() == 2
    assert one(out["gap_analysis"])["status"] == "Found"
    assert out["selected_specimens"].count() == 1


def test_files_with_different_headers(spark, tmp_path):
    for fmt, sep in (("csv", ","), ("tsv", "\t")):
        folder = tmp_path / fmt
        folder.mkdir()
        (folder / "a").write_text(f"processid{sep}species\nP1{sep}Aus bus\n")
        (folder / "b").write_text(f"species{sep}processid\nBus bus{sep}P2\n")
        got = dumps.read_specimens(spark, str(folder), fmt, columns=["processid", "species"])
        assert {tuple(r) for r in got.collect()} == {("P1", "Aus bus"), ("P2", "Bus bus")}


def test_any_number_of_codes(spark):
    universe = _universe(spark)
    codes = [f"X{i}" for i in range(5000)]
    assert retrieval.by_datasets(universe, codes).count() == 0
    assert retrieval.by_datasets(universe, [*codes, "DS-A"]).count() == retrieval.by_datasets(universe, ["DS-A"]).count() > 0


def test_import_without_a_tie_column(spark):
    rows = spark.createDataFrame([("P1", "9", "Aus bus"), ("P1", "10", "Cus dus"), ("P2", None, None)], "processid string, record_id string, species string")
    assert {r["processid"]: r["species"] for r in merge.dedupe_processid(rows).collect()} == {"P1": "Cus dus", "P2": None}
