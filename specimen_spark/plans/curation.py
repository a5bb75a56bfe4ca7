"""The two whole-table plans: retrieve records, then derive every analysis from them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specimen_spark.functions.storage import materialize
from specimen_spark.functions.text import not_blank
from specimen_spark.operators import bins, clean, geo, grade, merge, score, species
from specimen_spark.schema import conform
from specimen_spark.sources import retrieval
from specimen_spark.sources.retrieval import with_columns_of


def retrieve(
    universe: DataFrame,
    datasets=None,
    projects=None,
    taxa: DataFrame | None = None,
    countries: DataFrame | None = None,
    tie=None,
    delimiter: str = ",",
    widen=None,
) -> DataFrame:
    """Datasets, projects, taxa (first source wins) -> geography -> BIN expansion -> import.

    Geography comes before the expansion: only BINs seen in the region are expanded, and
    their foreign records come back. Run ``geo.size_gate`` on ``retrieve_seed`` first where a size limit
    matters. ``widen``, a row-wise function, gives the columns of compact rows; only these are shuffled then.
    The seed is read three times, so it is written. Expansion and duplicates take one window: the seed is
    the first source, the members of its BINs the second.
    """
    seed = materialize(retrieve_seed(universe, datasets, projects, taxa, countries, tie, delimiter, widen), "seed")
    found = merge.merge_sources([seed, retrieval.bin_members(seed, universe, widen)], tie=tie)
    return clean.add_provenance(clean.clean_rows(widen(found) if widen else found))


def retrieve_seed(
    universe, datasets=None, projects=None, taxa=None, countries=None, tie=None,
    delimiter=",", widen=None,
) -> DataFrame:
    """The records before expansion."""
    found = with_columns_of(merged(universe, datasets, projects, taxa, tie, delimiter, widen), widen, ["country_ocean"])
    return geo.filter_geo(found, countries).select(*universe.columns)


def merged(universe, datasets=None, projects=None, taxa=None, tie=None, delimiter=",", widen=None) -> DataFrame:
    """The records of all requests, one per key: the first request wins."""
    requests = [codes for codes in (datasets, projects) if codes is not None]
    if not requests and taxa is None:
        raise ValueError("Give datasets, projects or taxa")
    columns = [retrieval.RECORDSET_COLUMN] * bool(requests) + retrieval.TAXON_COLUMNS * (taxa is not None)
    if widen:
        columns = [c for c in columns if c in widen(universe).columns]
    rows = with_columns_of(universe, widen, columns)
    rows = retrieval.mark_recordsets(rows, requests, delimiter) if requests else rows.withColumn(retrieval.SOURCE, F.lit(None).cast("int"))
    named = retrieval.NAMED if taxa is not None else None
    if named:
        rows = retrieval.mark_names(rows, taxa)
    marks = [retrieval.SOURCE, *([named] if named else [])]
    return merge.first_marked(rows.select(*universe.columns, *marks), retrieval.SOURCE, named, tie=tie)


def curate(
    specimens: DataFrame, images: DataFrame | None = None, taxa: DataFrame | None = None,
    selections: DataFrame | None = None, write: bool = True,
) -> dict:
    """All analyses of an imported table, by name.

    The scored table feeds every branch, so it is written once to the shared folder
    (``write``) instead of being recomputed per branch.
    """
    specimens = conform(
        specimens, ["species", "bin_uri", "country_ocean", "family", "order", "genus"]
    )
    scored = score.process_specimens(specimens, images)
    if write:
        scored = materialize(scored, "scored")
    grades = grade.bags_grades(scored)
    out = {
        "specimen_data": scored,
        "bags_grades": grades,
        "selected_specimens": grade.auto_select_if_empty(scored, selections),
        "bin_analysis": bins.bin_content(scored.filter(not_blank("bin_uri"))),
        "species_checklist": species.species_checklist(scored, grades),
        "family_summary": species.family_summary(scored),
        "quality_summary": score.quality_metrics(scored),
    }
    if taxa is not None:
        out["gap_analysis"] = species.gap_analysis(taxa, scored)
    return out
