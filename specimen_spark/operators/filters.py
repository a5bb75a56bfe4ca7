"""Filters on the scored specimen table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specimen_spark import rules
from specimen_spark.functions.text import count_distinct_null_as_value, not_blank


def filter_rank(df: DataFrame, rank: int | str | None = None) -> DataFrame:
    return df if rank in (None, "All") else df.filter(F.col("rank") == int(rank))


def filter_min_score(df: DataFrame, min_score: float = 0) -> DataFrame:
    return df.filter(F.col("quality_score") >= min_score) if min_score > 0 else df


def filter_criteria(df: DataFrame, required=()) -> DataFrame:
    """Rows that meet all the named criteria."""
    if not required:
        return df
    wanted = F.array(*[F.lit(c) for c in required])
    return df.filter(F.size(F.array_except(wanted, F.split("criteria_met", "; "))) == 0)


def _keys(annotations: DataFrame, kinds) -> DataFrame:
    return annotations.filter(F.col("kind").isin(list(kinds))).select("processid").distinct()


def _held(df: DataFrame, keys: DataFrame, dealt: bool) -> DataFrame:
    """Rows with one of the keys. ``dealt``: by a shuffled hash join at every size, for frames whose keys may outgrow a
    broadcast: rows are moved once and never sorted."""
    return df.join(keys.hint("shuffle_hash") if dealt else keys, "processid", "left_semi")


def filter_selected(df: DataFrame, annotations: DataFrame, dealt: bool = False) -> DataFrame:
    return _held(df, _keys(annotations, ["selected"]), dealt)


def filter_annotated(df: DataFrame, annotations: DataFrame, dealt: bool = False) -> DataFrame:
    """Rows with a flag, a note or an updated id; a selection alone does not count."""
    return _held(df, _keys(annotations, ["flag", "curator_notes", "updated_id"]), dealt)


def filtered_metrics(df: DataFrame) -> DataFrame:
    """Counts of a filtered view: null is a species, blank is a BIN; percent with a BIN."""
    combos = df.groupBy("species", "bin_uri").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("quality_score").alias("score"),
        F.count("quality_score").alias("scored"),
    )
    return combos.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_specimens"),
        count_distinct_null_as_value("species").cast("long").alias("unique_species"),
        F.count_distinct("bin_uri").alias("unique_bins"),
        F.try_divide(F.sum("score"), F.sum("scored")).alias("avg_quality"),
        F.try_divide(F.sum(F.when(not_blank("bin_uri"), F.col("n")).otherwise(0)) * 100.0,
                     F.sum("n")).alias("bin_coverage"),
    )


def order_columns(df: DataFrame) -> DataFrame:
    """Curator columns first, in their fixed order, the rest after."""
    first = [c for c in rules.CURATOR_COLUMNS if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])
