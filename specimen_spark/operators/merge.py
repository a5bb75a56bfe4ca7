"""Merging sources and removing duplicate keys."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specimen_spark.functions.windows import first_per_key


def merge_first_wins(existing: DataFrame | None, new: DataFrame | None, key: str = "processid"):
    """Append the new rows whose key the existing rows lack; None returns the other side.

    Null counts as a key value, as in the membership test it replaces.
    """
    if existing is None:
        return new
    if new is None:
        return existing
    held = existing.select(F.col(key).alias("_held"))
    fresh = new.join(held, new[key].eqNullSafe(held["_held"]), "left_anti")
    return existing.unionByName(fresh)


def tie_order(df: DataFrame, tie) -> list:
    """Order among rows of one key: the tie columns, by default ``record_id``, then all other
    sortable columns, so that any frame has one answer."""
    first = [c for c in (tie or ["record_id"]) if c in df.columns]
    if tie and len(first) < len(tie):
        raise ValueError(f"no tie column {set(tie) - set(first)}")
    rest = [] if tie else [
        f.name for f in df.schema.fields if f.name not in first and not isinstance(f.dataType, (T.MapType, T.VariantType))
    ]
    return [F.col(f"`{c}`") for c in (*first, *rest)]


def merge_sources(sources, key: str = "processid", tie=None) -> DataFrame:
    """Ordered union of sources, the first source that holds a key wins.

    One union and one window replace a chain of anti-joins: a single shuffle on the key.
    """
    tagged = [df.withColumn("_source", F.lit(i)) for i, df in enumerate(sources) if df is not None]
    if not tagged:
        raise ValueError("No sources to merge")
    union = reduce(DataFrame.unionByName, tagged)
    return first_per_key(union, key, [F.col("_source"), *tie_order(union, tie)]).drop("_source")


def first_marked(marked: DataFrame, source: str, named: str | None, key: str = "processid", tie=None) -> DataFrame:
    """As ``merge_sources`` over the requests that one frame's rows are marked with; the marks go.

    ``source`` is the first request a row itself answers, else null; a row with the flag ``named`` brings in all
    rows of its key as a last request. So rows are not repeated per request, and move once: the first row of
    a key by source and tie is the one that stays, if a row of the key answers anything.
    """
    columns = [F.col(f"`{c}`") for c in marked.columns if c not in (source, named)]
    rows = marked.select(*columns, source) if named else marked.filter(F.col(source).isNotNull())
    first = first_per_key(rows, key, [F.col(source).asc_nulls_last(), *tie_order(marked.select(*columns), tie)])
    if not named:
        return first.select(*columns)
    keys = marked.filter(named).select(F.col(key).alias("_key")).distinct()
    held = first.join(keys, F.col(key) == F.col("_key"), "left")
    return held.filter(F.col(source).isNotNull() | F.col("_key").isNotNull()).select(*columns)


def dedupe_processid(df: DataFrame, tie=None) -> DataFrame:
    """One row per ``processid``: the lowest tie key. Row order has no meaning in Spark, so
    given tie columns must be unique inside a ``processid``; without any, see ``tie_order``."""
    return first_per_key(df, "processid", tie_order(df, tie))
