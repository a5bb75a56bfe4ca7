"""Record retrieval: each request is a filter or semi-join on the universe of specimens."""

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specimen_spark.functions.storage import materialize
from specimen_spark.functions.text import not_blank, title_first, trimws

RECORDSET_COLUMN = "bold_recordset_code_arr"
TAXON_COLUMNS = [
    "kingdom", "phylum", "class", "order", "family", "subfamily", "tribe", "genus",
    "species", "subspecies",
]
#: Marks of a row: the first request whose codes it holds (else null), and whether it has a wanted name.
SOURCE, NAMED = "_source", "_named"
#: Matched names up to this are sent to all tasks; more meet the rows in a join.
MAX_BROADCAST = 1_000_000


def with_columns_of(rows: DataFrame, widen, columns) -> DataFrame:
    """Compact rows with some columns of their records; ``widen``, a row-wise function, gives these."""
    if widen is None:
        return rows
    held = rows.withColumn("_stored", F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    return widen(held).select("_stored.*", *[c for c in columns if c not in rows.columns])


def mark_recordsets(universe: DataFrame, requests, delimiter: str = ",") -> DataFrame:
    """The universe with ``SOURCE``: the place of the first code list a row's recordsets are in, else null."""
    members = F.transform(F.split(F.col(RECORDSET_COLUMN), delimiter), lambda c: trimws(c))
    wanted = []
    for i, codes in enumerate(requests):
        if not isinstance(codes, DataFrame):
            codes = universe.sparkSession.createDataFrame([(c,) for c in codes], "_code string")
        wanted.append(codes.toDF("_code").select(trimws("_code").alias("_code"), F.lit(i).alias(SOURCE)).filter("_code <> ''"))
    first = reduce(DataFrame.union, wanted).groupBy("_code").agg(F.min(SOURCE).alias(SOURCE))
    # membership depends on the recordset text alone: test each distinct text once,
    # then mark the rows that carry a matching one. The texts are written, so that Spark knows
    # their size and moves the universe for them only if they are many
    hits = materialize(
        universe.select(RECORDSET_COLUMN).distinct()
        .select(F.col(RECORDSET_COLUMN).alias("_text"), F.explode(members).alias("_code"))
        .join(first, "_code").groupBy("_text").agg(F.min(SOURCE).alias(SOURCE)), "recordsets")
    return universe.join(hits, F.col(RECORDSET_COLUMN) == F.col("_text"), "left").drop("_text")


def _by_recordset(universe: DataFrame, codes, delimiter: str) -> DataFrame:
    members = F.transform(F.split(F.col(RECORDSET_COLUMN), delimiter), lambda c: trimws(c))
    if not isinstance(codes, DataFrame):
        codes = universe.sparkSession.createDataFrame([(c,) for c in codes], "_code string")
    wanted = codes.toDF("_code").select(trimws("_code").alias("_code")).filter("_code <> ''").distinct()
    # as in mark_recordsets
    hits = materialize(
        universe.select(RECORDSET_COLUMN).distinct()
        .select(RECORDSET_COLUMN, F.explode(members).alias("_code"))
        .join(wanted, "_code", "left_semi")
        .select(RECORDSET_COLUMN).distinct(), "recordsets")
    return universe.join(hits, RECORDSET_COLUMN, "left_semi").select(*universe.columns)


def by_datasets(universe: DataFrame, codes, delimiter: str = ",") -> DataFrame:
    """Records of the given dataset codes (list or one-column frame).

    ``delimiter`` is a regex; how codes are joined in the column depends on the dump.
    """
    return _by_recordset(universe, codes, delimiter)


def by_projects(universe: DataFrame, codes, delimiter: str = ",") -> DataFrame:
    """Records of the given project codes; same membership column."""
    return _by_recordset(universe, codes, delimiter)


def mark_names(universe: DataFrame, names: DataFrame, rank_columns=None) -> DataFrame:
    """The universe with ``NAMED``: whether a name at any rank equals one of the (trimmed, title-cased) names.

    Which ranks a name is compared with is a choice of this package: all that the frame
    has. The universe's distinct names (combined on the map side) meet the wanted ones; those found go to
    all tasks, so no row moves. If they are too many, the distinct rank tuples meet them and the rows meet these.
    """
    present = [c for c in (rank_columns or TAXON_COLUMNS) if c in universe.columns]
    column = names.columns[0] if "name" not in names.columns else "name"
    wanted = (
        names.select(title_first(column).alias("_name")).filter(not_blank("_name")).distinct()
    )
    ranks = F.array(*[F.col(c) for c in present]).cast("array<string>")
    found = materialize(
        universe.select(F.explode(F.array_compact(F.array_distinct(ranks))).alias("_name")).distinct()
        .join(wanted, "_name", "left_semi"), "names")
    if found.count() <= MAX_BROADCAST:
        rows, few = universe, F.broadcast(found)
        for c in present:
            rows = rows.join(few.select(F.col("_name").alias("_at_" + c)), F.col(c) == F.col("_at_" + c), "left")
        any_ = reduce(or_, [F.col("_at_" + c).isNotNull() for c in present], F.lit(False))
        return rows.select(*[F.col(f"`{c}`") for c in universe.columns], any_.alias(NAMED))
    hits = (
        universe.select(ranks.alias("_ranks")).distinct()
        .select("_ranks", F.explode(F.array_compact(F.array_distinct("_ranks"))).alias("_name"))
        .join(found, "_name", "left_semi")
        .select("_ranks").distinct()
    )
    rows = universe.withColumn("_r", ranks).join(hits, F.col("_r") == F.col("_ranks"), "left")
    return rows.withColumn(NAMED, F.col("_ranks").isNotNull()).drop("_r", "_ranks")


def by_taxa(universe: DataFrame, names: DataFrame, rank_columns=None) -> DataFrame:
    """Records whose name at any rank equals one of the names (see ``mark_names``), and all records of their keys.

    An unknown name gives no rows.
    """
    keys = mark_names(universe, names, rank_columns).filter(NAMED).select("processid")
    return universe.join(keys.distinct(), "processid", "left_semi").select(*universe.columns)


def by_processids(universe: DataFrame, ids: DataFrame) -> DataFrame:
    """Full records of a key list. Spark broadcasts the list only when it is small."""
    return universe.join(ids.select("processid").distinct(), "processid", "left_semi")


def bin_members(current: DataFrame, universe: DataFrame, widen=None) -> DataFrame:
    """All universe records of any BIN in ``current``, a written table. ``widen`` gives the columns of compact rows."""
    bins = with_columns_of(current, widen, ["bin_uri"]).filter(not_blank("bin_uri")).select("bin_uri").distinct()
    rows = with_columns_of(universe, widen, ["bin_uri"]).filter(not_blank("bin_uri"))
    return rows.join(bins, "bin_uri", "left_semi").select(*universe.columns)


def expand_bins(current: DataFrame, universe: DataFrame) -> DataFrame:
    """Append all universe records of any BIN in the current set: one hop, first copy wins.

    Geography is not re-applied, so foreign records of the same BIN come back on purpose.
    Blank BINs are dropped before the shuffle; a hot BIN sits on the streamed side of a
    semi-join, which adaptive execution splits. The current set is used three times, so it is
    written once.
    """
    current = materialize(current, "expand")
    members = bin_members(current, universe)
    held = current.select(F.col("processid").alias("_held"))
    new = members.join(held, members.processid.eqNullSafe(held._held), "left_anti")
    return current.unionByName(new.select(*current.columns))
