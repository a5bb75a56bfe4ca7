"""Small frames for the tests."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT = [
    "processid", "species", "identification_rank", "bin_uri", "nuc_basecount", "nuc",
    "voucher_type", "inst", "identified_by", "country_ocean", "coord", "collectors",
    "collection_date_start", "collection_date_end", "identification_method", "sector",
    "region", "museumid", "site", "taxonomy_notes", "short_note", "collection_notes", "notes",
]
SPECIMEN = T.StructType([T.StructField(c, T.StringType()) for c in TEXT])

FULL = dict(
    processid="P1", species="Homo sapiens", identification_rank="species", bin_uri="BIN:1",
    nuc_basecount="658", nuc="ATCG", voucher_type="museum", inst="Museum",
    identified_by="Expert", country_ocean="Canada", coord="45,-73", collectors="Coll",
    collection_date_start="2020-01-01", collection_date_end="2020-01-02",
    identification_method="morphology", sector="A", region="B", museumid="M1", site="S1",
    taxonomy_notes="", short_note="", collection_notes="", notes="",
)


def specimens(spark, *rows, **common):
    """Rows given as dicts; what a row leaves out is null."""
    full = [{**common, **r} for r in rows]
    return spark.createDataFrame([tuple(r.get(c) for c in TEXT) for r in full], SPECIMEN)


def full_specimens(spark, *changes):
    """Complete specimens P1, P2, ... with the given changes."""
    rows = [{**FULL, "processid": f"P{i + 1}", **c} for i, c in enumerate(changes)]
    return specimens(spark, *rows)


def species_bins(spark, content, score=None):
    """{species: [bin, ...]} -> one species-rank row per BIN entry."""
    rows = [
        (f"{sp}_{i}", sp, b, "species", float(i))
        for sp, bins in content.items()
        for i, b in enumerate(bins)
    ]
    return spark.createDataFrame(
        rows,
        "processid string, species string, bin_uri string, identification_rank string, quality_score double",
    )


def by_key(df, key="processid"):
    return {r[key]: r.asDict() for r in df.collect()}


def values(df, column):
    return [r[column] for r in df.select(column).collect()]


def one(df):
    return df.first().asDict()


def lit_frame(spark, **columns):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])
