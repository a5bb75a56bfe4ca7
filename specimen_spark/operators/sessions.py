"""Saved sessions as tables.

Layout: ``root/tables/day=<day>/session_id=<id>/version=<v>/<key>`` holds one dataset per key of a save,
``root/sessions/bucket=<hash of the id>`` a metadata row per save that names its day and version. The
row is appended after all tables of its version are complete, so a save that fails leaves the earlier
one readable, and a session may be saved from its own loaded tables. The completed version before the
current one stays, for frames that still read it; older ones are deleted.

A session is found in its bucket alone. Expiry rewrites the buckets that hold expired sessions by one
dynamic partition overwrite, and drops whole days of tables; neither grows with the sessions' number.
"""

import json
import time
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specimen_spark.functions.storage import children, delete, exists, materialize
from specimen_spark.functions.text import count_distinct_null_as_value, trimws
from specimen_spark.functions.windows import first_per_key

META_SCHEMA = T.StructType(
    [
        T.StructField("created_at", T.StringType()),
        T.StructField("updated_at", T.StringType()),
        T.StructField("user_email", T.StringType()),
        T.StructField("user_name", T.StringType()),
        T.StructField("user_orcid", T.StringType()),
        T.StructField("specimen_count", T.LongType()),
        T.StructField("species_count", T.LongType()),
        T.StructField("search_taxa", T.StringType()),
    ]
)
LIST_COLUMNS = [
    "session_id", "created_at", "updated_at", "user_email", "user_name", "user_orcid",
    "specimen_count", "species_count",
]


#: Partitions of the metadata.
BUCKETS = 64
PLACE = [T.StructField("version", T.StringType()), T.StructField("day", T.StringType()), T.StructField("session_id", T.StringType())]
STORED = T.StructType([*META_SCHEMA.fields, *PLACE])


def _bucket(session_id):
    return F.pmod(F.xxhash64(session_id), F.lit(BUCKETS)).cast("int")


def _home(root: str, session_id: str, day: str, version: str) -> str:
    return f"{root}/tables/day={day}/session_id={session_id}/version={version}"


def save_session(root: str, session_id: str, tables: dict, meta: dict, now: str, spark=None) -> None:
    """Write every non-null table of the session as a new version, then its metadata row.

    ``created_at`` of an earlier save is kept. Counts are taken from ``specimen_data``;
    null counts as one species. ``search_taxa`` may be text or a list, which is kept as JSON.
    """
    if "/" in session_id or not session_id:
        raise ValueError("session_id must be non-empty and without '/'")
    present = {k: df for k, df in tables.items() if df is not None}
    spark = spark or SparkSession.getActiveSession()
    earlier = _versions(spark, root, session_id).select("created_at", "day", "version").orderBy("version").collect()
    version, day = f"{time.time_ns():020d}", now[:10]
    home = _home(root, session_id, day, version)
    for key, df in present.items():
        df.write.parquet(f"{home}/{key}")
    records = species = 0
    if "specimen_data" in present:
        counted = spark.read.parquet(f"{home}/specimen_data").agg(
            F.count(F.lit(1)).alias("n"),
            count_distinct_null_as_value("species").cast("long").alias("species"),
        ).first()
        records, species = counted["n"], counted["species"]
    taxa = meta.get("search_taxa", "")
    created = min((r["created_at"] for r in earlier), default=now)
    row = (
        created, now, meta.get("email", ""), meta.get("name", ""), meta.get("orcid", ""),
        records, species, taxa if isinstance(taxa, str) else json.dumps(taxa), version, day, session_id,
    )
    (
        spark.createDataFrame([row], STORED).withColumn("bucket", _bucket(F.col("session_id"))).coalesce(1)
        .write.mode("append").partitionBy("bucket").parquet(f"{root}/sessions")
    )
    for old in earlier[-3:-1]:  # those before were deleted by earlier saves
        delete(spark, _home(root, session_id, old["day"], old["version"]))


def store_sessions(saves: DataFrame, root: str) -> None:
    """Append metadata rows of saves without tables, as when a listing is taken over."""
    given = [F.col(c).cast(t.dataType).alias(c) if c in saves.columns else F.lit(None).cast(t.dataType).alias(c)
             for c, t in ((f.name, f) for f in META_SCHEMA.fields)]
    rows = saves.select(*given, F.col("updated_at").alias("version"), F.substring("updated_at", 1, 10).alias("day"), "session_id")
    rows.withColumn("bucket", _bucket(F.col("session_id"))).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{root}/sessions")


def _versions(spark: SparkSession, root: str, session_id: str | None = None) -> DataFrame:
    """A row per save that was completed; of one session, from its bucket alone."""
    schema = T.StructType([*STORED.fields, T.StructField("bucket", T.IntegerType())])
    if not exists(spark, f"{root}/sessions"):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(f"{root}/sessions").filter(F.col("session_id").isNotNull())
    if session_id is None:
        return rows
    bucket = spark.range(1).select(_bucket(F.lit(session_id))).first()[0]
    return rows.filter((F.col("bucket") == bucket) & (F.col("session_id") == session_id))


def _latest(rows: DataFrame) -> DataFrame:
    return first_per_key(rows, "session_id", [F.col("version").desc()])


def _described(rows: DataFrame) -> DataFrame:
    return rows.select(*META_SCHEMA.fieldNames(), "session_id")


def read_sessions(spark: SparkSession, root: str) -> DataFrame:
    """The latest save of every session."""
    return _described(_latest(_versions(spark, root)))


def load_session(spark: SparkSession, root: str, session_id: str) -> dict | None:
    """The saved tables by key, a one-row ``metadata`` frame and, if saved, the list
    ``search_taxa``; None for an unknown id."""
    if not session_id:
        return None
    latest = _latest(_versions(spark, root, session_id))
    row = latest.first()
    if row is None:
        return None
    state = {"metadata": _described(latest)}
    home = _home(root, session_id, row["day"], row["version"])
    for key in children(spark, home):
        state[key] = spark.read.parquet(f"{home}/{key}")
    if row["search_taxa"]:
        try:
            state["search_taxa"] = json.loads(row["search_taxa"])
        except ValueError:  # plain text: one name
            state["search_taxa"] = [row["search_taxa"]]
    return state


def list_sessions(saves: DataFrame, tie: str | None = None) -> DataFrame:
    """Newest first, one row per session. ``saves`` may hold several saves of a session:
    the latest counts, with the first ``created_at``."""
    order = [F.col("updated_at").desc()] + ([F.col(tie).desc()] if tie else [])
    latest = first_per_key(saves, "session_id", order).drop("created_at")
    first = saves.groupBy("session_id").agg(F.min("created_at").alias("created_at"))
    return (
        latest.join(first, "session_id").select(*LIST_COLUMNS)
        .orderBy(F.col("updated_at").desc(), "session_id")
    )


def filter_sessions_by_user(sessions: DataFrame, email=None, orcid=None, name=None) -> DataFrame:
    """Sessions where any given identifier matches, or whose id is the identifier's hash.

    E-mail and name compare ignoring case. None given: no rows.
    """
    def given(x):
        return bool(x and x.strip())

    tests = []
    for value, column, fold in ((email, "user_email", True), (orcid, "user_orcid", False),
                                (name, "user_name", True)):
        if given(value):
            wanted = value.strip().lower() if fold else value.strip()
            held = F.lower(trimws(column)) if fold else trimws(column)
            tests.append((held == wanted) | (F.col("session_id") == F.md5(F.lit(wanted))))
    if not tests:
        return sessions.limit(0)
    condition = tests[0]
    for t in tests[1:]:
        condition = condition | t
    return sessions.filter(condition)


def expired_sessions(sessions: DataFrame, now: str, max_age_days: int = 30) -> DataFrame:
    """Sessions last saved strictly before ``now`` minus the age; ISO text compares as time."""
    cutoff = F.date_format(
        F.to_timestamp(F.lit(now), "yyyy-MM-dd'T'HH:mm:ss") - F.make_dt_interval(F.lit(max_age_days)),
        "yyyy-MM-dd'T'HH:mm:ss",
    )
    return sessions.filter(F.col("updated_at") < cutoff)


def _cutoff(now: str, max_age_days: int) -> str:
    return (datetime.fromisoformat(now) - timedelta(days=max_age_days)).isoformat()


def _listing(spark: SparkSession, root: str) -> dict[int, list[str]]:
    """Names of the files of each bucket."""
    return {b: children(spark, f"{root}/sessions/bucket={b}") for b in range(BUCKETS)}


def expire_sessions(spark: SparkSession, root: str, now: str, max_age_days: int = 30) -> int:
    """Forget expired sessions and delete their tables; returns how many.

    The rows that stay are written once and then replace the buckets that hold an expired session, each in
    whole; of the rows that stay, a session keeps its last two. A bucket that gets a save meanwhile is done
    anew. Then the tables of all days before the cutoff's go, a call for each day: an expired session of the
    cutoff's own day is no longer found, and its tables go a day later. Only bucket numbers, a count
    and names of days come to the driver.
    """
    for _ in range(10):
        before = _listing(spark, root)
        rows = _versions(spark, root)
        order = W.partitionBy("session_id").orderBy(F.col("version").desc())
        recent = rows.withColumn("_rn", F.row_number().over(order)).filter("_rn <= 2")
        old = F.max("updated_at").over(W.partitionBy("session_id")) < _cutoff(now, max_age_days)
        judged = materialize(recent.withColumn("_old", old), "sessions")
        expired = judged.filter("_old")
        buckets = [r[0] for r in expired.select("bucket").distinct().collect()]
        if not buckets:
            break
        removed = expired.filter("_rn = 1").count()
        # A row without an id stands in each bucket, so that one that becomes empty is replaced too.
        empty = spark.createDataFrame([(b,) for b in buckets], "bucket int")
        columns = [f.name for f in STORED.fields]
        stay = judged.filter(~F.col("_old") & F.col("bucket").isin(buckets)).select(*columns, "bucket")
        marks = empty.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in STORED.fields], "bucket")
        now_there = _listing(spark, root)
        if any(before[b] != now_there[b] for b in buckets):
            continue
        (
            stay.unionByName(marks).repartition("bucket").write.mode("overwrite").partitionBy("bucket")
            .option("partitionOverwriteMode", "dynamic").parquet(f"{root}/sessions")
        )
        break
    else:
        raise RuntimeError("sessions are saved faster than they can be expired")
    last = _cutoff(now, max_age_days)[:10]
    for name in children(spark, f"{root}/tables"):
        if name.startswith("day=") and name[len("day="):] < last:
            delete(spark, f"{root}/tables/{name}")
    return removed if buckets else 0
