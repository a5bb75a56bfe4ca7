"""Curator annotations.

Flat form: (processid, kind, value, user, ts), at most one row per (processid, kind);
kinds are selected, flag, updated_id, curator_notes. Older rows may hold a JSON object in
``value``; ``annot_extract`` reads both and passes flat text through unchanged.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specimen_spark import rules
from specimen_spark.functions.text import is_blank, not_blank, strip_html
from specimen_spark.functions.windows import first_per_key
from specimen_spark.operators.filters import order_columns
from specimen_spark.schema import column_or_null

KINDS = list(rules.ANNOTATION_FIELDS)
TS_FORMAT = "yyyy-MM-dd HH:mm:ss"


def _is_object(value: Column) -> Column:
    return F.coalesce(
        F.ltrim(value).startswith("{") & F.get_json_object(value, "$").isNotNull(), F.lit(False)
    )


def _fields(value: Column, names) -> Column:
    return F.coalesce(*[F.get_json_object(value, f"$.{n}") for n in names], F.lit(None))


def annot_extract(value, fields, default: str = "") -> Column:
    """First present field of an object, in priority order; a bare value as it is."""
    value = F.col(value) if isinstance(value, str) else value
    found = F.when(_is_object(value), _fields(value, fields)).otherwise(value)
    return F.coalesce(found, F.lit(default))


def _extract_by_kind(value: Column, kind: Column) -> Column:
    out = None
    for k, fields in rules.ANNOTATION_FIELDS.items():
        found = annot_extract(value, fields)
        out = F.when(kind == k, found) if out is None else out.when(kind == k, found)
    return out.otherwise(annot_extract(value, ["value"]))


def normalize_annotations(df: DataFrame) -> DataFrame:
    """Any annotation rows -> flat form. ``user`` and ``ts`` come from the object where the
    row has none of its own; a bare value leaves them empty."""
    value = F.col("value")
    user = _fields(value, ["user"])
    stamp = _fields(value, ["timestamp"])
    is_object = _is_object(value)
    ts = column_or_null(df, "ts", T.StringType())
    if "ts" in df.columns and isinstance(df.schema["ts"].dataType, (T.TimestampType, T.TimestampNTZType)):
        ts = F.date_format(ts, TS_FORMAT)
    return df.select(
        "processid",
        "kind",
        _extract_by_kind(value, F.col("kind")).alias("value"),
        F.coalesce(column_or_null(df, "user", T.StringType()), F.when(is_object, user), F.lit("")).alias("user"),
        F.coalesce(ts.cast("string"), F.when(is_object, stamp), F.lit("")).alias("ts"),
    )


def _cleared(value: Column, kind: Column) -> Column:
    """An empty value clears an annotation; anything but true clears a selection."""
    return F.when(kind == "selected", F.lower(value) != "true").otherwise(value == "")


def flatten_edits(events: DataFrame) -> DataFrame:
    """Edits with their scalar value; a row-wise step shared by batch and stream."""
    return events.select(
        "event_id", "ts", "processid", "kind",
        _extract_by_kind(F.col("value"), F.col("kind")).alias("value"), "user",
    )


def drop_cleared(state: DataFrame) -> DataFrame:
    return state.filter(~_cleared(F.col("value"), F.col("kind")))


def annot_fold(events: DataFrame) -> DataFrame:
    """Edits (event_id, ts, processid, kind, value, user) -> current state.

    The last write per (processid, kind) wins, later ``event_id`` on equal times; an empty
    value or a deselect deletes.
    """
    last = first_per_key(
        flatten_edits(events), ["processid", "kind"],
        [F.col("ts").desc(), F.col("event_id").desc()],
    )
    return drop_cleared(last).select("processid", "kind", "value", "user", "ts")


def _wide(annotations: DataFrame) -> DataFrame:
    """One row per specimen: a struct (ts, value, user) per kind; of several rows of a kind the
    latest counts."""
    flat = normalize_annotations(annotations)
    entry = F.struct("ts", "value", "user")
    return (
        flat.filter(F.col("kind").isin(KINDS))
        .groupBy("processid")
        .agg(*[F.max(F.when(F.col("kind") == k, entry)).alias(f"_{k}") for k in KINDS])
    )


def _flatten_lists(df: DataFrame) -> DataFrame:
    lists = {
        f.name: F.when(F.size(f.name) > 0, F.array_join(F.col(f.name).cast("array<string>"), "; "))
        for f in df.schema.fields
        if isinstance(f.dataType, T.ArrayType)
    }
    return df.withColumns(lists) if lists else df


def _annotation_values() -> dict:
    return {
        "selected": F.col("_selected").isNotNull(),
        "flag": F.coalesce("_flag.value", F.lit("")),
        "updated_id": F.coalesce("_updated_id.value", F.lit("")),
        "curator_notes": F.coalesce("_curator_notes.value", F.lit("")),
    }


def _drop_wide(df: DataFrame) -> DataFrame:
    return df.drop(*[f"_{k}" for k in KINDS])


def _annotated(df: DataFrame, annotations: DataFrame, widen, replaced) -> tuple[DataFrame, list[str]]:
    """Rows with a struct per kind, and the names of their own columns without those replaced."""
    joined = df.join(_wide(annotations), "processid", "left")
    joined = (widen(joined) if widen else joined).drop(*replaced)
    structs = [f"_{k}" for k in KINDS]
    return joined, [c for c in joined.columns if c not in structs]


def annot_merge(df: DataFrame, annotations: DataFrame, widen=None) -> DataFrame:
    """Annotations joined for display, with defaults; missing curator columns become null.

    ``widen``, a row-wise function, gives the columns of compact rows (with their ``processid``) and
    passes others on; only compact rows meet the annotations then.
    """
    joined, _ = _annotated(df, annotations, widen, ("selected", "flag", "updated_id", "curator_notes"))
    base = _flatten_lists(joined)
    absent = {
        c: F.lit(None).cast("double" if c in ("rank", "quality_score") else "string")
        for c in rules.CURATOR_COLUMNS
        if c not in base.columns and c not in KINDS
    }
    if absent:
        base = base.withColumns(absent)
    casts = {c: F.col(c).cast("double") for c in ("quality_score", "rank")}
    return order_columns(_drop_wide(base.withColumns(casts).withColumns(_annotation_values())))


def annot_merge_export(df: DataFrame, annotations: DataFrame, widen=None) -> DataFrame:
    """Annotations joined for export: flag user and time added, lists joined, HTML stripped
    from every text column of the data, annotation columns first. Idempotent. ``widen``: see
    ``annot_merge``."""
    joined, columns = _annotated(df, annotations, widen, rules.EXPORT_ANNOTATION_COLUMNS)
    base = _flatten_lists(joined)
    # the key had its raw value for the join and is stripped after it
    texts = {c: strip_html(c) for c in columns if isinstance(base.schema[c].dataType, T.StringType)}
    values = {
        **_annotation_values(),
        "flag_user": F.coalesce("_flag.user", F.lit("")),
        "flag_timestamp": F.coalesce("_flag.ts", F.lit("")),
    }
    out = _drop_wide(base.withColumns(texts).withColumns(values))
    first = rules.EXPORT_ANNOTATION_COLUMNS
    return out.select(*first, *[c for c in columns if c not in first])


def annot_validate(annotations: DataFrame, df: DataFrame) -> DataFrame:
    """Violations (processid, kind, problem): unknown flag, long note, unknown selection."""
    flat = normalize_annotations(annotations)
    flags = [f for f in rules.FLAG_LABELS if f]
    rowwise = flat.select(
        "processid", "kind",
        F.when((F.col("kind") == "flag") & not_blank("value") & ~F.col("value").isin(flags),
               "unknown flag")
        .when((F.col("kind") == "curator_notes") & (F.length("value") > rules.MAX_NOTE_LENGTH),
              "note is too long")
        .alias("problem"),
    ).filter(F.col("problem").isNotNull())
    known = df.select("processid")
    unknown = (
        flat.filter("kind = 'selected'").join(known, "processid", "left_anti")
        .select("processid", "kind", F.lit("selected specimen is not in the table").alias("problem"))
    )
    return rowwise.unionByName(unknown)


def annot_flag_labels(annotations: DataFrame) -> DataFrame:
    """(processid, flag, label); an unknown code keeps itself as its label."""
    pairs = [F.lit(x) for pair in rules.FLAG_LABELS.items() for x in pair]
    flags = normalize_annotations(annotations).filter("kind = 'flag'")
    label = F.try_element_at(F.create_map(*pairs), F.col("value"))
    return flags.select(
        "processid", F.col("value").alias("flag"), F.coalesce(label, "value").alias("label")
    )


def flag_options(spark) -> DataFrame:
    return spark.createDataFrame(list(rules.FLAG_LABELS.items()), "flag string, label string")


def annot_counts(annotations: DataFrame) -> DataFrame:
    """(kind, specimens)."""
    return annotations.groupBy("kind").agg(F.count(F.lit(1)).alias("specimens"))


def has_annotations(annotations: DataFrame) -> bool:
    """Anything worth saving; one probe action."""
    return not annotations.filter(~is_blank("kind")).isEmpty()
