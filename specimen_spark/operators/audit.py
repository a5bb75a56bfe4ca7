"""Audit rows: filter by level, export history, export statistics."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEGABYTE = 1024 * 1024


def audit_filter(audit: DataFrame, level: str | None = None) -> DataFrame:
    return audit if level is None else audit.filter(F.col("level") == level)


def _in_range(audit: DataFrame, from_date, to_date) -> DataFrame:
    """Days are inclusive on both ends. The bounds are plain timestamps, so they push down; where rows
    have the ``day`` of their folder, other folders are not read."""
    first, last = F.lit(from_date).cast("date"), F.lit(to_date).cast("date")
    if from_date is not None:
        audit = audit.filter(F.col("timestamp") >= first)
        audit = audit.filter(F.col("day") >= first) if "day" in audit.columns else audit
    if to_date is not None:
        audit = audit.filter(F.col("timestamp") < F.date_add(last, 1))
        audit = audit.filter(F.col("day") <= last) if "day" in audit.columns else audit
    return audit


def _exports(audit: DataFrame, from_date, to_date) -> DataFrame:
    return _in_range(audit, from_date, to_date).filter(F.col("export_type").isNotNull())


def export_history(
    audit: DataFrame, from_date=None, to_date=None, export_type=None, format=None,
    limit: int | None = None, tie: str | None = None, after: tuple | None = None,
) -> DataFrame:
    """Exports in a date range, newest first; ``limit`` cuts a report's page from them.

    ``after`` is the ``page_key`` of the page before: the next one begins behind it, without sorting or
    skipping what came earlier. Pages are complete where ``tie`` is unique among equal times.
    """
    rows = _exports(audit, from_date, to_date)
    if export_type not in (None, "All"):
        rows = rows.filter(F.col("export_type") == export_type)
    if format not in (None, "All"):
        rows = rows.filter(F.col("format") == format)
    if after is not None:
        when = F.lit(after[0])
        behind = F.col("timestamp") < when
        rows = rows.filter(behind | ((F.col("timestamp") == when) & (F.col(tie) < F.lit(after[1]))) if tie else behind)
        rows = rows.filter(F.col("day") <= F.to_date(when)) if "day" in rows.columns else rows
    rows = rows.orderBy(F.col("timestamp").desc(), *([F.col(tie).desc()] if tie else []))
    return rows if limit is None else rows.limit(limit)


def page_key(page: DataFrame, tie: str | None = None) -> tuple | None:
    """What ``after`` takes for the next page: the last row's time and tie; None for an empty page."""
    order = [F.col("timestamp").asc(), *([F.col(tie).asc()] if tie else [])]
    last = page.select("timestamp", *([tie] if tie else [])).orderBy(*order).first()
    return None if last is None else tuple(last)


def export_stats(audit: DataFrame, from_date=None, to_date=None) -> DataFrame:
    """Totals, success percent (1 decimal), average size in MB (2 decimals)."""
    total, size = F.count(F.lit(1)), F.sum("file_size")
    good = F.count_if(F.coalesce("success", F.lit(False)))
    return _exports(audit, from_date, to_date).agg(
        total.alias("total_exports"),
        good.alias("successful_exports"),
        F.round(F.try_divide(good, total) * 100, 1).alias("success_rate"),
        F.coalesce(F.sum("record_count"), F.lit(0)).alias("total_records_exported"),
        F.round(F.try_divide(size, total) / MEGABYTE, 2).alias("avg_size_mb"),
    )
