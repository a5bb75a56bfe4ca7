"""Scoring and ranking of arriving specimens.

``stream_score`` joins specimens and images as streams, whose state holds each row in memory. ``stream_score_log`` holds
rows in a commit log and meets them in batch joins, so that tables of any size can arrive in one batch.
"""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from specimen_spark.functions.commitlog import CommitLog
from specimen_spark.functions.storage import exists, file_system, shuffles_released
from specimen_spark.functions.windows import first_per_key
from specimen_spark.operators.score import process_specimens


def stream_score(
    specimens: DataFrame, images: DataFrame | None = None, scoring=None, ranks=None,
    keys=("processid",), time: str = "arrived", within: str = "1 hour", widen=None,
) -> DataFrame:
    """Validation flags, score, rank and defaults on a streaming frame; output mode append.

    Without images, or with a static table of them, it is the batch projection: stateless.

    With a stream of images both streams have an event time, and a specimen is scored at once without
    image and again when an image of its processid arrives, up to ``within`` before or after it. Rows
    with equal ``keys``, and further images of a processid, are dropped ``within`` the watermark, which also
    bounds what the join keeps. ``widen``, a row-wise function, gives the specimens of compact rows with these
    keys and the time, so that shuffles and state hold compact rows. Each specimen so has one or two rows: ``latest_scores`` takes the one that counts.
    """
    if images is None or not images.isStreaming:
        return process_specimens(widen(specimens) if widen else specimens, images, scoring, ranks)
    arriving = (
        specimens.drop("has_image").withWatermark(time, within).dropDuplicatesWithinWatermark(list(keys))
    )
    seen = (
        images.filter(F.col("processid").isNotNull() & (F.col("processid") != ""))
        .select(F.col("processid").alias("_pid"), F.col(time).alias("_seen"))
        .withWatermark("_seen", within).dropDuplicatesWithinWatermark(["_pid"])
    )
    span = F.expr(f"interval {within}")
    near = (F.col("_seen") >= F.col(time) - span) & (F.col("_seen") <= F.col(time) + span)
    with_image = arriving.join(seen, (F.col("processid") == F.col("_pid")) & near).drop("_pid", "_seen")
    both = arriving.withColumn("has_image", F.lit(False)).unionByName(with_image.withColumn("has_image", F.lit(True)))
    return process_specimens(widen(both) if widen else both, None, scoring, ranks)


def stream_score_log(
    specimens: DataFrame, images: DataFrame, path: str, checkpoint: str, columns=("*",), scoring=None, ranks=None,
    keys=("processid",), time: str = "arrived", within: str = "1 hour", widen=None, trigger: dict | None = None,
) -> StreamingQuery:
    """Scores of two streams in a folder below ``path`` per batch; ``read_scores`` reads them.

    A specimen is scored at once, with its image if that is there, and again when one of its processid arrives later, up to
    ``within`` before or after it; so it has one or two rows. Of rows with equal ``keys`` the first counts. As with a
    watermark, rows more than ``within`` behind the newest of the slower stream are not taken. What arrives is a folder of a
    commit log, the stream's state below the checkpoint; batch joins and windows meet it, and folders go once
    nothing that is still taken can be near their rows. ``widen`` gives the specimens of rows with ``has_image``. A batch that a failure
    repeats replaces what it wrote.
    """
    spark = specimens.sparkSession
    rows = specimens.drop("has_image").withColumn("_pid", F.lit(None).cast("string"))
    seen = images.filter(F.col("processid").isNotNull() & (F.col("processid") != "")).select(F.col("processid").alias("_pid"), time)
    arriving = rows.unionByName(seen, allowMissingColumns=True)
    state, span = checkpoint.rstrip("/") + "/state/log", F.expr(f"interval {within}")
    order = ["_batch", F.col(time), F.xxhash64(*[c for c in rows.columns if c != "_pid"])]

    def near(times: str):
        return F.coalesce(F.exists(times, lambda t: (t >= F.col(time) - span) & (t <= F.col(time) + span)), F.lit(False))

    def write(batch: DataFrame, batch_id: int) -> None:
        log = CommitLog(spark, state)
        _note(spark, state + "/_schema.json", batch.schema.json())
        named = log.record()["folders"]
        before = [f for f in named if f["batch"] < batch_id]
        limit = _limit(before, within)
        taken = batch if limit is None else batch.filter(F.unix_micros(time) >= limit)
        entry = log.write(taken, f"batch-{batch_id}", batch=batch_id)
        entry |= _newest(log.frame(batch.schema, names=[entry["name"]]), time)
        old = [f for f in before if _last(f) is not None and (limit is None or _last(f) >= limit - _micros(within))]
        log.commit([entry], [f["name"] for f in named if f not in old])
        log.clean()
        if _last(entry) is None:
            return
        held = reduce(DataFrame.unionByName, [
            log.frame(batch.schema, names=[f["name"]]).withColumn("_batch", F.lit(f["batch"])) for f in [*old, entry]])
        new = F.col("_batch") == batch_id
        times = held.filter("_pid is not null").groupBy("_pid").agg(
            F.collect_set(F.when(new, F.col(time))).alias("_now"), F.collect_set(F.when(~new, F.col(time))).alias("_before"))
        met = held.filter("_pid is null").drop("_pid").join(times, F.col("processid") == F.col("_pid"), "left").drop("_pid")
        found = first_per_key(met, list(keys), order).withColumns({"_now": near("_now"), "_before": near("_before"), "_new": new}).filter(
            "_new or (_now and not _before)").withColumn("has_image", F.expr("_now or _before")).drop("_new", "_now", "_before", "_batch")
        scores = process_specimens(widen(found) if widen else found, None, scoring, ranks).select(*columns)
        with shuffles_released(spark):
            scores.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return arriving.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(
        **(trigger or {"processingTime": "10 seconds"})).start()


def _newest(rows: DataFrame, time: str) -> dict:
    """Newest times of a folder's specimens and images in microseconds, null without any."""
    at = F.unix_micros(time)
    return rows.agg(F.max(F.when(F.col("_pid").isNull(), at)).alias("specimen"), F.max(F.when(F.col("_pid").isNotNull(), at)).alias("image")).first().asDict()


def _last(folder: dict) -> int | None:
    return max((x for x in (folder["specimen"], folder["image"]) if x is not None), default=None)


def _limit(folders: list[dict], within: str) -> int | None:
    """Times before this are too late; null as long as one of the streams has brought nothing."""
    newest = [max((f[kind] for f in folders if f[kind] is not None), default=None) for kind in ("specimen", "image")]
    return None if None in newest else min(newest) - _micros(within)


def _micros(within: str) -> int:
    count, unit = within.split()
    return int(count) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1_000_000


def _note(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written once."""
    if not exists(spark, path):
        fs, target = file_system(spark, path)
        stream = fs.create(target, True)
        stream.write(bytearray(text.encode()))
        stream.close()


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """The rows that ``stream_score_log`` wrote; ``latest_scores`` takes those that count."""
    return spark.read.option("recursiveFileLookup", True).parquet(path)


def latest_scores(rows: DataFrame, keys=("processid",)) -> DataFrame:
    """One row per specimen of what ``stream_score`` wrote: the one with its image, if it came."""
    return first_per_key(rows, list(keys), [F.col("has_image").desc()])
