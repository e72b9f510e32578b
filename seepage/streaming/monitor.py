"""Watching arriving pastes: the batch detection on a stream, with each content id reported once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seepage.functions import text as X
from seepage.operators.score import score_content, site_counts

HOT_ID_SALTS = 16


def detect(pastes: DataFrame, target: str) -> DataFrame:
    """Pastes that name the target in title or preview and in their content, scored.

    The same function serves batch and streaming frames. The cheap test on
    title and preview stands before the one on the content.
    """
    named = pastes.where(X.mentions_target(target, "title", "content_preview")).where(
        X.mentions_target(target, "content")
    )
    scored = score_content(named, "content", target)
    return scored.withColumn("content_id", X.content_id("url", "title", "date")).withColumn(
        "content_preview", X.truncate(X.redacted("content"), 500)
    )


def once_per_id(detections: DataFrame, arrival: str, delay: str) -> DataFrame:
    """First arrival per content id.

    ``arrival`` is when a row came in, not when it was seen at its source: an
    old row that comes in last is new all the same. State is bounded by the
    watermark on it, so a repeat that comes in later than ``delay`` after the
    first is reported again, and no first arrival is lost. The first step works
    on (id, salt), which spreads a hot id over several tasks and leaves at most
    one row per salt for the second.
    """
    salt = F.pmod(F.xxhash64("site", "content", F.spark_partition_id()), F.lit(HOT_ID_SALTS)).cast("int")
    return (
        detections.withWatermark(arrival, delay)
        .withColumn("_salt", salt)
        .dropDuplicatesWithinWatermark(["content_id", "_salt"])
        .dropDuplicatesWithinWatermark(["content_id"])
        .drop("_salt")
    )


def once_ever(detections: DataFrame, arrival: str, delay: str, seen: DataFrame | None = None) -> DataFrame:
    """First arrival per content id that neither the stream nor the history has had, whatever the delay.

    ``seen`` (content_id) is what earlier batch runs found. The ids of the
    stream itself are kept as state without a time limit, 16 bytes and the id each; the
    step before it, whose state the watermark bounds, spreads a hot id over
    several tasks. A query that starts again from its checkpoint has its state
    again. Put the state into RocksDB where ids outgrow the executors' memory
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    if seen is not None:
        detections = detections.join(seen.select("content_id").distinct(), "content_id", "left_anti")
    salt = F.pmod(F.xxhash64("site", "content", F.spark_partition_id()), F.lit(HOT_ID_SALTS)).cast("int")
    return (
        detections.withWatermark(arrival, delay)
        .withColumn("_salt", salt)
        .dropDuplicatesWithinWatermark(["content_id", "_salt"])
        .drop("_salt")
        .dropDuplicates(["content_id"])
    )


def monitor(pastes: DataFrame, target: str, delay: str, sink: str, checkpoint: str, trigger: dict | None = None,
            forever: bool = False, seen: DataFrame | None = None):
    """Start the job that appends detections to a parquet folder; returns the running query.

    Every row is stamped with the time it came in (``discovered_at``).
    ``trigger`` goes to ``writeStream.trigger``: by default what is there is
    processed and the query ends; pass ``{"processingTime": "1 minute"}`` to
    keep watching. With ``forever``, or a history in ``seen``, no content id is
    reported twice; otherwise a repeat later than ``delay`` is.
    """
    arriving = pastes.withColumn("discovered_at", F.current_timestamp())
    found = detect(arriving, target)
    if forever or seen is not None:
        found = once_ever(found, "discovered_at", delay, seen)
    else:
        found = once_per_id(found, "discovered_at", delay)
    return (
        found.drop("content").withColumn("detection_type", F.lit("real_time"))
        .writeStream.format("parquet").outputMode("append")
        .option("path", sink).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def summarise(detections: DataFrame, folder: str, checkpoint: str, at: str = "discovered_at", trigger: dict | None = None):
    """Keep the exposure counts of each site up to date while detections arrive; returns the running query.

    ``detections`` is a stream of what ``monitor`` writes. Counts are state, one
    row a site; a micro-batch writes the sites it changed into its own folder
    and replaces that folder if it runs again, so nothing counts twice.
    """
    counts = detections.groupBy("site").agg(*site_counts(at))

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return (
        counts.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def summary(spark: SparkSession, folder: str) -> DataFrame:
    """The counts of each site as its last micro-batch left them."""
    kept = spark.read.parquet(folder)
    newest = F.max_by(F.struct(*[c for c in kept.columns if c != "batch"]), "batch").alias("newest")
    return kept.groupBy(F.col("site").alias("_site")).agg(newest).select("newest.*")
