"""Streaming jobs over new mail, alerts and the decision log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headrisk import constants as C
from headrisk.functions.domains import SuffixRules
from headrisk.operators.alerts import PLACE_KEEP_MS
from headrisk.operators.history import log_entries, retain_latest
from headrisk.operators.lookups import is_small
from headrisk.operators.scoring import assess
from headrisk.settings import Settings
from headrisk.streaming.state import DELAYED_DDL, PACED_STREAM_DDL, PENDING_DDL, DelayedAlert, PacedAlerts, PendingAlert

PERIOD_PARTS = 8
#: Files that a task of a log's writer has open at once; a task with rows of more periods sorts them.
OPEN_FILES = 4
#: Files of a log that a compaction names in its plan, at most.
LISTED_FILES = 1000
CHECKPOINT_CONF = "spark.checkpoint.dir"


def checkpoint_dir(spark: SparkSession, job: str, fallback: str | None = None) -> str:
    """Folder for a job's progress below the shared folder the cluster names."""
    root = spark.conf.get(CHECKPOINT_CONF, None) or fallback
    if root is None:
        raise ValueError(f"set {CHECKPOINT_CONF} to a shared folder")
    return f"{root.rstrip('/')}/{job}"


def scored_stream(messages: DataFrame, settings: Settings, rules: SuffixRules, contacts: DataFrame | None = None,
                  account_domains: DataFrame | None = None) -> DataFrame:
    """Log rows of a stream of messages.

    Scoring is one narrow pass with joins to static tables, so the batch transform runs on the
    stream as it is and keeps no state.
    """
    return log_entries(assess(messages, settings, rules, contacts, account_domains),
                       F.col("received_at").cast("timestamp"), settings)


def score_stream(messages: DataFrame, path: str, checkpoint: str, settings: Settings, rules: SuffixRules,
                 contacts: DataFrame | None = None, account_domains: DataFrame | None = None, **trigger):
    """Score new mail and append it to the decision log, exactly once per file of the sink."""
    rows = scored_stream(messages, settings, rules, contacts, account_domains)
    return (rows.withColumn("assessed_on", F.to_date("assessed_at")).writeStream.format("parquet")
            .partitionBy("assessed_on").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(**(trigger or {"availableNow": True})).start())


def _dated(log: DataFrame, period: str, parts: int) -> DataFrame:
    """Rows with the first day of their period, each period dealt to ``parts`` tasks and files."""
    return (log.withColumn("assessed_on", F.to_date(F.date_trunc(period, "assessed_at")))
            .repartition("assessed_on", F.pmod(F.xxhash64("msg_id"), F.lit(parts))))


def _write_dated(log: DataFrame, path: str, period: str, parts: int) -> None:
    """A task has rows of few periods, so it keeps their files open instead of sorting its wide rows by period first."""
    conf, key = log.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(key)
    conf.set(key, str(OPEN_FILES))
    try:
        _dated(log, period, parts).write.mode("overwrite").partitionBy("assessed_on").parquet(path)
    finally:
        conf.set(key, before)


def log_sink(path: str, stream: str, period: str = "day", parts: int = PERIOD_PARTS):
    """For ``foreachBatch``: each batch has a folder of its own below ``path``, which a replay of the batch overwrites."""
    def write(batch: DataFrame, batch_id: int) -> None:
        _write_dated(batch, f"{path}/stream={stream}/batch={batch_id}", period, parts)
    return write


def read_log_sink(spark: SparkSession, path: str) -> DataFrame:
    """All batches of all streams of a log, with ``stream``, ``batch`` and ``assessed_on``, the first day of the period."""
    return spark.read.option("basePath", path).parquet(path)


def compact_log(spark: SparkSession, path: str, target: str, n: int = C.LOG_MAX, owner: str = "account_id", period: str = "day",
                parts: int = PERIOD_PARTS) -> DataFrame:
    """Write the newest ``n`` entries of every owner as few files per period; the batches stay as they are.

    Only owner, time and id are ranked; the entries themselves are read once, from the files that hold one to keep, and not moved before.
    """
    log = read_log_sink(spark, path)
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    newest = retain_latest(log.select(*dict.fromkeys([owner, "assessed_at", "msg_id"]), *place), n, owner).select("_file", "_row").persist()
    try:
        files = [r["_file"] for r in newest.select("_file").distinct().limit(LISTED_FILES + 1).collect()]
        rows = log.where(F.col("_metadata.file_path").isin(files)) if len(files) <= LISTED_FILES else log
        kept = rows.select(*log.columns, *place).join(F.broadcast(newest) if is_small(newest) else newest, ["_file", "_row"], "left_semi")
        _write_dated(kept.select(*[c for c in log.columns if c not in ("stream", "batch", "assessed_on")]), target, period, parts)
    finally:
        newest.unpersist()
    return spark.read.parquet(target)


def dedup_alerts(alerts: DataFrame, delay_ms: int = C.ALERT_DELAY_MS, watermark: str = "0 seconds") -> DataFrame:
    """Ignore a message that waits already; ``msg_id`` and ``at_ms`` of the others. ``operators.alerts.pending_alerts`` is the batch form.

    ``alerts(msg_id, assessed_at timestamp)``. Dropping duplicates within a watermark would not do: it forgets a message
    only at the end of a later batch, so a request after the delay is lost or not as the batches fall.
    """
    return (alerts.withWatermark("assessed_at", watermark).groupBy("msg_id").transformWithStateInPandas(
        statefulProcessor=PendingAlert(delay_ms), outputStructType=PENDING_DDL, outputMode="append", timeMode="eventTime"))


def delayed_alerts(events: DataFrame, delay_ms: int = C.ALERT_DELAY_MS, watermark: str = "0 seconds",
                   keep_ms: int = PLACE_KEEP_MS) -> DataFrame:
    """Alerts that still stand after the delay; ``operators.alerts.settled_alerts`` is the batch form.

    ``events(msg_id, at timestamp, kind, junk, folder_type)``: kind ``alert`` asks for an alert,
    ``moved`` and ``deleted`` report where the message is now, which holds for ``keep_ms``. Of changes
    at one time, one that takes the message away counts. An alert comes out when the watermark passes its time.
    """
    return (events.withWatermark("at", watermark).groupBy("msg_id").transformWithStateInPandas(
        statefulProcessor=DelayedAlert(delay_ms, keep_ms), outputStructType=DELAYED_DDL, outputMode="append",
        timeMode="eventTime"))


def paced_stream(alerts: DataFrame, interval_ms: int = C.ALERT_INTERVAL_MS, queue_max: int = C.ALERT_QUEUE_MAX,
                 watermark: str = "0 seconds") -> DataFrame:
    """Paced alerts per owner; ``alerts(owner, at timestamp, msg_id, group_key, eligible)``.

    An alert is taken when the watermark passes it, in order of time and message, and so gives what ``operators.alerts.paced_alerts`` does.
    """
    return (alerts.withWatermark("at", watermark).groupBy("owner").transformWithStateInPandas(
        statefulProcessor=PacedAlerts(interval_ms, queue_max), outputStructType=PACED_STREAM_DDL,
        outputMode="append", timeMode="eventTime"))


def stream_counts(log: DataFrame, window: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Messages per class and time window."""
    return (log.withWatermark("assessed_at", watermark)
            .groupBy(F.window("assessed_at", window).alias("w"), "classification")
            .agg(F.count("*").alias("n"))
            .select(F.col("w.start").alias("window_start"), "classification", "n"))
