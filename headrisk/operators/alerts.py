"""Alerts for low-risk mail: eligibility, texts, duplicate suppression and pacing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headrisk import constants as C
from headrisk.functions.address import filled, strip
from headrisk.functions.pacing import PACED_DDL, keep_after_wait, pace_sorted
from headrisk.settings import Settings

#: How long a message counts as where it was last seen; it is there again for alerts that fall due later.
PLACE_KEEP_MS = 3_600_000


def alert_eligible(assessments: DataFrame, settings: Settings) -> DataFrame:
    keep = F.col("score") <= F.lit(float(settings.alert_max_score))
    return assessments.where(keep if settings.alert_enabled else F.lit(False))


def is_junk_folder(folder_type: Column) -> Column:
    return F.coalesce(folder_type.isin(C.JUNK_FOLDER_TYPES), F.lit(False))


def still_eligible(alerts: DataFrame, mailbox: DataFrame) -> DataFrame:
    """Alerts whose message still exists outside junk-like folders."""
    alive = mailbox.where(~F.coalesce("junk", F.lit(False)) & ~is_junk_folder(F.col("folder_type"))).select("msg_id")
    return alerts.join(alive, "msg_id", "left_semi")


def alert_text(count: Column, account_email: Column, account_name: Column, folder_name: Column, raw_from: Column,
               subject: Column, snippet: Column) -> Column:
    """Title and body of an alert for one or several messages."""
    some = lambda c: filled(strip(c))
    who = F.coalesce(some(account_email), some(account_name), some(folder_name), F.lit("Inbox"))
    title = F.when(count == 1, F.format_string(C.ALERT_SINGLE, who)).otherwise(C.ALERT_MANY_TITLE)
    lines = F.concat_ws(
        "\n",
        F.when(count > 1, F.format_string(C.ALERT_MANY_BODY, count.cast("string"))),
        some(raw_from), F.coalesce(some(subject), F.lit(C.ALERT_NO_SUBJECT)),
        F.when(count > 1, F.format_string(C.ALERT_MORE, (count - 1).cast("string"))).otherwise(some(snippet)))
    return F.struct(title.alias("title"), lines.alias("body"))


# ------------------------------------------------------------------ order-dependent folds

def with_segment(df: DataFrame, key: str, width: int, at: str = "at_ms") -> DataFrame:
    """Number the stretches of a key's time line that no pause of ``width`` interrupts.

    Times are cut into buckets of that width; an empty bucket is a pause. Only the distinct
    buckets of a key are ordered, so their number is bounded by the time span and not by the
    rows, and every stretch can then be worked on by a task of its own.
    """
    bucket = F.floor(F.col(at) / width).cast("bigint")
    occupied = df.select(F.col(key).alias("_key"), bucket.alias("_bucket")).distinct()
    w = Window.partitionBy("_key").orderBy("_bucket")
    islands = occupied.withColumn("segment", F.col("_bucket") - F.row_number().over(w))
    return (df.withColumn("_bucket", bucket)
            .join(islands.withColumnRenamed("_bucket", "_at"),
                  (F.col(key) == F.col("_key")) & (F.col("_bucket") == F.col("_at")))
            .drop("_key", "_bucket", "_at"))


def pending_alerts(alerts: DataFrame, delay_ms: int = C.ALERT_DELAY_MS) -> DataFrame:
    """Drop alerts of a message that already waits; each kept alert starts the wait anew.

    ``alerts(msg_id, at_ms)``. Rows stream through a sorted partition, so a message with any
    number of requests needs no more memory than one with a single request.
    """
    rows = with_segment(alerts.select("msg_id", "at_ms").distinct(), "msg_id", delay_ms)
    return (rows.repartition("msg_id", "segment").sortWithinPartitions("msg_id", "segment", "at_ms")
            .mapInPandas(keep_after_wait(delay_ms), "msg_id bigint, at_ms bigint"))


def settled_alerts(events: DataFrame, delay_ms: int = C.ALERT_DELAY_MS, keep_ms: int = PLACE_KEEP_MS) -> DataFrame:
    """Alerts that still stand after the delay: ``msg_id``, ``requested_at`` and ``shown_at``.

    ``events(msg_id, at_ms, kind, junk, folder_type)`` as for the stream ``jobs.delayed_alerts``. An alert and the changes of
    the ``keep_ms`` before it falls due lie in one or two neighbouring cells of the time line, so a change goes to its own
    cell and the next, and no ordering covers more of a message than two cells.
    """
    gone = (F.col("kind") == "deleted") | F.coalesce("junk", F.lit(False)) | is_junk_folder(F.col("folder_type"))
    cell = F.floor(F.col("at_ms") / (keep_ms + 1)).cast("bigint")
    kept = pending_alerts(events.where("kind = 'alert'"), delay_ms).withColumn("at_ms", F.col("at_ms") + delay_ms)
    due = kept.select("msg_id", cell.alias("cell"), "at_ms", F.lit(0).alias("rank"), F.lit(None).cast("struct<at:bigint,gone:boolean>").alias("place"))
    changes = events.where("kind <> 'alert'").select(
        "msg_id", F.explode(F.array(cell, cell + 1)).alias("cell"), "at_ms", (1 + gone.cast("int")).alias("rank"),
        F.struct(F.col("at_ms").alias("at"), gone.alias("gone")).alias("place"))
    before = Window.partitionBy("msg_id", "cell").orderBy("at_ms", "rank").rowsBetween(Window.unboundedPreceding, -1)
    last = due.unionByName(changes).withColumn("last", F.last("place", ignorenulls=True).over(before)).where("rank = 0")
    hidden = F.coalesce(F.col("last.gone") & (F.col("at_ms") - F.col("last.at") <= keep_ms), F.lit(False))
    return last.where(~hidden).select("msg_id", (F.col("at_ms") - delay_ms).alias("requested_at"), F.col("at_ms").alias("shown_at"))


def paced_alerts(alerts: DataFrame, interval_ms: int = C.ALERT_INTERVAL_MS,
                 queue_max: int = C.ALERT_QUEUE_MAX) -> DataFrame:
    """Alerts as an owner sees them: one per interval, waiting ones folded by account and folder.

    ``alerts(owner, at_ms, msg_id, group_key, eligible)``; the result adds ``shown_at`` and how
    many messages an alert stands for. A full queue is empty after ``queue_max`` intervals, so a
    longer pause separates stretches that cannot influence each other.
    """
    rows = with_segment(alerts.select("owner", "at_ms", "msg_id", "group_key", "eligible"), "owner",
                        (queue_max + 2) * interval_ms)
    return (rows.repartition("owner", "segment").sortWithinPartitions("owner", "segment", "at_ms", "msg_id")
            .mapInPandas(pace_sorted(interval_ms, queue_max), PACED_DDL))
