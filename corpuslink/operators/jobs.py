"""The life of jobs, from their stage events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import numbered
from .catalog import STAGES


def fold_stage_log(events: DataFrame) -> DataFrame:
    """job_id, its status and the state of each stage, from the last event of each (job, stage)."""
    last = events.groupBy("job_id", "stage").agg(F.max_by("state", F.struct("updated_at", "event_id")).alias("state"), F.max(F.struct("updated_at", "event_id")).alias("at"))
    log = F.map_from_entries(F.sort_array(F.collect_list(F.struct("stage", "state"))))
    newest = F.max_by(F.struct("stage", "state"), "at")
    out = last.groupBy("job_id").agg(log.alias("stage_log"), newest.alias("n"))
    staged = F.col("n.state").isin("failed", "processing")
    return out.select("job_id", F.when(staged, F.concat_ws(":", "n.state", "n.stage")).otherwise(F.col("n.state")).alias("status"), "stage_log")


def stuck_jobs(jobs: DataFrame, now: str, minutes: int = 30) -> DataFrame:
    """Jobs that have been processing for longer, as failed at their stage with the reason."""
    late = F.col("status").startswith("processing:") & (F.col("updated_at") < F.lit(now).cast("timestamp_ntz") - F.make_interval(mins=F.lit(minutes)))
    stage = F.substring_index("status", ":", -1)
    return jobs.where(late).select("job_id", F.concat(F.lit("failed:"), stage).alias("status"), F.concat(F.lit("no progress in "), stage).alias("error"))


def claim_order(jobs: DataFrame) -> DataFrame:
    """Pending jobs, the oldest first, with the stage they start from. jobs: job_id, status, updated_at, retry_from."""
    pending = jobs.where("status = 'pending'").select("job_id", "updated_at", F.coalesce("retry_from", F.lit(STAGES[0])).alias("start_stage"))
    return numbered(pending, "updated_at", "job_id").select("job_id", "place", "start_stage")


def retry(jobs: DataFrame, stage: str) -> DataFrame:
    """Every job with its new status and, where it can't be retried, the reason."""
    failed = F.col("status").startswith("failed")
    reason = F.when(F.lit(stage not in STAGES), "unknown stage").when(~failed, F.concat(F.lit("status is "), "status"))
    return jobs.select("job_id", F.when(reason.isNull(), "pending").otherwise(F.col("status")).alias("status"), F.when(reason.isNull(), stage).alias("retry_from"), reason.alias("rejected"))


def cancel(jobs: DataFrame) -> DataFrame:
    open_ = (F.col("status") == "pending") | F.col("status").startswith("processing:")
    return jobs.select("job_id", F.when(open_, "cancelled").otherwise(F.col("status")).alias("status"), F.when(~open_, F.concat(F.lit("status is "), "status")).alias("rejected"))


def stage_durations(events: DataFrame) -> DataFrame:
    """Milliseconds from the first to the last event of each stage of a job that has completed."""
    ends = events.groupBy("job_id", "stage").agg(F.min("updated_at").alias("a"), F.max("updated_at").alias("b"), F.bool_or(F.col("state") == "completed").alias("done"))
    ms = F.timestamp_diff("MILLISECOND", F.col("a").cast("timestamp"), F.col("b").cast("timestamp"))
    return ends.where("done").select("job_id", "stage", ms.alias("duration_ms"))


def event_windows(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """Events by window of time and state; on a stream, late data is waited for as long as `late` says."""
    e = events.withWatermark("updated_at", late) if late else events
    return e.groupBy(F.window("updated_at", width).alias("w"), "state").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "state", "n")
