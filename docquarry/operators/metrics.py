"""Event metrics and ingestion progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry import constants as C
from docquarry.operators import ranks
from docquarry.operators.topn import first_per_group


def recent_events(events: DataFrame, history: int = C.METRICS_HISTORY) -> DataFrame:
    """The last ``history`` events; events have ``event_id``, ``ts``, ``event_type``, ``duration``."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(history)


def counters(events: DataFrame) -> DataFrame:
    """Lifetime count per type."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"))


def event_stats(events: DataFrame, history: int = C.METRICS_HISTORY) -> DataFrame:
    """One row: number, mean and 95th percentile of the kept events' durations.

    Events without a duration, or with 0, do not count.  The percentile is the
    value at index ``int(n * 0.95)`` of the sorted durations.
    """
    kept = recent_events(events, history)
    timed = F.filter(F.sort_array(F.collect_list("duration")), lambda d: d != 0)
    one = kept.agg(F.count("*").alias("events"), timed.alias("_d"))  # at most `history` values
    n = F.size("_d")
    index = F.least(F.floor(n * 0.95).cast("int"), n - 1)
    total = F.aggregate("_d", F.lit(0.0), lambda a, b: a + b)
    return one.select(
        "events",
        F.when(n > 0, F.round(total / n, 3)).otherwise(0.0).alias("avg_duration"),
        F.when(n > 0, F.round(F.get("_d", index), 3)).otherwise(0.0).alias("p95_duration"),
    )


def all_event_stats(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Number, mean and 95th percentile of the durations of all events, for each group.

    As ``event_stats``, without a limit on the history: the percentile is found by
    narrowing down its rank, not by sorting.  Groups without a duration get 0.
    """
    keys = keys or []
    timed = ranks.value_at(events.where(F.col("duration") != 0), keys, "duration", 0.95)
    counted = events.groupBy(*keys).agg(F.count("*").alias("events"))
    names = [f"_g{i}" for i in range(len(keys))]
    found = timed.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], "n", "total", "value")
    on = F.lit(True)
    for k, n in zip(keys, names):
        on = on & F.col(k).eqNullSafe(F.col(n))
    return counted.join(found, on, "left").select(
        *keys, "events",
        F.coalesce(F.round(F.col("total") / F.col("n"), 3), F.lit(0.0)).alias("avg_duration"),
        F.coalesce(F.round("value", 3), F.lit(0.0)).alias("p95_duration"),
    )


def event_rates(events: DataFrame, now: Column | str, window_seconds: int = 60) -> DataFrame:
    """Events per second of every type over the window that ends at ``now``.

    The rate divides by the time since the oldest event of any type in the
    window, so a window that has just begun to fill is not understated.
    """
    end = F.to_timestamp_ntz(F.lit(now)) if isinstance(now, str) else now
    seconds = F.timestamp_diff("MICROSECOND", F.col("ts"), end) / 1e6
    inside = events.withColumn("_age", seconds).where(F.col("_age").between(0, window_seconds))
    per_type = inside.groupBy("event_type").agg(F.count("*").alias("n"))
    span = inside.agg(F.max("_age")).scalar()
    return per_type.select("event_type", "n", F.when(span > 0, F.col("n") / span).otherwise(0.0).alias("rate"))


def bounded_history(events: DataFrame, per_type: int = C.METRICS_HISTORY) -> DataFrame:
    """The last events of every type, numbered from the newest."""
    order = [F.desc("ts"), F.desc("event_id")]
    return first_per_group(events, ["event_type"], order, per_type, "age_rank")


# --- ingestion status -----------------------------------------------------------


def merge_status(log: DataFrame) -> DataFrame:
    """Current state per crate from a log of status reports.

    Status, error and update time are those of the last report.  Counts and tier
    keep their last known value.  ``completed_at`` is the last completion.  One
    aggregation with partial results, however long a crate's log is.
    """
    when = F.struct("updated_at", "seq")

    def last_known(name: str) -> Column:
        known = F.col(name).isNotNull()
        return F.max_by(F.when(known, F.col(name)), F.when(known, when)).alias(name)

    return log.groupBy("crate_id", "crate").agg(
        F.max_by("status", when).alias("status"),
        F.min("updated_at").alias("started_at"),
        F.max("updated_at").alias("updated_at"),
        F.max(F.when(F.col("status") == "completed", F.col("updated_at"))).alias("completed_at"),
        F.max_by("error_message", when).alias("error_message"),
        last_known("items_processed"),
        last_known("total_items"),
        last_known("ingestion_tier"),
    )


def incomplete(status: DataFrame) -> DataFrame:
    return status.where(F.col("status") != "completed").orderBy(F.desc("updated_at"), "crate_id")


def stalled(status: DataFrame, now: str, after_seconds: int = C.STALL_SECONDS) -> DataFrame:
    """Active runs without a report for too long."""
    end = F.to_timestamp_ntz(F.lit(now))
    quiet = F.timestamp_diff("SECOND", F.col("updated_at"), end)
    active = status.where(F.col("status").isin(C.ACTIVE_STATUSES))
    return active.withColumn("stale_seconds", quiet).where(F.col("stale_seconds") > after_seconds)


def progress(status: DataFrame, elapsed_seconds: float, concurrency: int = 3) -> DataFrame:
    """One row of overall progress with an estimate of the time left.

    Every crate of the status table is a unit of work; finished ones are those
    completed or failed.  The estimate uses the mean time of successful runs.
    """
    took = F.timestamp_diff("SECOND", F.col("started_at"), F.col("completed_at"))
    done = F.col("status") == "completed"
    base = status.agg(
        F.count("*").alias("total"),
        F.count_if(done).alias("success"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.avg(F.when(done & (took > 0), took)).alias("avg_processing_time"),
    )
    processed = F.col("success") + F.col("failed")
    remaining = F.greatest(F.col("total") - processed, F.lit(0))
    percent = F.when(F.col("total") > 0, processed / F.col("total") * 100).otherwise(0.0)
    rate = processed / elapsed_seconds if elapsed_seconds > 0 else F.lit(0.0)
    eta = (
        F.when(
            (remaining > 0) & (F.col("avg_processing_time") > 0),
            F.floor(remaining / (concurrency / F.col("avg_processing_time"))),
        )
        .when((remaining > 0) & (rate > 0), F.floor(remaining / rate))
        .otherwise(F.lit(0))
    )
    return base.select(
        "total",
        "success",
        "failed",
        processed.alias("processed"),
        remaining.alias("remaining"),
        F.least(F.lit(100.0), F.greatest(F.lit(0.0), percent)).alias("progress_percent"),
        rate.alias("rate_per_second"),
        eta.cast("bigint").alias("eta_seconds"),
    )
