"""Streams with state: bounded history, stalled runs, status and counters."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from docquarry import constants as C
from docquarry.operators.topn import first_per_group
from docquarry.session import shared_dir
from docquarry.streaming.merged import MergedTable

#: a key is dealt out to so many states, so that no task has all rows of a frequent one
SHARDS = 16
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _shard(column: str, shards: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(shards)).cast("int").alias("shard")


def stream_folder(spark: SparkSession, kind: str) -> str:
    """A new folder for a stream's progress and results."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


# --- bounded history and lifetime counters ------------------------------------------


class LastEvents(StatefulProcessor):
    """The last ``size`` events of a key as a list state, and the number of all events as a value state.

    Events are ordered by time, then id, not by arrival, so late ones find their
    place.  An event that comes again while it is in the list is not counted again.
    """

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "event_id bigint, micros bigint, duration double")
        self.count = handle.getValueState("count", "n bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        columns = ["event_id", "micros", "duration"]
        kept = pd.DataFrame([tuple(r) for r in self.last.get()] if self.last.exists() else [], columns=columns)
        n = self.count.get()[0] if self.count.exists() else 0
        for part in rows:
            part = part[columns].drop_duplicates("event_id")
            part = part[~part["event_id"].isin(kept["event_id"])]
            n += len(part)
            kept = part if kept.empty else pd.concat([kept, part])
            kept = kept.sort_values(["micros", "event_id"], ascending=False).head(self.size)
        self.last.put([(int(i), int(m), None if pd.isna(d) else float(d)) for i, m, d in kept.itertuples(index=False)])
        self.count.update((n,))
        yield pd.DataFrame({"event_type": [key[0]], "shard": [key[1]], "n": [n], "kept": [len(kept)]})

    def close(self) -> None:
        pass


def track_history(events: DataFrame, per_type: int, shards: int = SHARDS) -> DataFrame:
    """A stream of (event_type, shard, n, kept) for every changed state; the events themselves are in the state."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = events.select("event_type", _shard("event_id", shards), "event_id", F.unix_micros("ts").alias("micros"), F.col("value").alias("duration"))
    return rows.groupBy("event_type", "shard").transformWithStateInPandas(
        LastEvents(per_type), "event_type string, shard int, n bigint, kept bigint", "update", "none"
    )


def history(spark: SparkSession, progress: str, per_type: int) -> DataFrame:
    """The last events of every type, read from the state of a ``track_history`` stream.

    Each shard holds its own last ``per_type``, so the last of all are among them.
    """
    state = spark.read.format("statestore").option("stateVarName", "last").load(progress)
    rows = state.select(
        "key.event_type", "list_element.event_id", F.timestamp_micros("list_element.micros").alias("ts"), "list_element.duration"
    )
    return first_per_group(rows, ["event_type"], [F.desc("ts"), F.desc("event_id")], per_type, "age_rank")


def lifetime_counters(spark: SparkSession, progress: str) -> DataFrame:
    """All events of each type so far, from the state of a ``track_history`` stream."""
    state = spark.read.format("statestore").option("stateVarName", "count").load(progress)
    return state.groupBy("key.event_type").agg(F.sum("value.n").alias("n"))


def state_rows(spark: SparkSession, progress: str, variable: str) -> int:
    """Entries a state variable holds."""
    return spark.read.format("statestore").option("stateVarName", variable).load(progress).count()


def run_history(events: DataFrame, per_type: int, progress: str, shards: int = SHARDS, trigger: dict | None = None) -> StreamingQuery:
    """Start ``track_history``; without a trigger, process what is there and stop."""
    query = (
        track_history(events, per_type, shards).writeStream.foreachBatch(lambda batch, _: batch.write.format("noop").mode("overwrite").save())
        .option("checkpointLocation", progress).outputMode("update").trigger(**(trigger or {"availableNow": True})).start()
    )
    if trigger is None:
        query.awaitTermination()
    return query


# --- ingestion status: upsert and stalled runs -----------------------------------------


STATUS_KEYS = ["crate_id", "crate"]
_REPORT = "struct<updated_at:timestamp,seq:bigint,status:string,error_message:string>"
_KNOWN = {"items_processed": "bigint", "total_items": "bigint", "ingestion_tier": "string"}
STATUS_SCHEMA = f"crate_id bigint, crate string, report {_REPORT}, started_at timestamp, completed_at timestamp, " + ", ".join(
    f"{name} struct<updated_at:timestamp,seq:bigint,value:{kind}>" for name, kind in _KNOWN.items()
)
STATUS_MERGES = {"report": F.max, "started_at": F.min, "completed_at": F.max, **dict.fromkeys(_KNOWN, F.max)}


def status_parts(log: DataFrame) -> DataFrame:
    """Status reports in a form that can be merged in any order: each value with its time."""
    time, values = F.col("updated_at").cast("timestamp"), {}
    for name, kind in _KNOWN.items():
        known = F.struct(time.alias("updated_at"), F.col("seq").cast("bigint").alias("seq"), F.col(name).cast(kind).alias("value"))
        values[name] = F.when(F.col(name).isNotNull(), known).alias(name)
    return log.select(
        F.col("crate_id").cast("bigint").alias("crate_id"), "crate",
        F.struct(time.alias("updated_at"), F.col("seq").cast("bigint").alias("seq"), "status", "error_message").alias("report"),
        time.alias("started_at"), F.when(F.col("status") == "completed", time).alias("completed_at"), *values.values(),
    )


def status_table(spark: SparkSession, path: str, every: int = 20) -> MergedTable:
    return MergedTable(spark, path, STATUS_KEYS, STATUS_MERGES, _schema(spark, STATUS_SCHEMA), every)


def current_status(table: MergedTable) -> DataFrame:
    """The columns of ``metrics.merge_status``."""
    return table.read().select(
        *STATUS_KEYS, "report.status", "started_at", "report.updated_at", "completed_at", "report.error_message",
        *[F.col(f"{name}.value").alias(name) for name in _KNOWN],
    )


#: states that hold the last reports of some runs each, so that a call serves many runs
BUCKETS = 1024
_LAST = {"run": "string", "shard": "int", "crate": "string", "status": "string", "micros": "bigint", "seq": "bigint"}
_LAST_STATE = ", ".join(f"{name} array<{kind}>" for name, kind in {**_LAST, "marked": "boolean"}.items())


def _follow(after: int, by_event_time: bool):
    """The last reports of a bucket's runs are its state, with marks on those that stalled.

    It times out when the first unmarked run has had no other report for ``after`` seconds.
    """

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # of equal reports the last one stays, so known ones come after new ones
        parts = [] if state.hasTimedOut else [part[[*_LAST]].assign(marked=False, fresh=True) for part in frames]
        if state.exists:
            parts.append(pd.DataFrame(dict(zip([*_LAST, "marked"], state.get))).assign(fresh=False))
        last = pd.concat(parts).sort_values(["micros", "seq"], kind="stable").drop_duplicates(["run", "shard"], keep="last")
        now = state.getCurrentWatermarkMs() if by_event_time else state.getCurrentProcessingTimeMs()
        waiting = last["status"].isin(C.ACTIVE_STATUSES) & ~last["marked"]
        due = last["micros"] // 1000 + after * 1000
        stalled = waiting & (due < now)
        last["marked"] |= stalled
        state.update(tuple(last[name].tolist() for name in (*_LAST, "marked")))
        if (waiting & ~stalled).any():
            first = int(due[waiting & ~stalled].min())
            if by_event_time:
                state.setTimeoutTimestamp(max(first, now + 1))
            else:
                state.setTimeoutDuration(max(first - now, 1))
        out = pd.concat([last[last["fresh"]].assign(stalled=False), last[stalled].assign(stalled=True)])
        if len(out):
            yield out[[*_LAST, "stalled"]]

    return follow


STALLED_SCHEMA = "crate_id bigint, report struct<micros:bigint,seq:bigint,stalled:boolean,crate:string,status:string>"


def quiet_runs(
    log: DataFrame, after_seconds: int = C.STALL_SECONDS, late: str | None = "0 seconds", shards: int = 4, buckets: int = BUCKETS
) -> DataFrame:
    """A stream of (crate_id, report): the last report of a run as it changes, and again, marked, when it has stalled.

    With ``late`` the clock is the watermark, the largest report time less that
    much; reports behind it are dropped.  With None it is the time of day, and runs
    are found without any new report.  Runs share ``buckets`` states; a batch
    rewrites the states it has reports for.  Reports without a time are left out.
    """
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    timed = log.withColumn("updated_at", F.col("updated_at").cast("timestamp")).where("updated_at IS NOT NULL")
    timed = timed.withWatermark("updated_at", late) if late is not None else timed
    # ids as text: a column of numbers with a null would become floats
    rows = timed.select(
        F.col("crate_id").cast("bigint").cast("string").alias("run"), _shard("seq", shards), "crate", "status", F.unix_micros("updated_at").alias("micros"),
        F.coalesce(F.col("seq").cast("bigint"), F.lit(-(2**63))).alias("seq"), *(["updated_at"] if late is not None else []),
    )
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("run", "shard"), F.lit(buckets)))
    out = dealt.groupBy("bucket").applyInPandasWithState(
        _follow(after_seconds, late is not None), ", ".join(f"{n} {k}" for n, k in _LAST.items()) + ", stalled boolean", _LAST_STATE, "update",
        GroupStateTimeout.EventTimeTimeout if late is not None else GroupStateTimeout.ProcessingTimeTimeout,
    )
    return out.select(F.col("run").cast("bigint").alias("crate_id"), F.struct("micros", "seq", "stalled", "crate", "status").alias("report"))


def stalled_table(spark: SparkSession, path: str, every: int = 20) -> MergedTable:
    """The last report of each run over all shards; of one report, the stalled mark counts."""
    return MergedTable(spark, path, ["crate_id"], {"report": F.max}, _schema(spark, STALLED_SCHEMA), every)


def stalled_runs(table: MergedTable, status: MergedTable | None = None) -> DataFrame:
    """Runs whose last report is marked as stalled, with the last counts known from the status table."""
    rows = table.read().where("report.stalled").select(
        "crate_id", "report.crate", "report.status", F.timestamp_micros("report.micros").alias("updated_at")
    )
    if status is None:
        return rows
    return rows.join(current_status(status).select("crate_id", "crate", *_KNOWN), ["crate_id", "crate"], "left")


# --- counters ---------------------------------------------------------------------------


def counter_table(spark: SparkSession, path: str, every: int = 20) -> MergedTable:
    """Lifetime counters per type; every batch adds its own counts once."""
    return MergedTable(spark, path, ["event_type"], {"n": F.sum}, _schema(spark, "event_type string, n bigint"), every)


def feed(stream: DataFrame, table: MergedTable, progress: str, mode: str = "append", writer: str = "stream", trigger: dict | None = None) -> StreamingQuery:
    """Merge a stream into a table; without a trigger, process what is there and stop."""
    query = (
        stream.writeStream.foreachBatch(lambda batch, epoch: table.add(batch, epoch, writer))
        .option("checkpointLocation", progress).outputMode(mode).trigger(**(trigger or {"availableNow": True})).start()
    )
    if trigger is None:
        query.awaitTermination()
    return query


def _schema(spark: SparkSession, text: str) -> StructType:
    return spark.createDataFrame([], text).schema

