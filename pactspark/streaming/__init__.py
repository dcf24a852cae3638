"""Structured Streaming operators; the same functions serve batch frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Share of the work that is done after each stage of a contract's processing.
STAGE_PROGRESS = {"extract": 5, "segment": 25, "classify": 45, "ner": 60, "obligations": 75, "normalize_dates": 85, "generate_tasks": 95}


def latest_progress(events: DataFrame, key: str, *fields: str, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The latest event of each key, by time and then id."""
    return events.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(ts, tie)).alias("last")).select(key, "last.*")


def first_use(events: DataFrame, key: str, ts: str = "ts", within: str = "1 hour") -> DataFrame:
    """The first event of each key; in a stream, keys are forgotten after ``within``."""
    if events.isStreaming:
        return events.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])
    return events.groupBy(key).agg(F.min(ts).alias(ts))


def reminder_scan(due: DataFrame, delivered: Callable[[], DataFrame], deliver: Callable[[DataFrame], None], keys: list[str], checkpoint: str, every: str | None = "15 minutes") -> StreamingQuery:
    """Deliver each due reminder at most once: what was delivered, in this run or any before, is left out."""

    def batch(df: DataFrame, _: int) -> None:
        deliver(df.dropDuplicates(keys).join(delivered(), keys, "left_anti"))

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return due.writeStream.foreachBatch(batch).trigger(**trigger).option("checkpointLocation", checkpoint).start()


#: States after which a contract's progress doesn't change.
TERMINAL = ("COMPLETE", "FAILED")


def progress_events(stages: DataFrame) -> DataFrame:
    """(contract_id, stage, progress_pct, status) of (contract_id, stage): what is published when a stage ends.

    ``complete`` is 100 percent and COMPLETE; stages that aren't known (null too) publish nothing. Serves streams and batches.
    """
    pairs = [F.lit(x) for kv in (STAGE_PROGRESS | {"complete": 100}).items() for x in kv]
    pct = F.try_element_at(F.create_map(*pairs), F.lower("stage"))
    status = F.when(F.lower("stage") == "complete", "COMPLETE").otherwise("PROCESSING")
    return stages.select("contract_id", "stage", pct.alias("progress_pct"), status.alias("status")).where("progress_pct IS NOT NULL")


def publish(events: DataFrame, path: str, checkpoint: str | None = None) -> StreamingQuery | None:
    """Append progress events as JSON lines under ``path``; a stream goes on where its ``checkpoint`` says, each event once."""
    if events.isStreaming:
        return events.writeStream.format("json").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    events.write.mode("append").json(path)
    return None


def until_terminal(events: DataFrame, key: str, order: list[str], status: str = "status") -> DataFrame:
    """Each key's events in order up to its first terminal one, that included: what a subscriber gets."""
    ended = F.coalesce(F.col(status).isin(*TERMINAL), F.lit(False)).cast("int")
    before = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return events.withColumn("_ended", F.coalesce(F.max(ended).over(before), F.lit(0))).where("_ended = 0").drop("_ended")


def consume(tries: DataFrame, key: str, ts: str, tie: str, ttl: str = "7 days") -> DataFrame:
    """Tries with ``accepted``: true for a key's first use, and again for the first one after ``ttl`` has gone by since its last use."""
    order = W.partitionBy(key).orderBy(ts, tie)
    last = F.lag(ts).over(order)
    return tries.withColumn("accepted", last.isNull() | (F.col(ts) > last + F.expr(f"INTERVAL {ttl}")))
