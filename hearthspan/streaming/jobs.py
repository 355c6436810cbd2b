"""Streaming forms of the monitoring jobs: file source, checkpoint, available-now trigger.

A job writes each micro-batch under its epoch, so a replayed batch overwrites itself; the result is
read back as the newest row per key. Nothing is held in the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hearthspan.functions.rank import newest
from hearthspan.session import scratch


def read_folder(spark: SparkSession, folder: str, schema) -> DataFrame:
    """All files that arrived since the last run."""
    return spark.readStream.schema(schema).parquet(folder)


def run(out: DataFrame, mode: str, path: str, checkpoint: str, sink: Callable | None = None) -> None:
    """Process what has arrived and stop. `sink(batch, epoch)` may replace the plain write."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    q = out.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink or write).start()
    q.awaitTermination()


def run_and_read(out: DataFrame, mode: str, keys: list[str] | None = None, arrivals: Iterable[Callable] = (lambda: None,)) -> DataFrame:
    """Run once after every arrival, going on from the checkpoint; with keys, the newest row per key over the epochs."""
    spark = out.sparkSession
    path = scratch(spark, "stream")
    for arrive in arrivals:
        arrive()
        run(out, mode, f"{path}/rows", f"{path}/checkpoint")
    rows = spark.read.schema(out.schema.add("epoch", "long")).parquet(f"{path}/rows")
    return newest(rows, keys, ["epoch"]).drop("epoch") if keys else rows.drop("epoch")


def tumbling(events: DataFrame, every: str, key: str, late: str) -> DataFrame:
    w = F.window("started_at", every)
    return events.withWatermark("started_at", late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sliding(events: DataFrame, length: str, step: str, key: str, late: str) -> DataFrame:
    w = F.window("started_at", length, step)
    return events.withWatermark("started_at", late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sessions(events: DataFrame, gap: str, key: str, late: str) -> DataFrame:
    """Closed sessions only: append mode emits one when the watermark has passed it.

    A row exactly `gap` after the last one begins a new session. Spark would still join it, so its gap is a microsecond shorter.
    """
    w = F.session_window("started_at", f"{gap} -1 microseconds")
    end = (F.col("w.end") + F.expr("INTERVAL 1 MICROSECOND")).alias("end")
    return events.withWatermark("started_at", late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), end, key, "n")


def late_overlap(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Rows read again through an overlap are dropped by key within the watermark."""
    return events.withWatermark("started_at", late).dropDuplicatesWithinWatermark(keys)


def snapshot(out: DataFrame, keys: list[str], order: list[str], arrivals: Iterable[Callable] = (lambda: None,)) -> DataFrame:
    """Latest row per key. Each batch is cut to one row per key before it is written."""
    spark = out.sparkSession
    path = scratch(spark, "snapshot")

    def sink(batch: DataFrame, epoch: int) -> None:
        newest(batch, keys, order).write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")

    for arrive in arrivals:
        arrive()
        run(out, "append", path, f"{path}/checkpoint", sink)
    return newest(spark.read.parquet(f"{path}/rows").drop("epoch"), keys, order)


def backoff_claim(items: DataFrame, results: DataFrame, at_s: int, wait_s: int, key: str = "property_id", arrivals: Iterable[Callable] = (lambda: None,)) -> DataFrame:
    """Items without a success at any version and without a failure inside the back-off time."""
    spark = items.sparkSession
    path = scratch(spark, "claim")

    def sink(batch: DataFrame, epoch: int) -> None:
        blocked = results.where((F.col("ok") == 1) | ((F.col("ok") == 0) & (F.col("done_s") > at_s - wait_s)))
        batch.join(blocked.select(key), key, "left_anti").write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")

    for arrive in arrivals:
        arrive()
        run(items, "append", path, f"{path}/checkpoint", sink)
    return spark.read.parquet(f"{path}/rows").drop("epoch")


# ---- a fold with state ---------------------------------------------------------------------------

def alert_state(events: DataFrame, key: str, period_s: int, burst: int, runs: int) -> DataFrame:
    """Edges of the failure state per period; a period is judged once a later one has begun.

    events(key, at_s, failed). State: counts of open periods, streak, problem, last period judged; a late
    row of a judged period changes nothing any more.
    """
    out = f"{key} long, period long, failures long, streak long, edge string"

    def fold(k, batches: Iterator[pd.DataFrame], state: GroupState):
        opened, streak, problem, judged = (dict(state.get[0]), *state.get[1:]) if state.exists else ({}, 0, False, -1)
        for b in batches:
            for p, n in b.groupby(b["at_s"] // period_s)["failed"].sum().items():
                if p > judged:
                    opened[int(p)] = opened.get(int(p), 0) + int(n)
        rows, newest_p = [], max(opened, default=judged)
        for p in sorted(x for x in opened if x < newest_p):
            n = opened.pop(p)
            streak = streak + 1 if n > 0 else 0
            now = n >= burst or streak >= runs
            edge = "onset" if now and not problem else "clear" if problem and not now else None
            problem = now
            judged = p
            rows.append((k[0], p, n, streak, edge))
        state.update((opened, streak, problem, judged))
        yield pd.DataFrame(rows, columns=[key, "period", "failures", "streak", "edge"])

    return events.select(key, "at_s", "failed").groupBy(key).applyInPandasWithState(fold, out, "opened map<long,long>, streak long, problem boolean, judged long", "append", GroupStateTimeout.NoTimeout)
