"""Structured Streaming: windowed counters, quotas, incident state, event lines.

Event time and watermarks bound all state; each query survives restarts by its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.sources.records import EVENT


def bucketed_counts(events: DataFrame, late: str = "10 minutes", bucket: str = "1 minute") -> DataFrame:
    """bucket_start, metric, count of events (ts, metric); rows later than the watermark are left out."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", bucket).alias("w"), "metric").agg(F.count("*").alias("count"))
    return counted.select(F.col("w.start").alias("bucket_start"), "metric", "count")


def quota_counts(requests: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """key, window_start, requests, chars of tumbling windows."""
    counted = requests.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "key").agg(F.count("*").alias("requests"), F.sum("chars").alias("chars"))
    return counted.select("key", F.col("w.start").alias("window_start"), "requests", "chars")


def session_counts(events: DataFrame, gap: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    counted = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "key").agg(F.count("*").alias("events"))
    return counted.select("key", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


def latest_cues(lines: DataFrame, late: str = "1 hour") -> DataFrame:
    """Cue updates of event lines (value, and ts if there is one, else the time of reading), one row for each cue of each
    chunk; of equal deltas that come within `late` of each other one stays, so the state that tells them apart is
    bounded."""
    timed = lines if "ts" in lines.columns else lines.withColumn("ts", F.current_timestamp())
    found = timed.select("ts", F.from_json("value", EVENT).alias("e")).where("e.type IN ('result_chunk', 'result')")
    chunks = found.select("ts", F.explode("e.data.cues").alias("c"))
    return chunks.withWatermark("ts", late).select("ts", "c.*").dropDuplicatesWithinWatermark(["id", "translation"]).drop("ts")


def incident_states(signals: DataFrame, settle_minutes: int = 150) -> DataFrame:
    """Status changes of incidents from signals (component_id, ts, failing), as they come.

    A component that fails opens an incident (investigating), again identified; when it serves it is monitoring and then
    resolved. One that fails again within settle_minutes of its resolution re-opens the same incident.
    """
    steps = {"investigating": "identified", "monitoring": "resolved"}

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, status, settled = state.get if state.exists else (0, "resolved", -(10**18))
        out = []
        for row in pd.concat(list(batches)).sort_values("ts").itertuples():
            at = row.ts.value // 1_000_000
            before = status
            if row.failing:
                if status == "resolved":
                    number += at - settled > settle_minutes * 60_000
                    status = "investigating"
                elif status != "identified":
                    status = steps.get(status, "identified") if status == "investigating" else "identified"
            elif status in ("investigating", "identified"):
                status = "monitoring"
            elif status == "monitoring":
                status, settled = "resolved", at
            if status != before:
                out.append((key[0], int(number), row.ts, status))
        state.update((int(number), status, int(settled)))
        yield pd.DataFrame(out, columns=["component_id", "incident_no", "ts", "status"])

    return signals.groupBy("component_id").applyInPandasWithState(
        update, "component_id string, incident_no long, ts timestamp, status string", "number long, status string, settled long", "append", GroupStateTimeout.NoTimeout
    )


def upsert_batches(path: str, key: list[str], value: str):
    """For foreachBatch: adds each batch's counts to the table at path and writes the sums as a new version of it.

    Versions are numbered by batch, so a batch that comes again after a failure starts from the same version as before and
    counts once. upserted reads the table.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [v for v in _versions(spark, path) if v < batch_id]
        new = batch.groupBy(*key).agg(F.sum(value).alias(value))
        if before:
            new = new.unionByName(spark.read.parquet(f"{path}/version={max(before)}").select(*new.columns)).groupBy(*key).agg(F.sum(value).alias(value))
        new.write.mode("overwrite").parquet(f"{path}/version={batch_id}")
        for old in sorted(before)[:-1]:  # the last one is kept for the case that this batch comes again
            _folder(spark, f"{path}/version={old}", delete=True)

    return write


def upserted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/version={max(_versions(spark, path))}")


def _folder(spark: SparkSession, path: str, delete: bool = False):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if delete:
        return fs.delete(at, True)
    return fs.listStatus(at) if fs.exists(at) else []


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions that were written whole."""
    names = [x.getPath().getName() for x in _folder(spark, path)]
    return [int(n[8:]) for n in names if n.startswith("version=") and any(x.getPath().getName() == "_SUCCESS" for x in _folder(spark, f"{path}/{n}"))]
