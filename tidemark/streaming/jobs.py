"""Stateful streams of translation jobs: parts put together to cues, and jobs that can be taken up again.

State lies in RocksDB and ends by timers of event time: a key of which nothing came for its time to live is dropped, so
that state grows with the keys of that time, not with all that ever came. Rows behind the watermark are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 24 * 60 * 60 * 1000
#: Days for which a job can be taken up again.
JOB_DAYS = 7


def prepare(spark: SparkSession) -> None:
    """State with timers needs RocksDB; set before the query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def millis(ts) -> int:
    return pd.Timestamp(ts).value // 1_000_000


def column(values: list, kind=object) -> pd.Series:
    """A column of a stated type, which an empty one has too."""
    return pd.Series(values, dtype=kind)


class Expiring(StatefulProcessor):
    """State of a key that is dropped when nothing came for ttl_ms of event time. One timer a key, moved on with it."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "ms long")

    def extend(self, seen_ms: int) -> None:
        before = self.until.get()[0] if self.until.exists() else None
        after = seen_ms + self.ttl_ms
        if before is not None and before >= after:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        self.handle.registerTimer(after)
        self.until.update((after,))

    def close(self) -> None:
        pass


class CueMerge(Expiring):
    """Parts (doc_id, cue, part from 0, parts, text, ts) to cues. A cue comes once all its parts are there, and again only
    if a later part changes it; a repeated or older part changes nothing. One that never was whole comes at its end, with
    the parts it has and complete false."""

    def init(self, handle) -> None:
        super().init(handle)
        self.parts = handle.getMapState("parts", "part int", "text string, ms long")
        self.head = handle.getValueState("head", "parts int, ms long, shown string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # The number of parts is that of the newest row; of equally new ones the greatest.
        number, newest, shown = self.head.get() if self.head.exists() else (0, -(10**18), None)
        for batch in rows:
            for part, parts, text, ts in zip(batch["part"], batch["parts"], batch["text"], batch["ts"], strict=True):
                ms, value = millis(ts), text or ""
                if (ms, parts) > (newest, number):
                    newest, number = ms, int(parts)
                held = self.parts.getValue((int(part),)) if self.parts.containsKey((int(part),)) else None
                if held is None or (ms, value) > (held[1], held[0]):
                    self.parts.updateValue((int(part),), (value, ms))
        self.extend(newest)
        texts = [self.parts.getValue((i,))[0] for i in range(number)] if all(self.parts.containsKey((i,)) for i in range(number)) else None
        text = None if texts is None else "\n".join(texts)
        fresh = text is not None and text != shown
        self.head.update((number, newest, text if fresh else shown))
        yield self.shown(key, [text] if fresh else [], True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        number, _, shown = self.head.get()
        held = dict((k[0], v[0]) for k, v in self.parts.iterator())
        lost = ["\n".join(held[i] for i in sorted(held) if i < number)] if shown is None else []
        for state in (self.parts, self.head, self.until):
            state.clear()
        yield self.shown(key, lost, False)

    def shown(self, key, texts: list[str], complete: bool) -> pd.DataFrame:
        n = len(texts)
        return pd.DataFrame({"doc_id": column([key[0]] * n), "cue": column([key[1]] * n, "int64"), "text": column(texts), "complete": column([complete] * n, bool)})


def merged_cues(parts: DataFrame, late: str = "10 minutes", ttl_ms: int = 60 * 60 * 1000) -> DataFrame:
    """doc_id, cue, text, complete of a stream of parts (doc_id string, cue long, part, parts, text, ts), as they are done."""
    prepare(parts.sparkSession)
    rows = parts.withWatermark("ts", late).groupBy("doc_id", "cue")
    return rows.transformWithStateInPandas(CueMerge(ttl_ms), "doc_id string, cue long, text string, complete boolean", "append", "EventTime")


class JobProgress(Expiring):
    """Results (job, fingerprint, cue, translation, ts) to what is new in them. A job's fingerprint is that of its newest
    row: when it changes, the job begins anew and rows of others are passed over. A blank translation takes the cue's
    translation away. Of one cue the newest row counts, of equally new ones the greatest translation."""

    def init(self, handle) -> None:
        super().init(handle)
        self.cues = handle.getMapState("cues", "cue long", "translation string, ms long")
        self.head = handle.getValueState("head", "fingerprint string, ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark, newest = self.head.get() if self.head.exists() else (None, -(10**18))
        changed: dict[int, str | None] = {}
        for batch in rows:
            for fingerprint, cue, translation, ts in zip(batch["fingerprint"], batch["cue"], batch["translation"], batch["ts"], strict=True):
                ms, value = millis(ts), (translation or "").strip()
                if fingerprint != mark:
                    if mark is not None and (ms, fingerprint) <= (newest, mark):
                        continue
                    self.cues.clear()
                    changed, mark = {}, fingerprint
                newest = max(newest, ms)
                held = self.cues.getValue((int(cue),)) if self.cues.containsKey((int(cue),)) else None
                if held is None or (ms, value) > (held[1], held[0]):
                    self.cues.updateValue((int(cue),), (value, ms))
                    if value != (held[0] if held else ""):
                        changed[int(cue)] = value or None
        self.head.update((mark, newest))
        self.extend(newest)
        yield self.shown(key, mark, list(changed.items()), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = self.head.get()[0]
        for state in (self.cues, self.head, self.until):
            state.clear()
        yield self.shown(key, mark, [(None, None)], True)

    def shown(self, key, mark: str, found: list[tuple], expired: bool) -> pd.DataFrame:
        n = len(found)
        cues, texts = column([c for c, _ in found], "Int64"), column([t for _, t in found])
        return pd.DataFrame({"job": column([key[0]] * n), "fingerprint": column([mark] * n), "cue": cues, "translation": texts, "expired": column([expired] * n, bool)})


def job_progress(results: DataFrame, late: str = "1 hour", days: float = JOB_DAYS) -> DataFrame:
    """job, fingerprint, cue, translation, expired of a stream of results: each change once. A job is dropped, with a row
    that says so (cue null), when nothing came for it for some days."""
    prepare(results.sparkSession)
    rows = results.withWatermark("ts", late).groupBy("job")
    return rows.transformWithStateInPandas(JobProgress(int(days * DAY_MS)), "job string, fingerprint string, cue long, translation string, expired boolean", "append", "EventTime")
