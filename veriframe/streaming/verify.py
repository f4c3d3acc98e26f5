"""Structured Streaming: verification of arriving reads, and quotas kept as state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from veriframe.operators import compare as C
from veriframe.operators import extract as E


def verify_stream(reads: DataFrame, claims: DataFrame, path: str, checkpoint: str, fuzzy: bool = True):
    """Starts a query: each micro-batch of reads (record_id, text) is parsed, compared and appended to path.

    The batch number is part of the folder, so a batch that runs again after a failure replaces its own output.
    """

    def one(batch: DataFrame, number: int) -> None:
        known = claims.join(batch.select("record_id").distinct(), "record_id", "left_semi")
        C.rollup(C.compare(known, E.parse(batch), fuzzy)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return reads.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


GRANTS = "tenant long, seq long, n long, granted boolean, used long"


class _Quota(StatefulProcessor):
    """A tenant's used count, and its requests that wait for their turn."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getValueState("used", "used long")
        self.held = handle.getListState("held", "at long, seq long, n long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        new = [(int(r["at"]), int(r["seq"]), int(r["n"])) for r in rows]
        self.held.appendList(new)
        first = min(new)[0]
        if first <= timerValues.getCurrentWatermarkInMs():
            yield from self._grant(key, timerValues)
        else:
            self.handle.registerTimer(first)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        yield from self._grant(key, timerValues)

    def _grant(self, key: Any, timerValues: TimerValues) -> Iterator[Row]:
        """Requests that no earlier one can precede any more, in order."""
        mark = timerValues.getCurrentWatermarkInMs()
        held = sorted(tuple(h) for h in self.held.get())
        due = [h for h in held if h[0] <= mark]
        if not due:
            return
        used = self.used.get()[0] if self.used.exists() else 0
        for _, seq, n in due:
            ok = self.limit <= 0 or used + n <= self.limit
            used += n if ok else 0
            yield Row(tenant=key[0], seq=seq, n=n, granted=ok, used=used)
        self.used.update((used,))
        if rest := held[len(due) :]:
            self.held.put(rest)
            self.handle.registerTimer(rest[0][0])
        else:
            self.held.clear()


def quota_stream(requests: DataFrame, limit: int, delay: str = "0 seconds") -> DataFrame:
    """requests (tenant, seq, n, ts), a stream -> GRANTS, each request once, in order of (ts, seq) within a tenant.

    Requests may arrive in any order within ``delay``: they wait in the tenant's state until the watermark has passed their ts, when a timer has
    them granted; a rejected one takes nothing. Later ones are dropped, as by any operator on event time. What a tenant holds is what arrives for it within
    the delay; its used count is one number. After a restart the state is that of the last whole micro-batch, so nothing is granted twice.
    Needs the RocksDB state store, which is set here for the session.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    typed = requests.withWatermark("ts", delay).select(*[F.col(c).cast("long").alias(c) for c in ("tenant", "seq", "n")], "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    return typed.groupBy("tenant").transformWithState(_Quota(limit), GRANTS, "append", "eventTime")
