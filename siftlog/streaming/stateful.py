"""Streams whose state outlives a trigger: retries that come due, and origins that fall silent.

State sits in the RocksDB store below the stream's checkpoint, so it survives lost
executors and restarts. An origin holds one small row; unsettled receipts share a
row by hash bucket. Timers run on event time: they fire once the watermark has
passed them, whatever arrived.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from siftlog.session import ensure_utc

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE_SETTING = "spark.sql.streaming.stateStore.providerClass"

RETRY_SCHEMA = "receipt_id string, action string, attempt int, at_ms bigint, code string"
STALE_SCHEMA = "peer_id string, last_ms bigint, found_ms bigint"


def with_store(spark: SparkSession) -> SparkSession:
    """A session of the same application with the store these streams need; the caller's keeps its settings."""
    own = ensure_utc(spark.newSession())
    own.conf.set(STORE_SETTING, STORE)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return own


def needs_store(spark: SparkSession) -> None:
    """Stateful streams need the RocksDB store; a session that names another one is told so."""
    if spark.conf.get(STORE_SETTING) != STORE:
        raise RuntimeError(f"set {STORE_SETTING} to {STORE} for this stream")


#: Receipts share a state row by hash: one call from Python to the store serves all of a bucket that a trigger touches.
RETRY_BUCKETS = 4096
RETRY_STATE = "failed string"


def _retries(most: int, base_ms: int, cap_ms: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """Attempts of the receipts of a bucket: a failure that may be repeated comes due after its backoff, the last one is a dead letter.

    The state is a JSON list of [receipt, attempts, due_ms, code] of those that failed and are not settled.
    """
    def wait_ms(attempts: int) -> int:
        return min(cap_ms, base_ms * 2 ** min(attempts - 1, 40))

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failed = {r: (attempts, due_ms, code) for r, attempts, due_ms, code in json.loads(state.get[0])} if state.exists else {}
        now_ms, out = state.getCurrentWatermarkMs(), []
        outcomes = [] if state.hasTimedOut else [row for part in parts for row in zip(*(part[c].tolist() for c in ("at_ms", "ok", "retryable", "code", "receipt_id")), strict=True)]
        text = lambda v: v if isinstance(v, str) else None
        for at_ms, ok, retryable, code, receipt in sorted(((int(a), bool(o), bool(r), text(c), text(i)) for a, o, r, c, i in outcomes), key=lambda x: (*x[:3], x[3] or "", x[4] or "")):
            attempts = failed.pop(receipt, (0, None, None))[0] + 1
            if not ok and retryable and attempts < most:
                failed[receipt] = (attempts, at_ms + wait_ms(attempts), code)
            else:
                out.append((receipt, "DONE" if ok else "DEAD_LETTER", attempts, at_ms, None if ok else code))
        for receipt, (attempts, due_ms, code) in failed.items():
            if due_ms is not None and due_ms <= now_ms:
                failed[receipt] = (attempts, None, code)
                out.append((receipt, "RETRY", attempts + 1, due_ms, code))
        if failed:
            state.update((json.dumps([[r, *f] for r, f in failed.items()]),))
            waiting = [due_ms for _, due_ms, _ in failed.values() if due_ms is not None]
            if waiting:  # a timeout fires once the watermark is above it
                state.setTimeoutTimestamp(max(min(waiting) - 1, 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["receipt_id", "action", "attempt", "at_ms", "code"])

    return step


def retry_stream(outcomes: DataFrame, most: int, base_ms: int, cap_ms: int, watermark: str = "0 seconds", buckets: int = RETRY_BUCKETS) -> DataFrame:
    """(receipt_id, action, attempt, at_ms, code) of a stream of outcomes (receipt_id, event_time, at_ms, ok, retryable, code).

    RETRY when an attempt comes due, DONE and DEAD_LETTER when a receipt is settled; attempts count over triggers.
    `buckets` is fixed for the life of a checkpoint; a bucket's state holds its unsettled receipts only.
    """
    needs_store(outcomes.sparkSession)
    rows = outcomes.withWatermark("event_time", watermark).select("receipt_id", "event_time", "at_ms", "ok", "retryable", "code")
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("receipt_id"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInPandasWithState(_retries(most, base_ms, cap_ms), RETRY_SCHEMA, RETRY_STATE, "append", GroupStateTimeout.EventTimeTimeout)


class Silence(StatefulProcessor):
    """The newest snapshot of one origin, and a timer for the moment when it is too old."""

    def __init__(self, after_ms: int):
        self.after_ms = after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "last_ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = max(int(part["at_ms"].max()) for part in rows)
        before = self.newest.get()[0] if self.newest.exists() else None
        if before is None or last > before:
            if before is not None:
                self.handle.deleteTimer(before + self.after_ms)
            self.newest.update((last,))
            self.handle.registerTimer(last + self.after_ms)
        yield pd.DataFrame({"peer_id": pd.Series([], dtype=str), "last_ms": pd.Series([], dtype="int64"), "found_ms": pd.Series([], dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.newest.get()[0]
        yield pd.DataFrame({"peer_id": [key[0]], "last_ms": [last], "found_ms": [last + self.after_ms]})

    def close(self) -> None:
        pass


def silent_origins(snapshots: DataFrame, after_ms: int, watermark: str = "0 seconds") -> DataFrame:
    """(peer_id, last_ms, found_ms) each time an origin has sent nothing for `after_ms`, of a stream (peer_id, event_time, at_ms).

    The report comes from the origin's timer: other origins moving the watermark on is enough.
    """
    needs_store(snapshots.sparkSession)
    return snapshots.withWatermark("event_time", watermark).groupBy("peer_id").transformWithStateInPandas(Silence(after_ms), STALE_SCHEMA, "Append", "EventTime")
