"""Sessions on a stream from their first frame to their seal: decisions, and one incident for each session that breached.

A processor holds for each session one value, the latch with the last frames that a breach would freeze, and its breach if there is
one.  An end marker, or a timer after ``silence``, closes a session: if it breached, its incident comes out as a row of its own kind.  What
stays is a tombstone, so that a frame that comes after the end is stopped and doesn't open the session anew; a timer clears it after
``burial``.

Every call to the state is a message to the JVM, and a session has only some rows in a batch.  So a batch reads and writes a session's state
once, a timer is moved on when it goes off and not with each batch, and rows are judged one by one.

Timers run on event time: they go off as the stream's watermark passes them, so a replay seals the same sessions at the same
frames.  A frame that is older than the watermark is dropped by Spark and gets no decision, so no permission either.
"""

from __future__ import annotations

import contextlib
import math
from collections.abc import Iterator
from datetime import timezone

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: ``kind`` is "decision" or "incident"; an incident's frame is that of the breach.
ROWS = (
    "kind string, session long, frame_id long, verdict string, acted string, norm double, bound double, reason string, breach boolean, "
    "event map<string,string>, kept_from long, kept_to long, frames long, closed_by string"
)
#: ``due`` is when the next thing happens, ``timer`` when the session's one timer goes off: not after that.
_LATCH = "stopped boolean, last long, ended boolean, frames long, recent array<long>, due long, timer long"
_ROW = Row(*(column.split()[0] for column in ROWS.split(", ")))
_BREACH = "frame_id long, acted string, norm double, bound double, reason string, event map<string,string>, kept_from long, kept_to long"

#: Where Spark keeps the state of such processors.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def rocksdb(spark):
    """Queries started inside keep their state in RocksDB, which timers and lists need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def number(x: float, otherwise: str) -> str:
    return f"{round(np.float64(x), 6):.6f}" if np.isfinite(x) else otherwise


def decide(rows: list[Row], bounds: dict[str, float], stopped: bool, last: int, ended: bool) -> Iterator[tuple]:
    """For each row ``verdict, acted, norm, bound, reason, breach``, as :func:`veristream.streaming.guard.judge` has them; NaN is None."""
    none = lambda x: None if x is None or math.isnan(x) else float(x)
    for r in rows:
        bound, norm, why = none(bounds.get(r.action)), none(r.norm), ""
        if ended:
            reason = "session ended"
        else:
            if r.frame_id is not None and r.frame_id <= last:
                why = "out of order"
            elif bound is None or math.isinf(bound):
                why = "no bound"
            elif norm is None or math.isinf(norm):
                why = "non-finite norm"
            elif norm > bound:
                why = "norm exceeds bound"
            reason = "prior breach" if stopped else why or "within envelope"
        stop = bool(ended or stopped or why)
        yield "ESTOP" if stop else "PERMIT", "emergency_stop" if stop else r.action, norm, bound, reason, bool(why) and not stopped
        stopped, ended = stopped or bool(why), ended or r.ended is True


def millis(at) -> int:
    return int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1000)


class Sessions(StatefulProcessor):
    def __init__(self, bounds: dict[str, float], shard_id: str, pre: int, post: int, silence: int, burial: int):
        self.bounds, self.shard_id, self.pre, self.post, self.silence, self.burial = bounds, shard_id, pre, post, silence, burial

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latch = handle.getValueState("latch", _LATCH)
        self.breach = handle.getValueState("breach", _BREACH)

    def _wake(self, due: int, timer: int | None) -> int:
        """The session's one timer, which may go off before it is due but not after."""
        if timer is not None and timer <= due:
            return timer
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(due)
        return due

    def _breached(self, row: Row, norm: float | None, bound: float | None, reason: str, before: list[int]) -> tuple:
        nan = lambda x: math.nan if x is None else x
        said = {"evt": "envelope_breach", "action": str(row.action), "l_inf": number(nan(norm), "inf"), "bound": number(nan(bound), "none"), "envelope_shard_id": self.shard_id, "reason": reason}
        # The frame's own keys stay under the breach's.
        event = {k: v for k, v in dict(row.event or {}).items() if k not in said} | said
        kept_from = min([*before[len(before) - min(self.pre, len(before)) :], row.frame_id])
        return row.frame_id, "emergency_stop", norm, bound, reason, event, kept_from, row.frame_id + self.post - 1

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        session = key[0]
        stopped, last, ended, frames, recent, due, timer = self.latch.get() or (False, -1, False, 0, [], None, None)
        rows = sorted(rows, key=lambda r: (r.frame_id is None, r.frame_id))
        out, breach, recent, closed, newest = [], None, list(recent), ended, last
        for r, (verdict, acted, norm, bound, reason, first) in zip(rows, decide(rows, self.bounds, stopped, last, ended), strict=True):
            if first:
                breach = self._breached(r, norm, bound, reason, [f for f in recent if f < r.frame_id])
            if not closed and r.frame_id is not None and r.frame_id > last:
                recent.append(r.frame_id)
                frames += 1
            closed, newest = closed or r.ended is True, newest if r.frame_id is None else max(newest, r.frame_id)
            out.append(_ROW("decision", session, r.frame_id, verdict, acted, norm, bound, reason, first, None, None, None, None, None))
        if breach:
            self.breach.update(breach)
        stopped, ends = stopped or breach is not None, closed and not ended
        due = max([timerValues.getCurrentWatermarkInMs(), *(millis(r.at) for r in rows if r.at is not None)]) + (self.burial if closed else self.silence)
        timer = self._wake(due, timer)
        self.latch.update((stopped, newest, closed, frames, recent[-self.pre :] if self.pre and not closed else [], due, timer))
        yield from out
        if ends and stopped:
            yield self._incident(session, frames, "end")

    def _incident(self, session: int, frames: int, closed_by: str) -> Row:
        frame_id, acted, norm, bound, reason, event, kept_from, kept_to = self.breach.get()
        self.breach.clear()
        return _ROW("incident", session, frame_id, "ESTOP", acted, norm, bound, reason, True, list(dict(event).items()), kept_from, kept_to, frames, closed_by)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self.latch.get()
        if state is None:
            return
        stopped, last, ended, frames, recent, due, _ = state
        if due > expiredTimerInfo.getExpiryTimeInMs() and due >= timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(due)
            self.latch.update((stopped, last, ended, frames, recent, due, due))
        elif ended:
            self.latch.clear()
        else:
            self.handle.registerTimer(due + self.burial)
            self.latch.update((stopped, last, True, frames, [], due + self.burial, due + self.burial))
            if stopped:
                yield self._incident(key[0], frames, "silence")

    def close(self) -> None:
        pass


def sessions(frames: DataFrame, bounds: dict[str, float], shard_id: str, pre: int = 20, post: int = 20, silence_ms: int = 600_000, burial_ms: int = 86_400_000) -> DataFrame:
    """Rows of :data:`ROWS` for a stream of ``session, frame_id, action, norm, at`` with a watermark on ``at`` and, where there are
    such, ``event`` (a map of the frame's own keys) and ``ended``.  Start it within :func:`rocksdb`.

    Each frame gives a decision.  A session that breached gives one incident when it ends: its breach's event, the frames that a
    window of ``pre`` and ``post`` around the breach keeps, and how many frames it had.  What is sent under a session's name
    ``burial_ms`` after its end is a new session."""
    given = lambda c, kind: F.col(c) if c in frames.columns else F.lit(None).cast(kind).alias(c)
    frames = frames.select("session", "frame_id", "action", "norm", "at", given("event", "map<string,string>"), given("ended", "boolean"))
    processor = Sessions(bounds, shard_id, pre, post, silence_ms, burial_ms)
    return frames.groupBy("session").transformWithState(processor, ROWS, "append", "eventTime")
