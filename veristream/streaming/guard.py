"""The guard, the keep window and the hash chain on a stream of frames, one state for each session.

Frames of a session must arrive in order of frame_id from batch to batch; within a batch they are sorted.  The keep window and
the chain raise on a frame that comes too late, as what they have written can't be taken back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DECISIONS = "session long, frame_id long, verdict string, acted string, norm double, bound double, reason string, breach boolean"
KEPT = "session long, frame_id long"


def judge(rows: pd.DataFrame, bounds: dict[str, float], stopped: bool, last: int, ended: bool) -> pd.DataFrame:
    """Decisions on a session's rows, in order of frame_id, after what came before: whether it was stopped, its last frame, and whether
    it has ended.  What can't be judged is a breach; what comes after the end is stopped, and no breach of its own."""
    bound, norm = rows["action"].map(bounds).astype(float), rows["norm"].astype(float)
    late = rows["frame_id"] <= last
    marked = rows["ended"].eq(True) if "ended" in rows.columns else pd.Series(False, index=rows.index)
    over = marked.cumsum().shift(fill_value=0).gt(0) | ended
    why = pd.Series(np.select([late, ~np.isfinite(bound), ~np.isfinite(norm), norm > bound], ["out of order", "no bound", "non-finite norm", "norm exceeds bound"], ""), index=rows.index)
    why[over] = ""
    prior = (why != "").cumsum().shift(fill_value=0).gt(0) | stopped
    stop = over | prior | (why != "")
    reason = np.select([over, prior, why != ""], ["session ended", "prior breach", why], "within envelope")
    return pd.DataFrame({
        "frame_id": rows["frame_id"], "verdict": np.where(stop, "ESTOP", "PERMIT"), "acted": np.where(stop, "emergency_stop", rows["action"]), "norm": rows["norm"], "bound": bound,
        "reason": reason, "breach": ~over & ~prior & (why != ""),
    })


def guard(frames: DataFrame, bounds: dict[str, float]) -> DataFrame:
    """Decisions for a stream of ``session, frame_id, action, norm``; ``bounds`` has a number for each action of the envelope.

    A frame that isn't behind all frames of the batches before is a breach, "out of order".  Where the stream has a column
    ``ended``, a true one ends the session: frames that come later under its name are stopped, "session ended".  That is remembered for
    ever; :func:`veristream.streaming.incidents.sessions` has timers, and seals sessions too."""
    ends = "ended" in frames.columns

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stopped, last, ended = state.get if state.exists else (False, -1, False)
        rows = pd.concat(batches).sort_values("frame_id", kind="stable")
        decided = judge(rows, bounds, stopped, last, ended)
        ended = bool(ended or (ends and rows["ended"].eq(True).any()))
        state.update((bool(stopped or decided["breach"].any()), max(last, int(rows["frame_id"].max())), ended))
        yield decided.assign(session=key[0])[["session", *decided.columns]]

    keyed = frames.select("session", "frame_id", "action", "norm", *(["ended"] if ends else [])).groupBy("session")
    return keyed.applyInPandasWithState(step, DECISIONS, "stopped boolean, last long, ended boolean", "append", GroupStateTimeout.NoTimeout)


def write_once(stream: DataFrame, path: str, checkpoint: str):
    """Write a stream's batches to a Parquet table, each once: a batch that is repeated after a failure replaces what it wrote.
    Gives the writer; its ``start()`` runs it."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def _in_order(key, batches: Iterator[pd.DataFrame], last: int) -> pd.DataFrame:
    rows = pd.concat(batches).sort_values("frame_id", kind="stable")
    if rows["frame_id"].min() <= last:
        raise ValueError(f"session {key[0]}: frame {rows['frame_id'].min()} comes after frame {last}")
    return rows


def keep_extending(frames: DataFrame, pre: int, post: int) -> DataFrame:
    """Kept frames of a stream of ``session, frame_id, trigger``.  State: the last ``pre`` frames that aren't written, and how many more
    frames the open window takes."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer, left, last = (list(state.get[0]), *state.get[1:]) if state.exists else ([], 0, -1)
        kept = []
        rows = _in_order(key, batches, last)
        for frame, trigger in zip(rows["frame_id"].tolist(), rows["trigger"].tolist(), strict=True):
            if trigger:
                kept += buffer
                buffer, left = [], post
            if left:
                kept.append(frame)
                left -= 1
            else:
                buffer = [*buffer, frame][-pre:] if pre else []
        state.update((buffer, left, int(rows["frame_id"].max())))
        yield pd.DataFrame({"session": pd.Series([key[0]] * len(kept), dtype="int64"), "frame_id": pd.Series(kept, dtype="int64")})

    keyed = frames.select("session", "frame_id", "trigger").groupBy("session")
    return keyed.applyInPandasWithState(step, KEPT, "buffer array<long>, left int, last long", "append", GroupStateTimeout.NoTimeout)


def chain(frames: DataFrame, domain: str = "frames@1:") -> DataFrame:
    """Links for a stream of ``session, frame_id, payload_sha256``.  State: the last link."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        link, last = state.get if state.exists else (hashlib.sha256(f"{domain}{key[0]}".encode()).hexdigest(), -1)
        rows, links = _in_order(key, batches, last), []
        for frame, payload in zip(rows["frame_id"].tolist(), rows["payload_sha256"].tolist(), strict=True):
            # A record without a hash has no link, which breaks the chain there.
            link = hashlib.sha256(bytes.fromhex(link) + bytes.fromhex(payload or "") + frame.to_bytes(4, "little")).hexdigest()
            links.append(link if payload is not None else None)
        state.update((link, int(rows["frame_id"].max())))
        yield pd.DataFrame({"session": key[0], "frame_id": rows["frame_id"], "payload_sha256": rows["payload_sha256"], "chain": links})

    keyed = frames.select("session", "frame_id", "payload_sha256").groupBy("session")
    return keyed.applyInPandasWithState(step, "session long, frame_id long, payload_sha256 string, chain string", "link string, last long", "append", GroupStateTimeout.NoTimeout)
