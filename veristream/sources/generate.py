"""Seeded missions: an action schedule, vectors, distributions and one fault frame."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The actions; the safe ones take turns every STRETCH frames.
SAFE = ("maintain_speed", "decelerate", "steer_left", "steer_right")
ACTIONS = (*SAFE, "emergency_stop")
STRETCH, LANES = 10, 64
#: Frames that leave a task at once.
BATCH = 1000


#: Parts of one in a distribution: shares have four digits.
PARTS = 10_000


def _shares(rng: np.random.Generator, n: int) -> np.ndarray:
    """For n frames the shares of all actions, the selected one first: it has seven tenths of the parts or more, and the rest is cut
    at places drawn together; shares are whole numbers of parts, so they add up to one."""
    selected = rng.integers(PARTS * 7 // 10, PARTS * 19 // 20 + 1, n)
    cuts = np.sort(rng.random((n, len(ACTIONS) - 2)), axis=1) * (PARTS - selected)[:, None]
    edges = np.column_stack([np.zeros(n), np.floor(cuts), PARTS - selected])
    return np.column_stack([selected, np.diff(edges, axis=1)]) / PARTS


def missions(spark, n_missions: int, frames: int = 100, seed: int = 7, fault_at: int | None = None, residual_bytes: int = 8192, scale: float = 0.8, fault_scale: float = 8.0) -> DataFrame:
    """``session, frame_id, action, latents (64 float32), distribution, residual, evt``; a mission is drawn whole from its own seed, by one task."""

    def one(mission: int, numbers: np.ndarray) -> pa.RecordBatch:
        """A mission's frames, all drawn at once: what is drawn doesn't depend on the partitioning."""
        rng = np.random.default_rng([seed, mission])
        n = len(numbers)
        fault = numbers == (-1 if fault_at is None else fault_at)
        chosen = np.where(fault, 0, numbers // STRETCH % len(SAFE))
        low, high = np.where(fault, fault_scale, 0.0)[:, None], np.where(fault, 2 * fault_scale, scale)[:, None]
        lanes = (low + rng.random((n, LANES)) * (high - low)).astype("<f4")
        # The selected action first, then the others in order.
        others = np.array([[a for a in range(len(ACTIONS)) if a != k] for k in range(len(SAFE))])
        named = np.array(ACTIONS)[np.column_stack([chosen, others[chosen]])]
        keys, shares = named.ravel().tolist(), _shares(rng, n).ravel()
        offsets = pa.array(np.arange(0, len(keys) + 1, len(ACTIONS), dtype=np.int32))
        residual = rng.integers(0, 256, (n, residual_bytes), np.uint8)
        return pa.RecordBatch.from_arrays([
            pa.array([f"mission-{mission}"] * n), pa.array(numbers, pa.int64()), pa.array(np.array(SAFE)[chosen].tolist()), pa.array([row.tobytes() for row in lanes], pa.binary()),
            pa.MapArray.from_arrays(offsets, pa.array(keys), pa.array(shares)), pa.array([row.tobytes() for row in residual], pa.binary()), pa.array(np.where(fault, "wheel_slip", None).tolist(), pa.string()),
        ], names=["session", "frame_id", "action", "latents", "distribution", "residual", "evt"])

    def draw(batches):
        for batch in batches:
            for mission in batch.column("id").to_pylist():
                whole = one(mission, np.arange(frames))
                for at in range(0, frames, BATCH):
                    yield whole.slice(at, BATCH)

    ids = spark.range(n_missions)
    return ids.mapInArrow(draw, "session string, frame_id long, action string, latents binary, distribution map<string,double>, residual binary, evt string")


def payloads(df: DataFrame, vector: str, lanes: int = LANES) -> DataFrame:
    """Add ``payload``: the vector's first lanes as little-endian float32, filled up with zeros."""

    def write(batches):
        for batch in batches:
            made = [np.resize(np.append(np.array((v or [])[:lanes], "<f4"), np.zeros(lanes, "<f4")), lanes).astype("<f4").tobytes() for v in batch.column(vector).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], [*batch.schema.names, "payload"])

    from pyspark.sql.types import BinaryType, StructType

    return df.mapInArrow(write, StructType([*df.schema.fields]).add("payload", BinaryType()))


def vectors(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``vector``: the payload's little-endian float32 lanes; bytes beyond a whole lane are cut, a null payload is an empty vector."""

    def read(batches):
        for batch in batches:
            lanes = [np.frombuffer(b[: len(b) // 4 * 4], "<f4").tolist() if b else [] for b in batch.column(payload).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lanes, pa.list_(pa.float32()))], [*batch.schema.names, "vector"])

    from pyspark.sql.types import ArrayType, FloatType, StructType

    return df.mapInArrow(read, StructType([*df.schema.fields]).add("vector", ArrayType(FloatType())))
