"""Arrays of numbers as compressed bytes, for shuffles that carry a few bytes a word instead of a row a word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

_KINDS = {pa.binary(): "binary", pa.int64(): "long", pa.float64(): "double", pa.bool_(): "boolean"}


def pack(a: np.ndarray) -> bytes:
    """Byte planes, compressed: constant and slowly varying bytes cost nearly nothing."""
    cells = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize)
    planes = np.empty(cells.shape[::-1], np.uint8)
    for k in range(a.itemsize):
        planes[k] = cells[:, k]
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(size, -1)
    cells = np.empty(planes.shape[::-1], np.uint8)
    for k in range(size):
        cells[:, k] = planes[k]
    return cells.view(dtype).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def unpack_sorted(b: bytes, dtype) -> np.ndarray:
    return np.cumsum(unpack(b, dtype), dtype=dtype)


def by_bucket(bucket: np.ndarray):
    """Runs of equal values of a sorted array: value, begin, end."""
    if len(bucket):
        at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        yield from zip(bucket[at].tolist(), at.tolist(), [*at[1:].tolist(), len(bucket)], strict=True)


def table_of(schema: pa.Schema, rows) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema.names]
    return pa.table([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_KINDS[f.type]}" for f in schema)


#: Ranges that a group's keys are dealt into at once.
FAN = 1024


class Route:
    """The way of sorted 64-bit keys from groups of documents to buckets by range of key, and of answers back.

    A group sends one row to each bucket, which would be more rows than keys where there are very many of both.  Beyond
    ``fan`` buckets the way has a stop between: a group sends one row to each of at most ``fan`` ranges of buckets, a stop puts the rows
    of about ``fan`` groups together and deals them to the buckets of its range; answers go back the same way.  Rows so stay
    long, and their number grows with the keys.  A row holds keys of groups ``gs``; ``who`` says whose each is (empty: all the
    first's), and ``home`` who gets the answer: a group, or a stop.

    ``bits`` is the length of the keys, one for each level; levels are independent sets of keys.  ``payload`` gives name, type and
    number of the values that a key brings, ``answer`` of those that it gets."""

    def __init__(self, buckets: int, bits: list[int], payload: list[tuple], answer: list[tuple], fan: int | None = None):
        fan = fan or FAN
        self.buckets, self.bits, self.payload, self.answer, self.fan = buckets, bits, payload, answer, fan
        self.coarse = -(-buckets // fan)
        self.ranges = -(-buckets // self.coarse)
        long, binary = pa.int64(), pa.binary()
        self.there = pa.schema([("bucket", long), ("home", long), ("gs", binary), ("who", binary), ("keys", binary), *((n, binary) for n, _, _ in payload)])
        self.back = pa.schema([("home", long), ("bucket", long), ("gs", binary), ("who", binary), ("keys", binary), *((n, binary) for n, _, _ in answer)])
        self.told = pa.schema([("g", long), ("bucket", long), ("keys", binary), *((n, binary) for n, _, _ in answer)])

    def _bucket(self, keys: np.ndarray, level: int) -> np.ndarray:
        return ((keys >> np.uint64(self.bits[level] - 32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)

    def sent(self, g: int, level: int, keys: np.ndarray, values: list[np.ndarray]):
        """A group's rows, of sorted keys."""
        for r, i, j in by_bucket(self._bucket(keys, level) // self.coarse + level * self.ranges):
            yield (r, g, pack(np.array([g])), b"", pack_sorted(keys[i:j]), *(pack(v[..., i:j]) for v in values))

    def level_of(self, bucket: int) -> int:
        """Of a bucket, where keys meet."""
        return bucket // self.buckets

    def _stop(self, key, table: pa.Table) -> pa.Table:
        """The rows of some groups for a range of buckets, as rows for each bucket."""
        place, batch = key[0].as_py(), key[1].as_py()
        level = place // self.ranges
        rows = Rows(table, self.payload)
        order = np.argsort(rows.keys, kind="stable")
        keys, who = rows.keys[order], np.repeat(np.arange(len(rows.sizes), dtype=np.uint32), rows.sizes)[order]
        gs = pack(np.array(table.column("home").to_pylist()))
        values = [v[:, order] for v in rows.values]
        out = []
        for b, i, j in by_bucket(self._bucket(keys, level) + level * self.buckets):
            out.append((b, place << 32 | batch, gs, pack(who[i:j]), pack_sorted(keys[i:j]), *(pack(v[:, i:j]) for v in values)))
        return table_of(self.there, out)

    def dealt(self, rows, n_groups: int):
        """The rows of groups, grouped by bucket."""
        if self.coarse > 1:
            batch = F.pmod(F.xxhash64("home"), F.lit(1 + n_groups // self.fan))
            rows = rows.groupBy("bucket", batch.alias("batch")).applyInArrow(lambda k, t: self._stop(k, t), ddl(self.there))
        return rows.groupBy("bucket")

    def answers(self, bucket: int, table: pa.Table, rows: Rows, values: list[np.ndarray], only: np.ndarray | None = None):
        """What each row's sender is told of its keys: ``values`` of all of them, or the keys that are in ``only`` themselves."""
        at = 0
        for home, gs, who, size in zip(*(table.column(c).to_pylist() for c in ("home", "gs", "who")), rows.sizes.tolist(), strict=True):
            part = slice(at, at + size)
            at += size
            if only is None:
                yield (home, bucket, gs, who, b"", *(pack(v[..., part]) for v in values))
            elif len(mine := rows.keys[part][only[part]]):
                yield (home, bucket, gs, pack(unpack(who, np.uint32)[only[part]]) if who else b"", pack_sorted(mine))

    def _home(self, key, table: pa.Table) -> pa.Table:
        """The answers that came back to a stop, as rows for each of its groups."""
        table = table.sort_by("bucket")
        gs = unpack(table.column("gs")[0].as_py(), np.int64)
        who = np.concatenate([unpack(b, np.uint32) for b in table.column("who").to_pylist()])
        order = np.argsort(who, kind="stable")
        keys = [unpack_sorted(b, np.uint64) for b in table.column("keys").to_pylist() if b]
        keys = np.concatenate(keys)[order] if keys else None
        values = [v[:, order] for v in values_of(table, self.answer)]
        out = []
        for w, i, j in by_bucket(who[order].astype(np.int64)):
            out.append((int(gs[w]), key[0].as_py() >> 32, pack_sorted(keys[i:j]) if keys is not None else b"", *(pack(v[:, i:j]) for v in values)))
        return table_of(self.told, out)

    def returned(self, answers):
        """``g, bucket, keys`` and the answers' values, in the order of the group's own keys if sorted by ``bucket``."""
        if self.coarse > 1:
            return answers.groupBy("home").applyInArrow(lambda k, t: self._home(k, t), ddl(self.told))
        return answers.select(F.col("home").alias("g"), *self.told.names[1:])

    def level_told(self, bucket: int) -> int:
        """Of a row of answers."""
        return bucket // self.ranges


def values_of(table: pa.Table, kinds: list[tuple]) -> list[np.ndarray]:
    """The packed values of all rows side by side, as many lines as there are for each key."""
    return [np.concatenate([unpack(b, dtype).reshape(n, -1) for b in table.column(name).to_pylist()], axis=1) for name, dtype, n in kinds]


class Rows:
    """The keys and values of the rows of a bucket."""

    def __init__(self, table: pa.Table, payload: list[tuple]):
        each = [unpack_sorted(b, np.uint64) for b in table.column("keys").to_pylist()]
        self.sizes = np.array([len(k) for k in each])
        self.keys = np.concatenate(each)
        self.values = values_of(table, payload)
