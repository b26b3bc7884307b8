"""Framed binary record files as DataFrames, and back.

``spark.read.format("framed").option("kind", "hot" | "cold" | "frames").load(path)`` gives one row for each record that a scan
finds, with a status; ``path`` is a file, or a folder whose sub-folders hold the kind's file.  Hot files have
records of one length, so they are split by frame ranges and a ``frame_id`` filter seeks straight to its record; the others
are walked, one task a file.  Cold files resynchronise on damage; frame files stop.  :func:`scan` gives the rows of such a walk from many
tasks a file.

Writers: :func:`write_hot`, :func:`write_cold` and :func:`write_frames`, one file for each session, written where the session's
rows are.  ``df.write.format("framed").option("kind", ...).save(path)`` writes ``session, frame_id, payload`` as they lie: a session's rows in one
partition, in order of frame_id.  Its files are moved to their places one by one when the whole job has succeeded; a driver that dies
meanwhile leaves some of them.  "append" adds sessions, and refuses one that has a file; "overwrite" leaves only what it wrote.
"""

from __future__ import annotations

import contextlib
import hashlib
import itertools
import json
import os
import struct
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, InputPartition, WriterCommitMessage

#: The wire format.
HEADER, HEADER_BYTES = "<4sBII", 13
VERSION = 1
KINDS = {"hot": ("cam_latents.bin", b"AXLF", b"AXLR", 256), "cold": ("cam_residuals.bin", b"", b"AXRR", 10 << 20), "frames": ("frames.bin", b"AXFF", b"AXFR", 32 << 20)}
HOT_PAYLOAD = 256
HOT_RECORD = HEADER_BYTES + HOT_PAYLOAD
RESYNC_CHUNK, RESYNC_MOST = 64 << 10, 64 << 20
#: Records of a hot file that one task reads.
HOT_SPLIT = 100_000

#: Bytes of a cold or frame file that one task of :func:`scan` reads, its most tasks, and bytes between a record's header and its payload.
SPLIT_BYTES = 64 << 20
MOST_RANGES = 256
EXTRA = {"hot": 0, "cold": 0, "frames": 64}

SCHEMA = "session string, offset long, magic binary, ver short, frame_id long, dlen long, payload_sha256 string, claimed_sha256 string, chain string, payload binary, status string, garbage long"
_TYPES = {"string": pa.string(), "long": pa.int64(), "short": pa.int16(), "binary": pa.binary()}
_ARROW = [_TYPES[f.split(" ")[1]] for f in SCHEMA.split(", ")]


@dataclass
class Split(InputPartition):
    path: str
    first: int
    count: int

    def __init__(self, path, first=0, count=-1):
        self.path, self.first, self.count = path, first, count


def _row(session, offset, magic=None, ver=None, frame_id=None, dlen=None, digest=None, claimed=None, chain=None, payload=None, status="VERIFIED", garbage=0):
    return (session, offset, magic, ver, frame_id, dlen, digest, claimed, chain, payload, status, garbage)


def _session(path: str) -> str:
    return os.path.basename(os.path.dirname(path))


def _next_magic(f, magic: bytes, at: int) -> int:
    """Where the magic stands next, from ``at`` on; -1 if not within the budget."""
    f.seek(at)
    tail, tail_at = b"", at
    while tail_at - at < RESYNC_MOST and (chunk := f.read(RESYNC_CHUNK)):
        found = (tail + chunk).find(magic)
        if found >= 0:
            return tail_at + found
        keep = min(len(magic) - 1, len(tail) + len(chunk))
        tail_at += len(tail) + len(chunk) - keep
        tail = (tail + chunk)[-keep:] if keep else b""
    return -1


class FramedReader(DataSourceReader):
    def __init__(self, options):
        self.kind = options.get("kind", "hot")
        self.name, self.file_magic, self.magic, self.most = KINDS[self.kind]
        path = options["path"]
        below = sorted(os.path.join(d, self.name) for d, _, names in os.walk(path) if self.name in names)
        self.files = [path] if os.path.isfile(path) else below
        self.only: int | None = None

    def pushFilters(self, filters):
        for f in filters:
            if self.kind == "hot" and isinstance(f, EqualTo) and f.attribute == ("frame_id",) and isinstance(f.value, int):
                self.only = f.value
            yield f  # Spark still checks what a damaged record really says

    def partitions(self):
        if self.kind != "hot":
            return [Split(p) for p in self.files]
        out = []
        for p in self.files:
            n = max(1, -(-(os.path.getsize(p) - len(self.file_magic)) // HOT_RECORD))
            out += [Split(p, self.only, 1)] if self.only is not None else [Split(p, k, min(HOT_SPLIT, n - k)) for k in range(0, n, HOT_SPLIT)]
        return out

    def read(self, split):
        if split is None:  # no file at all
            return
        with open(split.path, "rb") as f:
            if f.read(len(self.file_magic)) != self.file_magic:
                yield _row(_session(split.path), 0, status="BAD_FILE_HEADER")
            elif self.kind == "hot":
                yield from self._hot(f, split)
            else:
                yield from _walk(f, self.kind, _session(split.path))

    def _hot(self, f, split):
        for number in range(split.first, split.first + split.count):
            offset = len(self.file_magic) + number * HOT_RECORD
            f.seek(offset)
            head = f.read(HEADER_BYTES)
            if not head:
                return
            if len(head) < HEADER_BYTES:
                yield _row(_session(split.path), offset, status="EOF")
                return
            magic, ver, frame_id, dlen = struct.unpack(HEADER, head)
            payload = f.read(HOT_PAYLOAD)
            status = "BAD_MAGIC" if magic != self.magic else "BAD_VERSION" if ver != VERSION else "DRIFT" if frame_id != number else "BAD_DIM" if dlen != HOT_PAYLOAD else "TORN_WRITE" if len(payload) < dlen else "VERIFIED"
            yield _row(_session(split.path), offset, magic, ver, frame_id, dlen, hashlib.sha256(payload).hexdigest(), payload=payload, status=status)



def _walk(f, kind, session, end=float("inf")):
    """The records from where the file stands, of those that begin before ``end``."""
    _, _, right, most = KINDS[kind]
    extra = EXTRA[kind]
    while (offset := f.tell()) < end:
        head = f.read(HEADER_BYTES)
        if not head:
            return
        if len(head) < HEADER_BYTES:
            yield _row(session, offset, status="TRUNCATED_HEADER")
            return
        magic, ver, frame_id, dlen = struct.unpack(HEADER, head)
        if magic != right:
            following = _next_magic(f, right, offset + 1) if kind == "cold" else -1
            yield _row(session, offset, magic, status="BAD_MAGIC" if following < 0 else "RESYNC", garbage=max(0, following - offset))
            if following < 0:
                return
            f.seek(following)
            continue
        if ver != VERSION or dlen > most:
            yield _row(session, offset, magic, ver, frame_id, dlen, status="BAD_VERSION" if ver != VERSION else "TOO_LARGE")
            return
        claimed, payload = f.read(extra), f.read(dlen)
        if len(claimed) < extra or len(payload) < dlen:
            yield _row(session, offset, magic, ver, frame_id, dlen, status="TORN_WRITE")
            return
        digest = hashlib.sha256(payload).hexdigest()
        status = "HASH_MISMATCH" if extra and claimed[:32].hex() != digest else "VERIFIED"
        yield _row(session, offset, magic, ver, frame_id, dlen, digest, claimed[:32].hex() or None, claimed[32:].hex() or None, payload, status)


def _skim(f, kind, size, end) -> int:
    """Where the walk goes on from ``end``, or -1 if it stops before; payloads are passed over, not read."""
    _, _, right, most = KINDS[kind]
    while (offset := f.tell()) < end:
        head = f.read(HEADER_BYTES)
        if len(head) < HEADER_BYTES:
            return -1
        magic, ver, _, dlen = struct.unpack(HEADER, head)
        if magic != right:
            following = _next_magic(f, right, offset + 1) if kind == "cold" else -1
            if following < 0:
                return -1
            f.seek(following)
        elif ver != VERSION or dlen > most or (following := offset + HEADER_BYTES + EXTRA[kind] + dlen) > size:
            return -1
        else:
            f.seek(following)
    return offset


def _guess(f, kind, begin, end) -> int:
    """The first place in a range that looks like a record's header, or -1."""
    _, _, right, most = KINDS[kind]
    at = _next_magic(f, right, begin)
    while 0 <= at < end:
        f.seek(at)
        head = f.read(HEADER_BYTES)
        if len(head) == HEADER_BYTES and head[4] == VERSION and struct.unpack(HEADER, head)[3] <= most:
            return at
        at = _next_magic(f, right, at + 1)
    return -1


def _probe(batches, kind):
    """Of each range: where its walk is taken to begin (given, or guessed where that is null), and where it goes on."""
    for batch in batches:
        entries, exits = [], []
        for path, begin, end, entry in zip(*(batch.column(c).to_pylist() for c in ("path", "begin", "end", "entry")), strict=True):
            with open(path, "rb") as f:
                entries.append(_guess(f, kind, begin, end) if entry is None else entry)
                exits.append(-1)
                if entries[-1] >= 0:
                    f.seek(entries[-1])
                    exits[-1] = _skim(f, kind, os.path.getsize(path), end)
        columns = [batch.column(c) for c in ("path", "begin", "end")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(entries, pa.int64()), pa.array(exits, pa.int64())], names=["path", "begin", "end", "entry", "exit"])


def _read(batches, kind):
    names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
    for batch in batches:
        for path, end, entry in zip(*(batch.column(c).to_pylist() for c in ("path", "end", "entry")), strict=True):
            with open(path, "rb") as f:
                if entry < 0:
                    rows = iter([_row(_session(path), 0, status="BAD_FILE_HEADER")])
                else:
                    f.seek(entry)
                    rows = _walk(f, kind, _session(path), end)
                # Some records at a time: their payloads are what fills memory.
                while some := list(itertools.islice(rows, 16)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), _ARROW, strict=True)], names=names)


def scan(spark, kind: str, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The rows of the walk of all cold or frame files below a folder, from a task for each ``split_bytes`` of a file.

    A record's place is known only from the one before, so each range of a file is first skimmed from the first place in it that
    looks like a header, all ranges at once.  Where the walk really enters a range follows from where it left the one before: a range whose
    guess was wrong (a payload that holds a header, damage) is skimmed again from there.  Then all ranges are read from their true
    entries.  The driver holds one row for each range; where there are more than ``MOST_RANGES``, ranges are longer than asked for."""
    reader = FramedReader({"kind": kind, "path": folder})
    shape = "path string, begin long, end long, entry long"
    split_bytes = max(split_bytes, sum(map(os.path.getsize, reader.files)) // MOST_RANGES)
    files = {}
    for path in reader.files:
        with open(path, "rb") as f:
            whole = f.read(len(reader.file_magic)) == reader.file_magic
        size = os.path.getsize(path)
        # The first range begins where the records do.
        head = len(reader.file_magic)
        cuts = [head, *(c for c in range(split_bytes, size, split_bytes) if c > head)]
        files[path] = list(zip(cuts, [*cuts[1:], size], strict=True)) if whole else []

    def probed(ranges):
        rows = spark.createDataFrame(ranges, shape).repartition(len(ranges)).mapInArrow(lambda b: _probe(b, kind), f"{shape}, exit long").collect()
        return {(r.path, r.begin): (r.entry, r.exit) for r in rows}

    todo = [(p, b, e, b if not k else None) for p, ranges in files.items() for k, (b, e) in enumerate(ranges)]
    known, entries = {}, [(p, 0, 0, -1) for p, ranges in files.items() if not ranges]
    while todo:
        known |= probed(todo)
        todo, true = [], []
        for path, ranges in files.items():
            at = ranges[0][0] if ranges else -1
            for begin, end in ranges:
                if at < 0:
                    break
                if at >= end:
                    continue
                if known[path, begin][0] != at:
                    todo.append((path, begin, end, at))
                    break
                true.append((path, begin, end, at))
                at = known[path, begin][1]
    entries += true if known else []
    if not entries:
        return spark.createDataFrame([], SCHEMA)
    return spark.createDataFrame(entries, shape).repartition(len(entries), "path", "begin").mapInArrow(lambda b: _read(b, kind), SCHEMA)


def points(spark, kind: str, folder: str, wanted: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of ``session, offset`` rows, read at these places in order, without a scan: bytes read grow with the offsets.

    A record is judged by itself (magic, version, length, a frame's hash); an offset behind the end, or of a session without a file, gives EOF.
    Offsets of one range of a file go to one task, which seeks forward only."""
    name, _, right, most = KINDS[kind]
    extra, names = EXTRA[kind], [f.split(" ")[0] for f in SCHEMA.split(", ")]

    def one(f, session, offset):
        f.seek(offset)
        head = f.read(HEADER_BYTES)
        if len(head) < HEADER_BYTES:
            return _row(session, offset, status="TRUNCATED_HEADER" if head else "EOF")
        magic, ver, frame_id, dlen = struct.unpack(HEADER, head)
        status = "BAD_MAGIC" if magic != right else "BAD_VERSION" if ver != VERSION else "TOO_LARGE" if dlen > most else "VERIFIED"
        if status != "VERIFIED":
            return _row(session, offset, magic, ver, frame_id, dlen, status=status)
        claimed, payload = f.read(extra), f.read(dlen)
        if len(claimed) < extra or len(payload) < dlen:
            return _row(session, offset, magic, ver, frame_id, dlen, status="TORN_WRITE")
        digest = hashlib.sha256(payload).hexdigest()
        status = "HASH_MISMATCH" if extra and claimed[:32].hex() != digest else "VERIFIED"
        return _row(session, offset, magic, ver, frame_id, dlen, digest, claimed[:32].hex() or None, claimed[32:].hex() or None, payload, status)

    def rows(session, offsets):
        path = os.path.join(folder, session, name)
        if not os.path.exists(path):
            yield from (_row(session, at, status="EOF") for at in offsets)
            return
        with open(path, "rb") as f:
            yield from (one(f, session, at) for at in offsets)

    def read(batches):
        for session, mine in _by_session(batches, ["offset"]):
            found = rows(session, (at for _, at in mine))
            while some := list(itertools.islice(found, 16)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), _ARROW, strict=True)], names=names)

    places = wanted.where("session IS NOT NULL AND offset >= 0").select(F.col("session").cast("string").alias("session"), F.col("offset").cast("long").alias("offset")).distinct()
    dealt = places.repartition("session", F.floor(F.col("offset") / split_bytes)).sortWithinPartitions("session", "offset")
    return dealt.mapInArrow(read, SCHEMA)


class FramedSource(DataSource):
    @classmethod
    def name(cls):
        return "framed"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FramedReader(self.options)

    def writer(self, schema, overwrite):
        return FramedWriter(self.options, overwrite)


@dataclass
class Written(WriterCommitMessage):
    """Files beside their places, and the places."""

    files: list[tuple[str, str]]


class FramedWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite):
        self.kind, self.folder, self.overwrite = options.get("kind", "hot"), options["path"], overwrite
        self.record = _frame_record(options["domain"]) if "domain" in options else RECORDS[self.kind]

    def write(self, iterator):
        name, head = KINDS[self.kind][:2]
        files = []
        try:
            for session, mine in _by_session(iterator, ["frame_id", "payload"]):
                path = os.path.join(self.folder, session, name)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                files.append((f"{path}.{uuid.uuid4().hex}", path))
                with open(files[-1][0], "wb") as f:
                    _put(f, head, self.record, session, mine)
        except BaseException:
            _remove(files)
            raise
        return Written(files)

    def commit(self, messages):
        files = [pair for m in messages if m is not None for pair in m.files]
        places = sorted(path for _, path in files)
        twice = [p for p, q in itertools.pairwise(places) if p == q]
        there = [] if self.overwrite else [p for p in places if os.path.exists(p)]
        if twice or there:
            _remove(files)
            raise ValueError(f"a session's rows stand apart: {twice[:3]}" if twice else f"sessions that have a file: {there[:3]}")
        for beside, path in files:
            os.replace(beside, path)
        if self.overwrite:
            # What stood there before goes last: other sessions' files of this kind.
            name = KINDS[self.kind][0]
            for old in [os.path.join(d, name) for d, _, names in os.walk(self.folder) if name in names]:
                if old not in places:
                    os.remove(old)

    def abort(self, messages):
        _remove(pair for m in messages if m is not None for pair in m.files)


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FramedSource)


def scan_stats(records: DataFrame) -> DataFrame:
    """One row of totals of a scan."""
    return records.selectExpr("count_if(status = 'VERIFIED') AS records", "count_if(status IN ('RESYNC', 'BAD_MAGIC')) AS corrupt_headers", "count_if(status = 'RESYNC') AS resyncs", "coalesce(sum(garbage), 0) AS garbage_bytes")


def event_log(spark, path: str) -> DataFrame:
    """``session, line``: lines end at a line feed only, empty ones are skipped."""
    return spark.read.option("lineSep", "\n").text(path).selectExpr("regexp_extract(_metadata.file_path, '([^/]+)/[^/]+$', 1) AS session", "value AS line").where("line <> ''")


def json_table(spark, path: str, schema: str) -> DataFrame:
    """A JSON-lines table; an absent file is an empty table."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


@contextlib.contextmanager
def _committed(path: str):
    """A file that is there whole or not at all: it is written beside its place and moved there at the end, so a lost executor leaves
    none, and a repeated task replaces it."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    beside = f"{path}.{uuid.uuid4().hex}"
    try:
        with open(beside, "wb") as f:
            yield f
        os.replace(beside, path)
    finally:
        if os.path.exists(beside):
            os.remove(beside)


def _remove(files) -> None:
    for beside, _ in files:
        if os.path.exists(beside):
            os.remove(beside)


def _by_session(batches, columns: list[str]):
    """Each run of rows of one session, as it comes."""
    rows = ((s, *r) for b in batches for s, *r in zip(*(b.column(c).to_pylist() for c in ("session", *columns)), strict=True))
    return itertools.groupby(rows, key=lambda r: r[0])


def _put(f, head: bytes, record, session: str, rows) -> int:
    """Write a session's rows, of ``session`` and a record's values; gives their number."""
    f.write(head)
    state, n = None, 0
    for _, *row in rows:
        blob, state = record(session, *row, state)
        f.write(blob)
        n += 1
    f.flush()
    os.fsync(f.fileno())
    return n


def _sessions(rows: DataFrame, columns: list[str], name: str, head: bytes, record, folder: str) -> DataFrame:
    """One file for each session, its rows in order of frame_id: a partition's rows come sorted, and only one batch of them is held.
    Gives ``session, records, bytes``."""

    def write(batches):
        for session, mine in _by_session(batches, columns):
            with _committed(os.path.join(folder, session, name)) as f:
                n = _put(f, head, record, session, mine)
                size = f.tell()
            yield pa.RecordBatch.from_arrays([pa.array([session]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["session", "records", "bytes"])

    dealt = rows.select("session", *dict.fromkeys(["frame_id", *columns])).repartition("session").sortWithinPartitions("session", "frame_id")
    return dealt.mapInArrow(write, "session string, records long, bytes long")


def _header(kind: str, frame_id: int, payload: bytes) -> bytes:
    return struct.pack(HEADER, KINDS[kind][2], VERSION, frame_id, len(payload))


def _hot_record(session, frame_id, payload, at):
    if len(payload) != HOT_PAYLOAD or frame_id != (at or 0):
        raise ValueError(f"hot records are {HOT_PAYLOAD} bytes each, without gaps from frame 0")
    return _header("hot", frame_id, payload) + payload, frame_id + 1


def _cold_record(session, frame_id, payload, _):
    return _header("cold", frame_id, payload) + payload, None


def _frame_record(domain: str = "frames@1:"):
    def record(session, frame_id, payload, chain):
        chain = chain or hashlib.sha256(f"{domain}{session}".encode()).digest()
        digest = hashlib.sha256(payload).digest()
        chain = hashlib.sha256(chain + digest + struct.pack("<I", frame_id)).digest()
        return _header("frames", frame_id, payload) + digest + chain + payload, chain

    return record


RECORDS = {"hot": _hot_record, "cold": _cold_record, "frames": _frame_record()}


def _write(df: DataFrame, folder: str, kind: str, record=None) -> DataFrame:
    name, head = KINDS[kind][:2]
    return _sessions(df, ["frame_id", "payload"], name, head, record or RECORDS[kind], folder)


def write_hot(df: DataFrame, folder: str) -> DataFrame:
    return _write(df, folder, "hot")


def write_cold(df: DataFrame, folder: str) -> DataFrame:
    return _write(df, folder, "cold")


def write_frames(df: DataFrame, folder: str, domain: str = "frames@1:") -> DataFrame:
    return _write(df, folder, "frames", _frame_record(domain))


def write_event_log(events: DataFrame, folder: str) -> DataFrame:
    """One JSON-lines file for each ``session`` of ``frame_id, base, extra`` (maps as JSON text): extra keys win over base keys."""

    def line(_, frame_id, base, extra, state):
        return json.dumps(json.loads(base) | json.loads(extra or "{}")).encode() + b"\n", state

    written = _sessions(events, ["frame_id", "base", "extra"], "events.jsonl", b"", line, folder)
    return written.selectExpr("session", "records AS lines")


def write_summaries(rows: DataFrame, folder: str) -> DataFrame:
    """One ``session.json`` for each ``session, summary`` (a struct, written as JSON)."""

    def line(_, summary, state):
        return summary.encode() + b"\n", state

    made = rows.select("session", F.lit(0).alias("frame_id"), F.to_json("summary").alias("summary"))
    return _sessions(made, ["summary"], "session.json", b"", line, folder).select("session")


def listed(spark, folder: str, name: str) -> DataFrame:
    """``session`` of each file of a name below a folder, by listing: no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(folder)
    return files.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("session"))


def discover(records: DataFrame, logs: DataFrame) -> DataFrame:
    """Sessions that have both a stream and an event log, from :func:`listed` rows."""
    return records.select("session").distinct().join(logs.select("session").distinct(), "session", "left_semi")
