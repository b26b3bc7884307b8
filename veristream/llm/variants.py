"""Spelling variants: which words differ by one letter, and which of them is the usual form.

1. *Count.*  Runs of letters are cut out of the bytes of a slice and added up before they leave the task; Spark adds up the rest.
2. *Shards.*  The words, in order, are cut into shards of ``SHARD_BYTES``, each of which one task makes a compact trie:
   labels and numbers of children in breadth-first order, and the counts of the words that end at a node.
3. *Intersect.*  Shards are broadcast in rounds of ``ROUND_BYTES``, whatever the number of words.  Every block of words runs its
   distance-one Levenshtein automata through every shard, depth first: a block's states of one depth are one array, and a shard
   of words that begin alike ends nearly all of them at its root.  Accepting nodes are neighbours; only their number and the best one
   leave the task, never a pair.
4. *Reduce.*  Numbers are added up over shards, best forms compared, and forms followed to the last by pointer doubling.

An automaton has one path to each neighbour: of a run of equal letters the last one is deleted, and a letter is inserted behind
the run that it would prolong.

Defined results: a null text has no words; a null doc_id counts as the empty text; rows repeated under one doc_id count each; ties of
form go to the smallest word; a run of any length is one word; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as tx
from .cluster import checkpointed, spread_join, stored

MIN_LENGTH, MIN_COUNT = 6, 5
#: A form is at least so many times as frequent.
FREQUENT = 5
#: One of so many runs of a document loses a letter.
MISSPELT = 199

#: Bytes of words in a shard (and one word at most beyond), and of tries in a round.
SHARD_BYTES, ROUND_BYTES = 4 << 20, 32 << 20
#: Bytes of words whose automata run at once.
BLOCK = 1 << 14

#: Lead byte of U+00C0 to U+00FF, each of which has two bytes.
_LEAD = 0xC3
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), _LEAD]] = True

_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best", pa.string()), ("best_n", pa.int64())])
NEAR = "word string, n_near long, best string, best_n long"


def misspelt(word: bytes, h: int) -> bytes:
    text = word.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def letter_runs(ids: pa.Array, texts: pa.Array, least: int) -> pa.Table:
    """Words of a slice and their numbers, misspelt ones as such."""
    data, offsets = tx.utf8(texts)
    inside = _LETTER[data]
    inside[1:] |= data[:-1] == _LEAD
    data = tx.LOWER[data]
    runs = tx.Words(data, offsets, inside=inside)
    ends = np.cumsum(data == _LEAD, dtype=np.int64)
    # Letters: bytes without the second ones.
    length = runs.ends - runs.starts - (ends[runs.ends - 1] - ends[runs.starts] + (data[runs.starts] == _LEAD))
    kept = length >= least
    spans = np.repeat(kept, runs.ends - runs.starts)
    codes, distinct = tx.span_codes(data[inside][spans], (runs.ends - runs.starts)[kept])
    pairs, n = np.unique(runs.row[kept].astype(np.int64) * max(1, len(distinct)) + codes, return_counts=True)
    row, code = np.divmod(pairs, max(1, len(distinct)))
    words = distinct.to_pylist()
    begun = np.array([zlib.crc32(b"%s:" % (b"" if d is None else str(d).encode())) for d in ids.to_pylist()], np.int64)
    crc = zlib.crc32
    h = np.array([crc(words[c], b) for c, b in zip(code.tolist(), begun[row].tolist(), strict=True)], np.int64)
    odd = np.flatnonzero(h % MISSPELT == 0)
    changed = [misspelt(words[c], x) for c, x in zip(code[odd].tolist(), h[odd].tolist(), strict=True)]
    total = np.bincount(code, n, len(words)) - np.bincount(code[odd], n[odd], len(words))
    return pa.table([pa.array([*words, *changed], pa.binary()).cast(pa.string()), np.concatenate([total, n[odd]]).astype(np.int64)], schema=_COUNTS)


def _count(batches, least: int):
    for part in tx.slices(batches):
        counted = letter_runs(part.column("doc_id"), part.column("text"), least)
        counted = counted.filter(pc.and_(pc.greater(counted["n"], 0), pc.greater_equal(pc.utf8_length(counted["word"]), least)))
        yield from counted.combine_chunks().to_batches()


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n`` of all words of ``min_length`` letters or more that occur ``min_count`` times or more."""
    counted = docs.select("doc_id", "text").mapInArrow(partial(_count, least=min_length), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Trie:
    """A trie as arrays, nodes in breadth-first order: edge k leads to node k + 1, so the edges of a node lie side by side."""

    def __init__(self, labels: np.ndarray, children: np.ndarray, ends: np.ndarray, n: np.ndarray):
        self.labels, self.ends = labels, ends
        self.children = children.astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.children)])
        self.edges = np.repeat(np.arange(len(children), dtype=np.int64), children) << 8 | labels
        #: The count of the word that ends at a node.
        self.n = np.zeros(len(children), np.int64)
        self.n[ends] = n

    def child(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The child by a letter, or -1."""
        if not len(self.edges):
            return np.full(len(node), -1)
        key = node << 8 | letter
        at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
        return np.where(self.edges[at] == key, at + 1, -1)


def packed_trie(words: list[bytes], n: np.ndarray) -> bytes:
    """The trie of words in order, all different; one byte a letter."""
    lengths = np.array([len(w) for w in words], np.int64)
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    data = np.frombuffer(b"".join(words), np.uint8)
    labels, children, ends, counts = [], [], [], []
    # Words of one node stand side by side: level by level, each node is a run of them.
    at, node, nodes = np.arange(len(words)), np.zeros(len(words), np.int64), 1
    depth = done = 0
    while len(at):
        over = lengths[at] == depth
        ends.append(done + node[over])
        counts.append(n[at[over]])
        at, node = at[~over], node[~over]
        letter = data[begin[at] + depth]
        new = np.ones(len(at), bool)
        new[1:] = (node[1:] != node[:-1]) | (letter[1:] != letter[:-1])
        labels.append(letter[new])
        children.append(np.bincount(node[new], minlength=nodes))
        done, nodes, node, depth = done + nodes, int(new.sum()), np.cumsum(new) - 1, depth + 1
    sink = pa.BufferOutputStream()
    join = np.concatenate
    parts = [join(labels).astype(np.uint8), join(children).astype(np.uint8), join(ends).astype(np.int64), join(counts).astype(np.int64)]
    lists = pa.table([pa.array([p], pa.list_(pa.from_numpy_dtype(p.dtype))) for p in parts], names=["labels", "children", "ends", "n"])
    with pa.ipc.new_stream(sink, lists.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))) as writer:
        writer.write_table(lists)
    return sink.getvalue().to_pybytes()


def unpacked_trie(packed: bytes) -> Trie:
    lists = pa.ipc.open_stream(packed).read_all()
    return Trie(*(lists[c].combine_chunks().values.to_numpy() for c in ("labels", "children", "ends", "n")))


def neighbours(trie: Trie, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word and node of all words of the trie at distance one, each once.  Words end with a zero byte, which no edge has."""
    lengths = np.array([len(w) for w in words], np.int64)
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    text = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    # States before the edit: the word's own path, all prefixes that the trie holds.
    who, node, at = np.arange(len(words)), np.zeros(len(words), np.int64), begin.copy()
    stack = []
    while len(who):
        letter, after = text[at], text[np.minimum(at + 1, len(text) - 1)]
        # Deleted: the last letter of a run.
        gone = (letter > 0) & (letter != after)
        stack.append((who[gone], node[gone], at[gone] + 1))
        # Replaced by, or put behind, another letter.
        children = trie.children[node]
        edge = tx.ranges(trie.first[node], children)
        each = np.repeat(np.arange(len(node)), children)
        other = trie.labels[edge] != letter[each]
        edge, each = edge[other], each[other]
        stack.append((who[each], edge + 1, at[each]))
        inner = letter[each] > 0
        stack.append((who[each][inner], edge[inner] + 1, at[each][inner] + 1))
        to = trie.child(node, letter)
        on = (to >= 0) & (letter > 0)
        who, node, at = who[on], to[on], at[on] + 1
    found_who, found_node = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    terminal = np.zeros(len(trie.n), bool)
    terminal[trie.ends] = True
    # After the edit only the word's own letters go on.
    while stack:
        who, node, at = stack.pop()
        while len(who):
            letter = text[at]
            over = (letter == 0) & terminal[node]
            found_who.append(who[over])
            found_node.append(node[over])
            who, node, at, letter = (x[letter > 0] for x in (who, node, at, letter))
            to = trie.child(node, letter)
            who, node, at = who[to >= 0], to[to >= 0], at[to >= 0] + 1
    return np.concatenate(found_who), np.concatenate(found_node)


def spelled(trie: Trie, node: int) -> bytes:
    """The word that ends at a node."""
    out = bytearray()
    while node:
        out.append(int(trie.edges[node - 1]) & 0xFF)
        node = int(trie.edges[node - 1]) >> 8
    return bytes(reversed(out))


def _spelled(trie: Trie, nodes: np.ndarray) -> list[str]:
    return [spelled(trie, k).decode("latin-1") for k in nodes.tolist()]


def best_neighbours(trie: Trie, words: list[str]) -> pa.Table:
    """Of each word that has neighbours in the trie: how many, and the most frequent one, of equal ones the smallest."""
    who, node = neighbours(trie, [w.encode("latin-1") + b"\0" for w in words])
    # In order of the words; of each the largest count first.
    order = np.lexsort((-trie.n[node], who))
    who, node = who[order], node[order]
    first = np.flatnonzero(np.diff(who, prepend=-1))
    size = np.diff(first, append=len(who))
    # Only ties need their spelling to be compared.
    top = np.repeat(trie.n[node[first]], size) == trie.n[node]
    tied = np.add.reduceat(top.astype(np.int64), first) if len(first) else first
    best = _spelled(trie, node[first])
    for k in np.flatnonzero(tied > 1).tolist():
        best[k] = min(_spelled(trie, node[first[k] : first[k] + tied[k]]))
    return pa.table([pa.array([words[k] for k in who[first].tolist()], pa.string()), size, pa.array(best, pa.string()), trie.n[node[first]]], schema=_NEAR)


def _intersect(batches, shards):
    tries = [unpacked_trie(packed) for packed in shards.value]
    for batch in batches:
        for part in tx.slices([batch], "word", BLOCK):
            words = part.column("word").to_pylist()
            for trie in tries:
                yield from best_neighbours(trie, words).to_batches()


def _build(table: pa.Table) -> pa.Table:
    table = table.sort_by("word")
    words = [w.encode("latin-1") for w in table["word"].to_pylist()]
    packed = packed_trie(words, table["n"].to_numpy())
    return pa.table({"shard": table["shard"][:1], "size": pa.array([len(packed)], pa.int64()), "trie": pa.array([packed], pa.binary())})


def shards(words: DataFrame, shard_bytes: int) -> DataFrame:
    """``shard, size, trie`` of ``word, n``: words in order, cut where another ``shard_bytes`` begin."""
    dealt = checkpointed(words.repartitionByRange("word").withColumn("part", F.spark_partition_id()))
    bytes_ = F.octet_length("word") + 1
    before = F.coalesce(F.sum("b").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = dealt.groupBy("part").agg(F.sum(bytes_).alias("b")).select("part", before.alias("before"))
    within = F.sum(bytes_).over(Window.partitionBy("part").orderBy("word")) - bytes_
    placed = dealt.withColumn("within", within).join(parts, "part")
    shard = F.floor((F.col("within") + F.col("before")) / shard_bytes).cast("long")
    return placed.select(shard.alias("shard"), "word", "n").groupBy("shard").applyInArrow(_build, "shard long, size long, trie binary")


def near_words(words: DataFrame, shard_bytes: int = SHARD_BYTES, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """``word, n_near, best, best_n`` of the words of ``word, n`` that have a neighbour."""
    spark = words.sparkSession
    tries = stored(shards(words, shard_bytes))
    # Some 20 bytes for each shard of millions.
    sizes = sorted((r.shard, r.size) for r in tries.select("shard", "size").collect())
    rounds, room = [], 0
    for shard, size in sizes:
        if not rounds or size > room:
            rounds.append([])
            room = round_bytes
        rounds[-1].append(shard)
        room -= size
    found = []
    for some in rounds:
        packed = spark.sparkContext.broadcast([bytes(r.trie) for r in tries.where(F.col("shard").between(some[0], some[-1])).select("trie").collect()])
        found.append(stored(words.select("word").mapInArrow(partial(_intersect, shards=packed), NEAR)))
        packed.destroy()
    if not found:
        return spark.createDataFrame([], NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("top")
    return reduce(DataFrame.union, found).groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("top.word").alias("best"), (-F.col("top.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of rows ``word, form``: the last form that following them leads to.  A form is several times as frequent as its
    word, so chains are short and have no circles."""
    known = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        further = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        known = checkpointed(spread_join(known, further, ["root"], F.col("word"), "left"))
        if not known.where("next IS NOT NULL").head(1):
            return known.select("word", "root")
        known = known.select("word", F.coalesce("next", "root").alias("root"))


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of all words."""
    words = stored(word_counts(docs, min_length, min_count))
    found = words.join(near_words(words), "word", "left")
    usual = F.col("best_n") >= FREQUENT * F.col("n")
    found = stored(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(usual, F.col("best")).alias("form"), F.when(usual, F.col("best_n")).alias("form_n")))
    return found.join(roots(found.where("form IS NOT NULL")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_spelling_variants(spark, sf_dir):
    return spelling_variants(tx.read_documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH RECURSIVE t AS (SELECT 0 AS step, b AS i, b AS x FROM range(256) r(b) UNION ALL SELECT step + 1, i, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM t WHERE step < 8),
crc AS (SELECT list(x ORDER BY i) AS tab FROM t WHERE step = 8),
d AS (SELECT coalesce(doc_id::varchar, '') AS id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
r AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM d WHERE length(run) >= 6 GROUP BY ALL),
b AS (SELECT run, n, hex(encode(id || ':' || run)) AS x FROM r),
h AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, length(x) // 2), lambda k: ('0x' || x[2 * k + 1:2 * k + 2])::bigint)), lambda c, v: xor(c >> 8, tab[(xor(c, v) & 255) + 1])), 4294967295) AS h
  FROM b, crc
),
m AS (SELECT CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h),
w AS MATERIALIZED (SELECT word, sum(n)::bigint AS n FROM m WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
i AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
e AS MATERIALIZED (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS less FROM i),
p AS (
  SELECT DISTINCT a.word, b.word AS near, b.n FROM e AS a JOIN e AS b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT e.word, w.word, w.n FROM e JOIN w ON w.word = e.less UNION SELECT w.word, e.word, e.n FROM e JOIN w ON w.word = e.less
),
o AS (SELECT word, count(*) AS n_near FROM p GROUP BY word),
f AS (SELECT p.word, p.near AS form, p.n AS form_n FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, near) AS k FROM p) p JOIN w USING (word) WHERE k = 1 AND p.n >= 5 * w.n),
c AS (SELECT word, word AS root, 0 AS step FROM w UNION ALL SELECT c.word, f.form, step + 1 FROM c JOIN f ON f.word = c.root)
SELECT w.word, n, coalesce(n_near, 0) AS n_near, form, form_n, root
FROM w LEFT JOIN o USING (word) LEFT JOIN f USING (word) JOIN (SELECT word, arg_max(root, step) AS root FROM c GROUP BY word) USING (word)
"""
