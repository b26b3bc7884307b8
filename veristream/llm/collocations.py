"""Phrase collocations of each language.

1. *Explode.*  Every contiguous run of 1 to ``max_n`` words of a piece is one row ``lang, phrase``; the empty phrase stands for
   each word, so that its count is the language's number of words.  A task adds equal rows of a stretch of text up before they leave it.
2. *Aggregate.*  Rows travel packed, one compressed Arrow table for each stretch and bucket of phrases: 0.5 GB of text has
   190 million different rows, which as plain ones would take some 4.5 GB of shuffle.  A bucket unpacks and hash-aggregates its
   rows; phrases under ``min_count`` go, as no part of a candidate can be among them.
3. *Score.*  Each cut of a candidate is joined with the counts of both its parts, and scored in Decimal.
4. *Anti-join.*  A candidate goes if one of its one-word extensions is frequent enough.  That covers longer ones: what lies
   between is at least as frequent as the longer one, so a candidate too.
5. *Rank.*  The first ``top`` of each language, first within ``SALTS`` parts of it, then among what these leave.

A word that stands in very many phrases is a hot key of the joins, which deal it over several tasks.  Phrases are told apart by
their bytes; hashes only choose buckets.

Defined results: a null text has no words; a null language counts as ``und``; rows repeated under one doc_id count each;
ties of rank are broken by the phrase's bytes; a very long text is counted in stretches of ``STRETCH`` words; an empty table, or
one without frequent phrases, gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as tx
from .cluster import SALTS, spread_join, stored

MAX_N, MIN_COUNT, COVER_PERCENT, TOP = 3, 10, 50, 2000
SCORE_UNIT = 1_000_000

#: Bytes that end a piece, and those that end a word.
PIECE_END = np.zeros(256, bool)
PIECE_END[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WORD_END = PIECE_END.copy()
WORD_END[[0x20, 0x09]] = True

#: Text of a bucket, on average, and words that a task counts at once.
BUCKET_BYTES = 4 << 20
STRETCH = 1 << 18

_PACKED = pa.schema([("bucket", pa.int64()), ("rows", pa.binary())])
_COUNTED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("f", pa.int64())])
COUNTED = "lang string, phrase string, size int, f long"
_OPTIONS = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))


def _packed(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=_OPTIONS) as writer:
        writer.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _phrases(distinct: pa.Array, codes: np.ndarray, at: np.ndarray, size: int) -> pa.Array:
    """The phrases of ``size`` words that begin at the given words."""
    if not size:
        return pa.array([""] * len(at), pa.large_string())
    words = [distinct.take(pa.array(codes[at + k])) for k in range(size)]
    return pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string())) if size > 1 else words[0]


def grams(langs: pa.Array, texts: pa.Array, max_n: int, buckets: int):
    """The counted rows of a slice: a table and the bucket of each of its rows, by stretches."""
    data, offsets = tx.utf8(texts)
    data = tx.LOWER[data]
    words = tx.Words(data, offsets, WORD_END)
    if not len(words):
        return
    codes, distinct = words.codes()
    piece = np.cumsum(PIECE_END[data], dtype=np.int32)[words.starts]
    ends = np.cumsum(pc.binary_length(distinct).to_numpy())
    hashes = tx.word_hashes(np.frombuffer(b"".join(distinct.to_pylist()), np.uint8), np.concatenate([[0], ends[:-1]]), ends)
    distinct, codes = distinct.cast(pa.large_string()), codes.astype(np.int64)
    names = langs.dictionary_encode()
    lang = names.indices.to_numpy()[words.row].astype(np.int64)
    names = names.dictionary
    lang_hash = np.array([xxhash.xxh3_64_intdigest(name) for name in names.to_pylist()], np.uint64)
    for begin in range(0, len(words), STRETCH):
        # Words behind the stretch only end phrases that begin in it.
        end = min(begin + STRETCH, len(words))
        part = slice(begin, min(end + max_n - 1, len(words)))
        code, row, apart = codes[part], words.row[part], piece[part]
        # Of each start: the number of its phrase, and its hash.  A phrase is one that is a word shorter, and a word.
        starts = np.arange(end - begin)
        ids, hashed, out = lang[begin:end], lang_hash[lang[begin:end]], []
        for size in range(max_n + 1):
            if size:
                starts, ids, hashed = (x[starts + size <= len(code)] for x in (starts, ids, hashed))
                last = starts + size - 1
                same = (row[starts] == row[last]) & (apart[starts] == apart[last])
                starts, last = starts[same], code[last[same]]
                ids, hashed = ids[same] * len(distinct) + last, tx.mix(hashed[same] * np.uint64(0x9E3779B97F4A7C15) + hashes[last])
            _, first, ids, n = np.unique(ids, return_index=True, return_inverse=True, return_counts=True)
            at = starts[first]
            table = [names.take(pa.array(lang[begin + at])), _phrases(distinct, code, at, size), pa.array(np.full(len(at), size, np.int32)), pa.array(n)]
            out.append((hashed[first] % np.uint64(buckets), pa.table(table, names=_COUNTED.names)))
        yield np.concatenate([b for b, _ in out]).astype(np.int64), pa.concat_tables([t for _, t in out])


def _explode(batches, max_n: int, buckets: int):
    for part in tx.slices(batches):
        for bucket, table in grams(part.column("lang"), part.column("text"), max_n, buckets):
            order = np.argsort(bucket, kind="stable")
            table, bucket = table.take(pa.array(order)).combine_chunks(), bucket[order]
            at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            rows = [_packed(table.slice(i, j - i).to_batches()[0]) for i, j in zip(at, [*at[1:], len(bucket)], strict=True)]
            yield tx.batch_of(_PACKED, bucket[at], rows)


def _aggregate(table: pa.Table, min_count: int) -> pa.Table:
    rows = pa.concat_tables([pa.ipc.open_stream(b.as_buffer()).read_all() for b in table.column("rows")])
    summed = rows.group_by(["lang", "phrase", "size"]).aggregate([("f", "sum")])
    summed = summed.filter(pc.or_(pc.greater_equal(summed["f_sum"], min_count), pc.equal(summed["size"], 0)))
    return pa.table([summed[n] for n in ("lang", "phrase", "size", "f_sum")], names=_COUNTED.names).cast(_COUNTED)


def phrase_counts(docs: DataFrame, max_n: int = MAX_N, min_count: int = MIN_COUNT) -> DataFrame:
    """``lang, phrase, size, f`` of all phrases of up to ``max_n`` words found ``min_count`` times or more in a language, and
    of the empty phrase, whose count is the number of words."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    packed = rows.mapInArrow(partial(_explode, max_n=max_n, buckets=1 + total // BUCKET_BYTES), "bucket long, rows binary")
    return packed.groupBy("bucket").applyInArrow(lambda t: _aggregate(t, min_count), COUNTED)


def collocations(docs: DataFrame, max_n: int = MAX_N, min_count: int = MIN_COUNT, cover_percent: int = COVER_PERCENT, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the first ``top`` phrases of two words or more of each language."""
    counts = stored(phrase_counts(docs, max_n, min_count))
    found = counts.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"))

    parts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    parts = parts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    of = counts.where("size > 0")
    parts = spread_join(parts, of.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"], F.col("phrase"))
    parts = spread_join(parts, of.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"], F.col("phrase"))
    # Up to 36 digits; each part is at least as frequent as the whole, so a score is SCORE_UNIT at most.
    square = F.lit(SCORE_UNIT).cast("decimal(7,0)") * F.col("a").cast("decimal(15,0)") * F.col("a").cast("decimal(15,0)")
    parts = parts.withColumn("square", square.cast("decimal(38,0)")).withColumn("parts", F.col("l").cast("decimal(18,0)") * F.col("r").cast("decimal(18,0)"))
    parts = parts.withColumn("score", F.expr("square div parts"))
    scored = parts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    inner = F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring(phrase, length(substring_index(phrase, ' ', 1)) + 2)"))
    longer = found.where("size > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    covered = (scored["lang"] == longer["lang"]) & (scored["phrase"] == longer["phrase"]) & (100 * longer["longer"] >= cover_percent * scored["a"])
    left = scored.join(longer, covered, "left_anti")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = left.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    for keys in (["lang", "_salt"], ["lang"]):
        salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    words = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return salted.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir):
    return collocations(tx.read_documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM d),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (
  SELECT lang, 1 AS size, ws[i] AS phrase FROM i UNION ALL SELECT lang, 2, ws[i] || ' ' || ws[i + 1] FROM i WHERE i + 1 <= len(ws)
  UNION ALL SELECT lang, 3, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FROM i WHERE i + 2 <= len(ws)
),
c AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::bigint AS n FROM c WHERE size = 1 GROUP BY lang),
a AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS ws, f AS a FROM c WHERE size > 1 AND f >= 10),
u AS (SELECT *, unnest(range(1, size)) AS k FROM a),
k AS (SELECT lang, size, phrase, a, k, array_to_string(ws[1:k], ' ') AS first, array_to_string(ws[k + 1:], ' ') AS rest FROM u),
q AS (SELECT lang, phrase, f FROM c WHERE f >= 10),
s AS (
  SELECT k.lang, k.size, k.phrase, k.a, k.k, l.f AS l, r.f AS r, (1000000::hugeint * k.a * k.a) // (l.f::hugeint * r.f) AS score
  FROM k JOIN q AS l ON l.lang = k.lang AND l.phrase = k.first JOIN q AS r ON r.lang = k.lang AND r.phrase = k.rest
),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
x AS (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a FROM a WHERE size = 3),
m AS (SELECT lang, phrase, max(a) AS longer FROM x GROUP BY ALL),
o AS (SELECT b.* FROM b LEFT JOIN m USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a),
t AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::bigint AS score FROM o JOIN n USING (lang))
SELECT * FROM t WHERE rank <= 2000
"""
