"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a target number of words.  A document should be taken target / source_size times: the whole part
is certain, the fraction is a probability.  Pivotal rounding makes the fractions integral: of two documents, a random
choice moves words from one to the other until one of them is at 0 or 1; the odds keep every document's
expectation, and the words a pair takes stay the same, so a source's total can't drift.  A source is split into
buckets of about ``BUCKET_DOCS`` documents by hash of the doc_id and the text.  Each leaves at most one undecided document; these
meet, ``FAN_IN`` buckets at a time, in the next round of the reduction tree, up to one document a source,
which a last draw decides.  A source misses its target by less than one document.

Draws are seeded by source, bucket and round, and documents are paired in a fixed order, so reruns agree.

Defined results: a null text has size 0; a document of size 0 takes the whole part of its copies; a null source is a
source of its own, the last; a null doc_id counts as -1 where documents are ordered; rows repeated under one doc_id
are separate documents; an empty table gives an empty result; other columns are ignored by :func:`mixture` and kept
by :func:`mixed`.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as tx
from .cluster import checkpointed, numbered

#: Weights of the sources in order, repeating; the mix as a share of all words; most copies of a source.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = 20240229
BUCKET_DOCS = 4096
FAN_IN = 256
SALTS = 32

_SIZES = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("size", pa.int64()), ("text_hash", pa.int64())])
_UNITS = "source string, source_key string, bucket long, doc_id long, text_hash long, size long, source_size long, target double, rest double, copies long"


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, text_hash``: the number of words of each document."""

    def run(batches):
        for part in tx.slices(batches):
            yield tx.batch_of(_SIZES, part.column("doc_id").cast(pa.int64()), part.column("source").cast(pa.string()), tx.Words(*tx.utf8(part.column("text"))).counts, part.column("text_hash"))

    return docs.select("doc_id", "source", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, source string, size long, text_hash long")


def targets(sized: DataFrame) -> DataFrame:
    """``source, source_size, n_docs, target`` of each source.  Only totals reach the driver."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    per = numbered(per, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    per = checkpointed(per.select("source", "source_size", "n_docs", weight.cast("double").alias("weight")))
    words, weight = per.agg(F.sum("source_size"), F.sum("weight")).first()
    words, level = SHARE * (words or 0), 0.0
    left, open_weight = words, weight or 0.0
    while open_weight and left / open_weight > level:
        level = left / open_weight
        full = F.col("weight") * level > MOST * F.col("source_size")
        capped, open_weight = per.agg(F.sum(F.when(full, MOST * F.col("source_size")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        left = words - capped
    return per.select("source", "source_size", "n_docs", F.least(F.col("weight") * level, (MOST * F.col("source_size")).cast("double")).alias("target"))


def pivot(size: np.ndarray, rest: np.ndarray, draw: np.random.Generator) -> tuple[np.ndarray, int]:
    """Round the probabilities ``rest`` one pair after the other.  Returns them with all but one integral, and the
    place of that one (-1: none)."""
    rest, held = rest.astype(float).copy(), -1
    draws = draw.random(len(rest))
    for k in range(len(rest)):
        if not 0 < rest[k] < 1 or not size[k]:
            continue
        if held < 0:
            held = k
            continue
        a, b, p, q = float(size[held]), float(size[k]), rest[held], rest[k]
        up, down = min((1 - p) * a, q * b), min(p * a, (1 - q) * b)  # words that may move to, and from, the one held
        if draws[k] * (up + down) < down:
            rest[held], rest[k] = (1.0, q - up / b) if (1 - p) * a <= q * b else (p + up / a, 0.0)
        else:
            rest[held], rest[k] = (0.0, q + down / b) if p * a <= (1 - q) * b else (p - down / a, 1.0)
        if not 1e-12 < rest[held] < 1 - 1e-12:
            rest[held] = round(rest[held])
            held = k
        if not 1e-12 < rest[k] < 1 - 1e-12:
            rest[k] = round(rest[k])
            held = -1 if held == k else held
    return rest, held


def _decide(key, table, level: int, last: bool):
    """One bucket: what is decided gets its copies, the one left keeps a null."""
    name, bucket = key[0].as_py(), key[1].as_py()
    ids = pc.fill_null(table.column("doc_id"), -1)
    order = np.lexsort((table.column("text_hash").to_numpy(), ids.to_numpy(), -table.column("size").to_numpy()))
    table = table.take(pa.array(order))
    size, wish = table.column("size").to_numpy(), table.column("rest").to_numpy()
    draw = np.random.default_rng([SEED, level, zlib.crc32(name.encode()), bucket])
    rest, held = pivot(size, wish - np.floor(wish), draw)
    if last and held >= 0:
        rest[held], held = float(draw.random() < rest[held]), -1
    whole = np.floor(wish).astype(np.int64)
    copies = whole + np.where(size > 0, np.rint(rest), 0).astype(np.int64)
    undecided = np.arange(len(size)) == held
    at = {n: table.column(n) for n in table.column_names}
    at["rest"] = pa.array(whole + rest)
    at["copies"] = pa.array(copies, pa.int64(), mask=undecided)
    return pa.table(at).select(table.column_names)


def _decider(level: int, last: bool):
    return lambda key, table: _decide(key, table, level, last)


def mixture(docs: DataFrame) -> DataFrame:
    """``doc_id, source, text_hash, size, source_size, target, copies, taken`` of each document."""
    sized = checkpointed(sizes(docs))
    salted = sized.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)))
    # Every source's row goes to each salt: one source may hold a third of all documents.
    per = targets(sized).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))).withColumnRenamed("source", "name")
    units = salted.join(per, F.col("source").eqNullSafe(F.col("name")) & (salted["salt"] == per["salt"]))
    units = units.select(
        "source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source_key"),
        F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "text_hash"), F.ceil(F.col("n_docs") / BUCKET_DOCS)).alias("bucket"),
        "doc_id", "text_hash", "size", "source_size", "target",
        F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)).alias("rest"), F.lit(None).cast("long").alias("copies"),
    )
    buckets = 1 + (sized.groupBy("source").count().agg(F.max("count")).first()[0] or 0) // BUCKET_DOCS
    # A document without words has nothing to round; there may be very many of them, all alike.
    level, done = 0, units.where("size = 0").withColumn("copies", F.floor("rest").cast("long"))
    units = units.where("size > 0")
    while True:
        last = buckets <= 1
        decided = checkpointed(units.groupBy("source_key", "bucket").applyInArrow(_decider(level, last), _UNITS))
        ready = decided.where("copies IS NOT NULL")
        done = done.union(ready)
        if last:
            break
        units = decided.where("copies IS NULL").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
        buckets, level = -(-buckets // FAN_IN), level + 1
    return done.select("doc_id", "source", "text_hash", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents, each as often as the mix takes it.  The texts are shuffled once: rows of one doc_id and text fall
    together, and the n-th of them takes the n-th of their copies."""
    key = ["_id", "_unnamed", "_hash"]
    named = lambda c: [F.coalesce(c, F.lit(0)).alias("_id"), c.isNull().alias("_unnamed")]
    every = F.struct(*(docs[c] for c in docs.columns))
    mine = docs.select(every.alias("_doc"), *named(docs["doc_id"].cast("long")), F.xxhash64(docs["text"]).alias("_hash"))
    taken = mixture(docs).select(*named(F.col("doc_id")), F.col("text_hash").alias("_hash"), "copies")
    # A list for each doc_id and text: one entry but for repeated rows.
    taken = taken.groupBy(*key).agg(F.sort_array(F.collect_list("copies"), asc=False).alias("_copies"))
    number = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("_doc")))
    rows = mine.join(taken, key).withColumn("_n", number).withColumn("_copies", F.get("_copies", F.col("_n") - 1)).where("_copies > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*(F.col(f"_doc.`{c}`").alias(c) for c in docs.columns))


def op6_pivotal_mixing(spark, sf_dir):
    return mixture(tx.read_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
