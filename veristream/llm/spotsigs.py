"""SpotSigs document fingerprints, with DataFrame functions only.

Anchors are the ``N_ANCHORS`` most frequent words of at most ``ANCHOR_LETTERS`` letters of all documents (function words, in
whatever language), counted exactly.  A signature is an anchor with the ``CHAIN`` content words (words that aren't
anchors) that follow it; a document's fingerprint is the set of its signatures' 32-bit hashes, sorted, in
hexadecimal.  A text with no whole signature gets one of all its words.  Likeness is the Jaccard index of two sets.

:func:`near_duplicates` compares all documents: equal sets are one class first; a set is only met by sets of its
own length partition and the next (lengths that a Jaccard index over the threshold allows), through the rarest signatures
that one of them must share (prefix filter), and pairs whose lengths can't reach the threshold are pruned before the sets are
intersected.  Signatures of one set only, most of them, are counted but never joined.

Defined results: a null text is an empty one; rows repeated under one doc_id are separate documents, ordered by text where
neighbours are sought; a null doc_id comes last there; a table with one row has that row for its next; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
from math import ceil, isqrt, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textops as tx
from .cluster import SALTS, checkpointed, spread_join, stored

N_ANCHORS = 64
ANCHOR_LETTERS = 4
CHAIN = 2
THRESHOLD = 0.8

#: A signature that takes more than this part of all places in sets has its sets dealt over several tasks.
OFTEN = 10_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[ \t-\r]+"), lambda w: w != "")


def anchors(docs: DataFrame, n: int = N_ANCHORS, letters: int = ANCHOR_LETTERS) -> list[str]:
    """The n most frequent short words: a list of fixed length."""
    short = F.filter(words_of(F.coalesce("text", F.lit(""))), lambda w: (F.length(w) <= letters))
    words = docs.select(F.explode(short).alias("word")).groupBy("word").count().where(F.col("word").rlike(r"^\p{L}+$"))
    return [r.word for r in words.orderBy(F.desc("count"), "word").limit(n).collect()]


def with_signatures(docs: DataFrame, text: str, name: str, common: list[str], chain: int = CHAIN) -> DataFrame:
    """Add column ``name``: the sorted hashes of the signatures of column ``text``."""
    w, c, a = f"{name}_words", f"{name}_content", f"{name}_anchors"
    common = common or [""]
    spots = F.filter(F.transform(F.col(w), lambda x, i: F.when(x.isin(common), i).otherwise(-1)), lambda i: i >= 0)
    whole = lambda i, j: i - j + (chain - 1) < F.size(c)
    sign = F.transform(F.col(a), lambda i, j: F.when(whole(i, j), F.hash(F.get(w, i), *(F.get(c, i - j + k) for k in range(chain)))))
    return (
        docs.withColumn(w, words_of(F.col(text)))
        .withColumn(c, F.filter(F.col(w), lambda x: ~x.isin(common)))
        .withColumn(a, spots)
        .withColumn(name, F.array_sort(F.array_distinct(F.array_compact(sign))))
        .withColumn(name, F.when(F.size(name) > 0, F.col(name)).otherwise(F.array(F.hash(F.array_join(w, " ")))))
        .drop(w, c, a)
    )


def written(signatures: str) -> Column:
    """The fingerprint: eight hexadecimal digits for each signature."""
    return F.array_join(F.transform(F.col(signatures), lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def likeness(a: str, b: str) -> Column:
    both = F.size(F.array_intersect(F.col(a), F.col(b)))
    return both / (F.size(a) + F.size(b) - both)


def _bucket(bounds: list[float]) -> Column:
    """How many of the sorted bounds a doc_id reaches, in two steps of a square root of them each; -1 without doc_id.  The
    bounds are one constant of the plan, however many they are."""
    step = max(1, ceil(sqrt(len(bounds))))
    rows = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    constant = lambda values, kind: F.from_json(F.lit(json.dumps(values)), kind)
    count = lambda values: F.size(F.filter(values, lambda b: b <= F.col("doc_id")))
    row = count(constant([r[0] for r in rows], "array<double>"))
    within = count(F.get(constant(rows, "array<array<double>>"), row - 1))
    return F.when(F.col("doc_id").isNull(), -1).when(row == 0, 0).otherwise((row - 1) * step + within)


def with_next(docs: DataFrame, make) -> DataFrame:
    """``make(rows)`` with ``next_<c>`` for its columns ``text`` and ``sigs``: those of the next document by descending doc_id; after
    the last comes the first.

    Documents are dealt into buckets of neighbouring ids, as many as a square root of the documents, so no task sees the whole
    order.  A bucket's last document finds its next one, the first of the bucket below, in a copy sent along: one row
    a bucket."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = 1 + isqrt(docs.count())
    bounds = sorted(set(docs.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.5 / n))) if n > 1 else []
    dealt = docs.withColumn("bucket", _bucket(bounds))
    down = Window.orderBy(F.desc("bucket"))
    heads = dealt.groupBy("bucket").agg(F.max("doc_id").alias("head"))
    # Whose last row needs this bucket's first: the bucket above, and for the topmost the lowest.
    lowest = F.min("bucket").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = checkpointed(heads.select(F.col("bucket").alias("of"), "head", F.coalesce(F.lag("bucket").over(down), lowest).alias("goes_to")))
    # At most n + 1 rows of three numbers.
    first = dealt.join(F.broadcast(heads), (F.col("bucket") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("head")))
    first = first.groupBy("goes_to", "doc_id").agg(F.min("text").alias("text"))
    copies = first.select("doc_id", "text", F.col("goes_to").alias("bucket"), F.lit(True).alias("copy"))
    every = make(dealt.withColumn("copy", F.lit(False)).unionByName(copies).repartition("bucket"))
    order = Window.partitionBy("bucket").orderBy("copy", F.col("doc_id").desc_nulls_last(), "text")
    return every.withColumns({f"next_{c}": F.lead(c).over(order) for c in ("text", "sigs")})


def edited(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars``, the fingerprints of each document and of the document edited with its next one's first half, and
    their likenesses."""
    common = anchors(docs)
    rows = with_next(docs, lambda d: with_signatures(d, "text", "sigs", common)).where("NOT copy")
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)))
    rows = with_signatures(rows, "edited", "edited_sigs", common)
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        written("sigs").alias("fingerprint"), written("edited_sigs").alias("edited_fingerprint"),
        likeness("sigs", "edited_sigs").alias("near_edited"), likeness("sigs", "next_sigs").alias("near_next"),
    )


def _signed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents ``doc_id, key`` and the different sets ``key, class_id, sigs``, from one pass that signs the texts."""
    signed = with_signatures(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "sigs", anchors(docs))
    signed = stored(signed.select("doc_id", F.struct(F.xxhash64("sigs").alias("h"), F.hash("sigs").alias("i")).alias("key"), "sigs"))
    sets = stored(signed.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.first("sigs").alias("sigs")))
    return signed.select("doc_id", "key"), sets


def _shared(sets: DataFrame) -> DataFrame:
    """``key, n, sigs`` of the sets that have a signature in common with another one: the size of the whole set, and those signatures,
    rarest first."""
    each = sets.select("key", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    counts = stored(each.groupBy("sig").count().where("count > 1"))
    often = F.col("count") * OFTEN > (sets.agg(F.sum(F.size("sigs"))).first()[0] or 0)
    # At most OFTEN signatures are broadcast: those whose sets are dealt over several tasks.
    salts = F.when(often, SALTS).otherwise(1)
    dealt = each.join(F.broadcast(counts.where(often).select("sig", F.lit(SALTS).alias("salts"))), "sig", "left")
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("key"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    # One row a signature and salt, so a task's part of them is small: hashed, as sorting all places costs more.
    met = dealt.join(counts.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).hint("shuffle_hash"), ["sig", "salt"])
    ranked = met.groupBy("key").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("count", "sig"))).alias("ranked"))
    return ranked.select("key", "n", F.transform("ranked", lambda x: x["sig"]).alias("sigs"))


def _pairs(sets: DataFrame, threshold: float) -> DataFrame:
    shared = stored(_shared(sets))
    # A prefix starts with the signatures that no other set has, which meet nothing; neither do they count in an intersection.
    alone = F.col("n") - F.size("sigs")
    prefix = F.slice("sigs", F.lit(1), F.greatest(F.col("n") - F.ceil(F.col("n") * threshold) + 1 - alone, F.lit(0)).cast("int"))
    part = F.floor(F.log("n") / F.log(F.lit(1 / threshold)))
    probes = checkpointed(shared.select("key", "n", part.alias("part"), F.explode(prefix).alias("sig")))
    shorter = probes.select(F.col("key").alias("a"), F.col("n").alias("m"), "sig", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    longer = probes.withColumnRenamed("key", "b")
    met = shorter.join(longer, ["sig", "part"]).where("a <> b AND (m < n OR (m = n AND a < b))").where(F.col("m") >= threshold * F.col("n"))
    met = met.select("a", "b", "m", "n").distinct()
    side = lambda name, sigs: shared.select(F.col("key").alias(name), F.col("sigs").alias(sigs))
    met = met.join(side("a", "x"), "a").join(side("b", "y"), "b").withColumn("both", F.size(F.array_intersect("x", "y")))
    return met.select("a", "b", (F.col("both") / (F.col("m") + F.col("n") - F.col("both"))).alias("likeness")).where(F.col("likeness") >= threshold)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Classes ``doc_id, key, class_id`` (documents with equal sets; the id is the smallest, null if no member has one), and pairs
    ``a, b, likeness`` of class keys whose likeness reaches the threshold.  A key is 96 bits of hash of the set."""
    signed, sets = _signed(docs)
    return spread_join(signed, sets.select("key", "class_id"), ["key"]).select("doc_id", "key", "class_id"), _pairs(sets, threshold)


def linked(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, class_id, n_links``: each document's class, and to how many others the class is near."""
    signed, sets = _signed(docs)
    ends = _pairs(sets, threshold).select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("n_links"))
    keys = sets.select("key", "class_id").join(ends, "key", "left").select("key", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return spread_join(signed, keys, ["key"]).select("doc_id", "class_id", "n_links")


def op4_spotsigs(spark, sf_dir):
    return edited(tx.read_documents(spark, sf_dir))


def spotsigs_near_duplicates(spark, sf_dir):
    return linked(tx.read_documents(spark, sf_dir))
