"""Quality scores from a compression classifier.

Two zstandard dictionaries are trained, on texts labelled good and on texts labelled bad.  A text is cut into
blocks of ``BLOCK`` bytes, each compressed with either dictionary (in whole texts the text itself would drown the
dictionary's part).  ``(bad - good) / (bad + good)`` of the summed sizes, and their mean against the text's size (repetition
shrinks both alike), go through a logistic fit, which gives the score.

Training sees a bounded sample: of the labelled documents, in order of a hash, the first ``SAMPLE`` for each label and purpose
(dictionary, calibration).  Of a text of over ``PARTS * PART`` characters it sees ``PARTS`` blocks at places drawn by that hash from
the whole of it, so at most 4 * SAMPLE * PARTS * PART characters reach the driver.
Rows whose crc32(doc_id as text) mod ``FOLDS`` is 0 are never in it.  The fit's intercept is moved from the sample's shares of
labels to those of all labelled documents outside that fold, which are counted.  Every document is scored whole, in one
pass without shuffle.

Defined results: a null or empty text scores the fit's intercept; a document labelled twice counts as good if any label
says so; labels other than 0 and 1 count as none; a null doc_id counts as the empty text for the fold and is never
sampled; of rows repeated under one doc_id equal texts are sampled once, different ones each; without sampled documents of
both labels every score is the share of good labels (0.5 without any); rows repeated under one doc_id are scored each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .cluster import checkpointed

FOLDS = 5
THRESHOLD = 0.3
SAMPLE, PARTS, PART = 1000, 8, 2048
DICTIONARY_BYTES, BLOCK, LEVEL = 112 << 10, 512, 3
#: Bytes of a segment and of a fragment that the dictionary builder weighs.
SEGMENT, FRAGMENT = 200, 8
#: Bytes of a training sample.
PIECE = 2048

_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])


def fold(doc_id):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(FOLDS))


def blocks(text: bytes, size: int = BLOCK) -> list[bytes]:
    return [text[at : at + size] for at in range(0, len(text), size)]


def dictionary(texts: list[str]) -> bytes:
    """A trained dictionary; where there are too few samples to train one, the samples themselves."""
    samples = [b for t in texts for b in blocks(t.encode(), PIECE)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=SEGMENT, d=FRAGMENT).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


class Model:
    """Both dictionaries and the fit; or, without labels of one kind, only a share."""

    def __init__(self, good: bytes, bad: bytes, share: float | None = None):
        self.good, self.bad, self.share = good, bad, share
        self.weights = np.zeros(3)

    def compressors(self):
        for data in (self.good, self.bad):
            yield zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(data), write_content_size=False, write_checksum=False, write_dict_id=False)

    def features(self, texts) -> np.ndarray:
        """For each text: 1, the normalised size difference (positive where the good dictionary serves better), and the
        mean compressed share."""
        good, bad = (c.compress for c in self.compressors())
        out = np.zeros((len(texts), 3))
        out[:, 0] = 1.0
        for k, text in enumerate(texts):
            if cut := blocks((text or "").encode()):
                a, b = sum(len(good(x)) for x in cut), sum(len(bad(x)) for x in cut)
                out[k, 1:] = (b - a) / (a + b), (a + b) / (2 * sum(map(len, cut)))
        return out

    def scores(self, texts) -> np.ndarray:
        if self.share is not None:
            return np.full(len(texts), self.share)
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.weights, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic fit on columns of which the first is 1, by Newton's method on standardised columns."""
    centre, scale = x.mean(axis=0), x.std(axis=0)
    centre[0], scale[scale == 0] = 0.0, 1.0
    z, w = (x - centre) / scale, np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-10:
            break
    w = w / scale
    w[0] -= w[1:] @ centre[1:]
    return w


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the bounded sample of labelled documents outside the held-out fold, for the shares of all their labels."""
    known = labels.where((fold(F.col("doc_id")) != 0) & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    texts = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_hash"))
    drawn = checkpointed(texts.distinct().join(known, "doc_id").withColumn("rank", F.xxhash64("doc_id", "text_hash")))
    order = ["rank", "doc_id", "text_hash"]
    sample = reduce(DataFrame.union, (drawn.where(F.col("quality") == q).orderBy(*order).limit(2 * SAMPLE) for q in (0, 1)))
    # At most 4 * SAMPLE rows of numbers: small enough to broadcast at any size of the tables.
    named = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    texts = named.join(F.broadcast(sample), ["doc_id", "text_hash"]).select("quality", "rank", "doc_id", "text_hash", "text")
    texts = texts.mapInArrow(partial(tx.draw_blocks, blocks=PARTS, block=PART), texts.schema).dropDuplicates(order)
    rows = sorted((r.quality, r.rank, r.doc_id, r.text) for r in texts.collect())
    n = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    split = {(q, half): [t for k, t in enumerate(r[3] for r in rows if r[0] == q) if k % 2 == half] for q in (0, 1) for half in (0, 1)}
    if not all(split[q, 0] and split[q, 1] for q in (0, 1)):
        return Model(b"", b"", share=n.get(1, 0) / sum(n.values()) if n else 0.5)
    model = Model(dictionary(split[1, 0]), dictionary(split[0, 0]))
    model.weights = logistic(model.features(split[1, 1] + split[0, 1]), np.repeat([1.0, 0.0], [len(split[1, 1]), len(split[0, 1])]))
    # The sample holds as many of either label as there are, up to its bound; the scores are for all labelled documents.
    model.weights[0] += np.log(n[1] / n[0]) - np.log(len(split[1, 1]) / len(split[0, 1]))
    return model


def _apply(batches, model):
    for part in tx.slices(batches):
        yield tx.batch_of(_SCORES, part.column("doc_id").cast(pa.int64()), part.column("held_out"), model.scores(part.column("text").to_pylist()))


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of all documents."""
    rows = docs.select("doc_id", "text", (fold(F.col("doc_id")) == 0).alias("held_out"))
    scored = rows.mapInArrow(partial(_apply, model=model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def op7_compression_quality(spark, sf_dir):
    docs = tx.read_documents(spark, sf_dir)
    return classify(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
