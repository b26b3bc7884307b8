"""Language identification in two steps: the family, then the language within it.

Both steps are duels of linear support vector machines, one for each pair of families and one for each pair of languages of
a family; most won duels decide.  Features of a text are the shares of its three-byte grams (within words, with their
borders) and of its whole words, hashed to ``DIM`` numbers; ASCII is lower-cased, and only letters and what isn't ASCII count.

Training sees a bounded sample of rows outside the held-out fold: of the ``LANGUAGES`` most frequent languages the first ``SAMPLE``
different texts each, in order of a hash; of texts over ``BLOCKS * BLOCK`` characters, ``BLOCKS`` blocks at places drawn by that
hash.  Every duel is fitted in a task of its own, on one half of its texts by dual coordinate descent; the other half fits a logistic
curve from margins to probabilities.  The score is the least probability among the winner's duels.  All texts are predicted whole,
in one pass without shuffle.  Weights are whole multiples of a power of two, so that sums don't depend on their order.

Families of languages that ``FAMILIES`` doesn't name are these languages themselves.

Defined results: ``und`` and score 0 where the text is null or has no letter, or where no language is learned; score 1
where only one is; ties of duels go to the larger sum of probabilities, then to the first name; a null doc_id counts as the empty
text for the fold; rows repeated under one doc_id are predicted each, and their equal texts sampled once a language; a text labelled with
two languages is an example of either; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as tx
from .cluster import SALTS, checkpointed
from .compression import logistic

FOLDS, HELD_OUT = 4, 2
LANGUAGES, SAMPLE = 64, 1000
BLOCKS, BLOCK = 16, 512
DIM = 1 << 12
#: Penalty of a margin's violation, and passes over the examples.
PENALTY, PASSES = 10.0, 30
#: Weights are multiples of 1 / UNIT.
UNIT = 1 << 16

#: Families of some languages.
FAMILIES = {
    "germanic": "da de en nl no sv",
    "romance": "ca es fr it pt ro",
    "slavic": "bg cs hr pl ru sk sr uk",
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}

#: Bytes between words: ASCII other than a-z (texts are lower-cased before).
BREAK = np.ones(256, bool)
BREAK[0x61:0x7B] = BREAK[0x80:] = False
#: Words, and rows, that are counted at once.
STRETCH, ROWS = 1 << 15, 128

_FIT = pa.schema([("duel", pa.int64()), ("weights", pa.binary()), ("bias", pa.float64()), ("slope", pa.float64()), ("level", pa.float64())])
_PREDICTED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def tally(texts: pa.Array) -> np.ndarray:
    """How often each text has each feature."""
    data, offsets = tx.utf8(texts)
    data = tx.LOWER[data]
    words = tx.Words(data, offsets, BREAK)
    rows = len(offsets) - 1
    counts = np.zeros(rows * DIM)
    for begin in range(0, len(words), STRETCH):
        part = slice(begin, begin + STRETCH)
        starts, ends, row = words.starts[part].astype(np.int64), words.ends[part].astype(np.int64), words.row[part].astype(np.int64)
        # Of each word as many grams as it has bytes: the first and the last one hold a border.
        length = ends - starts
        at = tx.ranges(starts, length)
        before, after = data[np.maximum(at - 1, 0)].astype(np.uint64), data[np.minimum(at + 1, len(data) - 1)].astype(np.uint64)
        last = np.cumsum(length) - 1
        before[last - length + 1] = after[last] = 0x20
        gram = tx.mix(before << np.uint64(16) | data[at].astype(np.uint64) << np.uint64(8) | after)
        feature = np.concatenate([np.repeat(row, length), row]) * DIM
        feature += (np.concatenate([gram, tx.word_hashes(data, starts, ends)]) % np.uint64(DIM)).astype(np.int64)
        counts += np.bincount(feature, minlength=len(counts))
    return counts.reshape(rows, DIM)


class Duel(NamedTuple):
    """First against second: two families, or (within ``family``) two languages."""

    family: str | None
    first: str
    second: str


def duels(langs: list[str], family_of: dict[str, str]) -> list[Duel]:
    families: dict[str, list[str]] = {}
    for lang in sorted(langs):
        families.setdefault(family_of.get(lang, lang), []).append(lang)
    out = [Duel(None, a, b) for a, b in combinations(sorted(families), 2)]
    return out + [Duel(family, a, b) for family, members in sorted(families.items()) for a, b in combinations(members, 2)]


class Model:
    """The duels of the learned languages: weights, one column each, and the curves of their margins."""

    def __init__(self, langs: list[str], family_of: dict[str, str], fits: list[dict]):
        self.duels = duels(langs, family_of)
        self.families: dict[str, list[str]] = {}
        for lang in sorted(langs):
            self.families.setdefault(family_of.get(lang, lang), []).append(lang)
        by_duel = {f["duel"]: f for f in fits}
        fits = [by_duel[k] for k in range(len(self.duels))]
        self.weights = np.array([np.frombuffer(f["weights"], np.float64) for f in fits]).reshape(len(fits), DIM).T
        self.bias, self.slope, self.level = (np.array([f[c] for f in fits]) for c in ("bias", "slope", "level"))

    def odds(self, texts: pa.Array) -> np.ndarray:
        """The probability that the first wins, for each text and duel."""
        counts = tally(texts)
        margin = counts @ self.weights / np.maximum(1, counts.sum(axis=1))[:, None] + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.level, -40, 40)))

    def winner(self, odds: np.ndarray, family: str | None, sides: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: which of the sides wins, and the least probability among its duels."""
        place = {side: k for k, side in enumerate(sides)}
        won, total, least = np.zeros((len(odds), len(sides))), np.zeros((len(odds), len(sides))), np.ones((len(odds), len(sides)))
        for k, duel in enumerate(self.duels):
            if duel.family == family:
                for side, p in ((place[duel.first], odds[:, k]), (place[duel.second], 1 - odds[:, k])):
                    won[:, side] += p > 0.5
                    total[:, side] += p
                    least[:, side] = np.minimum(least[:, side], p)
        best = np.argmax(won * (len(sides) + 1) + total, axis=1)
        return best, least[np.arange(len(odds)), best]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        if not self.families:
            return ["und"] * len(texts), np.zeros(len(texts))
        odds = self.odds(texts)
        names = list(self.families)
        family, score = self.winner(odds, None, names)
        langs = np.empty(len(texts), object)
        for k, name in enumerate(names):
            mine = np.flatnonzero(family == k)
            lang, least = self.winner(odds[mine], name, self.families[name])
            langs[mine] = np.array(self.families[name], object)[lang]
            score[mine] = np.minimum(score[mine], least)
        letters = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
        return [lang if some else "und" for lang, some in zip(langs.tolist(), letters.tolist(), strict=True)], np.where(letters, score, 0.0)


def vector_machine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a linear support vector machine (hinge loss) by dual coordinate descent."""
    w, alpha, norm = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(axis=1)
    draw = np.random.default_rng(0)
    for _ in range(PASSES):
        for k in draw.permutation(len(x)).tolist():
            new = min(max(alpha[k] - (y[k] * (x[k] @ w) - 1) / norm[k], 0.0), PENALTY)
            if new != alpha[k]:
                w += (new - alpha[k]) * y[k] * x[k]
                alpha[k] = new
    return w


def fit(table: pa.Table) -> pa.Table:
    """One duel, of rows ``duel, y, rank, text``."""
    table = table.sort_by([("y", "ascending"), ("rank", "ascending")])
    y = table["y"].to_numpy().astype(float)
    # Every other text of either side fits the machine, the rest its curve; a single text must serve for both.
    fits = np.concatenate([np.arange((y == side).sum()) % 2 == 0 for side in (-1, 1)])
    both = all((~fits & (y == side)).any() for side in (-1, 1))
    texts = table["text"].combine_chunks()
    share = np.empty((len(texts), DIM), np.float32)
    for k in range(0, len(texts), ROWS):
        counts = tally(texts.slice(k, ROWS))
        share[k : k + ROWS] = counts / np.maximum(1, counts.sum(axis=1))[:, None]
    # Rare features weigh more, and one more stands for the bias.
    scale = 1 / np.sqrt(share[fits].mean(axis=0, dtype=float) + 1e-5)
    x = np.concatenate([share[fits] * scale, np.ones((fits.sum(), 1))], axis=1)
    w = vector_machine(x, y[fits])
    weights, bias = np.round(w[:-1] * scale * UNIT) / UNIT, w[-1]
    rest = ~fits if both else fits
    margin = share[rest] @ weights + bias
    level, slope = logistic(np.stack([np.ones(len(margin)), margin], axis=1), (y[rest] > 0).astype(float))
    return pa.table([table["duel"][:1], pa.array([weights.tobytes()], pa.binary()), [bias], [slope], [level]], schema=_FIT)


def fold(doc_id):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(FOLDS))


def first_of(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` rows of each key by rank, first within parts of it."""
    rows = rows.withColumn("_salt", F.pmod("rank", F.lit(SALTS)))
    for keys in ([key, "_salt"], [key]):
        rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy("rank", "text_hash", "doc_id"))).where(F.col("_at") <= n)
    return rows.drop("_salt", "_at")


def train(docs: DataFrame, family_of: dict[str, str] | None = None) -> Model:
    """Fit on a bounded sample of the documents outside the held-out fold that have a language and a text."""
    spark, family_of = docs.sparkSession, FAMILY_OF if family_of is None else family_of
    named = docs.select("doc_id", "lang", "text", F.xxhash64("text").alias("text_hash"))
    known = named.where((fold(F.col("doc_id")) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # Copies count once.
    known = checkpointed(known.groupBy("lang", "text_hash").agg(F.min("doc_id").alias("doc_id")).withColumn("rank", F.xxhash64("text_hash", F.lit("sample"))))
    top = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    langs = [r.lang for r in top]
    planned = duels(langs, family_of)
    if not planned:
        return Model(langs, family_of, [])
    sample = first_of(known.where(F.col("lang").isin(langs)), "lang", SAMPLE)
    # At most LANGUAGES * SAMPLE rows of numbers: small enough to broadcast at any size of the tables.  A null doc_id finds its text too.
    pick = F.broadcast(sample.withColumnsRenamed({"doc_id": "_id", "lang": "_lang", "text_hash": "_hash"}))
    texts = named.join(pick, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang")) & (F.col("text_hash") == F.col("_hash")))
    texts = texts.dropDuplicates(["lang", "text_hash"]).select("doc_id", "lang", "text_hash", "rank", "text")
    texts = checkpointed(texts.mapInArrow(partial(tx.draw_blocks, blocks=BLOCKS, block=BLOCK), texts.schema).withColumn("family", F.col("lang")).replace(family_of, subset="family"))
    sides = [(k, d.first, 1, d.family is None) for k, d in enumerate(planned)] + [(k, d.second, -1, d.family is None) for k, d in enumerate(planned)]
    sides = F.broadcast(spark.createDataFrame(sides, "duel long, side string, y int, of_families boolean"))
    by_lang = texts.join(sides.where("NOT of_families"), F.col("lang") == F.col("side"))
    by_family = first_of(texts, "family", SAMPLE).join(sides.where("of_families"), F.col("family") == F.col("side"))
    examples = by_lang.union(by_family).select("duel", "y", "rank", "text")
    fits = examples.groupBy("duel").applyInArrow(fit, "duel long, weights binary, bias double, slope double, level double").collect()
    return Model(langs, family_of, [f.asDict() for f in fits])


def _apply(batches, shared):
    model = shared.value
    for part in tx.slices(batches, limit=1 << 19):
        for k in range(0, part.num_rows, ROWS):
            some = part.slice(k, ROWS)
            langs, score = model.predict(some.column("text"))
            yield tx.batch_of(_PREDICTED, some.column("doc_id").cast(pa.int64()), some.column("held_out"), langs, score)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", "text", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"))
    return rows.mapInArrow(partial(_apply, shared=shared), "doc_id long, held_out boolean, lang_pred string, score double")


def op12_language_families(spark, sf_dir):
    docs = tx.read_documents(spark, sf_dir)
    return identify(docs, train(docs))
