"""Language-model scores from a probabilistic suffix tree.

Tokens are lower-cased words and one end a text.  Contexts are up to ``DEPTH`` words long, rare ones too: every context and
every next word that occur ``LEAST`` times in training are counted, at any size of the corpus.  A context stays as a state
if it passes a divergence test: twice the log-likelihood ratio of its next-word distribution against that of its suffix
exceeds the chi-square's mean by ``DEVIATIONS`` standard deviations (next words that occur less often are one cell, and
only the others count as degrees of freedom).  A state's distribution is its counts, smoothed: the share of types
among what followed it (Witten and Bell) goes to the longest suffix that stays; the root is add-one smoothed.  A token
is scored in the longest suffix of what precedes it that is a state.

The tree is never in one place.  Documents are packed into groups of about ``GROUP_BYTES`` of text, longer texts in
several pieces that overlap by ``DEPTH`` words, and the groups are written to the shared folder.  A *gram* is a run of words by
its hash; its last word is the next word, those before are the context.  Words have 64 bits of hash, longer grams
``SPARE_BITS`` more than the corpus needs to number its words, so at any size a gram meets another's hash once in 2^SPARE_BITS.
Its total is then that of both.  A gram that occurs more often than its own parts, and a context whose words occur more often than it,
show that: they are left out, so a probability is always above 0 and at most 1.

1. *Count.*  A group sends its distinct grams of each length with their counts, as sorted, delta-coded, compressed arrays, to
   buckets by hash.  A bucket adds up and tells each group the totals of its grams, and one group for each gram that it owns it.
2. *Test.*  A group knows the counts that a gram's divergence needs, as all parts of a gram that it holds are in the group too.
   The owner of a gram adds it to its context's sums; groups send these sums, or only the question, to buckets by context,
   which test the context and tell each group that asked.  A context that is always followed by one word needs no question
   where that word is seen.
3. *Score.*  A group scores its documents with the totals and states that it was told.

A word or context that occurs everywhere is one entry a group, so no key is hot.  Sums are whole numbers, so the order in
which they are added changes nothing.

Defined results: a null text has no words, only its end; a null doc_id counts as the empty text for the fold; rows repeated
under one doc_id are scored each; without training documents every probability of the base is 1; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .cluster import stored
from .packed import Route, Rows, ddl, table_of, unpack

FOLDS, HELD_OUT = 7, 2
DEPTH = 2
DEVIATIONS = 4.0
#: Contexts, and words after them, are counted from this many occurrences on.
LEAST = 2
#: Text of a group, grams of a bucket.
GROUP_BYTES = 6 << 20
BUCKET_KEYS = 2 << 20
#: Words are about this many bytes; only sizes of buckets depend on it.
WORD_BYTES = 6
SPARE_BITS = 16
#: Gains and shares are added as whole numbers of these parts.
GAIN_PARTS, SHARE_PARTS = 16, 1 << 24
#: The end's hash stands for no word.
END_HASH = np.uint64(0x9E3779B97F4A7C15)

_GROUPS = pa.schema([("g", pa.int64()), ("docs", pa.binary())])
_DOCS = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lead", pa.int64()), ("last", pa.bool_()), ("text", pa.large_string())])
_SCORES = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
_SPACE = re.compile(rb"[ \t-\r]")


def pieces(text: bytes, size: int):
    """Cut a text at white space: how many words of the piece before come first, the text of these and the piece, and
    whether it is the last."""
    at, before = 0, []
    while True:
        space = _SPACE.search(text, at + size) if len(text) - at > size else None
        end = space.start() if space else len(text)
        yield len(before), b" ".join([*before, text[at:end]]) if before else text[at:end], space is None
        if space is None:
            return
        before = [*before, *text[at:end].rsplit(None, DEPTH)[-DEPTH:]][-DEPTH:]
        at = end


def _pack_groups(batches, size):
    """Documents as groups: one row each, of a compressed table."""
    number = TaskContext.get().partitionId() << 40
    press = zstandard.ZstdCompressor(level=3)

    def group(rows):
        nonlocal number
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _DOCS) as out:
            out.write_batch(tx.batch_of(_DOCS, *rows))
        number += 1
        return tx.batch_of(_GROUPS, [number], [press.compress(sink.getvalue())])

    uid = number
    for part in tx.slices(batches, limit=size):
        ids, held, texts = part.column("doc_id").cast(pa.int64()), part.column("held_out"), part.column("text")
        uids = pa.array(np.arange(uid, uid + part.num_rows))
        uid += part.num_rows
        if part.num_rows == 1 and texts[0].is_valid and len(raw := texts[0].as_buffer().to_pybytes()) > size:
            for lead, piece, last in pieces(raw, size):
                yield group([uids, ids, held, [lead], [last], pa.array([piece.decode()], pa.large_string())])
        else:
            n = part.num_rows
            yield group([uids, ids, held, np.zeros(n, np.int64), np.ones(n, bool), texts.cast(pa.large_string())])


class Group:
    """The tokens of a group's documents and its distinct grams."""

    def __init__(self, table: pa.Table | pa.RecordBatch, bits: int):
        raw = zstandard.ZstdDecompressor().decompress(table.column("docs")[0].as_py())
        self.docs = pa.ipc.open_stream(raw).read_all().combine_chunks()
        data, offsets = tx.utf8(self.docs.column("text"))
        data = tx.LOWER[data]
        words = tx.Words(data, offsets)
        lead, last, held = (self.docs.column(n).to_numpy() for n in ("lead", "last", "held_out"))
        counts = words.counts + last
        self.row = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        first = np.cumsum(counts) - counts
        self.place = (np.arange(len(self.row)) - first[self.row]).astype(np.int32)
        token = np.full(len(self.row), END_HASH)
        token[first[words.row] + np.arange(len(words)) - words.bounds[words.row]] = words.digests()[0]
        #: Tokens of the piece itself, and those of them that are learned from.
        self.own = self.place >= lead[self.row]
        learned = self.own & ~held[self.row]
        #: For each length, the sorted distinct grams, at each position the number of the one that ends there (-1: none), and counts.
        self.grams, self.at, self.counts = [], [], []
        for length in range(1, DEPTH + 2):
            if length > 1:
                token = tx.mix(np.concatenate([token[:1], token[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + token)
            where = np.flatnonzero(self.place >= length - 1)
            grams, number = np.unique(token[where] >> np.uint64(64 - bits if length > 1 else 0), return_inverse=True)
            at = np.full(len(token), -1, np.int32)
            at[where] = number
            self.grams.append(grams)
            self.at.append(at)
            self.counts.append(np.bincount(number[learned[where]], minlength=len(grams)))

    def follows(self, length: int) -> tuple[np.ndarray, ...]:
        """For each distinct gram of ``length`` + 1 words: the numbers of its context, its suffix, and the suffix's context
        (0 where that is empty)."""
        where = np.flatnonzero(self.at[length] >= 0)
        one = np.zeros(len(self.grams[length]), np.int64)
        one[self.at[length][where]] = where
        inner = self.at[length - 2][one - 1] if length > 1 else np.zeros(len(one), np.int32)
        return self.at[length - 1][one - 1], self.at[length - 1][one], inner


def stays(n, seen, kinds, gain, share) -> np.ndarray:
    """The divergence test of contexts: occurrences, those followed by counted words, the number of these words, their gains
    and the share that the suffix gives them."""
    rest = n - seen
    other = np.maximum(1 - share / SHARE_PARTS, 1e-12)
    more = np.where(rest > 0, 2 * rest * np.log(np.maximum(rest, 1) / (np.maximum(n, 1) * other)), 0.0)
    return (kinds > 0) & (rest >= 0) & (gain / GAIN_PARTS + more > kinds + DEVIATIONS * np.sqrt(2.0 * kinds))


class Steps:
    """The functions that run inside tasks."""

    def __init__(self, buckets: int, bits: int, n_tokens: int = 0, n_kinds: int = 0, fan: int | None = None):
        self.bits, self.n_tokens, self.n_kinds = bits, n_tokens, n_kinds
        #: Grams by their number of words less one, and contexts by their number of words.
        lengths = [64, *[bits] * DEPTH]
        self.grams = Route(buckets, lengths, [("counts", np.uint32, 1)], [("totals", np.uint64, 1), ("mine", np.uint8, 1)], fan)
        self.contexts = Route(buckets, [64, *lengths[:-1]], [("sums", np.int64, 5)], [("seen", np.int64, 1), ("kinds", np.int64, 1)], fan)
        self.counted = pa.schema([*self.grams.back, ("tokens", pa.int64()), ("words", pa.int64())])

    def ask(self, batches):
        for batch in batches:
            for row in (batch.slice(i, 1) for i in range(batch.num_rows)):
                group, rows = Group(row, self.bits), []
                for length, (grams, counts) in enumerate(zip(group.grams, group.counts, strict=True)):
                    rows += self.grams.sent(row.column("g")[0].as_py(), length, grams, [counts.astype(np.uint32)])
                yield from table_of(self.grams.there, rows).to_batches()

    def count(self, key, table):
        """The totals of a bucket's grams, told to each group in the order of its own; the first group that sent a gram owns it.
        One row more has the bucket's tokens and distinct words."""
        rows, bucket = Rows(table, self.grams.payload), key[0].as_py()
        (counts,) = rows.values[0]
        order = np.argsort(rows.keys, kind="stable")
        ranked = rows.keys[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        sums = np.add.reduceat(counts[order].astype(np.uint64), first)
        single = self.grams.level_of(bucket) == 0
        total = np.empty(len(ranked), np.uint64)
        total[order] = np.repeat(np.where(sums >= (1 if single else LEAST), sums, 0), np.diff(first, append=len(ranked)))
        mine = np.zeros(len(ranked), np.uint8)
        mine[order[first]] = 1
        out = [(*row, None, None) for row in self.grams.answers(bucket, table, rows, [total, mine])]
        if single:
            out.append((None, bucket, *[None] * 5, int(sums.sum()), int(np.count_nonzero(sums))))
        return table_of(self.counted, out)

    def _told(self, route: Route, size: int, table) -> list[list[np.ndarray]]:
        """The answers of a route by level, each in the order of the group's keys; empty where nothing was asked."""
        names = [n for n, _, _ in route.answer]
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("bucket", *names)), strict=True))
        out = [[[] for _ in names] for _ in range(size)]
        for bucket, *values in rows:
            for held, value, (_, dtype, _) in zip(out[route.level_told(bucket)], values, route.answer, strict=True):
                held.append(unpack(value, dtype).astype(np.int64))
        return [[np.concatenate(v) if v else np.zeros(0, np.int64) for v in level] for level in out]

    def _totals(self, table) -> tuple[list, list]:
        """The totals of the group's grams of each length, and which of them it owns."""
        told = self._told(self.grams, DEPTH + 1, table)
        return [t[0] for t in told], [t[1] > 0 for t in told]

    def _contexts(self, group: Group, totals, mine, length: int):
        """What a group knows of its contexts of ``length`` words: a function for the figures of given grams (context, words,
        gain, share), the counted grams that it owns, which contexts it must ask for, and the states among those that it
        needn't."""
        context, suffix, inner = group.follows(length)
        c, of_context = totals[length], totals[length - 1]

        def figures(grams):
            n, words = of_context[context[grams]], c[grams]
            q = of_context[suffix[grams]] / (totals[length - 2][inner[grams]] if length > 1 else self.n_tokens)
            return context[grams], words, np.rint(2 * words * np.log(words / (n * q)) * GAIN_PARTS), np.rint(q * SHARE_PARTS)

        size = len(group.grams[length - 1])
        # A gram that occurs more often than its parts shares its hash with another.
        whole = (c >= LEAST) & (c <= of_context[context]) & (c <= of_context[suffix])
        owned = np.flatnonzero(whole & mine[length])
        # A context that one word always follows: its sums are that word's.
        sole = np.flatnonzero(whole & (c == of_context[context]))
        at, words, gain, share = figures(sole)
        known, alone, open_ = np.zeros((3, size), bool)
        known[at] = True
        alone[at] = stays(words, words, np.ones(len(at)), gain, share)
        open_[context] = of_context[context] >= LEAST
        open_ &= ~known
        open_[context[owned]] = True
        return figures, owned, np.flatnonzero(open_), alone

    def test(self, key, left, right):
        if not left.num_rows:
            return table_of(self.contexts.there, [])
        group, rows = Group(left, self.bits), []
        totals, mine = self._totals(right)
        for length in range(1, DEPTH + 1):
            figures, owned, asked, _ = self._contexts(group, totals, mine, length)
            at, words, gain, share = figures(owned)
            size = len(group.grams[length - 1])
            kinds = np.bincount(at, minlength=size)
            # Who adds nothing needn't tell the context's occurrences either.
            n = np.where(kinds > 0, totals[length - 1], 0)
            sums = [n, *(np.bincount(at, v, size) for v in (words, None, gain, share))]
            values = np.stack([v[asked].astype(np.int64) for v in sums])
            rows += self.contexts.sent(key[0].as_py(), length, group.grams[length - 1][asked], [values])
        return table_of(self.contexts.there, rows)

    def decide(self, key, table):
        """The states among a bucket's contexts, told to each group in the order of its own: the occurrences that counted words
        follow, and the number of these words; zero for no state."""
        rows = Rows(table, self.contexts.payload)
        n, *sums = rows.values[0]
        order = np.argsort(rows.keys, kind="stable")
        ranked = rows.keys[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        seen, kinds, gain, share = (np.add.reduceat(s[order], first) for s in sums)
        kept = stays(np.maximum.reduceat(n[order], first), seen, kinds, gain, share)
        sizes = np.diff(first, append=len(ranked))
        out = np.zeros((2, len(ranked)), np.int64)
        for k, values in enumerate((seen, kinds)):
            out[k, order] = np.repeat(np.where(kept, values, 0), sizes)
        return table_of(self.contexts.back, self.contexts.answers(key[0].as_py(), table, rows, list(out)))

    def score(self, key, left, right):
        if not left.num_rows:
            return table_of(_SCORES, [])
        group = Group(left, self.bits)
        is_total = pc.is_valid(right.column("totals"))
        totals, mine = self._totals(right.filter(is_total))
        states = self._told(self.contexts, DEPTH + 1, right.filter(pc.invert(is_total)))
        c = totals[0][group.at[0]]
        all_ = self.n_tokens + self.n_kinds + 1
        p = (c + 1) / all_
        for length in range(1, DEPTH + 1):
            _, _, asked, alone = self._contexts(group, totals, mine, length)
            n = totals[length - 1]
            seen, kinds = np.where(alone, n, 0), alone.astype(np.int64)
            if len(asked):
                seen[asked], kinds[asked] = states[length]
            at = np.flatnonzero(group.place >= length)
            context = group.at[length - 1][at - 1]
            state = seen[context] > 0
            at, context = at[state], context[state]
            types = (kinds + n - seen)[context]
            words = np.minimum(totals[length][group.at[length][at]], seen[context])
            p[at] = (words + (types + (n - seen)[context]) * p[at]) / (n[context] + types)
        rows = len(group.docs)
        total = lambda values: np.bincount(group.row[group.own], values[group.own], rows)
        ids = [group.docs.column(n) for n in ("uid", "doc_id", "held_out")]
        found = [np.bincount(group.row[group.own], minlength=rows), total((c > 0).astype(float)).astype(np.int64), total(np.log10(c + 1.0)), total(np.log10(p))]
        return pa.table(dict(zip(_SCORES.names, [*ids, *found], strict=True)), schema=_SCORES)


def packed_groups(docs: DataFrame, size: int) -> DataFrame:
    """``g, docs``: the documents in groups, stored, so that a group stays what it is whenever it is read."""
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(FOLDS))
    named = docs.select("doc_id", "text", (fold == HELD_OUT).alias("held_out"))
    return stored(named.mapInArrow(lambda batches: _pack_groups(batches, size), ddl(_GROUPS)))


def score(docs: DataFrame, group_bytes: int = GROUP_BYTES, bucket_keys: int = BUCKET_KEYS, fan: int | None = None) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of all documents."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, n_groups = 1 + total // (WORD_BYTES * bucket_keys), 1 + total // group_bytes
    bits = min(64, SPARE_BITS + max(24, (total // WORD_BYTES).bit_length()))
    packed = packed_groups(docs, group_bytes)
    groups = packed.groupBy("g")
    steps = Steps(buckets, bits, fan=fan)
    asked = packed.mapInArrow(lambda batches: steps.ask(batches), ddl(steps.grams.there))
    counted = stored(steps.grams.dealt(asked, n_groups).applyInArrow(lambda k, t: steps.count(k, t), ddl(steps.counted)))
    n, v = (x or 0 for x in counted.agg(F.sum("tokens"), F.sum("words")).first())
    known = Steps(buckets, bits, n, v, fan)
    totals = known.grams.returned(counted.where("home IS NOT NULL").select(known.grams.back.names)).drop("keys")
    sums = groups.cogroup(totals.groupBy("g")).applyInArrow(lambda k, a, b: known.test(k, a, b), ddl(known.contexts.there))
    states = known.contexts.dealt(sums, n_groups).applyInArrow(lambda k, t: known.decide(k, t), ddl(known.contexts.back))
    states = known.contexts.returned(states).drop("keys")
    none = F.lit(None).cast("binary")
    told = totals.withColumns({"seen": none, "kinds": none}).unionByName(states.withColumns({"totals": none, "mine": none}))
    parts = groups.cogroup(told.groupBy("g")).applyInArrow(lambda k, a, b: known.score(k, a, b), ddl(_SCORES))
    # A long text's pieces come together.
    whole = parts.groupBy("uid", "doc_id", "held_out").agg(*(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")))
    base = F.col("base") - F.col("n_tokens") * float(np.log10(n + v + 1))
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op5_suffix_tree_scores(spark, sf_dir):
    return score(tx.read_documents(spark, sf_dir))
