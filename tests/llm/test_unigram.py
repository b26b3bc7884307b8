from functools import cache

import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from veristream.llm import unigram

PATH = public_tokenizers.path(unigram.VOCABULARY)


def tokenizer(pieces, byte_fallback):
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=unigram.SPACE_MARK, prepend_scheme="always", split=True)
    return t


@cache
def library():
    return tokenizer(unigram.vocabulary(PATH), True)


def check(texts):
    got = unigram.count_texts(pa.array(texts, pa.string()), PATH)[2].tolist()
    assert got == [len(e.ids) for e in library().encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.lists(st.sampled_from([" ", "  ", "the", "ing", "<s>", "<0x0A>", "▁", "▁▁", "é", "日本", "😀", "\n", "ἡ"]), max_size=30).map("".join)), max_size=6))
def test_counts(texts):
    check(texts)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcx▁", max_size=24), st.lists(st.tuples(st.text(alphabet="abc▁", min_size=1, max_size=4), st.integers(-4, 0)), max_size=12), st.booleans())
def test_ties_and_unknown(segment, pieces, byte_fallback):
    """Whole scores make many ties; small vocabularies many unknown characters."""
    vocabulary = [("<unk>", 0.0), *{p: float(s) for p, s in pieces}.items()]
    if byte_fallback:
        vocabulary += [(f"<0x{b:02X}>", -9.0) for b in range(256)]
    model = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=byte_fallback))
    assert unigram.Counter(vocabulary).count(segment)[0] == len(model.encode(segment, add_special_tokens=False).ids)


def test_query(spark, odd, empty, docs, as_table):
    for df in (odd, docs):
        want = sorted((str(r.doc_id), len(r.text or ""), len(library().encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect())
        got = unigram.op10_unigram_counts(spark, as_table(df)).collect()
        assert sorted((str(r.doc_id), r.n_chars, r.n_tokens) for r in got) == want
    assert unigram.token_counts(empty).count() == 0
