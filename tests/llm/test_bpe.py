import hashlib
import random
from functools import cache

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veristream.llm import bpe

PATH = public_tokenizers.path(bpe.VOCABULARY)


@cache
def library():
    return Tokenizer.from_file(PATH)


def check(text):
    want = library().encode(text, add_special_tokens=False).ids
    code = bpe.codec(PATH)
    assert code.encode(text) == want
    assert code.decode(want) == library().decode(want, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=400))
def test_any_text(text):
    check(text * 3)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\n\n ", "don't", "'s", "a", "word", "é", "日本", "😀", "12", "!!", "<|endoftext|>", " ", "\x1c", "\u0085"]), max_size=600))
def test_joins(parts):
    check("".join(parts))


def test_long_stretches():
    for text in ("a" * 20000, " " * 5000 + "x", "ab" * 9000 + " " + "c" * 400, "日本語" * 4000, "!" * 9000 + "\n" * 9000, "don't " * 3000, "x \n" * 4000, "word " * 9000):
        check(text)


def test_chunks_are_found_again():
    draw = random.Random(3)
    prose = lambda n: " ".join("".join(draw.choices("abcdefghij", k=draw.randint(2, 9))) for _ in range(n))
    shared = prose(2000)
    cut = lambda t: {t[a:b] for a, b in zip([0, *bpe.chunk_ends(t)], bpe.chunk_ends(t), strict=False)}
    a, b = cut(prose(50) + shared), cut(prose(77) + shared)
    assert len(a & b) > 0.8 * min(len(a), len(b))
    for t in ("", "x", "a" * 100000, shared):
        ends = bpe.chunk_ends(t)
        assert ends[-1] == len(t) and ends == sorted(set(ends)) and max(b - a for a, b in zip([0, *ends], ends, strict=False)) <= bpe.MOST + bpe.LEAST


def test_text_without_spaces_is_encoded_once():
    draw = random.Random(5)
    letters = [chr(0x4E00 + k) for k in range(3000)]
    plain = "".join(draw.choices(letters, k=50000))
    marked = "".join(draw.choice(letters) + ("\u3002" if k % 20 == 0 else "") for k in range(50000))
    for text, most in ((plain, 1.0), (marked, 1.3)):
        code = bpe.Codec(PATH)
        assert code.encode(text) == library().encode(text, add_special_tokens=False).ids
        assert code.encoded_chars <= most * len(text)
        code.encode(text)
    assert code.reused_chars > 0.9 * len(marked)


def test_repair_widens_until_the_tokens_agree(monkeypatch):
    """With anchors that don't hold (inside words), joins disagree and the text is encoded as a whole."""
    monkeypatch.setattr(bpe, "_ANCHOR", bpe.regex.compile(r"(?<=\w)(?=o)"))
    draw = random.Random(6)
    for _ in range(20):
        text = " ".join("".join(draw.choices(["lo", "go", "tion", "ing", "foo"], k=3)) for _ in range(800))
        assert bpe.Codec(PATH).encode(text) == library().encode(text, add_special_tokens=False).ids


def test_reuse_across_documents(docs):
    code = bpe.Codec(PATH)
    texts = [r.text for r in docs.collect() if r.text]
    for text in texts * 2:
        code.encode(text)
    whole = sum(map(len, texts))
    assert code.reused_chars > 0.8 * sum(len(t) for t in texts if len(t) > 2000)
    assert code.encoded_chars + code.reused_chars < 3 * whole


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5000)
    code = bpe.Codec(PATH)
    draw = random.Random(4)
    for _ in range(30):
        text = " ".join("".join(draw.choices("abcdefghij", k=6)) for _ in range(300))
        assert code.encode(text) == library().encode(text, add_special_tokens=False).ids
        assert sum(map(len, code.known)) <= 5000 + bpe.MOST


def test_query(spark, odd, empty, docs, as_table):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for df in (odd, docs):
        want = []
        for r in df.collect():
            ids = library().encode(r.text or "", add_special_tokens=False).ids
            want.append((str(r.doc_id), len(ids), sha(",".join(map(str, ids))), sha(library().decode(ids, skip_special_tokens=False))))
        assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op1_bpe_round_trip(spark, as_table(df)).collect()) == sorted(want)
    assert bpe.round_trip(empty).count() == bpe.encode(empty).count() == 0
    back = bpe.decode(bpe.encode(docs))
    assert {r.doc_id: r.text for r in back.collect()} == {r.doc_id: r.text for r in docs.collect()}
