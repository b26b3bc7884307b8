import random
import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from veristream.llm import notices

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def base_by_hand(text):
    words = WORD.findall(re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))
    at = [(k, label) for phrase, label in notices.PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    return len(words), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({label for _, label in at}))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["under", "the", "MIT", "license", "Apache", "version", "2", "cc", "by", "nc", "é", "x\x7fy", "\n", "."])).map(" ".join)), min_size=1, max_size=4))
def test_base(texts):
    for text, got in zip(texts, notices.scan(pa.array(texts, pa.string())), strict=True):
        assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == base_by_hand(text)
        assert set(filter(None, got["base_labels"].split(","))) <= set(filter(None, got["labels"].split(",")))


def edit(text, n, draw):
    for _ in range(n):
        at = draw.randrange(len(text))
        text = text[:at] + draw.choice(["", "q", "qz"[:1]]) + text[at + draw.randint(0, 1) :]
    return text


def test_edited_notices_are_found():
    draw = random.Random(1)
    for notice in notices.NOTICES:
        for _ in range(15):
            n = draw.randint(0, notice.errors)
            said = edit(notice.text.strip(), n, draw)
            text = f"été début {said} {notice.tail} fin 日本".replace("  ", " ")
            got = notices.scan(pa.array(["none", text, None]))
            assert notice.label in got[1]["labels"].split(","), (notice, text)
            assert got[0]["labels"] == got[2]["labels"] == "" and got[0]["score"] == 0.0
            span = next(s for s in got[1]["spans"] if s["label"] == notice.label)
            assert span["first_word"] >= 1 and span["errors"] <= notice.errors and 0 < span["score"] <= 1


def test_adjacent_notices_are_found_each():
    for notice in notices.NOTICES:
        said = notice.text.strip() + (" " if notice.text.endswith(" ") else "") + notice.tail
        for between in (" ", " x ", " and also "):
            got = notices.scan(pa.array([said + between + said + between + said]))[0]
            words, gap = len(said.split()), len(between.split())
            want = [k * (words + gap) for k in range(3)]
            spans = [s for s in got["spans"] if s["label"] == notice.label and s["errors"] == 0 and s["last_word"] - s["first_word"] == words - 1]
            assert [s["first_word"] for s in spans] == want, (said, between, got["spans"])
    worse = "relesed undr the mit license released under the mit license"
    assert notices.scan(pa.array([worse]))[0]["spans"][-1]["errors"] == 0


def test_tails_tell_versions_apart():
    got = notices.scan(pa.array(["Licensed under the Apache License, Version 1.1", "Licensed under the Apache Licence, Version 2.0", "licensed under cc by sa", "Licenced under CC-BY-NC"]))
    assert [g["labels"] for g in got] == ["", "apache-2", "", "cc-by-nc"]


def test_pieces_hold_the_pigeonhole():
    for notice in notices.NOTICES:
        pieces = notices.pieces(notice)
        assert len(pieces) == notice.errors + notices.needed(notice) and "".join(p for _, p in pieces) == notice.text
        assert all(len(p) >= 4 for _, p in pieces)


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=1, max_size=9), st.integers(0, 4), st.text("abcd", max_size=25))
def test_distance_of_a_part(pattern, errors, text):
    # The least distance of any part of the text, by the plain table.
    row = list(range(len(pattern) + 1))
    least = row[-1]
    for c in text:
        new = [0]
        for k, x in enumerate(pattern):
            new.append(min(row[k] + (x != c), row[k + 1] + 1, new[k] + 1))
        row, least = new, min(least, new[-1])
    # An empty part is as far as the pattern is long, and isn't looked for.
    assert notices.near(pattern, errors, text) == (bool(text) and least <= errors)


def test_licence_like_text_is_cheap():
    """Text that holds pieces of many notices, over and over: a few seconds for a megabyte."""
    import time

    text = "under this license permission is granted free of charge the software with or without " * 3000
    began = time.process_time()
    got = notices.scan(pa.array([text]))[0]
    assert time.process_time() - began < 900 * len(text) / 1e9 * 20 and got["labels"] == whole_by_hand(text[:2000])[0]


def test_query(spark, odd, empty, as_table):
    got = notices.op8_license_notices(spark, as_table(odd)).collect()
    want = sorted(str((r.doc_id, *base_by_hand(r.text))) for r in odd.collect())
    assert sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got) == want
    assert notices.search(empty).count() == 0


def whole_by_hand(text):
    """Labels and score by bounded-error matching over the whole text, without seeds or windows."""
    line = " ".join(WORD.findall(re.sub("[A-Z]", lambda c: c[0].lower(), text or "")))
    _, n, _, _, base = base_by_hand(text)
    labels, score = set(filter(None, base.split(","))), 0.0
    for notice in notices.NOTICES:
        if m := notices.pattern(notice).search(line):
            labels.add(notice.label)
            score = max(score, 1 - sum(m.fuzzy_counts) / len(notice.text))
    return ",".join(sorted(labels)), 1.0 if n else score


def test_labels_and_scores_by_brute_force(docs):
    """On documents as they are, and with notices put in that hold up to a few more edits than are allowed."""
    draw = random.Random(8)
    texts = [r.text for r in docs.collect() if r.text and len(r.text) < 2500][:120]
    for notice in notices.NOTICES:
        for _ in range(6):
            said = edit(notice.text.strip(), draw.randint(0, notice.errors + 3), draw)
            if draw.random() < 0.4:  # characters of four bytes put in
                for _ in range(draw.randint(1, notice.errors)):
                    at = draw.randrange(len(said))
                    said = said[:at] + "😀" + said[at:]
            text = draw.choice(texts)[: draw.randint(0, 600)]
            texts.append(f"{text} {said} {notice.tail} {draw.choice(texts)[:300]}")
    got = notices.scan(pa.array(texts))
    want = [whole_by_hand(t) for t in texts]
    assert [(g["labels"], round(g["score"], 9)) for g in got] == [(labels, round(score, 9)) for labels, score in want]
    assert sum(bool(labels) for labels, _ in want) > 40
