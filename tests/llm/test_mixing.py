import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veristream.llm import mixing

WORD = re.compile("[^\x20\x09-\x0d]+")


def targets_by_hand(size_of):
    """Sources in order, None last; the excess is shared again until no target is above twice its size."""
    names = sorted((s for s in size_of if s is not None)) + ([None] if None in size_of else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, full, left = dict.fromkeys(names, 0.0), set(), 1.5 * sum(size_of.values())
    while left > 1e-9:
        free = [s for s in names if s not in full]
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in free:
            if target[s] > 2 * size_of[s]:
                left += target[s] - 2 * size_of[s]
                target[s] = 2 * size_of[s]
                full.add(s)
    return target


def check(rows, docs):
    size_of = defaultdict(int)
    for r in docs:
        size_of[r.source] += len(WORD.findall(r.text or ""))
    target = targets_by_hand(dict(size_of))
    taken, most = defaultdict(int), defaultdict(int)
    assert len(rows) == len(docs)
    for r in rows:
        assert r.source_size == size_of[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    for s in size_of:
        assert abs(taken[s] - target[s]) <= most[s]


def test_mixture(docs, odd, empty):
    for df in (docs, odd):
        rows = mixing.mixture(df).collect()
        check(rows, df.select("source", "text").collect())
        assert sorted(map(str, rows)) == sorted(map(str, mixing.mixture(df.repartition(5)).collect()))
    assert mixing.mixture(empty).count() == mixing.mixed(empty).count() == 0


def test_rounds_of_the_tree(docs, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 2)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    check(mixing.mixture(docs).collect(), docs.select("source", "text").collect())


def test_mixed_repeats_documents(odd):
    rows = mixing.mixed(odd)
    assert rows.columns == odd.columns
    assert rows.count() == mixing.mixture(odd).agg({"copies": "sum"}).first()[0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.floats(0, 1)), max_size=30), st.integers(0, 2**32))
def test_pivot_keeps_the_words(units, seed):
    size, rest = np.array([u[0] for u in units], np.int64), np.array([u[1] for u in units], float)
    got, held = mixing.pivot(size, rest, np.random.default_rng(seed))
    assert np.all((got >= -1e-9) & (got <= 1 + 1e-9))
    whole = np.isclose(got, np.rint(got), atol=1e-9) | (size == 0)
    assert all(whole[k] for k in range(len(size)) if k != held)
    assert np.sum(size * got) == pytest.approx(np.sum(size * rest), abs=1e-6)


def test_pivot_keeps_expectations():
    size, rest = np.array([3, 5, 2, 9]), np.array([0.2, 0.7, 0.5, 0.4])
    total = np.zeros(4)
    for seed in range(4000):
        draw = np.random.default_rng(seed)
        got, held = mixing.pivot(size, rest, draw)
        if held >= 0:
            got[held] = draw.random() < got[held]
        total += got
    assert np.abs(total / 4000 - rest).max() < 0.03
