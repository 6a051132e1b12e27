"""Merging many units at once: pairs by a hash table, places linked; held against the agenda of one unit."""

import numpy as np

from memengine.llm import pieces
from memengine.llm.queries import TOKENIZER


def test_pairs_of_symbols_are_found_and_others_not():
    model = pieces.load_model(TOKENIZER)
    _, none, ident, pairs = model.tables()
    held = pairs.keys[pairs.keys >= 0]
    want = {(x[:k], x[k:]) for x in model.score for k in range(1, len(x))}
    assert held.size == np.unique(held).size <= len(want) and 4 * held.size <= pairs.keys.size
    left, right = held // pairs.base, held % pairs.base
    rank, made = pairs.look(left, right)
    assert (rank < pieces._NEVER).all() and (ident[made] >= 0).all()
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, none + 1, (2, 200_000))
    known = set(held.tolist())
    assert ((pairs.look(a, b)[0] < pieces._NEVER) == np.array([k in known for k in (a * pairs.base + b).tolist()])).all()
    assert (pairs.look(np.full(none, none), np.arange(none))[0] == pieces._NEVER).all()


def test_units_at_once_equal_units_one_by_one():
    model = pieces.load_model(TOKENIZER)
    rng = np.random.default_rng(5)
    letters = [*"etaoinshrdlu", "é", "\U0001f600", "\x07", "中", "▁"]
    units = ["▁" + "".join(rng.choice(letters, rng.integers(0, 31))) for _ in range(400)]
    for depth in (0, 1, 3):
        skips = np.sort(np.array([rng.choice(12, depth, replace=False) for _ in units], np.int64).reshape(len(units), depth), axis=1)
        flat, count, steps = model._merge(units, skips)
        want = [model._walk(u, iter(x.tolist())) for u, x in zip(units, skips)]
        assert [x.tolist() for x in np.split(flat, np.cumsum(count)[:-1])] == want
        assert (steps <= pieces._STEPS).all() and (depth or (steps < [len(u) for u in units]).all())
