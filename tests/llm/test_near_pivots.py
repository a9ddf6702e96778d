"""Near copies go through pivot distance tables, which lose no near pair."""

import random

import numpy as np

from tissuegrid.llm import shingles


def made_up(seed=1):
    rng = random.Random(seed)
    sets = []
    for _ in range(25):
        base = rng.sample(range(1000), rng.randrange(1, 60))
        for _ in range(rng.randrange(1, 6)):
            kept = {x for x in base if rng.random() > 0.08} | {rng.randrange(1000) for _ in range(rng.randrange(3))}
            sets.append(np.array(sorted(kept), np.uint64))
    rng.shuffle(sets)
    starts = np.r_[0, 2, 3, 40, len(sets)]
    return sets, starts


def roots(n, edges):
    label = list(range(n))
    for a, b in edges:
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = [new if x == old else x for x in label]
    return label


def test_tables_are_jaccard_distances_to_the_pivots_of_a_tile():
    sets, starts = made_up()
    table = shingles.pivot_table(sets, starts)
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        for k in range(shingles.N_PIVOTS):
            for i in range(a, b):
                x, y = set(sets[i].tolist()), set(sets[min(a + k, b - 1)].tolist())
                want = 1 - len(x & y) / max(len(x | y), 1) if k < b - a - 1 else 0
                assert abs(table[k, i] - want) < 1e-12


def test_pivots_discard_pairs_but_no_near_one(monkeypatch):
    exact, tables = shingles.is_near, shingles.pivot_table
    for seed in range(5):
        sets, starts = made_up(seed)
        n, compared = len(sets), []
        monkeypatch.setattr(shingles, "is_near", lambda x, y: compared.append(1) or exact(x, y))
        forests, counts = [], []
        for table in (tables, lambda sets, starts: np.zeros((1, len(sets)))):
            monkeypatch.setattr(shingles, "pivot_table", table)
            compared.clear()
            forests.append(shingles.tile_links(sets, np.zeros(n, np.int64), starts, np.zeros(n, bool)))
            counts.append(len(compared))
        pairs = [(i, j) for a, b in zip(starts[:-1], starts[1:], strict=True) for i in range(a, b) for j in range(i + 1, b)]
        want = roots(n, [p for p in pairs if exact(sets[p[0]], sets[p[1]])])
        assert all(roots(n, f.edges) == want for f in forests) and counts[0] < 0.7 * counts[1]
