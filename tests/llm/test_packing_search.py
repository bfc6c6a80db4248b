"""The local search tries every pair and has no limit of moves."""

from itertools import combinations

import numpy as np

from corpusloom.llm import packing


def test_step_is_the_best_of_all_exchanges():
    rng = np.random.default_rng(1)
    for size in [2, 3, 5, 60] * 40:
        some = lambda n: tuple(sorted({int(x): int(rng.integers(1, 3)) for x in rng.integers(1, 400, n)}.items(), reverse=True))
        source, target, room = some(size), some(3), int(rng.integers(1, 60))
        pieces = [a for a, n in source for _ in range(n)]
        gains = [sum(i) - sum(o) for k in (1, 2) for i in combinations(pieces, k) for o in [()] * (k == 1) + [(a,) for a, _ in target]]
        want = max((g for g in gains if 0 < g <= room), default=None)
        found = packing._step(source, target, room)
        assert (found and found[0]) == want


def test_pairs_of_short_pieces_are_tried():
    # of 40 lengths only the two shortest together replace the 7
    source = tuple((100 + k, 1) for k in range(40, 0, -1)) + ((5, 1), (4, 1))
    assert packing._step(source, ((7, 1),), 2) == (2, (5, 4), (7,))
