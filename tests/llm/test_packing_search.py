import itertools
import random

import numpy as np
import pytest

from dossier.llm.packing import best_fit_decreasing, bin_completion, fillings, lower_bound


def sequences(plan):
    return sum(n for _, n in plan)


@pytest.mark.parametrize("draw", [lambda r: r.lognormal(6.0, 0.8, 2_000_000), lambda r: r.lognormal(6.3, 0.5, 4_000_000), lambda r: r.integers(300, 700, 500_000)])
def test_a_plan_by_bin_completion_is_reached(draw):
    lengths = np.clip(draw(np.random.default_rng(4)).astype(int), 1, 4096)
    counts = np.bincount(np.concatenate([lengths, np.arange(1, 4097)]), minlength=4097)
    assert np.count_nonzero(counts) == 4096
    plan, bound, first = bin_completion(counts, 4096), lower_bound(counts, 4096), sequences(best_fit_decreasing(counts, 4096))
    held = np.zeros(4097, np.int64)
    for filling, n in plan:
        assert sum(s * k for s, k in filling) <= 4096
        for s, k in filling:
            held[s] += k * n
    assert (held == counts).all()
    assert sequences(plan) - bound <= (first - bound) // 8 and first > bound


def test_every_filling_is_there_or_dominated():
    rng = random.Random(3)

    def holds(pieces, rooms):
        return not pieces or any(r >= pieces[0] and holds(pieces[1:], [*rooms[:i], r - pieces[0], *rooms[i + 1 :]]) for i, r in enumerate(rooms))

    for _ in range(300):
        room, counts = rng.randrange(1, 30), np.zeros(40, int)
        for _ in range(rng.randrange(9)):
            counts[rng.randrange(1, 25)] += 1
        waste = rng.randrange(room + 1)
        items = np.repeat(np.arange(40), counts).tolist()
        every = {tuple(sorted(c)) for n in range(len(items) + 1) for c in itertools.combinations(items, n) if 0 <= room - sum(c) <= waste}
        got = [tuple(sorted(s for s, k in f for _ in range(k))) for f in fillings(room, counts, waste)]
        assert len(set(got)) == len(got) and set(got) <= every
        assert all(any(holds(f, list(g)) for g in got) for f in every)
