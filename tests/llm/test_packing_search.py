from itertools import combinations

import numpy as np

from lumendex.llm import packing


def improvable(bins, lengths, capacity):
    """Whether some move, one-for-one or two-for-one exchange raises the sum of squared fills (all are tried)."""
    fill = [int(lengths[b].sum()) for b in bins]
    for x, b in enumerate(bins):
        sums = {int(lengths[list(o)].sum()) for k in (1, 2) for o in combinations(b, k)}
        for y, t in enumerate(bins):
            if x != y and fill[y] < capacity and any(n > m and fill[y] + n - m <= capacity and fill[y] + n - m > fill[x] for n in sums for m in {0, *lengths[t].tolist()}):
                return True
    return False


def test_local_search_misses_no_partner():
    """Many bins of one length, where a partner is not among the first few, and many lengths."""
    rng = np.random.default_rng(3)
    for capacity, low, high, hot in ((200, 55, 70, None), (200, 20, 160, 70), (400, 60, 140, 100)):
        lengths = rng.integers(low, high, 400)
        if hot:
            lengths[:133] = hot
        lengths = np.sort(lengths)[::-1].copy()
        out = packing.local_search(packing.best_fit(lengths, capacity), lengths, capacity, 1.0)
        assert sorted(i for b in out for i in b) == list(range(400)) and all(lengths[b].sum() <= capacity for b in out)
        assert not improvable(out, lengths, capacity)


def test_partner_beyond_many_lengths():
    """1000 against 800 is the only exchange; 88 lengths of nearly full bins lie between each pair that could do it."""
    bins = [[1000, 600], [820, 800], *([k, 1999 - k] for first in (623, 823) for k in range(first, first + 176, 2))]
    lengths = np.array([n for b in bins for n in b])
    out = packing.local_search([[2 * i, 2 * i + 1] for i in range(len(bins))], lengths, 2000, 1.0)
    assert sorted(int(lengths[b].sum()) for b in out)[:2] == [1400, 1820]
    assert not improvable(out, lengths, 2000)
