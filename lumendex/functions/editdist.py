"""Edit distance with swaps of neighbouring characters (each place edited once), bounded."""

from __future__ import annotations


def osa_distance(a: str, b: str, most: int | None = None) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours from a to b; most + 1 for anything above most."""
    if most is None:
        most = max(len(a), len(b))
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [most + 1] * len(b)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            y = b[j - 1]
            best = min(one[j - 1] + (x != y), one[j] + 1, row[j - 1] + 1)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row[j] = best
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[len(b)], most + 1)
