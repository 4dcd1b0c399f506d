"""Edit distance within a small bound, by bit-parallel columns of a band around the diagonal."""

from __future__ import annotations


def within(a, b, k: int) -> bool:
    """Whether insertions, deletions and substitutions of single elements, at most k, turn a into b."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > k:
        return False
    if len(a) > len(b):
        a, b = b, a
    lo, m, n = 0, len(a), len(b)
    # Equal ends cost nothing; slices of growing size find them fast.
    step = 256
    while step:
        while lo + step <= m and a[lo : lo + step] == b[lo : lo + step]:
            lo += step
        step //= 2
    a, b = a[lo:], b[lo:]
    hi, m = 0, len(a)
    step = 256
    while step:
        while hi + step <= m and a[m - hi - step : m - hi] == b[len(b) - hi - step : len(b) - hi]:
            hi += step
        step //= 2
    a, b = a[: m - hi], b[: len(b) - hi]
    m, n = len(a), len(b)
    if m <= k:
        return _table(a, b) <= k
    # Bit d of a vector belongs to row column + d - (width - 1 - k); the top bit is the band's last row.
    width = 2 * k + 2
    every, top, across = (1 << width) - 1, 1 << (width - 1), 1 << (width - 2)
    up, down = every & (every << (width - k - 1)), 0
    distance, first = k, k + 1 - width
    for j in range(n):
        same, c = 0, b[j]
        for d in range(max(0, -first - j), min(width, m - first - j)):
            if a[first + j + d] == c:
                same |= 1 << d
        diagonal = ((((same & up) + up) ^ up) | same | down) & every
        plus = down | (every & ~(diagonal | up))
        minus = diagonal & up
        if j < m - k:
            distance += not diagonal & top
            if distance > 3 * k:  # from here the last row's end can't come back
                return False
        else:
            distance += bool(plus & across) - bool(minus & across)
            across >>= 1
        half = diagonal >> 1
        up, down = minus | (every & ~(half | plus)), half & plus
    return distance <= k


def _table(a, b) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]
