"""Edit distance within a band: bit-parallel over the diagonals that a limit leaves."""

from __future__ import annotations

from collections import Counter


def bag_bound(a: list, b: list) -> int:
    """A lower bound of the edit distance from how often each item occurs."""
    if len(a) < len(b):
        a, b = b, a
    rest = Counter(a)
    rest.subtract(b)
    return sum(n for n in rest.values() if n > 0)


def banded_distance(a: list, b: list, limit: int) -> int | None:
    """The edit distance of two sequences if it is at most ``limit``, else None.

    Common ends are cut off. What is left is aligned column by column in a band of ``2 * limit + 1`` diagonals held in one
    integer: bit r of the masks stands for row ``column - limit + r``. The cell on the band's lower edge starts at
    ``limit`` and grows by one for each diagonal step without a match; below the last row the score follows that row.
    """
    if limit < 0 or abs(len(a) - len(b)) > limit:
        return None
    n = min(len(a), len(b))
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a) if len(a) <= limit else None
    if bag_bound(a, b) > limit:
        return None
    band = 4
    while True:
        width = min(band, limit)
        found = _in_band(a, b, max(width, len(a) - len(b)))
        if found <= width:
            return found
        if width == limit:
            return None
        band *= 4


def _in_band(rows: list, cols: list, k: int) -> int:
    """The distance if it is at most ``k``; else some number over ``k``. ``k`` is at least the difference of the lengths."""
    n = len(rows)
    k = min(k, n)
    width = 2 * k + 1
    full = (1 << width) - 1
    top = width - 1
    where: dict = {}
    for r, x in enumerate(rows):
        where[x] = where.get(x, 0) | 1 << (r + k)
    # In column 0 every row from 1 on is one over the row before; bits under it stand for no cell.
    up, down = full ^ ((1 << k) - 1), 0
    score = k  # of the cell (row k, column 0); its diagonal is the band's lower edge
    for c, x in enumerate(cols, 1):
        # Row c - k + r has its bit at position r: rows[c - k + r - 1] is bit c + r - 1 of the shifted masks.
        eq = (where.get(x, 0) >> (c - 1)) & full
        diag = ((((eq & up) + up) ^ up) | eq | down) & full
        right_up = (down | ~(diag | up)) & full
        right_down = diag & up
        last = n - c + k  # the bit of row n
        if last >= top:
            score += not (diag >> top) & 1
        else:
            score += (right_up >> last) & 1
            score -= (right_down >> last) & 1
        shifted = diag >> 1
        up = (right_down | ~(shifted | right_up)) & full
        down = shifted & right_up
    return score


def edit_limit(n: int, similarity: float) -> int:
    """The largest distance of which ``1 - distance / n`` is at least ``similarity``."""
    return int((1 - similarity) * n + 1e-9)
