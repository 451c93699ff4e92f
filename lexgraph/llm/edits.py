"""Edit distance and text folding for Python workers."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from ..functions.chars import LOOKALIKES, to_plain

_LOOK = {ord(k): v for k, v in LOOKALIKES.items()}


def fold_text(text: str) -> str:
    """Lower case, base letters, plain widths and spaces, no invisible characters; look-alikes become Latin."""
    if text.isascii():
        return text.lower()
    plain = text.translate(to_plain()).translate(_LOOK)
    if plain.isascii():
        return plain.lower()
    return "".join(c for c in unicodedata.normalize("NFD", plain).lower() if not unicodedata.combining(c))


def damerau(a: Sequence, b: Sequence) -> int:
    """Unrestricted Damerau-Levenshtein distance, a true metric: insert, delete, substitute, swap neighbours."""
    if a == b:
        return 0
    # equal ends never change the distance
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    ha, hb = len(a), len(b)
    while ha > lo and hb > lo and a[ha - 1] == b[hb - 1]:
        ha -= 1
        hb -= 1
    a, b = a[lo:ha], b[lo:hb]
    if not a or not b:
        return len(a) or len(b)
    far = len(a) + len(b)
    last_row: dict = {}
    rows = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row = [far, i]
        last_col = 0
        before = rows[i]
        for j, y in enumerate(b, 1):
            r = last_row.get(y, 0)
            swap = rows[r][last_col] + (i - r - 1) + 1 + (j - last_col - 1)
            if x == y:
                row.append(min(before[j], swap))
                last_col = j
            else:
                row.append(min(before[j] + 1, row[j] + 1, before[j + 1] + 1, swap))
        last_row[x] = i
        rows.append(row)
    return rows[-1][-1]


def optimal_assignment(cost: list[list[float]]) -> tuple[float, list[int]]:
    """The cheapest assignment of rows to columns (rows <= columns): total and the column of each row."""
    n, m = len(cost), len(cost[0]) if cost else 0
    if not n:
        return 0.0, []
    inf = float("inf")
    u, v, at = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        at[0] = i
        j0 = 0
        least, way, used = [inf] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = at[j0], inf, 0
            for j in range(1, m + 1):
                if not used[j]:
                    cur = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if cur < least[j]:
                        least[j], way[j] = cur, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[at[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if at[j0] == 0:
                break
        while j0:
            at[j0] = at[way[j0]]
            j0 = way[j0]
    cols = [0] * n
    for j in range(1, m + 1):
        if at[j]:
            cols[at[j] - 1] = j - 1
    return sum(cost[i][c] for i, c in enumerate(cols)), cols
