"""String metrics. Where they differ from the textbook, the name's docstring says how."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Sequence
from typing import NamedTuple


def jaro(a: str | None, b: str | None) -> float:
    """Jaro similarity that keeps half transpositions. Two empty strings are alike; strings of at most
    one character have no window and never match. -1 for null."""
    if a is None or b is None:
        return -1.0
    if not a:
        return 0.0 if b else 1.0
    window = max(len(a), len(b)) // 2 - 1
    if window < 0 or not b:
        return 0.0
    taken = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for k in range(max(0, i - window), min(len(b), i + window + 1)):
            if not taken[k] and b[k] == c:
                taken[k] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [c for c, t in zip(b, taken, strict=True) if t]
    half = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - half) / m) / 3


def jaro_winkler(a: str | None, b: str | None, scale: float = 0.1, bonus_from: float = 0.7) -> float:
    """Jaro with a bonus for up to four common leading characters, from 0.7 on."""
    j = jaro(a, b)
    if j < bonus_from:
        return j
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return min(1.0, j + (1 - j) * prefix * scale)


def damerau(a: str | None, b: str | None) -> int:
    """Edit distance in which swapped neighbours cost what the diagonal before the second of
    them did; not optimal string alignment. -1 for null."""
    if a is None or b is None:
        return -1
    column = list(range(len(a) + 1))
    for x in range(1, len(b) + 1):
        diagonal, column[0] = column[0], x
        for y in range(1, len(a) + 1):
            old = column[y]
            best = min(old + 1, column[y - 1] + 1, diagonal + (a[y - 1] != b[x - 1]))
            if x > 1 and y > 1 and a[y - 1] == b[x - 2] and a[y - 2] == b[x - 1]:
                best = min(best, diagonal)
            column[y], diagonal = best, old
    return column[-1]


class Edits(NamedTuple):
    """Operations of a cheapest alignment."""

    matches: int = 0
    mismatches: int = 0
    transpositions: int = 0
    gap_opens: int = 0
    gap_extensions: int = 0


OPEN, EXTEND, MISMATCH, SWAP = 3, 2, 6, 4


def _apart(c: str) -> bool:
    """White space, hyphens and punctuation of every kind part words alike."""
    return c.isspace() or unicodedata.category(c)[0] == "P"


def _same(x: str, y: str) -> bool:
    return x == y or (_apart(x) and _apart(y))


def affine_gap(a: str, b: str) -> Edits:
    """Operation counts of a cheapest alignment with affine gaps; spaces and hyphens are alike."""
    if len(a) < len(b):
        a, b = b, a
    if a == b:
        return Edits(len(a))
    none = (10**9, Edits())
    n, m = len(b), len(a)

    def gap(cell: tuple[int, Edits], opened: tuple[int, Edits]) -> tuple[int, Edits]:
        """Cheaper of extending the gap ``opened`` and opening one after ``cell``."""
        if opened[0] <= cell[0] + OPEN:
            e = opened[1]
            return opened[0] + EXTEND, e._replace(gap_extensions=e.gap_extensions + 1)
        e = cell[1]
        return cell[0] + OPEN + EXTEND, e._replace(gap_opens=e.gap_opens + 1, gap_extensions=e.gap_extensions + 1)

    rows: list[list[tuple[int, Edits]]] = []
    down: list[tuple[int, Edits]] = [none] * (m + 1)
    for i in range(n + 1):
        row: list[tuple[int, Edits]] = []
        across = none
        for j in range(m + 1):
            if i == j == 0:
                row.append((0, Edits()))
                continue
            best = none
            if i:
                down[j] = gap(rows[i - 1][j], down[j])
                best = down[j]
            if j:
                across = gap(row[j - 1], across)
                best = min(best, across, key=lambda c: c[0])
            if i and j:
                cost, e = rows[i - 1][j - 1]
                step = (cost, e._replace(matches=e.matches + 1)) if _same(a[j - 1], b[i - 1]) else (cost + MISMATCH, e._replace(mismatches=e.mismatches + 1))
                if step[0] <= best[0]:
                    best = step
                if i > 1 and j > 1 and a[j - 1] == b[i - 2] and a[j - 2] == b[i - 1] and a[j - 1] != a[j - 2]:
                    cost, e = rows[i - 2][j - 2]
                    if cost + SWAP < best[0]:
                        best = (cost + SWAP, e._replace(transpositions=e.transpositions + 1))
            row.append(best)
        rows.append(row)
    return rows[n][m][1]


def possible_abbreviation(a: str, b: str, strict: bool = False) -> bool:
    """Loose: same first character, and the shorter is found in the longer in order. Strict: the
    shorter is a prefix, or both ends agree as well."""
    if not a or not b or a[0] != b[0]:
        return False
    short, long = sorted((a, b), key=len)
    if strict:
        if long.startswith(short):
            return True
        if a[-1] != b[-1]:
            return False
    return affine_gap(a, b).matches == len(short)


def abbreviation_similarity(a: str, b: str) -> float:
    """Share of the alignment's characters that match, gaps discounted."""
    e = affine_gap(a, b)
    total = len(a) + len(b)
    return (2 * e.matches) / total if total else 1.0


def jaccard(a: Sequence[str], b: Sequence[str]) -> float:
    x, y = set(a), set(b)
    return len(x & y) / len(x | y) if x and y else 0.0


def multiset_jaccard(a: Sequence[str], b: Sequence[str]) -> float:
    x, y = Counter(a), Counter(b)
    whole = (x | y).total()
    return (x & y).total() / whole if whole else 0.0
