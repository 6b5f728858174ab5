"""String similarities: edit-based ones that Spark lacks as Arrow functions, set-based ones as column expressions."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro similarity, raised for a common prefix of up to four characters where it exceeds 0.7."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = bytearray(len(b))
    found = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = 1
                found.append(ch)
                break
    m = len(found)
    if not m:
        return 0.0
    other = [ch for ch, t in zip(b, taken) if t]
    swaps = sum(x != y for x, y in zip(found, other)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def damerau_of(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance."""
    far = len(a) + len(b)
    last: dict[str, int] = {}
    rows = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row, seen = [far, i], 0
        for j, y in enumerate(b, 1):
            at = last.get(y, 0)
            swapped = rows[at][seen] + (i - at - 1) + 1 + (j - seen - 1)
            same = x == y
            row.append(min(rows[i][j] + (not same), rows[i][j + 1] + 1, row[j] + 1, swapped))
            if same:
                seen = j
        rows.append(row)
        last[x] = i
    return rows[-1][-1]


CELLS = 1 << 22  # of the matrices of distances that are worked on at once


def _codes(texts: list[str], width: int, fill: int) -> np.ndarray:
    """Code points in rows of one width."""
    out = np.array(texts, f"<U{max(width, 1)}").view(np.int32).reshape(len(texts), max(width, 1))[:, :width]
    return np.where(np.arange(width) < np.array([len(t) for t in texts], np.int64)[:, None], out, np.int32(fill))


def _matched(rank: np.ndarray, found: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The characters at the places found, moved to the front of each row; zeros behind."""
    out = np.zeros_like(codes)
    row, column = np.nonzero(found)
    out[row, rank[row, column]] = codes[row, column]
    return out


def jaro_winkler_all(left: list[str], right: list[str]) -> np.ndarray:
    """``jaro_winkler_of`` of many pairs at once: each step looks at one character of every left text."""
    n, la, lb = len(left), np.array([len(x) for x in left], np.int64), np.array([len(x) for x in right], np.int64)
    wide, high = int(max(la.max(initial=0), 4)), int(max(lb.max(initial=0), 4))
    a, b = _codes(left, wide, -1), _codes(right, high, -2)
    reach = np.maximum(0, np.maximum(la, lb) // 2 - 1)
    free, found = np.ones((n, high), bool), np.zeros((n, wide), bool)
    places = np.arange(high)
    for i in range(wide):
        fits = free & (b == a[:, i, None]) & (np.abs(places - i) <= reach[:, None])
        first, any_ = fits.argmax(axis=1), fits.any(axis=1)
        found[:, i] = any_
        free[np.flatnonzero(any_), first[any_]] = False
    m = found.sum(axis=1)
    taken = ~free
    short = min(wide, high)
    moved = (_matched(np.cumsum(found, axis=1) - 1, found, a)[:, :short] != _matched(np.cumsum(taken, axis=1) - 1, taken, b)[:, :short]).sum(axis=1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(m > 0, (m / la + m / lb + (m - moved) / m) / 3, 0.0)
    alike = np.cumprod(a[:, :4] == b[:, :4], axis=1).sum(axis=1)
    out = np.where(jaro > 0.7, jaro + alike * 0.1 * (1 - jaro), jaro)
    same = np.array([x == y and x != "" for x, y in zip(left, right)], bool)
    return np.where(same, 1.0, np.where((la == 0) | (lb == 0), 0.0, out))


def damerau_all(left: list[str], right: list[str]) -> np.ndarray:
    """``damerau_of`` of many pairs at once: each step is one cell of every pair's matrix."""
    n, la, lb = len(left), np.array([len(x) for x in left], np.int64), np.array([len(x) for x in right], np.int64)
    wide, high = int(la.max(initial=0)), int(lb.max(initial=0))
    a, b, every = _codes(left, wide, -1), _codes(right, high, -2), np.arange(n)
    far = wide + high
    grid = np.full((wide + 2, high + 2, n), far, np.int32)
    grid[1, 1:] = np.arange(high + 1)[:, None]
    grid[1:, 1] = np.arange(wide + 1)[:, None]
    last = np.zeros((high, n), np.int64)  # the last row in which a's character was b's of this column
    for i in range(1, wide + 1):
        seen = np.zeros(n, np.int64)
        for j in range(1, high + 1):
            same = a[:, i - 1] == b[:, j - 1]
            swapped = grid[last[j - 1], seen, every] + (i - last[j - 1] - 1) + 1 + (j - seen - 1)
            grid[i + 1, j + 1] = np.minimum(np.minimum(grid[i, j] + ~same, np.minimum(grid[i, j + 1], grid[i + 1, j]) + 1), swapped)
            seen[same] = j
        last[(a[:, i - 1, None] == b).T] = i
    return grid[la + 1, lb + 1, every].astype(np.int64)


def _distinct(a: pd.Series, b: pd.Series, f, kind: str) -> pd.Series:
    """A figure of each pair of texts: worked out once for each distinct pair, pairs of like length together; null where a text is null."""
    pairs = list(zip(a, b))
    some = sorted({p for p in pairs if p[0] is not None and p[1] is not None}, key=lambda p: (len(p[0]), len(p[1])))
    known: dict[tuple, float] = {}
    at = 0
    while at < len(some):
        end, high = at, 0
        while end < len(some) and end - at < 4096:
            high = max(high, len(some[end][1]) + 2)
            if end > at and (end - at + 1) * (len(some[end][0]) + 2) * high > CELLS:
                break
            end += 1
        known |= zip(some[at:end], f([p[0] for p in some[at:end]], [p[1] for p in some[at:end]]).tolist())
        at = end
    return pd.Series([known.get(p) for p in pairs], dtype=kind)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return _distinct(a, b, jaro_winkler_all, "Float64")


@F.pandas_udf(IntegerType())
def damerau(a: pd.Series, b: pd.Series) -> pd.Series:
    return _distinct(a, b, damerau_all, "Int32")


@F.pandas_udf(StructType().add("jaro_winkler", DoubleType()).add("damerau", IntegerType()))
def edit_figures(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Both figures of a pair in one pass over the data."""
    return pd.DataFrame({"jaro_winkler": _distinct(a, b, jaro_winkler_all, "Float64"), "damerau": _distinct(a, b, damerau_all, "Int32")})


def closest_of(word: str, options: list[str], cutoff: float = 0.8) -> str | None:
    """The most similar option by Ratcliff-Obershelp ratio, if it reaches the cutoff; ties go to the later word in order."""
    ranked = [(SequenceMatcher(None, o, word).ratio(), o) for o in options]
    best = max(ranked, default=(0.0, ""))
    return best[1] if best[0] >= cutoff else None


def overlap(a: Column, b: Column) -> Column:
    """Common elements over the smaller set, 0 if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def dice(a: Column, b: Column, empty: float = 0.0) -> Column:
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(empty)).otherwise(2 * F.size(F.array_intersect(a, b)) / both)


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / both)
