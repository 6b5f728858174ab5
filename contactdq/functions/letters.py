"""Bounds and Jaro-Winkler of keys against thousands of base keys at once, bit by bit in numpy.

Keys are sorted ones whose letters are bits of three numbers (``linking._spelled``). Within a cell all base keys have one length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Pairs that are looked at in one step. Below so many base keys all pairs are counted, above by rare letters first.
STEP, SMALL = 1 << 17, 512

#: A left key with more candidates in a cell is compared with them, and only what can be among its best is passed on. So many of the best by the bound come first, which raises its floor.
MANY, FIRST = 64, 256

_ONE = np.uint64(1)


def _codes(texts: list[str], width: int) -> np.ndarray:
    """Code points in rows of one width, zeros behind."""
    return np.array(texts, f"<U{width}").view(np.uint32).reshape(len(texts), width)


class Base:
    """The base keys of a cell: sorted keys of one length ``n``, their letters as bits and how many found no bit."""

    def __init__(self, keys: list[str], bits: np.ndarray, more: np.ndarray, words: np.ndarray):
        self.keys, self.bits, self.more, self.words, self.n = keys, bits, more, words, len(keys[0])
        self.codes = _codes(keys, max(self.n, 4))
        self._places: dict[int, np.ndarray] = {}
        self._rows = None

    def places(self, code: int) -> np.ndarray:
        """Where each key has a character, as bits of a number; for keys of up to 64 characters."""
        if code not in self._places:
            wide = np.zeros((len(self.keys), 64), bool)
            wide[:, : self.n] = self.codes[:, : self.n] == code
            self._places[code] = np.packbits(wide, axis=1, bitorder="little").view(np.uint64)[:, 0]
        return self._places[code]

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """For each letter the keys that have it, as bits of numbers, a last row of all keys, and the letters' order, rarest first."""
        if self._rows is None:
            spread = np.unpackbits(self.bits.view(np.uint8), axis=1, bitorder="little")
            wide = np.zeros((spread.shape[1] + 1, -(-len(self.keys) // 64) * 64), bool)
            wide[:-1, : len(self.keys)] = spread.T
            wide[-1, : len(self.keys)] = True
            self._rows = np.packbits(wide, axis=1, bitorder="little").view(np.uint64), np.argsort(spread.sum(axis=0, dtype=np.int64), kind="stable")
        return self._rows


def _needs(length: np.ndarray, n: int, floor: np.ndarray) -> np.ndarray:
    """For each left key and number of first characters shared (0 to 4): how many common letters let Jaro-Winkler reach the floor; more than any key has where none do."""
    common = np.arange(int(length.max()) + 1)
    jaro = (common / length[:, None] + common / n + 1) / 3
    alike = np.arange(5)[:, None] * 0.1
    return ((jaro[:, None, :] + alike * (1 - jaro[:, None, :])) < floor[:, None, None]).sum(axis=2).astype(np.int16)


def _alike(heads: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How many of the first four characters are shared, up to the first that is not."""
    out = np.zeros(np.broadcast_shapes(heads.shape, others.shape)[:-1], np.uint8)
    same = np.ones(out.shape, bool)
    for j in range(4):
        same &= heads[..., j] == others[..., j]
        out += same
    return out


def _common(bits: np.ndarray, more: np.ndarray, other: np.ndarray, other_more: np.ndarray) -> np.ndarray:
    out = np.minimum(more, other_more)
    out = out.astype(np.uint8 if out.max(initial=0) < 100 else np.int16)
    for j in range(3):
        out += np.bitwise_count(bits[..., j] & other[..., j])
    return out


def _by_rare_letters(base: Base, bits: np.ndarray, misses: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of left and base keys that lack no more than so many of the left key's rarest letters. ``at_most[j]`` has the base keys that lack up to ``j`` so far."""
    rows, order = base.rows()
    has = np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little")[:, order]
    some = np.argsort(has == 0, axis=1, kind="stable")[:, : 6 + 3 * misses]
    letters = np.where(np.take_along_axis(has, some, axis=1) == 1, order[some], len(rows) - 1)
    at_most = np.repeat(np.broadcast_to(rows[-1], (1, len(bits), rows.shape[1])), misses + 1, axis=0)
    for letter in letters.T:
        there = rows[letter]
        for j in range(misses, 0, -1):
            at_most[j] &= there
            at_most[j] |= at_most[j - 1]
        at_most[0] &= there
    left, word = np.nonzero(at_most[misses])
    pair, bit = np.nonzero(np.unpackbits(at_most[misses][left, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return left[pair], word[pair] * 64 + bit


def jaro_winkler_against(key: str, base: Base, at: np.ndarray) -> np.ndarray:
    """``jaro_winkler_of`` of a key and the base keys at some places; all have 1 to 64 characters, and the base keys one length."""
    la, lb = len(key), base.n
    reach = max(0, max(la, lb) // 2 - 1)
    every = np.uint64((1 << lb) - 1)
    held = {c: base.places(ord(c))[at] for c in set(key)}
    free, found = np.full(len(at), every), []
    for i, c in enumerate(key):
        window = np.uint64(((1 << (i + reach + 1)) - 1) >> max(0, i - reach) << max(0, i - reach) & ((1 << 64) - 1))
        low = held[c] & free & window
        low &= -low
        free ^= low
        found.append(low != 0)
    left = free ^ every
    m, moved = np.bitwise_count(left).astype(np.int64), np.zeros(len(at), np.int16)
    for c, some in zip(key, found):
        low = (left & -left) * some
        moved += held[c] & low != low
        left ^= low
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(m > 0, (m / la + m / lb + (m - moved // 2) / m) / 3, 0.0)
    alike = _alike(_codes([key], max(la, 4))[:, :4], base.codes[at, :4]) if min(la, lb) >= 4 else np.array([next((j for j in range(min(la, lb)) if key[j] != base.keys[i][j]), min(la, lb)) for i in at])
    return np.where(jaro > 0.7, jaro + alike * 0.1 * (1 - jaro), jaro)


def _best(key: str, base: Base, at: np.ndarray, bounds: np.ndarray, by_words: np.ndarray, k: int) -> np.ndarray:
    """Of candidates those that can be among the best ``k`` of them, ties included: by Jaro-Winkler, or because their words let DICE be as good."""
    figures = lambda some: np.concatenate([jaro_winkler_against(key, base, some[i : i + 4096]) for i in range(0, len(some), 4096)])
    if len(at) > 2 * FIRST:
        first = np.argpartition(bounds, -FIRST)[-FIRST:]
        some = np.maximum(bounds, by_words) >= np.partition(figures(at[first]), -k)[-k] - 1e-6
        at, by_words = at[some], by_words[some]
    told = figures(at)
    return at[np.maximum(told, by_words) >= np.partition(told, -k)[-k] - 1e-6]


def compared_cell(left: dict, base: Base, k: int, loose: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of left keys and of base keys whose bound reaches the left key's floor; of a left key that very many of them reach, the best ``k`` of the cell."""
    bits, more, floor, size = left["bits"], left["more"], left["floor"], np.array([len(x) for x in left["sx"]], np.int64)
    needs, heads = _needs(size, base.n, floor), _codes(left["sx"], max(int(size.max()), 4))[:, :4]
    xs, ys = [], []
    many = (left["misses"] > loose) | (len(base.keys) < SMALL)
    for misses in range(loose + 1):
        some = np.flatnonzero(~many & (left["misses"] == misses))
        step = max(1, STEP // 4 // -(-len(base.keys) // 64))
        for part in (some[i : i + step] for i in range(0, len(some), step)):
            x, y = _by_rare_letters(base, bits[part], misses)
            x = part[x]
            fits = _common(bits[x], more[x], base.bits[y], base.more[y]) >= needs[x, _alike(heads[x], base.codes[y, :4])]
            xs.append(x[fits])
            ys.append(y[fits])
    some = np.flatnonzero(many)
    step = max(1, STEP // len(base.keys))
    for part in (some[i : i + step] for i in range(0, len(some), step)):
        common, alike = _common(bits[part, None], more[part, None], base.bits[None], base.more[None]), _alike(heads[part, None], base.codes[None, :, :4])
        by_words = 2 * np.minimum(left["open"][part, None], base.words) / (left["words"][part, None] + base.words)
        fits = (common >= needs[part[:, None], alike]) | (by_words >= floor[part, None])
        for i in np.flatnonzero(fits.sum(axis=1) > max(MANY, k)):
            if base.n <= 64 and size[part[i]] <= 64:
                at = np.flatnonzero(fits[i])
                jaro = (common[i, at] / size[part[i]] + common[i, at] / base.n + 1) / 3
                fits[i] = False
                fits[i, _best(left["sx"][part[i]], base, at, jaro + 0.1 * alike[i, at] * (1 - jaro), by_words[i, at], k)] = True
        x, y = np.nonzero(fits)
        xs.append(part[x])
        ys.append(y)
    return np.concatenate(xs), np.concatenate(ys)


def _columns(table: pa.Table, key: str) -> dict:
    """The rows of a side by cell: numbers as arrays, keys as arrays of Arrow."""
    table = table.sort_by("cell").combine_chunks()
    out = {c: table.column(c).to_numpy() for c in table.column_names if c not in ("x", "y", key)}
    out["bits"] = np.ascontiguousarray(np.stack([out[f"b{j}"] for j in range(3)], axis=1)).view(np.uint64)
    return out | {c: table.column(c) for c in ("x", "y", key) if c in table.column_names}


def compared_cells(left: pa.Table, right: pa.Table, k: int, loose: int) -> pa.Table:
    """``x, y`` of the pairs of left and base keys of one cell that pass, for all cells of a bucket."""
    x, y, out = _columns(left, "sx"), _columns(right, "sy"), []
    cells, starts = np.unique(x["cell"], return_index=True)
    ends = np.append(starts[1:], len(x["cell"]))
    firsts, lasts = np.searchsorted(y["cell"], cells), np.searchsorted(y["cell"], cells, side="right")
    for start, end, first, last in zip(starts, ends, firsts, lasts):
        if first < last:
            keys = y["sy"].slice(first, last - first).to_pylist()
            base = Base(keys, y["bits"][first:last], y["more"][first:last], y["words"][first:last])
            some = {c: x[c][start:end] for c in ("bits", "more", "words", "open", "floor", "misses")} | {"sx": x["sx"].slice(start, end - start).to_pylist()}
            i, j = compared_cell(some, base, k, loose)
            out.append(pa.table({"x": x["x"].take(pa.array(start + i)), "y": y["y"].take(pa.array(first + j))}))
    return pa.concat_tables(out) if out else pa.table({"x": pa.array([], pa.string()), "y": pa.array([], pa.string())})
