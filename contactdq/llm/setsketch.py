"""SetSketch registers: truncated minima on an exponential scale.

Register i of a set is ``clip(floor(1 - log_b(m_i)), 0, q + 1)``, where m_i is the least of exponential hash values of rate
``a`` over the set's elements. Sketches of two sets merge by the larger register. With a base near 1, two registers agree
with a probability close to the Jaccard similarity; which of them is larger also tells how the rest is shared out, so
the similarity is estimated from all three counts by maximum likelihood, given the sets' sizes.
"""

from __future__ import annotations

import numpy as np

BASE, RATE, Q = 1.001, 20.0, (1 << 16) - 2
BANDS, ROWS = 48, 5
REGISTERS = BANDS * ROWS

_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(0, 1 << 63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_FACTORS = _rng.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_SEEDS = _rng.integers(0, 1 << 63, BANDS, np.uint64)


def registers(elements: np.ndarray) -> np.ndarray:
    """The registers of a set of mixed 64-bit hashes; zeros for an empty set."""
    if not len(elements):
        return np.zeros(REGISTERS, np.uint16)
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    step = max(1, 65536 // max(1, min(len(elements), 4096)))
    for at in range(0, len(elements), 4096):
        some = elements[at : at + 4096]
        for i in range(0, REGISTERS, step):
            np.minimum(least[i : i + step], np.multiply.outer(_FACTORS[i : i + step], some).min(axis=1), out=least[i : i + step])
    uniform = (least.astype(np.float64) + 1.0) / 2.0**64
    exponential = -np.log1p(-np.minimum(uniform, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, Q + 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(a, b)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row of a (n, REGISTERS) array."""
    parts = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64) + np.uint64(1)
    keys = (parts * _BAND_FACTORS).sum(axis=2, dtype=np.uint64) + _BAND_SEEDS
    keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return keys ^ (keys >> np.uint64(29))


def _log_p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def log_likelihoods(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, js: np.ndarray) -> np.ndarray:
    """(pairs, len(js)) log-likelihoods of similarities, from which register is larger and which agree."""
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = a.shape[1] - more - less
    u = (size_a / (size_a + size_b))[:, None]
    js = np.minimum(js[None, :], np.minimum(u / (1 - u), (1 - u) / u))
    p, m = _log_p(u - (1 - u) * js), _log_p((1 - u) - u * js)
    tiny = 1e-9
    return more * np.log(np.maximum(p, tiny)) + less * np.log(np.maximum(m, tiny)) + same * np.log(np.maximum(1 - p - m, tiny))


GRID = np.linspace(0, 1, 101)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest similarity of each pair, and how much likelier it is (natural log) than ``least``; 0 where it is no smaller."""
    table = log_likelihoods(a, b, size_a, size_b, np.concatenate((GRID, [least])))
    best = table[:, :-1].argmax(axis=1)
    j = GRID[best]
    return j, np.where(j >= least, 0.0, table[np.arange(len(table)), best] - table[:, -1])
