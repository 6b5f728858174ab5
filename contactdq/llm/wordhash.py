"""Words of a text as bytes, and 64-bit hashes of words and word runs with numpy.

A word's hash is a polynomial over its bytes, mixed; a run's hash mixes the sum of its words' hashes, each times a
constant of its place. All arithmetic is modulo 2**64. Memory is a few times the text.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = np.ones(1, np.uint64)
_unpowers = np.ones(1, np.uint64)

#: ASCII bytes other than letters and digits become spaces, A-Z become a-z; bytes above 127 are word bytes.
ALNUM_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def spaced(text: str | None, lower: bool = False) -> list[bytes]:
    """Words between the ASCII white-space characters 09-0D and 20; with ``lower``, A-Z lower-cased."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def alnum(text: str | None) -> list[bytes]:
    """Lower-cased words of ASCII letters, digits and all characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(ALNUM_TABLE).split()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finishing steps of a common 64-bit mixer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _unpowers
    if len(_powers) < n:
        n = 2 * n
        up, down = np.full(n, _BASE), np.full(n, _UNBASE)
        up[0] = down[0] = 1
        _powers, _unpowers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers, _unpowers


def word_hashes(words: list[bytes]) -> np.ndarray:
    """One hash for each word."""
    if not words:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(b" ".join(words), np.uint8)
    n = len(raw)
    up, down = _grown(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    gaps = np.flatnonzero(raw == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [n]))
    return mixed((total[ends] - total[starts]) * down[starts])


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words; empty where there are fewer words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k > 8:  # prefix sums with powers, as for bytes
        up, down = _grown(len(hashes) + 1)
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[: len(hashes)], out=total[1:])
        return mixed((total[k:] - total[:-k]) * down[:n])
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _BASE + hashes[i : i + n]
    return mixed(out)


def window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """The least value of every window of w values, by doubling."""
    size, out = 1, values
    while 2 * size <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return out if size == w else np.minimum(out[: len(values) - w + 1], out[w - size :])
