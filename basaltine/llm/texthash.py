"""64-bit hashes of the words of many texts at once, in numpy.

A word's hash is a polynomial over its bytes, modulo 2^64, with a random 64-bit value for each byte value; it is read
off prefix sums, so there is no loop over words. Words are parted by [\x20\x09-\x0D].
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


mix = _mix
_VALUES = _mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95)) | _U(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n at least."""
    if not _powers or len(_powers[0]) < n:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
        del _powers[:-2]
    return _powers[0], _powers[1]


def _piece(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of one piece."""
    a = np.frombuffer(raw, dtype=np.uint8)
    word = np.zeros(len(a) + 2, dtype=np.int8)
    word[1:-1] = ~_SPACE[a]
    change = np.diff(word)
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    up, down = _power(max(len(a) + 1, PIECE + 1))
    sums = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[a] * up[: len(a)], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def word_hashes(raw: bytes) -> np.ndarray:
    """Hashes of the words of a text, in order. Long texts are cut at white space."""
    if len(raw) <= PIECE:
        return _piece(raw)[0]
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        out.append(_piece(raw[at:end])[0])
        at = end
    return np.concatenate(out)


def word_hashes_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's words begin (one entry more than texts)."""
    hashes, bounds, group, size = [], [np.zeros(1, np.int64)], [], 0

    def flush() -> None:
        nonlocal group, size
        joined = b"\n".join(group)
        h, starts = _piece(joined) if len(joined) <= 2 * PIECE else (word_hashes(joined), None)
        if starts is None:
            counts = np.array([len(word_hashes(t)) for t in group])
        else:
            edges = np.cumsum([len(t) + 1 for t in group])
            counts = np.diff(np.searchsorted(starts, edges), prepend=0)
        hashes.append(h)
        bounds.append(counts)
        group, size = [], 0

    for t in texts:
        if size + len(t) > PIECE and group:
            flush()
        group.append(t)
        size += len(t) + 1
    if group:
        flush()
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), np.cumsum(np.concatenate(bounds))


_COEFFICIENTS = _mix(np.arange(1, 1025, dtype=np.uint64)) | _U(1)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word shingles at each position; of the whole sequence, if it is shorter and not empty."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = words[: len(words) - n + 1] * _COEFFICIENTS[0]
    for k in range(1, n):
        out = out + words[k : len(words) - n + 1 + k] * _COEFFICIENTS[k]
    return _mix(out + _U(n))
