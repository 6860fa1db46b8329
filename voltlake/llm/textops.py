"""Vectorised byte operations on one text: word bounds and 64-bit hashes of words and of word sequences."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
PIECE = 1 << 20  # bytes hashed at once, so that a very long text needs little memory
CACHED = 1 << 15  # bytes hashed at once where words are short: arrays of this length stay in a core's cache

#: ASCII lower case; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: U) -> np.ndarray:
    out = np.full(PIECE, base, dtype=U)
    out[0] = U(1)
    return np.multiply.accumulate(out)


def powers() -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i below PIECE, made once a process."""
    global _POWERS
    if _POWERS is None:
        _POWERS = (_powers(BASE), _powers(U(pow(int(BASE), -1, 1 << 64))))
    return _POWERS


_POWERS = None


def table(members: str | bytes) -> np.ndarray:
    """Flags of 256 byte values."""
    out = np.zeros(256, dtype=bool)
    out[np.frombuffer(members if isinstance(members, bytes) else members.encode(), dtype=np.uint8)] = True
    return out


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of every word, from differences of prefix sums; words may overlap, their starts are in order."""
    out = np.empty(len(starts), dtype=U)
    up, down = powers()
    first = 0
    while first < len(starts):
        at = int(starts[first])
        last = max(first + 1, int(np.searchsorted(ends, at + CACHED, side="right")))
        if ends[last - 1] - at > PIECE:  # a word longer than a piece
            out[first] = _long_word(buf, at, int(ends[first]))
            first += 1
            continue
        part = buf[at: int(ends[last - 1])]
        sums = np.zeros(len(part) + 1, dtype=U)
        np.cumsum((part + U(1)) * up[: len(part)], out=sums[1:])
        a, b = starts[first:last] - at, ends[first:last] - at
        out[first:last] = mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(U))
        first = last
    return out


def gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from every place: eight bytes are a number, and neighbouring runs are joined until they are long enough."""
    if gram < 8 or gram & (gram - 1):
        at = np.arange(len(buf) - gram + 1)
        return word_hashes(buf, at, at + gram)
    buf = np.ascontiguousarray(buf)
    out, size, base = np.ndarray((len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,)), 8, int(BASE)
    while size < gram:
        out = out[:-size] * U(base) + out[size:]
        size, base = 2 * size, base * base % (1 << 64)
    return mixed(out)


def _long_word(buf: np.ndarray, start: int, end: int) -> U:
    """The same hash, added up over pieces."""
    up, total = powers()[0], 0
    for k in range(start, end, PIECE):
        part = buf[k: min(k + PIECE, end)]
        total += int(np.sum((part + U(1)) * up[: len(part)])) * pow(int(BASE), k - start, 1 << 64)
    return mixed(np.array([(total + end - start) & ((1 << 64) - 1)], dtype=U))[0]


def sequences(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, dtype=U)
    out = words[:m].copy()
    for k in range(1, n):
        out = mixed(out * BASE + words[k: m + k])
    return out
