"""64-bit hashes of the words and word shingles of whole texts, computed over byte arrays.

Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lowered.  A
word's hash is a polynomial over random values of its bytes, taken from
running sums, so no word is ever cut out of its text.
"""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[0x41:0x5B] += 32
_EXACT = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_VALUE = _EXACT[_LOWER]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 20
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, value: np.ndarray = _EXACT) -> np.ndarray:
    """Hashes of the spans [start, end) of a byte array, which don't overlap and ascend."""
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        # spans up to about _CHUNK bytes from the first one's start
        at = int(starts[k])
        last = max(k + 1, int(np.searchsorted(ends, at + _CHUNK, "right")))
        end = int(ends[last - 1])
        up, down = _power(max(_CHUNK, end - at))
        run = np.empty(end - at + 1, np.uint64)
        run[0] = 0
        np.cumsum(value[data[at:end]] * up[: end - at], out=run[1:])
        s, e = starts[k:last] - at, ends[k:last] - at
        out[k:last] = mix((run[e] - run[s]) * down[s])
        k = last
    return out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    out = span_hashes(data, starts, ends, _VALUE)
    sizes = np.array([len(x) + 1 for x in texts])
    bound = np.cumsum(sizes)
    upto = np.searchsorted(starts, bound, "left")
    return out, np.diff(np.concatenate([[0], upto]))


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of a sequence of hashes."""
    h = np.full(len(parts[0]), len(parts), np.uint64)
    for p in parts:
        h = mix((h + p) * np.uint64(_BASE))
    return h


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of ``width`` words; a shorter text is one shingle, an empty one none."""
    words, counts = word_hashes(texts)
    rolled = combine([words[k : len(words) - width + 1 + k] for k in range(width)]) if len(words) >= width else np.zeros(0, np.uint64)
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            s = np.sort(rolled[at : at + n - width + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif n:
            out.append(combine([words[at + k : at + k + 1] for k in range(n)]))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out
