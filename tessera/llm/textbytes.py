"""Word hashes of many texts at once, over their concatenated bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_P = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, kept between calls."""
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for k, base in enumerate((_P, pow(_P, -1, 1 << 64))):
                _powers[k] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))])
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ np.uint64(salt & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(29))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words between white space, the number of words of each text)."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    power, inverse = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1])])
        words = mix((sums[last] - sums[first]) * inverse[first])
    return words, np.diff(np.searchsorted(first, ends), prepend=0)


def chunks(texts: list[str], size: int = 2 << 20) -> Iterator[list[bytes]]:
    """The texts as UTF-8, in lists of about `size` bytes."""
    part, n = [], 0
    for t in texts:
        raw = t.encode()
        if part and n + len(raw) > size:
            yield part
            part, n = [], 0
        part.append(raw)
        n += len(raw)
    if part:
        yield part
