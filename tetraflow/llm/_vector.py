"""Vectorised words and polynomial hashes over bytes (numpy, modulo 2**64)."""

from __future__ import annotations

import hashlib

import numpy as np

#: Longer words are hashed by BLAKE2b: modulo 2**64 a polynomial is weak where its degree is high.
LONG_WORD = 32
#: The separators of a word: space and the five control characters from tab to return.
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"

_GROWN: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64, by doubling."""
    out = np.ones(max(1, n), dtype=np.uint64)
    done, step = 1, base
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(step)
        done, step = done + more, step * step % 2**64
    return out


def _tables(seed: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per byte a random word; powers of an odd base, and of its inverse, for n bytes."""
    rng = np.random.Generator(np.random.PCG64(seed))
    letters = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = (int(rng.integers(2**40, 2**60)) << 3) | 5
    size = 1 << max(16, int(n - 1).bit_length())
    if seed not in _GROWN or len(_GROWN[seed][0]) < n:
        _GROWN[seed] = _powers(base, size), _powers(pow(base, -1, 2**64), size)
    up, down = _GROWN[seed]
    return letters, up, down


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_spans(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that belong to words."""
    inside = np.empty(len(data) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    np.take(is_word, data, out=inside[1:-1])
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes, mixed; of a long word a keyed digest."""
    letters, up, down = _tables(seed, len(data) + 1)
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(letters[data] * up[: len(data)], out=sums[1:])
    out = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        word = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little"))
        out[i] = int.from_bytes(word.digest(), "little")
    return out


def rolling(words: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Rabin-Karp hashes of every ``width`` consecutive words, in log(width) steps."""
    rng = np.random.Generator(np.random.PCG64(seed + 1))
    base = (int(rng.integers(2**40, 2**60)) << 3) | 5
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    block, size, out, done = words, 1, None, 0
    while True:
        if width & size:
            part = block[: len(words) - size + 1]
            if out is None:
                out, done = part, size
            else:
                keep = len(words) - (done + size) + 1
                out = out[:keep] * np.uint64(pow(base, size, 2**64)) + part[done : done + keep]
                done += size
        if size * 2 > width:
            return mix(out[:n].copy())
        keep = len(words) - 2 * size + 1
        block = block[:keep] * np.uint64(pow(base, size, 2**64)) + block[size : size + keep]
        size *= 2


def separated_by(separators: bytes) -> np.ndarray:
    """For each byte 1 if it belongs to a word, else 0."""
    table = np.ones(256, dtype=np.int8)
    table[list(separators)] = 0
    return table
