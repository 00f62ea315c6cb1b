"""Vectorised hashing of words and byte windows, used inside tasks.

A text is handled as a NumPy byte array. Hashes of words and of byte windows are differences of one prefix polynomial
over the text (arithmetic modulo 2**64), so their cost does not depend on the lengths.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {}
_random = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
POSITION_FACTORS = _random.integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: White space of the word definition [^\x20\x09-\x0D]+
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Every ASCII byte that is neither a letter nor a digit separates words here.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[128:] = False
PUNCTUATION[48:58] = PUNCTUATION[65:91] = PUNCTUATION[97:123] = False
#: Rows of a batch of texts that a task takes apart at once: whole batches as Python objects would be most of a worker's memory.
TOGETHER = 500


def small(batches):
    """Batches of at most TOGETHER rows, without copies."""
    for batch in batches:
        for k in range(0, batch.num_rows, TOGETHER):
            yield batch.slice(k, TOGETHER)


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for reuse."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(4096, 1 << (max(n, 1) - 1).bit_length())
        have = np.ones(size, U64)
        have[1:] = U64(base)
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def inverse_powers(n: int) -> np.ndarray:
    return powers(n, _INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix_polynomial(data: np.ndarray) -> np.ndarray:
    """c with c[j]-c[i] = sum of value(data[k]) * base**k for i <= k < j."""
    c = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_VALUES[data] * powers(len(data)), out=c[1:])
    return c


def as_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def word_spans(data: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are not separators."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~separators[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(data: np.ndarray, separators: np.ndarray = SPACE) -> np.ndarray:
    """A 64-bit hash of every word of the lower-cased text, in order."""
    data = LOWER[data]
    start, end = word_spans(data, separators)
    if not len(start):
        return np.zeros(0, U64)
    c = prefix_polynomial(data)
    return mix((c[end] - c[start]) * inverse_powers(len(data))[start] + (end - start).astype(U64))


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of `words` words; of the whole sequence if it is shorter; empty without words."""
    w = word_hashes(as_bytes(text))
    n = len(w)
    if n == 0:
        return w
    if n < words:
        return mix(np.array([(w * POSITION_FACTORS[:n]).sum(dtype=U64) + U64(n)]))
    total = w[: n - words + 1] * POSITION_FACTORS[0]
    for k in range(1, words):
        total += w[k : n - words + 1 + k] * POSITION_FACTORS[k]
    return np.unique(mix(total))


def set_key(values: np.ndarray) -> int:
    """A signed 64-bit key of a sorted hash set."""
    n = len(values)
    h = mix(values * (powers(n) | U64(1))).sum(dtype=U64) + U64(n)
    return int(mix(np.array([h])).astype(np.int64)[0])
