"""Words of whole texts as 64-bit hashes, made by numpy over Arrow buffers inside tasks.

Words are runs of bytes other than space and \\x09-\\x0D. A word's hash is a polynomial over random
values of its bytes, taken from prefix sums, then mixed; n-grams mix the hashes of their words.
All arithmetic wraps at 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text turned into words at once.
CHUNK = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_LOWERED = _BYTES.copy()
_LOWERED[65:91] = _BYTES[97:123]
_PLACES = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
_powers = {"n": 0, "up": None, "down": None}


def _power_tables(n: int):
    if _powers["n"] < n:
        n = max(n, CHUNK + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
        _powers["n"] = n
    return _powers["up"], _powers["down"]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and where each begins; null is empty."""
    texts = pc.fill_null(texts, "")
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """``hash`` of each word in order; ``bounds[i]:bounds[i + 1]`` are the words of text i;
    ``starts`` and ``ends`` are byte places in ``data``."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        data, offsets = text_bytes(texts)
        self.data, n = data, len(data)
        word = ~_SPACE[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        begins, ends = offsets[:-1], offsets[1:]
        full = ends > begins
        before[begins[full]] = False
        after[ends[full] - 1] = False
        self.starts = np.flatnonzero(word & ~before)
        self.ends = np.flatnonzero(word & ~after) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        up, down = _power_tables(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_LOWERED if lower else _BYTES)[data] * up[:n], out=sums[1:])
        self.hash = mix((sums[self.ends] - sums[self.starts]) * down[self.starts])

    def __len__(self):
        return len(self.bounds) - 1

    def grams(self, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the k words from each word on, whether they all lie in its text)."""
        return grams(self.hash, self.bounds, k, seed)


def gram_hash(words: np.ndarray, n: int, k: int, seed: int = 0) -> np.ndarray:
    total = np.full(n, (k * 0x9E3779B97F4A7C15 + seed * 0xE7037ED1A0B428DB) & (2**64 - 1), np.uint64)
    for i in range(k):
        total += words[i : i + n] * _PLACES[(i + 7 * seed) % len(_PLACES)]
    return mix(total)


def grams(words: np.ndarray, bounds: np.ndarray, k: int, seed: int = 0):
    n = max(0, len(words) - k + 1)
    ends = np.repeat(bounds[1:], np.diff(bounds))[:n]
    return gram_hash(words, n, k, seed), np.arange(n) + k <= ends
