"""Word shingles as 64-bit hashes, computed over flat byte arrays. No hash is linear in the bytes, so no texts are known to collide.

Words are what ``[^\\x20\\x09-\\x0D]+`` matches, optionally with A-Z in lower case. A text with fewer words than a shingle has its
whole sequence as one shingle; a text without words has none.
"""

from __future__ import annotations

import hashlib

import numpy as np

_STEP = np.uint64(0xD6E8FEB86659FD93)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BELOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # masks of the lowest k bytes


def identities(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell byte ranges of one length apart: up to 16 bytes the bytes themselves, beyond that their BLAKE2 digest."""
    sizes = ends - starts
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    lanes = np.ndarray(len(data) + 9, "<u8", padded, strides=(1,))  # eight bytes from each place
    low = lanes[starts] & _BELOW[np.minimum(sizes, 8)]
    high = np.zeros(len(starts), np.uint64)
    more = np.flatnonzero(sizes > 8)
    high[more] = lanes[starts[more] + 8] & _BELOW[np.minimum(sizes[more] - 8, 8)]
    long = np.flatnonzero(sizes > 16)
    if len(long):
        view = memoryview(np.ascontiguousarray(data))
        digests = b"".join([hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)])
        low[long], high[long] = np.frombuffer(digests, "<u8").reshape(-1, 2).T
    return low, high


def hash_identities(low: np.ndarray, high: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return mix(low + mix(high + mix(sizes.astype(np.uint64) + np.uint64(1))))


def word_hashes(texts: list[str], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, text after text, and the bounds of each text's words (one more than texts)."""
    encoded = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
    if lower:
        data = _LOWER[data]
    blank = _BLANK[data]
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    ends = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
    hashes = hash_identities(*identities(data, starts, ends), ends - starts)
    text_starts = np.concatenate([[0], np.cumsum([len(e) + 1 for e in encoded])])
    return hashes, np.searchsorted(starts, text_starts)


def shingle_hashes(texts: list[str], size: int, lower: bool = False) -> list[np.ndarray]:
    """The shingles of every text in their order, repeats included."""
    words, bounds = word_hashes(texts, lower)
    n = len(words)
    full = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        full = mix(full * _STEP + words[k : n - size + 1 + k])
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(full[a : b - size + 1])
            continue
        whole = np.zeros(min(1, b - a), np.uint64)
        for k in range(a, b):
            whole = mix(whole * _STEP + words[k])
        out.append(mix(whole + np.uint64(b - a)))
    return out
