"""SHA-256 over many messages at once, with its chaining states in the open.

The library's digests are opaque, so a hash that has to be resumed in another task is kept as its chaining value: every message here is a sequence of 64-byte
blocks (digests as hex text), so a state between blocks is eight 32-bit words and nothing else.
"""

from __future__ import annotations

from math import isqrt

import numpy as np

_M = 0xFFFFFFFF


def _primes(n: int) -> list[int]:
    found: list[int] = []
    p = 2
    while len(found) < n:
        if all(p % q for q in found):
            found.append(p)
        p += 1
    return found


def _cube_root(x: int) -> int:
    low, high = 0, 1 << (x.bit_length() // 3 + 1)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if mid**3 <= x else (low, mid - 1)
    return low


#: The standard's constants: the first 32 bits of the fractional parts of the square roots of 8 primes and of the cube roots of 64.
START = np.array([isqrt(p << 64) & _M for p in _primes(8)], np.uint32)
_ROUND = np.array([_cube_root(p << 96) & _M for p in _primes(64)], np.uint32)
_HEX = np.frombuffer(bytes(range(256)).hex().encode(), np.uint8).reshape(256, 2)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> n) | (x << (32 - n))


def start(n: int) -> np.ndarray:
    """The states of ``n`` hashes that have read nothing: words in rows, messages in columns."""
    return np.repeat(START[:, None], n, axis=1)


def absorb(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The states (8, n) after one more block (16, n) each."""
    w = list(blocks)
    a, b, c, d, e, f, g, h = states
    for t in range(64):
        k = t % 16
        if t >= 16:
            x, y = w[(t - 15) % 16], w[(t - 2) % 16]
            w[k] = w[k] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> 3)) + w[(t - 7) % 16] + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> 10))
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + _ROUND[t] + w[k]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return states + np.stack([a, b, c, d, e, f, g, h])


def hex_text(digests: np.ndarray) -> np.ndarray:
    """(n, 32) bytes as (n, 64) letters."""
    return _HEX[digests].reshape(len(digests), 64)


def hex_blocks(digests: np.ndarray) -> np.ndarray:
    """Digests as the blocks (16, n) that their hex text is."""
    return np.ascontiguousarray(hex_text(digests).view(">u4").astype(np.uint32).T)


def to_bytes(states: np.ndarray) -> np.ndarray:
    """States (8, n) as (n, 32) bytes."""
    return np.ascontiguousarray(states.T.astype(">u4")).view(np.uint8).reshape(-1, 32)


def from_bytes(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.ascontiguousarray(raw).view(">u4").reshape(-1, 8).astype(np.uint32).T)


def finish(states: np.ndarray, n_blocks: np.ndarray) -> np.ndarray:
    """The digests (n, 32) of messages that end here, after so many blocks each."""
    last = np.zeros((16, states.shape[1]), np.uint32)
    bits = n_blocks.astype(np.uint64) * np.uint64(512)
    last[0], last[14], last[15] = 1 << 31, bits >> np.uint64(32), bits & np.uint64(_M)
    return to_bytes(absorb(states, last))
