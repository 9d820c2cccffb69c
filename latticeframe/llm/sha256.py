"""SHA-256 with open states, many messages at a time.

A state is a column of an (8, n) array of 32-bit words. ``hashlib`` can copy a running state within one process but can't store
it; here a state is plain data that rows carry. All messages are sequences of hexadecimal digests, so a part is one block of 64
bytes and a state never holds a part of a block.
"""

from __future__ import annotations

import math

import numpy as np


def _cube_root(n: int) -> int:
    x = round(n ** (1 / 3))
    while x**3 > n:
        x -= 1
    while (x + 1) ** 3 <= n:
        x += 1
    return x


PRIMES = [n for n in range(2, 312) if all(n % d for d in range(2, math.isqrt(n) + 1))]
ROUNDS = [np.uint32(_cube_root(p << 96) & 0xFFFFFFFF) for p in PRIMES]
START = np.array([math.isqrt(p << 64) & 0xFFFFFFFF for p in PRIMES[:8]], np.uint32)
_digits = np.frombuffer(b"0123456789abcdef", np.uint8).astype(np.uint32)
_all = np.arange(1 << 16)
HEX = (_digits[_all >> 12] << 24) | (_digits[(_all >> 8) & 15] << 16) | (_digits[(_all >> 4) & 15] << 8) | _digits[_all & 15]


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def fresh(n: int) -> np.ndarray:
    """The state before any part, n times."""
    return np.repeat(START[:, None], n, axis=1)


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """States after one more block of 16 words each."""
    w = list(block)
    for t in range(16, 64):
        x, y = w[t - 15], w[t - 2]
        small = _turned(x, 7) ^ _turned(x, 18) ^ (x >> np.uint32(3))
        large = _turned(y, 17) ^ _turned(y, 19) ^ (y >> np.uint32(10))
        w.append(w[t - 16] + small + w[t - 7] + large)
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        one = h + (_turned(e, 6) ^ _turned(e, 11) ^ _turned(e, 25)) + (g ^ (e & (f ^ g))) + (ROUNDS[t] + w[t])
        two = (_turned(a, 2) ^ _turned(a, 13) ^ _turned(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def hex_block(digests: np.ndarray) -> np.ndarray:
    """The block that holds each digest as 64 hexadecimal digits."""
    return np.stack([HEX[(digests[j // 2] >> np.uint32(0 if j % 2 else 16)) & np.uint32(0xFFFF)] for j in range(16)])


def finish(state: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Digests of messages of so many parts."""
    block = np.zeros((16, state.shape[1]), np.uint32)
    block[0] = np.uint32(1 << 31)
    block[14] = (parts.astype(np.uint64) >> np.uint64(23)).astype(np.uint32)
    block[15] = (parts.astype(np.uint64) << np.uint64(9)).astype(np.uint32)
    return compress(state, block)


def resume(state: np.ndarray, digests: np.ndarray, on: np.ndarray) -> np.ndarray:
    """States after one more digest each where ``on``; unchanged elsewhere. ``digests``: those of the rows that are on."""
    if not on.any():
        return state
    out = state.copy()
    out[:, on] = compress(state[:, on], hex_block(digests))
    return out


def to_words(values: list[bytes]) -> np.ndarray:
    """Stored states or digests as an (8, n) array."""
    return np.frombuffer(b"".join(values), ">u4").reshape(-1, 8).T.astype(np.uint32)


def to_bytes(words: np.ndarray) -> list[bytes]:
    flat = np.ascontiguousarray(words.T).astype(">u4").tobytes()
    return [flat[i : i + 32] for i in range(0, len(flat), 32)]
