"""md5 of many strings at once: the keys of `keys`, for Arrow functions that ask for several of a row."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np

#: Fixed values of RFC 1321: state at the start, shifts of a round's four steps, sines.
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]


def _first_words(words: np.ndarray) -> np.ndarray:
    """The first word of each column's digest; 16 rows of words a block."""
    state = [np.full(words.shape[1], x, np.uint32) for x in START]
    f = np.empty_like(state[0])
    for at in range(0, len(words), 16):
        a, b, c, d = (x.copy() for x in state)
        for i in range(64):
            if i < 16:
                k = i
                np.bitwise_xor(np.bitwise_and(np.bitwise_xor(c, d, out=f), b, out=f), d, out=f)
            elif i < 32:
                k = 5 * i + 1
                np.bitwise_xor(np.bitwise_and(np.bitwise_xor(b, c, out=f), d, out=f), c, out=f)
            elif i < 48:
                k = 3 * i + 5
                np.bitwise_xor(np.bitwise_xor(b, c, out=f), d, out=f)
            else:
                k = 7 * i
                np.bitwise_xor(np.bitwise_or(np.invert(d, out=f), b, out=f), c, out=f)
            a += f
            a += words[at + k % 16]
            a += SINES[i]
            shift = SHIFTS[i // 16][i % 4]
            np.left_shift(a, np.uint32(shift), out=f)
            a >>= np.uint32(32 - shift)
            a |= f
            a += b
            a, b, c, d = d, a, b, c
        for x, y in zip(state, (a, b, c, d)):
            x += y
    return state[0]


def first_words(heads: Sequence[bytes], tails: Sequence[bytes]) -> Iterator[np.ndarray]:
    """For one head after the other the first 32 bits of md5(head + tail) of all tails, as numbers."""
    sizes = np.fromiter(map(len, tails), np.int64, len(tails))
    length, parts = -1, []
    for head in heads:
        if len(head) != length:  # heads of like length differ in their first words only
            length, parts = len(head), []
            blocks = (length + sizes + 8) // 64 + 1
            for n in np.unique(blocks):
                rows = np.flatnonzero(blocks == n)
                text = np.array([head + tails[i] for i in rows], f"S{64 * n}").view(np.uint8).reshape(len(rows), 64 * n)
                text[np.arange(len(rows)), length + sizes[rows]] = 0x80
                text[:, -8:] = ((length + sizes[rows]) * 8).astype("<u8").view(np.uint8).reshape(-1, 8)
                parts.append((rows, text, np.ascontiguousarray(text.view("<u4").T)))
        out = np.empty(len(tails), np.uint32)
        for rows, text, words in parts:
            text[:, :length] = np.frombuffer(head, np.uint8)
            k = -(-length // 4)
            words[:k] = text[:, : 4 * k].copy().view("<u4").T
            out[rows] = _first_words(words).byteswap()
        yield out
