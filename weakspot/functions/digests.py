"""MD5 of many short texts at once, in numpy: the tasks' form of what hash_number() gives one text at a time."""

from __future__ import annotations

import math

import numpy as np

_K = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_PLACE = [lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Texts hashed in one go, so that the state stays in the cache.
CHUNK = 16384


def _block(state: list, words: list) -> list:
    """The state after one block of 16 words; words and state are arrays, or ints where all texts agree."""
    a, b, c, d = state
    with np.errstate(over="ignore"):
        for i in range(64):
            q = i // 16
            f = (d ^ (b & (c ^ d))) if q == 0 else (c ^ (d & (b ^ c))) if q == 1 else (b ^ c ^ d) if q == 2 else (c ^ (b | (d ^ np.uint32(0xFFFFFFFF))))
            w = words[_PLACE[q](i)]
            k = np.uint32((_K[i] + int(w)) & 0xFFFFFFFF) if isinstance(w, int) else w + np.uint32(_K[i])
            f = f + a
            f += k
            s = _TURNS[q][i % 4]
            turned = f << np.uint32(s)
            f >>= np.uint32(32 - s)
            turned |= f
            turned += b
            a, b, c, d = d, turned, b, c
        return [x + y for x, y in zip(state, (a, b, c, d), strict=True)]


def hash_numbers(heads: list[bytes], tails: list[bytes]):
    """Yields (place of the tail, places of heads, numbers): for each text head + tail the number that hash_number() gives it.

    The numbers are the first 32 bits of the text's MD5, as uint32. Heads are taken by length, CHUNK at a time.
    """
    lengths = np.array([len(h) for h in heads], dtype=np.int64)
    for length in np.unique(lengths).tolist():
        same = np.flatnonzero(lengths == length)
        for at in range(0, len(same), CHUNK):
            places = same[at : at + CHUNK]
            text = np.frombuffer(b"".join([heads[i] for i in places]), dtype=np.uint8).reshape(len(places), length)
            for size in {len(t) for t in tails}:
                full = length + size
                blocks = (full + 8) // 64 + 1
                padded = np.zeros((len(places), 64 * blocks), dtype=np.uint8)
                padded[:, :length] = text
                padded[:, full] = 0x80
                padded[:, -8:] = np.frombuffer((8 * full).to_bytes(8, "little"), dtype=np.uint8)
                table = np.ascontiguousarray(padded.view("<u4").T)
                first, last = length // 4, -(-full // 4)  # words that a tail touches
                for t, tail in enumerate(tails):
                    if len(tail) != size:
                        continue
                    end = np.zeros(4 * (last - first), dtype=np.uint8)
                    end[length - 4 * first : full - 4 * first] = np.frombuffer(tail, dtype=np.uint8)
                    added = end.view("<u4")
                    state = [np.full(len(places), x, dtype=np.uint32) for x in _START]
                    for block in range(blocks):
                        words: list = []
                        for j in range(16 * block, 16 * block + 16):
                            if first <= j < last:
                                words.append(table[j] | added[j - first])
                            else:
                                words.append(table[j] if 4 * j < length else int(table[j, 0]))
                        state = _block(state, words)
                    yield t, places, state[0].byteswap()
