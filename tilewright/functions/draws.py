"""The numbers that `hashing` draws, in numpy: many texts `seed:id:number:...` are hashed side by side inside a task."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

BLOCK = 16_384  # texts hashed side by side
ROOM = 55  # longest text that one block of MD5 holds
KINDS = ("tinyint", "smallint", "int", "bigint", "string")  # types of ids whose text is the same here and in Spark
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
TERMS = [int(abs(np.sin(np.float64(i + 1))) * 2**32) for i in range(64)]
POWERS = 10 ** np.arange(19)


def _rounds(words: list[np.ndarray | int]) -> list[np.ndarray]:
    """MD5 of one block each: the four words of the digests from the sixteen words of the blocks."""
    n = next(len(w) for w in words if not isinstance(w, int))
    a, b, c, d = (np.full(n, v, np.uint32) for v in START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            g = 7 * i % 16
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        word = words[g]
        f += a
        if isinstance(word, int):
            f += np.uint32((TERMS[i] + word) & 0xFFFFFFFF)
        else:
            f += np.uint32(TERMS[i])
            f += word
        np.left_shift(f, SHIFTS[i], out=t)
        np.right_shift(f, 32 - SHIFTS[i], out=f)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    return [x + np.uint32(s) for x, s in zip((a, b, c, d), START)]


class Ids:
    """The texts of a column of ids, ready to be hashed behind a seed and before numbers."""

    def __init__(self, ids: pa.Array):
        self.ids = ids = ids.cast(pa.large_string())
        ends = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        text = np.frombuffer(ids.buffers()[2] or b"", np.uint8)
        self.length = np.diff(ends)
        width = int(min(ROOM, self.length.max(initial=0)))
        place = np.arange(width)
        inside = place < self.length[:, None]
        self.letters = np.zeros((len(ids), width), np.uint8)
        self.letters[inside] = text[(ends[:-1, None] + place)[inside]]

    def digest(self, seed: str, at: np.ndarray, *numbers: np.ndarray, first: bool = False) -> np.ndarray:
        """The digests of `seed:id:number:...` as columns of big-endian words, or the first word only; numbers are not negative."""
        out = np.empty((1 if first else 4, len(at)), np.uint32)
        numbers = [v.astype(np.uint32) if v.max(initial=0) < 1 << 32 else v for v in numbers]  # narrow ones are divided faster
        digits = [np.maximum(1, np.searchsorted(POWERS, v, "right")) for v in numbers]
        shape = self.length[at]
        for d in digits:
            shape = shape * 20 + d
        for kind in np.flatnonzero(np.bincount(shape)) if len(at) and shape.max() < 1 << 24 else np.unique(shape):
            rows = np.flatnonzero(shape == kind)
            sizes = [int(d[rows[0]]) for d in digits]
            own = int(self.length[at[rows[0]]])
            if len(seed.encode()) + 1 + own + sum(sizes) + len(sizes) > ROOM:
                out[:, rows] = self._long(seed, at[rows], [v[rows] for v in numbers])[: len(out)]
                continue
            for lo in range(0, len(rows), BLOCK):
                part = rows[lo : lo + BLOCK]
                found = _rounds(self._words(seed, at[part], own, [v[part] for v in numbers], sizes))
                for i in range(len(out)):
                    out[i, part] = found[i].byteswap()
        return out[0] if first else out

    def _words(self, seed: str, at: np.ndarray, own: int, numbers: list[np.ndarray], sizes: list[int]) -> list[np.ndarray | int]:
        head = f"{seed}:".encode()
        size = len(head) + own + sum(sizes) + len(sizes)
        letters = np.zeros((len(at), 4 * (size // 4 + 1)), np.uint8)  # one place at least is left for the mark behind the text
        letters[:, : len(head)] = np.frombuffer(head, np.uint8)
        letters[:, len(head) : len(head) + own] = self.letters[at, :own]
        place = len(head) + own
        for v, n in zip(numbers, sizes):
            letters[:, place] = ord(":")
            for k in range(n):
                letters[:, place + 1 + k] = v // v.dtype.type(POWERS[n - 1 - k]) % v.dtype.type(10) + ord("0")
            place += 1 + n
        letters[:, place] = 0x80
        known = np.ascontiguousarray(letters.view("<u4").T)
        return [*known, *[0] * (14 - len(known)), 8 * size, 0]

    def _long(self, seed: str, at: np.ndarray, numbers: list[np.ndarray]) -> np.ndarray:
        texts = [":".join([seed, self.ids[int(i)].as_py(), *map(str, key)]) for i, *key in zip(at.tolist(), *[v.tolist() for v in numbers])]
        return np.frombuffer(b"".join(hashlib.md5(t.encode()).digest() for t in texts), ">u4").reshape(-1, 4).T

    def number(self, seed: str, at: np.ndarray, *numbers: np.ndarray) -> np.ndarray:
        """`hashing.hash_int` of the same seed, id and numbers."""
        return (self.digest(seed, at, *numbers, first=True) >> 4).astype(np.int64)
