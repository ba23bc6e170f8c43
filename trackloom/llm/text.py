"""Word splitting and hashing shared by the corpus operators.  All of it runs inside Spark tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes whose hashes are made together.
SEGMENT = 500_000

#: Maps every ASCII byte outside 0-9, A-Z, a-z to a space and lower-cases A-Z; bytes from 0x80 on stay.
_ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


#: Bytes that are no white space.
_BLACK = np.array([c not in b" \t\n\x0b\x0c\r" for c in range(256)])


def alnum_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, as UTF-8."""
    return text.translate(_ALNUM).split()


def space_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``, as UTF-8."""
    return text.split()


def slices(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of each run of true values."""
    edge = np.flatnonzero(np.diff(mask, prepend=False, append=False))
    return edge[0::2], edge[1::2] - edge[0::2]


def utf8(column: pa.Array) -> list[bytes]:
    """A string column as bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class WordHashes:
    """Word hashes of texts, the same in every process, without making the words."""

    def __init__(self, alnum: bool = False, lower: bool = False):
        """Words as alnum_words gives them, or as space_words does (of the lower-cased text)."""
        self.alnum, self.lower, self.prefix = alnum, lower, Prefix(BASES[0])

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words one after the other, and how many each text has."""
        found, at = [], 0
        while at < len(texts):
            upto, held = at, 0
            while upto < len(texts) and (upto == at or held + len(texts[upto]) <= SEGMENT):
                held += len(texts[upto])
                upto += 1
            found.append(self._some(texts[at:upto]))
            at = upto
        return (np.concatenate([h for h, _ in found]), np.concatenate([n for _, n in found])) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def _some(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        blob = b" ".join([*texts, b""])
        blob = blob.translate(_ALNUM) if self.alnum else blob.lower() if self.lower else blob
        x = np.frombuffer(blob, np.uint8)
        start, size = slices(_BLACK[x])
        ends = np.cumsum([len(t) + 1 for t in texts])
        return self.prefix(x, start, size), np.bincount(np.searchsorted(ends, start, "right"), minlength=len(texts))


class Rolling:
    """Rabin-Karp hashes modulo 2**64 of all windows of n items, by prefix sums.

    The value of the window at i is sum(x[i+k] * base**k); dividing the difference of two prefix
    sums by base**i (base is odd, so it has an inverse) gives all of them in a few array passes.
    """

    def __init__(self, n: int, base: int):
        self.n, self.base, self.inverse = n, base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if len(x) < self.n:
            return np.zeros(0, np.uint64)
        if len(self.up) < len(x):
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(len(x) * 5 // 4, b, np.uint64)], dtype=np.uint64) for b in (self.base, self.inverse))
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * self.up[: len(x)], out=total[1:])
        return (total[self.n :] - total[: -self.n]) * self.down[: len(x) - self.n + 1]


class Prefix:
    """Hashes modulo 2**64 of any slices of bytes, by the same prefix sums; the length of a slice counts."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, x: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """start: ascending."""
        if len(x) <= 2 * SEGMENT or not len(start):
            return self._some(x, start, size)
        edge = np.searchsorted(start, np.arange(0, len(x), SEGMENT))
        return np.concatenate([self._some(x[start[a] : start[b - 1] + size[b - 1]], start[a:b] - start[a], size[a:b]) for a, b in zip(edge, [*edge[1:], len(start)]) if b > a])

    def _some(self, x: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        if len(self.up) < len(x) + 1:
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(len(x) * 5 // 4 + 1, b, np.uint64)], dtype=np.uint64) for b in (self.base, self.inverse))
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * self.up[: len(x)], out=total[1:])
        h = (total[start + size] - total[start]) * self.down[start] + size.astype(np.uint64) * np.uint64(BASES[1])
        return (h ^ (h >> np.uint64(31))) * np.uint64(BASES[1]) >> np.uint64(1)


#: Odd multipliers of the two independent rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def starts_in_documents(counts: np.ndarray, n: int) -> np.ndarray:
    """Start positions, in concatenated documents of so many words, of windows of n words that cross no border."""
    per = np.maximum(counts - n + 1, 0)
    first = np.repeat(np.cumsum(counts) - counts - (np.cumsum(per) - per), per)
    return first + np.arange(len(first))


class Places:
    """64-bit keys -> numbers from 0 on in order of arrival, looked up and learned for whole arrays (open addressing)."""

    _FREE = np.uint64((1 << 64) - 1)

    def __init__(self, most: int):
        """Room for this many keys."""
        bits = max(4, (2 * most).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.place, self.size = np.full(1 << bits, self._FREE), np.full(1 << bits, -1, np.int32), 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for unknown ones."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.place[slot], np.int32(-1))
        left = np.flatnonzero((there != keys) & (there != self._FREE))
        while len(left):
            slot[left] = slot[left] + 1 & self.mask
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self.place[slot[left[hit]]]
            left = left[~hit & (there != self._FREE)]
        return out

    def learn(self, keys: np.ndarray) -> None:
        """Adds keys that are distinct and unknown."""
        place = np.arange(self.size, self.size + len(keys), dtype=np.int32)
        self.size += len(keys)
        slot = self._slot(keys)
        while len(keys):  # the first key of each free slot takes it, the others try the next one
            first = np.zeros(len(keys), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            first &= self.keys[slot] == self._FREE
            self.keys[slot[first]], self.place[slot[first]] = keys[first], place[first]
            keys, place, slot = keys[~first], place[~first], slot[~first] + 1 & self.mask


def ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges one after the other, and which range each is of."""
    n = stop - start
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + start[of], of


#: Bytes of letters after lower-casing A-Z: a-z, and all from 0x80 on.
_LETTERS = np.array([97 <= c <= 122 or c >= 128 for c in range(256)])


def letter_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[a-z\\x80-]+`` of texts after lower-casing A-Z: the bytes of all texts, and of each word its start and size in them and its text."""
    x = np.frombuffer(b"\0".join([*texts, b""]).lower(), np.uint8)
    start, size = slices(_LETTERS[x])
    ends = np.cumsum([len(t) + 1 for t in texts])
    return x, start, size, np.searchsorted(ends, start, "right")
