"""Monotone integer sequences in Elias-Fano form, searched where they lie (in mapped memory).

A sequence of n values below 2**64 is kept as its low bits, packed side by side, and its high parts in unary
(a one for each value, a zero for each step of the high part), with the number of ones before each 64-bit word.
Nothing is decoded: a lookup selects a bit of the unary words and reads one packed low part.
"""

from __future__ import annotations

import mmap
import struct

import numpy as np

HEAD = struct.Struct("<QQQQ")


ONES, HIGHS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
#: Place of the r-th one of a byte (0 if it has fewer).
IN_BYTE = np.array([[([k for k in range(8) if byte >> k & 1] + [0] * 8)[r] for r in range(8)] for byte in range(256)], np.int64)


def select_in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the rank-th (from 0) one of each 64-bit word: bytewise running counts pick a byte, a table the bit."""
    rank = rank.astype(np.uint64)
    x = word - ((word >> np.uint64(1)) & np.uint64(0x5555555555555555))
    x = (x & np.uint64(0x3333333333333333)) + ((x >> np.uint64(2)) & np.uint64(0x3333333333333333))
    upto = ((x + (x >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * ONES
    byte = np.bitwise_count((((rank * ONES) | HIGHS) - upto) & HIGHS).astype(np.uint64) << np.uint64(3)
    rank -= ((upto << np.uint64(8)) >> byte) & np.uint64(255)
    return byte.astype(np.int64) + IN_BYTE[(word >> byte) & np.uint64(255), rank]


def packed(low: np.ndarray, width: int) -> np.ndarray:
    """`width` low bits of each value side by side, as 64-bit words with one more at the end."""
    words = np.zeros((len(low) * width + 63) // 64 + 1, np.uint64)
    if width:
        out = words.view(np.uint8)
        for at in range(0, len(low), 1 << 15):
            bits = np.unpackbits(low[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :width]
            part = np.packbits(bits.ravel(), bitorder="little")
            out[at * width // 8 : at * width // 8 + len(part)] = part
    return words


class EliasFano:
    @staticmethod
    def build(values: np.ndarray, width: int | None = None, room: int = 0) -> list[bytes]:
        """Head, low words, unary words, ones before each unary word.  A given width keeps that many low bits; `room` high parts have a zero each."""
        n = len(values)
        top = int(values[-1]) if n else 0
        if width is None:
            width = max(0, (top // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        high = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        unary = np.zeros((max(int(high[-1]) if n else 0, n + room) + 2 + 63) // 64 * 64 + 64, bool)
        unary[high] = True
        words = np.packbits(unary, bitorder="little").view("<u8")
        before = np.cumsum(np.bitwise_count(words), dtype=np.uint32) - np.bitwise_count(words).astype(np.uint32)
        low = packed(values & np.uint64((1 << width) - 1), width)
        return [HEAD.pack(n, width, len(low), len(words)), low.tobytes(), words.tobytes(), before.tobytes()]

    def __init__(self, head: bytes, low: np.ndarray, words: np.ndarray, before: np.ndarray):
        self.n, self.width, n_low, n_words = HEAD.unpack(head)
        self.low, self.words, self.before = low.view("<u8")[:n_low], words.view("<u8")[:n_words], before.view("<u4")[:n_words]
        self.mask = np.uint64((1 << self.width) - 1)

    def lows(self, k: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(k), np.uint64)
        bit = k.astype(np.uint64) * np.uint64(self.width)
        word, off = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        return ((self.low[word] >> off) | ((self.low[word + 1] << np.uint64(1)) << (np.uint64(63) - off))) & self.mask

    def at(self, k: np.ndarray) -> np.ndarray:
        """The k-th values (k below n)."""
        word = np.searchsorted(self.before, k.astype(np.uint32), "right") - 1
        one = word * 64 + select_in_word(self.words[word], k - self.before[word])
        return ((one - k).astype(np.uint64) << np.uint64(self.width)) | self.lows(k)

    def run(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[from, to) of the values with that high part: the ones between its zero and the zero before."""
        start, end = np.zeros(len(high), np.int64), np.zeros(len(high), np.int64)
        high = high.astype(np.uint64)
        later = np.flatnonzero(high > 0)
        place = np.full(len(high), -1, np.int64)  # of the zero before the run
        if len(later):
            zero = high[later] - np.uint64(1)
            zeros = np.arange(len(self.words), dtype=np.int64) * 64 - self.before
            there = zero < np.uint64(int(zeros[-1]) + 64 - int(np.bitwise_count(self.words[-1])))
            z = zero[there].astype(np.int64)
            word = np.searchsorted(zeros, z, "right") - 1
            place[later[there]] = at = word * 64 + select_in_word(~self.words[word], z - zeros[word])
            start[later[there]] = at - z
            gone = later[~there]
            start[gone] = end[gone] = self.n
            place[gone] = -2
        todo, at = np.flatnonzero(place > -2), place[place > -2] + 1
        while len(todo):  # ones that follow; a run seldom leaves its word
            word, off = at >> 6, (at & 63).astype(np.uint64)
            inside = word < len(self.words)
            rest = ~(self.words[np.minimum(word, len(self.words) - 1)] >> off) & (np.uint64(2**64 - 1) >> off)
            ones = np.where(rest == 0, 64 - off.astype(np.int64), np.bitwise_count((rest & (~rest + np.uint64(1))) - np.uint64(1)).astype(np.int64))
            end[todo] += np.where(inside, ones, 0)
            on = inside & (rest == 0)
            todo, at = todo[on], at[on] + ones[on]
        known = place > -2
        end[known] += start[known]
        return start, end

    def within(self, low: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Index of the first value in [first, last), all of one high part, whose low part isn't below `low`."""
        a, b = first.copy(), last.copy()
        todo = np.flatnonzero(a < b)
        while len(todo):
            mid = (a[todo] + b[todo]) >> 1
            below = self.lows(mid) < low[todo]
            a[todo[below]] = mid[below] + 1
            b[todo[~below]] = mid[~below]
            todo = todo[a[todo] < b[todo]]
        return a

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value that isn't below x (n if there is none)."""
        x = x.astype(np.uint64)
        return self.within(x & self.mask, *self.run(x >> np.uint64(self.width)))


def mapped(parts: list[bytes]) -> list[np.ndarray]:
    """The parts in one memory map of their own, each on an 8-byte boundary."""
    sizes = [(len(p) + 7) // 8 * 8 for p in parts]
    area = mmap.mmap(-1, max(8, sum(sizes)))
    for p, size in zip(parts, sizes, strict=True):
        area.write(p + bytes(size - len(p)))
    whole, ends = np.frombuffer(area, np.uint8), np.cumsum([0, *sizes])
    return [whole[a : a + len(p)] for a, p in zip(ends[:-1], parts, strict=True)]
