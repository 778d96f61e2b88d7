"""Sorted whole numbers in Elias-Fano form, searched many at a time."""

import mmap
import tempfile

import numpy as np


def _nth_bit(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The place of the ``n``-th set bit (from 0) of each word, by halving."""
    place, left, words = np.zeros(len(n), np.int64), n.astype(np.int64), words.copy()
    for width in (32, 16, 8, 4, 2, 1):
        lower = words & np.uint64((1 << width) - 1)
        count = np.bitwise_count(lower).astype(np.int64)
        up = left >= count
        place += np.where(up, width, 0)
        left -= np.where(up, count, 0)
        words = np.where(up, words >> np.uint64(width), lower)
    return place


class EliasFano:
    """A non-decreasing sequence: low bits as they are, high bits in unary, kept in a mapped file."""

    def __init__(self, values: np.ndarray) -> None:
        n, most = len(values), int(values[-1]) if len(values) else 0
        self.n, self.shift = n, max(0, (most // max(1, n)).bit_length() - 1)
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if self.shift <= np.dtype(t).itemsize * 8)
        self.buckets = (most >> self.shift) + 1
        bits = np.zeros((n + self.buckets + 64) // 64 * 64, np.uint8)
        bits[(values >> self.shift) + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))])
        #: How many values lie in buckets below each: where a bucket's zero stands, less the zeros before.
        starts = np.concatenate([[0], np.cumsum(np.bincount(values >> self.shift, minlength=self.buckets))])
        self.low, self.high, self.ones, self.starts = mapped(
            (values & ((1 << self.shift) - 1)).astype(kind), high, ones.astype(np.uint32), starts.astype(np.uint32))

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        """The values at the given places."""
        word = np.searchsorted(self.ones, at, "right") - 1
        place = word * 64 + _nth_bit(self.high[word], at - self.ones[word])
        return ((place - at) << self.shift) | self.low[at].astype(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each number, by search for its successor; -1 where it is not held."""
        if not self.n:
            return np.full(len(wanted), -1)
        bucket = wanted >> self.shift
        inside = (wanted >= 0) & (bucket < self.buckets)
        bucket = np.where(inside, bucket, 0)
        start, end = self.starts[bucket].astype(np.int64), self.starts[bucket + 1].astype(np.int64)
        low, stop = wanted & ((1 << self.shift) - 1), end
        while (open_ := start < stop).any():
            middle = np.where(open_, (start + stop) >> 1, 0)
            less = open_ & (self.low[middle].astype(np.int64) < low)
            start, stop = np.where(less, middle + 1, start), np.where(open_ & ~less, middle, stop)
        at = np.minimum(start, self.n - 1)
        return np.where(inside & (start < end) & (self.low[at].astype(np.int64) == low), at, -1)


def mapped(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays, read only, in one nameless mapped file that goes with them."""
    out, size = [], sum(a.nbytes + 8 for a in arrays)
    with tempfile.TemporaryFile() as file:
        file.truncate(max(1, size))
        held = mmap.mmap(file.fileno(), max(1, size))
    at = 0
    for a in arrays:
        held[at : at + a.nbytes] = a.tobytes()
        out.append(np.frombuffer(held, a.dtype, len(a), at))
        at += -(-a.nbytes // 8) * 8
    return out
