"""Periodic runs of words, found by block convolution with a number-theoretic transform."""

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import whole

#: A prime ``15 * 2**27 + 1`` below 2**31 and a generator of its residues.
PRIME, GENERATOR = 2013265921, 31

#: A run has this many periods and words at least.
MIN_PERIODS, MIN_WORDS = 4, 6

#: Numbers that are transformed in one go.
TOGETHER = 1 << 20

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUNS = "array<struct<start:long,length:long,period:long>>"


def times(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """Products modulo the prime, of numbers below it."""
    product = a * b
    return product - product // np.uint64(PRIME) * np.uint64(PRIME)


def less_prime(a: np.ndarray) -> np.ndarray:
    """Numbers below twice the prime, modulo the prime (a difference below 0 wraps to a large number)."""
    return np.minimum(a, a - np.uint64(PRIME))


def powers(base: int, count: int) -> np.ndarray:
    out, step = np.ones(1, np.uint64), base
    while len(out) < count:
        out = np.concatenate([out, times(out, np.uint64(step))])
        step = step * step % PRIME
    return out


class Transform:
    """The number-theoretic transform of rows of ``size`` numbers, ``size`` a power of two."""

    def __init__(self, size: int) -> None:
        root = pow(GENERATOR, (PRIME - 1) // size, PRIME)
        self.halves = [1 << k for k in reversed(range(size.bit_length() - 1))]
        self.there = {h: powers(pow(root, size // (2 * h), PRIME), h) for h in self.halves}
        self.back = {h: powers(pow(root, -(size // (2 * h)), PRIME), h) for h in self.halves}
        self.scale = np.uint64(pow(size, -1, PRIME))

    def forward(self, rows: np.ndarray) -> np.ndarray:
        """In place; the result is in bit-reversed order."""
        for half in self.halves:
            pairs = rows.reshape(len(rows), -1, 2, half)
            a, b = pairs[:, :, 0].copy(), pairs[:, :, 1]
            pairs[:, :, 0], pairs[:, :, 1] = (
                less_prime(a + b), times(less_prime(a + (np.uint64(PRIME) - b)), self.there[half]))
        return rows

    def backward(self, rows: np.ndarray) -> np.ndarray:
        for half in reversed(self.halves):
            pairs = rows.reshape(len(rows), -1, 2, half)
            a, b = pairs[:, :, 0].copy(), times(pairs[:, :, 1], self.back[half])
            pairs[:, :, 0], pairs[:, :, 1] = less_prime(a + b), less_prime(a + (np.uint64(PRIME) - b))
        return times(rows, self.scale)


@lru_cache(maxsize=32)
def transform_of(size: int) -> Transform:
    """Its tables are as large as two rows, and are made once per size."""
    return Transform(size)


def occurrences(codes: np.ndarray, starts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """``(start, distance)`` where a block of ``block`` words occurs again ``distance`` later,
    for all distances from ``block`` to ``2 * block - 1``.

    The squared differences of the block and each stretch of the window after it are summed
    modulo the prime: squares by running sums, products by a cyclic convolution as long as the
    window, whose wrapped part lies outside the distances asked for. A sum of 0 means no mismatch.
    A multiple of the prime would look like 0 as well; the caller compares the words themselves.
    """
    window = 2 * block - 1
    transform = transform_of(2 * block)
    padded = np.concatenate([codes, np.zeros(3 * block, np.uint64)])
    found = []
    for at in range(0, len(starts), max(1, TOGETHER // (2 * block))):
        part = starts[at : at + max(1, TOGETHER // (2 * block))]
        blocks, windows = np.zeros((2, len(part), 2 * block), np.uint64)
        blocks[:, :block] = padded[part[:, None] + np.arange(block)[::-1]]
        windows[:, :window] = padded[part[:, None] + block + np.arange(window)]
        own = times(blocks, blocks).sum(axis=1) % np.uint64(PRIME)
        sums = np.cumsum(times(windows, windows), axis=1) % np.uint64(PRIME)
        sums = np.concatenate([np.zeros((len(part), 1), np.uint64), sums], axis=1)
        others = less_prime(sums[:, block : 2 * block] + (np.uint64(PRIME) - sums[:, :block]))
        products = transform.backward(times(transform.forward(blocks), transform.forward(windows)))[:, block - 1 : window]
        row, shift = np.nonzero(less_prime(own[:, None] + others) == less_prime(products + products))
        keep = part[row] + block + shift + block <= len(codes)
        found.append((part[row[keep]], block + shift[keep]))
    return tuple(np.concatenate(f) for f in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2


def equal_until(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common beginning, comparing ever longer stretches."""
    at, step, most = 0, 64, min(len(a), len(b))
    while at < most:
        differ = a[at : at + step] != b[at : at + step][: len(a[at : at + step])]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, step * 2
    return most


def find_runs(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of numbers above 0, by start and period.

    A run with period ``q`` from ``block`` to ``2 * block - 1`` and four periods at least holds an
    aligned block and its copy ``q`` later, so for each dyadic ``block`` the copies of aligned
    blocks are searched, and their distances extended as far as words agree.

    Left out, since they cannot find a new run, are blocks with a word that does not return
    within the window, blocks that lie with their window in a run of a shorter period, and
    copies at a multiple of the period within such a run.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    gap = np.full(n, n, np.int64)
    same = np.flatnonzero(codes[order[1:]] == codes[order[:-1]])
    gap[order[same]] = order[same + 1] - order[same]
    covered_to, covered_by = np.zeros(n, np.int64), np.ones(n, np.int64)
    runs: dict[tuple[int, int], int] = {}
    block = 1
    while MIN_PERIODS * block <= n:
        starts = np.arange(n // block) * block
        returns = gap[: len(starts) * block].reshape(-1, block).max(axis=1) < 2 * block
        new = covered_to[starts] < np.minimum(n, starts + 3 * block - 1)
        starts = starts[returns & new]
        at, distance = occurrences(codes, starts, block)
        known = (covered_to[at] >= at + block + distance) & (distance % covered_by[at] == 0)
        done: dict[int, int] = {}
        for a, d in zip(at[~known].tolist(), distance[~known].tolist(), strict=True):
            if a < done.get(d, 0):
                continue  # in a stretch that is known already
            end = a + equal_until(codes[a : n - d], codes[a + d :])
            if end < a + block:
                continue
            done[d] = end
            start = a - equal_until(codes[:a][::-1], codes[d : a + d][::-1])
            if end + d - start >= max(MIN_WORDS, MIN_PERIODS * d):
                key = start, end + d - start
                runs[key] = min(d, runs.get(key, d))
        for (start, length), period in runs.items():
            if period >= block:
                reach = slice(start, start + length)
                further = covered_to[reach] < start + length
                covered_by[reach][further] = period
                covered_to[reach][further] = start + length
        block *= 2
    return sorted((s, length, q) for (s, length), q in runs.items())


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run holds after its first period."""
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]


def coded(words: list[str]) -> np.ndarray:
    """Numbers from 1, equal for equal words."""
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words), 1)}
    return np.fromiter(map(numbers.__getitem__, words), np.uint64, len(words))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_words, runs, collapsed`` for each row of ``docs``.

    Words are maximal runs of characters other than ASCII blanks. A run is a stretch of words
    with smallest period ``q`` (words ``q`` apart are equal) of at least ``max(6, 4 * q)`` words
    that cannot be extended with this period. ``runs`` has start (word number from 0), length
    and period of each, by start and then period. ``collapsed`` are the words of the text,
    joined by one space, without those that a run holds after its first period.

    * A null or empty text has no words, no runs and collapses to the empty text.
    * Runs may overlap or lie within each other; repeated rows stay; an empty table gives none.
    * Other columns are not looked at, whatever their names.

    There is no shuffle. A task holds one batch and the words of one text; blocks are transformed
    about a million numbers at a time, or one block of a very long text.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found, collapsed = [], [], []
            for text in batch.column(1):
                words = WORD.findall(text.as_py())
                runs = find_runs(coded(words))
                counts.append(len(words))
                found.append([{"start": s, "length": length, "period": q} for s, length, q in runs])
                collapsed.append(" ".join(collapse(words, runs) if runs else words))
            made = [pa.array(counts, pa.int64()), pa.array(found, run_type), pa.array(collapsed, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"))
    return rows.mapInArrow(search, f"id {kind}, n_words long, runs {RUNS}, collapsed string").withColumnRenamed("id", id_col)
