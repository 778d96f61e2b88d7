"""Token counts of a byte-level BPE vocabulary, merged on ragged numpy arrays."""

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how byte-level vocabularies of this kind cut text before merging.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pre-tokens a worker remembers, those merged in one go, and characters of a text cut in one go.
REMEMBERED, TOGETHER, STRETCH = 500_000, 100_000, 1 << 22


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_merges(path: str) -> dict:
    """Byte ids, merge pairs in order of rank, and special strings of a vocabulary file."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    vocab, letters = content["model"]["vocab"], byte_letters()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in content["model"]["merges"]]
    return {
        "bytes": np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64),
        "left": np.array([vocab[a] for a, _ in pairs], np.int64),
        "right": np.array([vocab[b] for _, b in pairs], np.int64),
        "made": np.array([vocab[a + b] for a, b in pairs], np.int64),
        "special": [t["content"] for t in content["added_tokens"]],
    }


class PairMerger:
    """Counts the symbols left of byte strings after all merges, many strings at once."""

    def __init__(self, merges: dict) -> None:
        keys = merges["left"] << 32 | merges["right"]
        self.byte_ids, self.made = merges["bytes"], merges["made"]
        self.bits = 64 - max(10, int(len(keys) * 16).bit_length())
        self.keys = np.full((1 << (64 - self.bits)) + 64, -1, np.int64)
        self.ranks = np.full(len(self.keys), len(keys), np.int32)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slots(keys).tolist(), strict=True)):
            while self.keys[slot] not in (-1, key):
                slot += 1
            if self.keys[slot] == -1:
                self.keys[slot], self.ranks[slot] = key, rank

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, the number of merges for pairs that never merge."""
        keys = left << 32 | right
        slots = self._slots(keys)
        out = self.ranks[slots]
        open_ = np.flatnonzero((self.keys[slots] != keys) & (self.keys[slots] != -1))
        out[self.keys[slots] != keys] = len(self.made)
        while open_.size:
            slots[open_] += 1
            found = self.keys[slots[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[slots[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def count(self, strings: list[bytes]) -> np.ndarray:
        """Symbols of each string. In each round every string merges its lowest-rank pair."""
        never = len(self.made)
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        symbols = self.byte_ids[np.frombuffer(b"".join(strings), np.uint8)]
        owner = np.repeat(np.arange(len(strings)), lengths)
        counts = lengths.copy()
        ranks = np.full(len(symbols), never, np.int32)
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        ranks[inside] = self.rank(symbols[inside], symbols[inside + 1])
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(owner)])
            lowest = np.minimum.reduceat(ranks, starts)
            if (lowest == never).any():  # these are done
                live = np.repeat(lowest < never, sizes)
                symbols, owner, ranks = symbols[live], owner[live], ranks[live]
                sizes, lowest = sizes[lowest < never], lowest[lowest < never]
                if not len(symbols):
                    break
            hits = np.flatnonzero(ranks == np.repeat(lowest, sizes))
            # of overlapping pairs (aaa) every second one merges, from the left
            run = np.r_[True, (hits[1:] != hits[:-1] + 1) | (owner[hits[1:]] != owner[hits[:-1]])]
            nth = np.arange(len(hits)) - np.maximum.accumulate(np.where(run, np.arange(len(hits)), 0))
            hits = hits[nth % 2 == 0]
            symbols[hits] = self.made[ranks[hits]]
            np.subtract.at(counts, owner[hits], 1)
            stay = np.ones(len(symbols), bool)
            stay[hits + 1] = False
            ranks[hits] = never
            moved = np.zeros(len(symbols), bool)
            moved[hits] = True
            symbols, owner, ranks, moved = symbols[stay], owner[stay], ranks[stay], moved[stay]
            at = np.flatnonzero(moved)
            moved[at[at > 0] - 1] = True  # the pair to its left changed too
            redo = np.flatnonzero(moved[:-1])
            same = owner[redo] == owner[redo + 1]
            ranks[redo] = never
            ranks[redo[same]] = self.rank(symbols[redo[same]], symbols[redo[same] + 1])
        return counts


class Known(dict):
    """Counts by pre-token; what is looked up in vain counts 0 and is noted in ``absent``."""

    absent: list[str]

    def __missing__(self, key: str) -> int:
        self.absent.append(key)
        return 0


class TokenCounter:
    """Token counts of whole texts; remembers the counts of pre-tokens it has seen."""

    def __init__(self, merges: dict, remembered: int = REMEMBERED, together: int = TOGETHER) -> None:
        self.merger, self.remembered, self.together = PairMerger(merges), remembered, together
        self.known = Known()
        self.pattern = regex.compile(PRE_TOKENS)
        special = sorted(merges["special"], key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def count(self, texts: list[str]) -> list[int]:
        totals = [0] * len(texts)
        held: list[tuple[int, list[str]]] = []  # pre-tokens not known yet, by text
        size = 0

        def settle() -> None:
            new = list({p for _, pieces in held for p in pieces})
            counts = dict(zip(new, self.merger.count([s.encode("utf-8", "replace") for s in new]).tolist(), strict=True))
            for i, pieces in held:
                totals[i] += sum(map(counts.__getitem__, pieces))
            if len(self.known) + len(counts) > self.remembered:
                self.known = Known()
            self.known.update(counts)
            held.clear()

        for i, text in enumerate(texts):
            parts = [text]
            if self.special and self.special.search(text):
                parts = self.special.split(text)
                totals[i] += len(parts) - 1
            for part in parts:
                for at in range(0, max(1, len(part)), STRETCH):  # of very long texts a stretch at a time
                    self.known.absent = []
                    totals[i] += sum(map(self.known.__getitem__, self._pieces(part, at, at + STRETCH)))
                    held.append((i, self.known.absent))
                    size += len(self.known.absent)
                    if size > self.together:
                        settle()
                        size = 0
        settle()
        return totals

    def _pieces(self, text: str, start: int, end: int) -> list[str]:
        """Pre-tokens that start in ``[start, end)``, for stretches in order."""
        if start == 0 and len(text) <= end:
            return self.pattern.findall(text)
        out = []
        at = self._carry if start else 0
        for m in self.pattern.finditer(text, at):
            if m.start() >= end:
                break
            out.append(m[0])
            at = m.end()
        self._carry = at
        return out


def count_tokens(docs: DataFrame, merges_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_tokens`` of each whole text, without begin, end or padding.

    Texts are cut into pre-tokens. A batch's new pre-tokens are held as one ragged array of
    symbols; in each round every pre-token merges all places of its lowest-rank pair, until no
    pair is left, and the symbols that survive are counted. A special string in a text
    is one token. There is no shuffle; a task holds one batch and a bounded memory of pre-tokens.

    A null or empty text has 0 bytes and 0 tokens; repeated rows give repeated rows; an empty
    table gives none; other columns are not looked at. The file is read on the driver and
    its bounded tables travel with the task.
    """
    merges = load_merges(merges_path)

    kind = docs.schema[id_col].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(merges)
        for batch in batches:
            totals = pa.array(counter.count(batch.column(2).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), totals], ["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(count, f"id {kind.simpleString()}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
