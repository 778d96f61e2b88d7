"""Language identification with hyperdimensional profiles of letter n-grams."""

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import sampled

#: N-grams whose vectors a worker keeps, letters handled in one go, texts and cells of a count matrix.
VECTORS, LETTERS, TEXTS, CELLS = 20_000, 500_000, 256, 4_000_000


@functools.lru_cache(maxsize=1)
def letter_codes() -> np.ndarray:
    """For each code point its lower-case letter, or 0 for what is no letter."""
    codes = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(ch := chr(c))[0] == "L":
            codes[c] = ord(low) if len(low := ch.lower()) == 1 else c
    return codes


def letters_of(text: str) -> np.ndarray:
    """The letters of a text; each run of other characters, and both ends, are one 0."""
    letters = letter_codes()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    if not letters.any():
        return np.empty(0, np.uint32)
    gap = letters == 0
    gap[1:] &= gap[:-1]
    return np.r_[np.uint32(0), letters[~gap], np.uint32(0)]


class Hyperspace:
    """Seeded letter vectors of +1 and -1, and the n-gram vectors bound from them."""

    def __init__(self, dimensions: int, n: int, seed: int) -> None:
        self.dimensions, self.n, self.seed = dimensions, n, seed
        self.number = np.full(0x110000, -1, np.int64)  # of a letter, as letters are met
        self.letters: list[np.ndarray] = []
        self._forget()

    def _forget(self) -> None:
        self.row: dict[int, int] = {}
        self.vectors = np.zeros((VECTORS, self.dimensions), np.float32)

    def _numbered(self, letters: np.ndarray) -> np.ndarray:
        for code in np.unique(letters[self.number[letters] < 0]).tolist():
            self.number[code] = len(self.letters)
            draw = np.random.default_rng([self.seed, code])
            self.letters.append(draw.integers(0, 2, self.dimensions).astype(np.float32) * 2 - 1)
        return self.number[letters]

    def bind(self, grams: np.ndarray) -> np.ndarray:
        """The product of an n-gram's letter vectors, each rotated by its place."""
        out = np.ones((len(grams), self.dimensions), np.float32)
        for place in range(self.n):
            numbers = (grams >> (21 * (self.n - 1 - place))) & ((1 << 21) - 1)
            different, which = np.unique(numbers, return_inverse=True)
            out *= np.stack([np.roll(self.letters[k], place) for k in different.tolist()])[which]
        return out

    def vectors_of(self, grams: np.ndarray) -> np.ndarray:
        """The vectors of distinct n-grams, remembered up to a bound."""
        if len(grams) > VECTORS // 2:
            return self.bind(grams)
        rows = [self.row.get(g, -1) for g in grams.tolist()]
        new = [g for g, r in zip(grams.tolist(), rows, strict=True) if r < 0]
        if len(self.row) + len(new) > VECTORS:
            self._forget()
            new = grams.tolist()
        if new:
            first = len(self.row)
            self.vectors[first : first + len(new)] = self.bind(np.array(new, np.int64))
            self.row.update(zip(new, range(first, first + len(new)), strict=True))
            rows = [self.row[g] for g in grams.tolist()]
        return self.vectors[rows]

    def bundle(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The sum of each text's n-gram vectors, and its number of n-grams."""
        lists = [letters_of(t) for t in texts]
        return self._bundle([self._numbered(x) for x in lists])

    def _bundle(self, lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n, sizes = self.n, np.fromiter((max(0, len(x) - self.n + 1) for x in lists), np.int64, len(lists))
        total = np.zeros((len(lists), self.dimensions), np.float32)
        if not sizes.any():
            return total, sizes
        bits = min(21, max(6, len(self.letters).bit_length()))
        grams = np.concatenate([
            functools.reduce(lambda a, k, x=x, m=m: a << bits | x[k : m + k], range(1, n), x[:m])
            for x, m in zip(lists, sizes.tolist(), strict=True) if m
        ])
        if bits * n <= 21:
            present = np.zeros(1 << bits * n, np.int64)
            present[grams] = 1
            different = np.flatnonzero(present)
            present[different] = np.arange(len(different))
            which = present[grams]
        else:
            different, which = np.unique(grams, return_inverse=True)
        if len(different) * len(lists) > CELLS and len(lists) > 1:
            half = len(lists) // 2
            return tuple(np.concatenate(x) for x in zip(self._bundle(lists[:half]), self._bundle(lists[half:]), strict=True))
        owner = np.repeat(np.arange(len(lists)), sizes)
        count = np.bincount(owner * len(different) + which, minlength=len(lists) * len(different))
        count = count.reshape(len(lists), len(different)).astype(np.float32)
        wide = np.zeros(len(different), np.int64)
        for place in range(n):
            wide = wide << 21 | (different >> (bits * (n - 1 - place))) & ((1 << bits) - 1)
        for first in range(0, len(wide), VECTORS // 2):
            part = slice(first, first + VECTORS // 2)
            total += count[:, part] @ self.vectors_of(wide[part])
        return total, sizes


def groups_of(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of bounded size together, with the place of the first."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and (size + len(text) > LETTERS or i - start >= TEXTS):
            yield start, texts[start:i]
            start, size = i, 0
        size += len(text)
    if texts:
        yield start, texts[start:]


def learn_prototypes(
    docs: DataFrame, text_col: str, lang_col: str, space: Hyperspace, max_rows: int
) -> tuple[list[str], np.ndarray]:
    """Languages and one prototype each: the sum of its documents' directions.

    Of more than ``max_rows`` documents about that many are used, chosen by a hash of the text.
    Tasks sum their documents; sums meet by language and dimension, so only prototypes reach
    the driver.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    share = min(1.0, max_rows / max(1, rows.count()))
    rows = rows.filter(sampled(share, F.lit(3), F.col(text_col)))
    dimensions, n, seed = space.dimensions, space.n, space.seed

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Hyperspace(dimensions, n, seed)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, part in groups_of(texts):
                total, sizes = own.bundle(part)
                norm = np.linalg.norm(total, axis=1)
                for k in np.flatnonzero(sizes):
                    lang = langs[start + k]
                    sums[lang] = sums.get(lang, 0.0) + total[k] / norm[k]
        for lang, vector in sums.items():
            whole = np.rint(vector.astype(np.float64) * 1e6).astype(np.int64)  # exact sums in any order
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * dimensions), pa.array(np.arange(dimensions), pa.int32()), pa.array(whole)], ["lang", "place", "value"]
            )

    parts = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    parts = parts.mapInArrow(learn, "lang string, place int, value long")
    cells = parts.groupBy("lang", "place").agg(F.sum("value").alias("value")).collect()
    langs = sorted({c["lang"] for c in cells})
    at = {lang: i for i, lang in enumerate(langs)}
    out = np.zeros((len(langs), dimensions))
    for c in cells:
        out[at[c["lang"]], c["place"]] = c["value"]
    if len(langs) > 1:  # what all languages share tells none
        units = out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
        out = units - units.mean(axis=0)
    return langs, out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def identify_language(
    docs: DataFrame,
    learn_from: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    dimensions: int = 1_024,
    n: int = 3,
    max_rows: int = 20_000,
    seed: int = 11,
) -> DataFrame:
    """``id_col, learned, lang_pred, score`` for each row of ``docs``.

    Letters have seeded random vectors; an n-gram's vector is the product of its letters'
    vectors, rotated by place; a document's is the sum over its n-grams. Languages are sums of
    their documents, less what all languages share. The nearest language by cosine is
    predicted; ``score`` is the cosine, within 0 and 1.

    Prototypes are learned from about ``max_rows`` of the rows where ``learn_from`` holds
    (a bound for fitting only; all rows are predicted, from whole texts).

    * ``und`` with score 0 for a null text, one without a letter, or if nothing was learned.
    * Ties go to the language first in code point order. Repeated rows get equal answers.
    * An empty table gives no rows. Columns but the three are not looked at.
    """
    slim = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"),
        F.coalesce(learn_from, F.lit(False)).alias("learned"),
    )
    space = Hyperspace(dimensions, n, seed)
    langs, prototypes = learn_prototypes(slim.filter("learned"), "text", "lang", space, max_rows)
    kind = docs.schema[id_col].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Hyperspace(dimensions, n, seed)
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            names, scores = [], []
            for _, part in groups_of(texts):
                total, sizes = own.bundle(part)
                norm = np.maximum(np.linalg.norm(total, axis=1), 1e-12)
                cosine = total.astype(np.float64) @ prototypes.T / norm[:, None] if langs else np.zeros((len(part), 1))
                for k, best in enumerate(cosine.argmax(axis=1).tolist()):
                    known = bool(langs) and sizes[k] > 0
                    names.append(langs[best] if known else "und")
                    scores.append(min(1.0, max(0.0, float(cosine[k, best]))) if known else 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["id", "learned", "lang_pred", "score"],
            )

    out = slim.select("id", "learned", "text").mapInArrow(predict, f"id {kind}, learned boolean, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)
