"""Fill-in-the-middle: documents cut at two token ends, found in a compressed set of boundaries."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import whole

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")

#: Offsets that one container covers, and bytes of its bitmap.
SPAN = 1 << 16
BITMAP_BYTES = SPAN // 8

IS_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
CONTINUES = (np.arange(256) & 0xC0) == 0x80


@dataclass
class ArrayBox:
    """The places themselves."""

    places: np.ndarray

    def select(self, nth: int) -> int:
        return int(self.places[nth])


@dataclass
class BitmapBox:
    """One bit per place, and the number of bits before each word of 64."""

    words: np.ndarray
    before: np.ndarray

    def select(self, nth: int) -> int:
        word = int(np.searchsorted(self.before, nth, side="right")) - 1
        bits = np.unpackbits(self.words[word : word + 1].view(np.uint8), bitorder="little")
        return word * 64 + int(np.flatnonzero(bits)[nth - int(self.before[word])])


@dataclass
class RunBox:
    """First place of each run of neighbours, and the number of places before each run."""

    starts: np.ndarray
    before: np.ndarray

    def select(self, nth: int) -> int:
        run = int(np.searchsorted(self.before, nth, side="right")) - 1
        return int(self.starts[run]) + nth - int(self.before[run])


def smallest_box(member: np.ndarray) -> ArrayBox | BitmapBox | RunBox:
    """The container for these places (a flag for each) that takes the fewest bytes."""
    places = np.flatnonzero(member)
    first = np.flatnonzero(np.diff(places, prepend=-2) != 1)
    if 4 * len(first) < min(2 * len(places), BITMAP_BYTES):
        return RunBox(places[first].astype(np.uint16), first.astype(np.uint32))
    if 2 * len(places) <= BITMAP_BYTES:
        return ArrayBox(places.astype(np.uint16))
    full = np.zeros(SPAN, bool)
    full[: len(member)] = member
    words = np.packbits(full, bitorder="little").view(np.uint64)
    counts = np.bitwise_count(words).astype(np.uint32)
    return BitmapBox(words, np.cumsum(counts) - counts)


class BoundarySet:
    """Ends of the tokens ``[A-Za-z]+|[^A-Za-z]`` of a UTF-8 text, as a set of byte offsets.

    The text is read a container's span at a time, so that besides it only containers are held.
    """

    def __init__(self, text: bytes) -> None:
        data = np.frombuffer(text, np.uint8)
        self.boxes: list[ArrayBox | BitmapBox | RunBox] = []
        upto = [0]
        for at in range(0, len(data), SPAN):
            here, after = data[at : at + SPAN], data[at + 1 : at + SPAN + 1]
            ends = np.ones(len(here), bool)  # the last byte of a text ends a token
            ends[: len(after)] = ~CONTINUES[after] & ~(IS_LETTER[here[: len(after)]] & IS_LETTER[after])
            self.boxes.append(smallest_box(ends))
            upto.append(upto[-1] + int(np.count_nonzero(ends)))
        self.upto = np.array(upto, np.int64)

    def __len__(self) -> int:
        return int(self.upto[-1])

    def cut_after(self, tokens: int) -> int:
        """Byte offset after the first ``tokens`` tokens."""
        if tokens == 0:
            return 0
        box = int(np.searchsorted(self.upto, tokens, side="left")) - 1
        return box * SPAN + self.boxes[box].select(tokens - 1 - int(self.upto[box])) + 1


def code_points(text: bytes) -> int:
    return len(text) - int(np.count_nonzero(CONTINUES[np.frombuffer(text, np.uint8)]))


def rearranged(text: bytes, draws: tuple[int, ...], plain_percent: int, spm_percent: int, marks: tuple[bytes, ...]):
    """``n, form, prefix_chars, middle_chars, formatted`` of one text, by four draws."""
    tokens = BoundarySet(text)
    n = len(tokens)
    if not n or draws[2] % 100 >= 100 - plain_percent or any(m in text for m in marks):
        return n, "plain", None, None, text
    a, b = sorted(tokens.cut_after(d % (n + 1)) for d in draws[:2])
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = marks
    form = "spm" if draws[3] % 100 < spm_percent else "psm"
    order = (s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle)
    return n, form, code_points(prefix), code_points(middle), b"".join(order)


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 1,
    plain_percent: int = 10,
    spm_percent: int = 20,
    marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """``id_col, n, form, prefix_chars, middle_chars, formatted`` for each row of ``docs``.

    A text is ``n`` tokens, each a run of ASCII letters or one other code point. Two cuts after
    a number of tokens from 0 to ``n`` are drawn by a hash of seed and id, and prefix, suffix and
    middle are written each after its mark: prefix first (``psm``), or suffix first (``spm``, in
    ``spm_percent`` of the cases). The form is ``plain``, and the text as it is, for
    ``plain_percent`` of the ids, and where the text is empty or contains a mark;
    then the counts of code points are null. :func:`restored` gives the text back.

    * A null text is the empty text; a null id draws as an empty id.
    * Rows with the same id draw the same numbers; each row stays. An empty table gives no rows.
    * Other columns are not looked at, whatever their names.

    There is no shuffle. A task holds one batch of texts, and of one text at a time the
    containers of its boundaries, at most an eighth of its bytes and some.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draw = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(F.col(id_col).alias("id"), F.encode(whole(F.col(text_col)), "UTF-8").alias("text"), *draw)
    coded = tuple(m.encode() for m in marks)
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = ["n", "form", "prefix_chars", "middle_chars"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, *draws = batch.columns
            drawn = zip(*(d.to_pylist() for d in draws), strict=True)
            done = [rearranged(t.as_py(), h, plain_percent, spm_percent, coded) for t, h in zip(texts, drawn, strict=True)]
            *facts, formatted = zip(*done, strict=True) if done else [()] * 5
            made = [pa.array(f, k) for f, k in zip(facts, kinds, strict=True)]
            written = pa.array(formatted, pa.binary()).view(pa.string())
            yield pa.RecordBatch.from_arrays([ids, *made, written], ["id", *names, "formatted"])

    schema = f"id {kind}, n long, form string, prefix_chars long, middle_chars long, formatted string"
    return rows.mapInArrow(cut, schema).withColumnRenamed("id", id_col)


def restored(formatted: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that :func:`fill_in_middle` wrote as ``formatted``.

    The parts hold no mark, and none arises where a part meets a mark, since marks begin
    with a character that stands nowhere else in them.
    """
    parts = F.split(formatted, "|".join(rf"\Q{m}\E" for m in marks))
    after = lambda i: F.get(parts, F.lit(i))
    return (
        F.when(form == "psm", F.concat(after(1), after(3), after(2)))
        .when(form == "spm", F.concat(after(2), after(3), after(1)))
        .otherwise(formatted)
    )
