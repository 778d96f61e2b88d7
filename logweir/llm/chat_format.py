"""Conversations as training texts, with a loss mask over tokens that covers assistant turns."""

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import whole

#: The control strings of the template.
BEGIN, END = "<s>", "</s>"
USER, USER_END = "[INST]", "[/INST]"
OTHER, OTHER_END = "[TURN]", "[/TURN]"
CONTROLS = (BEGIN, END, USER, USER_END, OTHER, OTHER_END)

#: A control string, or the vocabulary's own, with any number of backslashes after its first character.
REST = r"/?(?:s>|INST\]|TURN\])|\|endoftext\|>"
LOOKS_LIKE_CONTROL = re.compile(rf"([<\[])(\\*)({REST})")
ESCAPED = re.compile(rf"([<\[])\\(\\*)({REST})")

WRITTEN_TURN = re.compile(
    r"\[INST\](?P<user>.*?)\[/INST\]|\[TURN\](?P<role>.*?)\[/TURN\](?P<other>.*?)</s>|(?P<assistant>.*?)</s>", re.S
)

#: Characters that are encoded in one go.
TOGETHER = 1 << 19

TURNS = "array<struct<role:string,text:string>>"
TOKENS = "ids array<int>, token_starts array<int>, token_ends array<int>, loss array<boolean>"


def escape(text: str) -> str:
    """The text without control strings: one more backslash in all that looks like one."""
    return LOOKS_LIKE_CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """A conversation by the template, and the spans ``[start, end)`` of assistant texts in order."""
    out, at, spans = [BEGIN], len(BEGIN), []
    for role, text in turns:
        text = escape(text)
        if role == "user":
            parts = [USER, text, USER_END]
        elif role == "assistant":
            parts = [text, END]
            spans.append((at, at + len(text)))
        else:
            parts = [OTHER, escape(role), OTHER_END, text, END]
        out += parts
        at += sum(map(len, parts))
    return "".join(out), np.array(spans, np.int64).reshape(-1, 2)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns that :func:`render` wrote."""
    turns = []
    for m in WRITTEN_TURN.finditer(formatted, len(BEGIN)):
        kind = m.lastgroup
        role = unescape(m["role"]) if kind == "other" else kind
        turns.append((role, unescape(m[kind])))
    return turns


def mask_tokens(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """True for tokens that share a character with a span. Both are sorted, so each span's
    first and last token are found by binary search."""
    spans = spans[spans[:, 0] < spans[:, 1]]
    first = np.searchsorted(ends, spans[:, 0], side="right")
    last = np.searchsorted(starts, spans[:, 1], side="left")
    steps = np.zeros(len(starts) + 1, np.int64)
    np.add.at(steps, first, 1)
    np.add.at(steps, last, -1)
    return np.cumsum(steps[:-1]) > 0


def read_masked(formatted: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> list[str]:
    """The stretches of text under the mask, unescaped."""
    starts, ends = starts[loss], ends[loss]
    gaps = np.flatnonzero(starts[1:] > ends[:-1]) + 1
    first, last = np.r_[0, gaps][: len(starts)], np.r_[gaps, len(ends)][: len(ends)] - 1
    return [unescape(formatted[a:b]) for a, b in zip(starts[first].tolist(), ends[last].tolist(), strict=True)]


def load_tokenizer(path: str):
    """The tokenizer with the control strings as tokens of their own, and exact offsets."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer, processors

    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_special_tokens([AddedToken(c, normalized=False) for c in CONTROLS])
    tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def shares(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours of ``most`` in sum, or of one that is larger."""
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if sizes:
        yield start, len(sizes)


def format_chats(
    turns: DataFrame,
    tokenizer_path: str,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """``conv_col, formatted, ids, token_starts, token_ends, loss``, one row per conversation.

    A conversation is the rows of one ``conv_col`` in order of turn. It is rendered whole,
    ``<s>`` and then ``[INST]text[/INST]`` for a user, ``text</s>`` for an assistant and
    ``[TURN]role[/TURN]text</s>`` for any other role, and encoded once. Control strings are single
    tokens (ids after the vocabulary); inside texts and roles they get a backslash after
    their first character, which :func:`read_chats` takes out again. ``token_starts`` and
    ``token_ends`` count code points of ``formatted``; ``loss`` is true for the tokens of
    assistant texts, and those tokens cover these texts and nothing else.

    * A null text or role is empty. Null turns come first, equal turns are ordered by role and
      text; repeated rows are turns of their own. Rows whose ``conv_col`` is null are one conversation.
    * An empty table gives no rows. Other columns are not looked at, whatever their names.

    One shuffle brings turns together, after each task has gathered its own. A conversation is
    one row, so it must fit into a task; a task encodes about half a million characters at once.
    """
    kind = turns.schema[conv_col].dataType.simpleString()
    row = F.struct(F.col(turn_col).alias("turn"), whole(F.col(role_col)).alias("role"), whole(F.col(text_col)).alias("text"))
    chats = turns.select(F.col(conv_col).alias("id"), row.alias("row")).groupBy("id").agg(
        F.sort_array(F.collect_list("row")).alias("rows"))
    int_list = pa.list_(pa.int32())
    kinds = [pa.string(), int_list, int_list, int_list, pa.list_(pa.bool_())]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(tokenizer_path)
        for batch in batches:
            ids, chats = batch.columns
            rendered = [render([(t["role"], t["text"]) for t in turns.as_py()]) for turns in chats]
            for start, end in shares([len(text) for text, _ in rendered], TOGETHER):
                texts, spans = zip(*rendered[start:end], strict=True)
                columns = [list(texts), [], [], [], []]
                for coded, spans_of in zip(tokenizer.encode_batch(texts, add_special_tokens=False), spans, strict=True):
                    offsets = np.array(coded.offsets, np.int32).reshape(-1, 2)
                    loss = mask_tokens(offsets[:, 0], offsets[:, 1], spans_of)
                    for column, values in zip(columns[1:], (coded.ids, offsets[:, 0], offsets[:, 1], loss), strict=True):
                        column.append(values)
                made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids[start:end], *made], ["id", "formatted", "ids", "token_starts", "token_ends", "loss"])

    return chats.mapInArrow(encode, f"id {kind}, formatted string, {TOKENS}").withColumnRenamed("id", conv_col)


def read_chats(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """``conv_col, turns, trained, formatted_chars``, read from the result of :func:`format_chats`.

    ``turns`` are the role and text of each turn; ``trained`` are the stretches of text under
    the loss mask, unescaped, so each assistant text that is not empty once and in order. A null
    role or text was written, and comes back, as an empty one.
    """
    kind = chats.schema[conv_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            formatted = batch.column(1).to_pylist()
            marked = zip(formatted, *(c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]), strict=True)
            trained = [read_masked(text, starts, ends, loss.astype(bool)) for text, starts, ends, loss in marked]
            turns = [[{"role": r, "text": t} for r, t in read_turns(text)] for text in formatted]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(turns, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))),
                    pa.array(trained, pa.list_(pa.string())),
                    pa.array(map(len, formatted), pa.int64()),
                ],
                ["id", "turns", "trained", "formatted_chars"],
            )

    rows = chats.select(F.col(conv_col).alias("id"), "formatted", "token_starts", "token_ends", "loss")
    schema = f"id {kind}, turns {TURNS}, trained array<string>, formatted_chars long"
    return rows.mapInArrow(read, schema).withColumnRenamed("id", conv_col)
