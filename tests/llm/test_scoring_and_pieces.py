"""Trigram scores against a dictionary model, pieces against the public library."""

import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from logweir.llm.elias_fano import EliasFano
from logweir.llm.line_dedup import dedup_lines
from logweir.llm.ngram_score import score_texts
from logweir.llm.pieces import Neighbours, PieceTable, decode, encode, load_pieces

SCHEMA = "doc_id long, text string, words string, shard int"
TEXTS = ["the cat sat on the mat", "The cat ran", None, "", " \n\t ", "the cat sat on the mat", "Äpfel 猫 \U0001f600 the", "a" * 5000, "x  y\n\nz, 42!"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(None, "the cat", "clash", 1), (0, TEXTS[0], "clash", 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("size, step", [(0, 1), (1, 5), (1000, 3), (5000, 10**9)])
def test_sorted_numbers_are_found_and_read(size, step):
    values = np.sort(np.random.default_rng(size).integers(0, size * step + 1, size))
    held = EliasFano(values)
    if size:
        assert (held[np.arange(size)] == values).all()
    asked = np.concatenate([values, values + 1, [0, 10**15]])
    found = held.find(asked)
    assert ((found >= 0) == np.isin(asked, values)).all()
    assert (values[found[found >= 0]] == asked[found >= 0]).all() if size else True


def test_scores_equal_a_dictionary_model(docs):
    learn = F.coalesce(F.col("doc_id") != 1, F.lit(True))
    got = score_texts(docs, learn).collect()
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    one, two, three = Counter(), Counter(), Counter()
    for i, t in rows:
        if i != 1:
            line = ["<", "<", *tokens(t)]
            one.update(line[2:])
            two.update(zip(line[1:], line[2:]))
            three.update(zip(line, line[1:], line[2:]))
    total, kinds = sum(one.values()), len(one)

    def score(text):
        line, base, out = ["<", "<", *tokens(text)], 0.0, 0.0
        for u, v, w in zip(line, line[1:], line[2:]):
            p = (one[w] + 0.5) / (total + 0.5 * (kinds + 1))
            base += math.log10(p)
            for counts, key in ((two, (v,)), (three, (u, v))):
                after = {k[-1]: c for k, c in counts.items() if k[:-1] == key}
                if after:
                    p = (max(after.get(w, 0) - 0.75, 0) + 0.75 * len(after) * p) / sum(after.values())
            out += math.log10(p)
        return len(line) - 2, base, out

    assert len(got) == len(rows)
    by_id = {i: t for i, t in rows}
    for r in got:
        n, base, full = score(by_id[r.doc_id])
        assert (r.n_tokens, r.train_tokens, r.learned) == (n, total, r.doc_id != 1)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(full, abs=2e-3 * n)


def test_no_rows_and_no_training_rows(spark, docs):
    assert score_texts(docs.limit(0), F.lit(True)).count() == 0
    assert {r.n_known for r in score_texts(docs, F.lit(False)).collect()} == {0}


def test_pieces_equal_the_library_and_come_back(docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    table, library = load_pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    got = encode(docs, table).withColumn("back", decode(F.col("ids"), table)).collect()
    assert len(got) == docs.count()
    for r in got:
        assert list(r.ids or []) == library.encode(r.text or "")
        assert (r.back or "") == (r.text or "")
    assert encode(docs.limit(0), table).count() == 0


ODD = ["a\u2581b c", "\u2581", " ", "  lead", "trail  ", "nul\x00nul", "\x00", "qxzjq wvkxq", "\U0001f600\U0001f600é\u0301x", "abab" * 50 + "\nzz", "tab\tè\u00e8ü\u00fc"]


def test_parts_of_odd_texts_equal_the_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    table, library = load_pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    got = encode(spark.createDataFrame([*enumerate(ODD)], "doc_id long, text string"), table).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert r.text == ODD[r.doc_id] and list(r.ids) == library.encode(r.text)
    parts, sizes = Neighbours.of(table.pairs).cut(["ab  c", "", "è"])
    assert sizes[1] == 0 and "".join(parts.to_pylist()) == "\u2581ab\u2581\u2581c\u2581è"


def test_a_unigram_model_takes_the_best_path(spark):
    scores = {"\u2581": -4.0, "a": -3.1, "b": -3.3, "c": -5.7, "ab": -4.2, "\u2581a": -3.9, "bc": -4.9, "abc": -9.3, "\u2581ab": -7.77, "ca": -3.05}
    pieces = tuple((p, 300 + i, x) for i, (p, x) in enumerate(scores.items()))
    table = PieceTable(pieces, tuple([b""] * 320), 3, False)
    number = {p: i for p, i, _ in pieces}

    def best(text):
        if not text:
            return 0.0, []
        found = []
        for n in range(1, len(text) + 1):
            part = text[:n]
            if part in scores or n == 1:
                cost, ids = best(text[n:])
                own = [number[part]] if part in number else [3 + b for b in part.encode()]
                found.append((cost - scores.get(part, -1e6), own + ids))
        return min(found)

    texts = ["abcab", "cabca bcaab", "aéb", "xab c", "abcabcabc"]
    for r in encode(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), table).collect():
        assert list(r.ids) == best("\u2581" + r.text.replace(" ", "\u2581"))[1]


def test_shared_lines_stay_in_the_last_document(spark):
    line = "A line that is long enough"
    rows = [(i, f"own {i}\n {line.upper() if i == 1 else line} \n{line}") for i in range(4)] + [(9, None)]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].n_dropped for i in (0, 1, 2, 3, 9)] == [2, 2, 2, 0, 0]
    assert got[0].kept_text == "own 0" and got[9].kept_text == "" and got[9].n_lines == 1


def test_packed_texts_cross_the_shuffle_small_and_whole():
    """A part costs its letters and about a byte, not an offset, which hardly compresses."""
    import random

    import pyarrow as pa

    from logweir.llm import pieces

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(20_000)]
    neighbours = pieces.Neighbours.of(frozenset(a + b for a in "abcdefgh" for b in "abcdefgh"))
    texts = [None, "", "é\x00 \n" + "x" * 300, pieces.SPACE, " ".join(words)]
    blob = pieces.pack(pa.array(range(5)), pa.array(texts), neighbours)
    parts, codes, sizes = pieces.cut_texts(texts, neighbours)
    (found,) = pieces.unpack(pa.chunked_array([[blob]], pa.binary()))
    assert found["parts"].equals(parts) and found["sizes"].to_pylist() == sizes.tolist()
    assert pieces.codes_of(found).tolist() == codes.tolist()
    assert found["plain"].to_pylist() == [None, "", None, pieces.SPACE, None]
    assert len(blob) < 90_000
