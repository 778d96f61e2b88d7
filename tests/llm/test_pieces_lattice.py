"""The lattice tells the short pieces of a place by one look-up; its rows are places, not substrings."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from logweir.llm.pieces import LATTICE_LETTERS, NO_PIECE, STEM, PieceTable, best_path, decode, encode, lattice, load_pieces, merge_edges, merged

LETTERS = "abcé\U0001f600猫"


def made(rng):
    """A table of random pieces, some far longer than a stem, some with the same score, which is worse than
    that of shorter ones, as in BPE models; not all letters are pieces."""
    held = {"".join(rng.choices("abcé", k=rng.choice([1, 2, 2, 3, 4, 5, 6, 9]))) for _ in range(60)} | {"a", "abcab", "abcabc", "a" * 40, "b" * 70}
    listed = tuple((p, 300 + i, -float(10 * len(p) + rng.randint(0, 3))) for i, p in enumerate(sorted(held - {"c"})))
    return PieceTable(listed, tuple([b""] * 400), 3, True)


def words_of(rng):
    sizes = [1, 1, 2, 3, 4, 5, 6, 8, 12, 20, LATTICE_LETTERS - 1, LATTICE_LETTERS]
    return ["".join(rng.choices(LETTERS, weights=[5, 5, 5, 5, 1, 1], k=rng.choice(sizes))) for _ in range(80)] + ["a" * LATTICE_LETTERS, "猫" * LATTICE_LETTERS]


def test_edges_are_the_pieces_of_each_word_and_rows_are_places(spark, monkeypatch):
    rng = random.Random(7)
    table, words = made(rng), words_of(rng)
    ids = {p: i for p, i, _ in table.pieces}
    frame, grouped = spark.createDataFrame(list(enumerate(words)), "k int, word string"), []
    monkeypatch.setattr(type(frame), "groupBy", lambda self, *a, f=type(frame).groupBy: grouped.append(self) or f(self, *a))
    got = {r.k: r for r in lattice(frame.withColumn("carried", F.concat(F.lit("of "), "word")), table, ["k"], "carried").collect()}
    assert len(got) == len(words)
    costs, longer = {p: -x for p, _, x in table.pieces}, 0
    for k, word in enumerate(words):
        found = [(s, z, word[s : s + z]) for s in range(len(word)) for z in range(1, len(word) - s + 1)]
        found = sorted((costs.get(p, float("inf")), s, z, p) for s, z, p in found if p in ids or z == 1)
        coded = [(e >> 28 & 63, e >> 22 & 63, e & (1 << 22) - 1) for e in got[k].edges]
        assert coded == [(s, z, ids.get(p, NO_PIECE + ord(p[0]))) for _, s, z, p in found]
        assert (got[k].n, got[k].carried) == (len(word), "of " + word)
        longer += sum(z > STEM for _, _, z, _ in found)
    monkeypatch.undo()
    assert [g.count() for g in grouped] == [sum(map(len, words)) + longer]  # one row for each substring in the table before


def test_folds_equal_the_heap_and_the_best_of_all_paths(spark):
    rng = random.Random(8)
    table, words = made(rng), words_of(rng)
    ids, scores = {p: i for p, i, _ in table.pieces}, {p: x for p, _, x in table.pieces}
    frame = spark.createDataFrame([(w, w) for w in words], "carried string, word string")

    def folded(fold, table):
        coded = lattice(frame, table, [], "carried").select("carried", fold(F.col("edges"), F.col("n"), table).alias("ids"))
        return {r.carried: list(r.ids) for r in coded.collect()}

    spelt = lambda got: [x for i in got for x in ([i] if i >= 0 else [3 + b for b in chr(-i - 1).encode()])]
    for word, got in folded(merge_edges, table).items():
        assert spelt(got) == merged(word, ids, scores, 3)
    costs, named = {i: -scores[p] for p, i in ids.items()}, {i: p for p, i in ids.items()}
    for word, got in folded(best_path, table).items():
        assert "".join(named[i] if i >= 0 else chr(-i - 1) for i in got) == word
        least = [0.0] + [float("inf")] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(end):
                part = word[start:end]
                if part in scores or end - start == 1:
                    least[end] = min(least[end], least[start] + -scores.get(part, -1e6))
        assert sum(costs.get(i, 1e6) for i in got) == least[-1]


@pytest.mark.parametrize("seed", [1, 2])
def test_words_up_to_the_longest_of_the_lattice_equal_the_library(spark, seed):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    table, library = load_pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(seed)
    long = ["e" * k for k in range(LATTICE_LETTERS - 3, LATTICE_LETTERS + 3)] + ["".join(rng.choices("etaoinshr", k=k)) for k in (60, 61, 62, 63)]
    rows = list(enumerate([None, "", *long, " ".join(long), *["".join(rng.choices("etaoin ß\n\x02犬\U0001f600", k=k)) for k in range(1, 60)]]))
    got = encode(spark.createDataFrame(rows, "doc_id int, text string"), table).withColumn("back", decode(F.col("ids"), table)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert list(r.ids or []) == library.encode(r.text or "") and (r.back or "") == (r.text or "")


def test_spelt_spaces_and_bytes_decode_as_before(spark):
    table = PieceTable((), tuple([b"", "▁a▁".encode(), b"b", b"\xe2", b"\x96", b"\x81", b"\xff"]), 0, True)
    rows = [([1, 2],), ([3, 4, 5, 2, 3, 4, 5],), ([6, 2, 3],), ([0, 0],), ([],), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "ids array<int>").select(decode(F.col("ids"), table)).collect()]
    assert got == ["a b", "b ", "�b�", "", "", None]
