"""A block's parts are looked up once, not once for each packed piece of it."""

import random

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from logweir.llm import pieces
from logweir.llm.pieces import LATTICE_LETTERS, encode, load_pieces


def test_a_block_is_looked_up_once_and_its_order_does_not_depend_on_its_pieces(monkeypatch):
    neighbours = pieces.Neighbours.of(frozenset(a + b for a in "abcé" for b in "abcé"))
    rng = random.Random(2)
    texts = [[None, ""], ["ab c", "x" + "ab" * 60 + " é"], [" ".join("".join(rng.choices("abcé", k=rng.randint(1, 6))) for _ in range(300))], ["c ab"]]
    blobs = [pieces.pack(pa.array(range(len(t)), pa.int64()), pa.array(t, pa.string()), neighbours) for t in texts]
    calls = []
    for name in ("index_in", "unique"):  # what was called for each piece
        monkeypatch.setattr(pc, name, lambda *a, f=getattr(pc, name), **b: calls.append(1) or f(*a, **b))
    told = []
    for some in (blobs, blobs[::-1]):
        held = list(pieces.unpack(pa.chunked_array([some], pa.binary())))
        words, share, places, far = pieces.vocabulary_of(held, 7)
        every = [w.decode() for w in words + far]
        for piece, place in zip(held, places, strict=True):
            assert [every[i] for i in place] == piece["parts"].to_pylist()
        assert all(len(w.decode()) > LATTICE_LETTERS for w in far) and far
        assert sorted(share.tolist()) == share.tolist() and len(set(words)) == len(words) == len(share)
        told.append((words, share.tolist(), far))
    assert told[0] == told[1] and len(calls) < 2


@pytest.mark.parametrize("size", [200, 10**9])
def test_letters_without_a_piece_in_many_blocks_equal_the_library(spark, monkeypatch, size):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    table, library = load_pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("ab e\n\x01猫犬字é\U0001f600Ж") for _ in range(rng.randint(0, 80))) + rng.choice(["", "q" * 70])) for i in range(60)]
    monkeypatch.setattr(pieces, "BLOCK_BYTES", size)
    got = encode(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), table).collect()
    assert len(got) == 60
    for r in got:
        assert list(r.ids or []) == library.encode(r.text) and r.text == rows[r.doc_id][1]
