"""Words before many tokens are split over shards; what shards count apart adds up."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweir.llm import ngram_score
from logweir.llm.ngram_score import BEGIN, Common, Tally, hashed, opened, score_texts, squeezed


def some_texts(n):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    deal = lambda: rng.choice(["the", "the", "of the", "", *rng.choices(words, range(40, 0, -1), k=4)])
    return [(i % (n - 5), " ".join(deal() for _ in range(rng.randint(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("share, most", [(32, 400_000), (300, 400_000), (32, 3), (10**9, 1)])
def test_split_words_and_small_shards_give_the_same_scores(spark, monkeypatch, share, most):
    docs = spark.createDataFrame([*some_texts(90), (None, None), (None, "the " * 300)], "doc_id long, text string").repartition(3)
    learn = F.coalesce(F.col("doc_id") % 4 != 1, F.lit(True))
    rows = lambda: sorted(map(tuple, score_texts(docs, learn).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[2], -r[5]))
    whole = rows()
    monkeypatch.setattr(ngram_score, "SHARD_BYTES", 400)
    monkeypatch.setattr(ngram_score, "SPLIT_TOKENS", 12)
    monkeypatch.setattr(ngram_score, "COMMON_SHARE", share)
    monkeypatch.setattr(ngram_score, "MOST_COMMON", most)
    small = rows()
    assert len(whole) == len(small) == 92
    for a, b in zip(whole, small, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_tokens_after_a_common_word_go_to_many_shards():
    before = [b"a%d" % i for i in range(4000)]
    hashes = np.append(hashed([b"the", b"rare", *before]), BEGIN)
    common = Common(hashes[:1], np.array([3_000_000]), np.array([3_000_000]))
    u = np.arange(2, 4002)
    for v, least, most in ((0, 9, 500), (1, 1, 4000)):
        shard = common.shard(hashes, common.codes(hashes), u, np.full(4000, v), 50)
        assert len(set(shard.tolist())) >= least and np.bincount(shard).max() <= most
        assert shard.min() >= 0 and shard.max() < 50


def test_counts_are_held_once_for_each_key(monkeypatch):
    monkeypatch.setattr(ngram_score, "MOST_HELD", 10)
    tally = Tally(2)
    for _ in range(1000):
        tally.add(np.array([3, 1, 3]), np.array([0, 5, 0]), np.array([1, 0, 2]))
    assert sum(len(x[0]) for x in tally.held) < 30
    assert [x.tolist() for x in tally.result()] == [[3, 1], [0, 5], [3000, 0]]


def test_lists_of_numbers_come_back():
    lists = [np.array([], np.int64), np.array([-(2**63), 5, 2**62]), np.array([0, 0]), np.array([255, 256])]
    assert [x.tolist() for x in opened(squeezed(*lists))] == [x.tolist() for x in lists]
