"""The stages of the pipeline, token counts and vector search against plain versions."""

import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logweir.llm.queries import op1_token_counts
from logweir.llm.token_counts import count_tokens
from logweir.llm.vector_search import nearest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _class string, mix_size int, row string, kept boolean"
SHARED = "this very line stands in many of them"


def prose(k, n=70):
    return " ".join(f"w{(k * 131 + j * j * 7) % 3000}" for j in range(n))


def corpus():
    texts = {i: prose(i) for i in range(24)}
    texts |= {30: prose(3), 31: prose(4) + " end", 32: "front " + prose(5)}  # copies of 3, 4 and 5
    texts |= {i: f"{prose(i)}\n  {SHARED.upper() if i % 2 else SHARED}\t\n{prose(i + 500, 9)}" for i in range(40, 46)}
    texts |= {50: "too short", 51: None, 52: "", 53: "again and " * 60}
    return [(i, t, "en", "ab"[i % 2] if i % 5 else None, len(t or ""), "c", 1, "r", True) for i, t in texts.items()]


def test_each_stage_on_what_the_one_before_kept(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    texts = {r[0]: r[1] for r in rows}

    good = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert good.columns == docs.columns
    assert {r.doc_id for r in good.collect()} == {i for i in texts if i < 50}

    whole = corpus_pipeline.line_dedup(spark, good, str(tmp_path))
    got = {r.doc_id: r for r in whole.collect()}
    assert whole.columns == docs.columns and len(got) == good.count()
    for i, r in got.items():
        lines = texts[i].split("\n")
        assert r.text == "\n".join(x for x in lines if x.strip().lower() != SHARED or i == 45) and r.n_chars == len(r.text)

    single = corpus_pipeline.near_duplicates(spark, whole, str(tmp_path))
    assert single.columns == docs.columns
    assert {r.doc_id for r in single.collect()} == set(got) - {30, 31, 32}

    mixed = corpus_pipeline.mixing(spark, single, str(tmp_path))
    assert mixed.columns == docs.columns
    sizes, taken = Counter(), Counter()
    for r in single.collect():
        sizes[r.source] += len(WORD.findall(r.text))
    for r in mixed.collect():
        taken[r.source] += len(WORD.findall(r.text))
        assert set(WORD.findall(r.text)) <= set(WORD.findall(got[r.doc_id].text)) and r.n_chars == len(r.text)
    weights = {s: w for s, w in zip(sorted(sizes, key=lambda s: (s is None, s or "")), (3, 1, 2))}
    full = [s for s in sizes if 1.5 * sum(sizes.values()) * weights[s] / 6 > 2 * sizes[s]]
    left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
    for s in sizes:
        aim = 2 * sizes[s] if s in full else min(2 * sizes[s], left * weights[s] / sum(w for t, w in weights.items() if t not in full))
        assert taken[s] == pytest.approx(aim, abs=9)

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    coded = corpus_pipeline.pieces(spark, mixed, str(tmp_path)).collect()
    assert len(coded) == mixed.count() and all(list(r.ids) == library.encode(r.text) for r in coded)

    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.text, tuple(r.ids)) for r in out.collect()) == sorted((r.doc_id, r.text, tuple(r.ids)) for r in coded)


def test_stages_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_token_counts_equal_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = [None, "", " ", "a", "It's 3 o'clock,   isn't it?\n\n", "été 猫 \U0001f600\U0001f916", "<|endoftext|>x<|endoftext|>", "aaaa" * 20_000,
             " \t\n" * 30_000, "one two three four five " * 260, "don'T'S're 12345   z", "\x00\x1f"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(3, "a", "x"), (None, "b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = sorted((str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in count_tokens(docs, path).collect()) == want
    assert count_tokens(docs.limit(0), path).count() == 0
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id for r in op1_token_counts(spark, str(tmp_path)).filter("over_limit").collect()} == {7, 8, 9} - {
        i for i in (7, 8, 9) if dict((a, c) for a, _, c in want)[str(i)] <= 1024}


def test_nearest_vectors_found(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(30, 16))
    vectors = np.round(centers[rng.integers(0, 30, 3000)] + 0.3 * rng.normal(size=(3000, 16)), 3)
    vectors[7] = vectors[50]  # ties: equal vectors
    vectors[8] = vectors[50]
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(vectors)]
    odd = [(4000, None, "x"), (4050, [0.0] * 16, "x"), (4100, [float("nan")] * 16, "x"), (4150, [None] * 16, "x")]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, score string").repartition(4)
    got = nearest(frame, F.col("vec_id") % 50 == 0).collect()
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in got}
    hits = 0
    for q in range(0, 3000, 50):
        scores = units @ units[q]
        order = sorted((i for i in range(3000) if i != q), key=lambda i: (-round(scores[i], 12), i))[:5]
        mine = [found[q, k][0] for k in range(1, 6)]
        hits += len(set(mine) & set(order))
        assert all(found[q, k][1] == pytest.approx(scores[found[q, k][0]], abs=1e-12) for k in range(1, 6))
        assert [(-round(found[q, k][1], 12), found[q, k][0]) for k in range(1, 6)] == sorted((-round(found[q, k][1], 12), found[q, k][0]) for k in range(1, 6))
    assert len(got) == 5 * 60 and hits >= 0.9 * 300
    assert [found[50, k][0] for k in (1, 2)] == [7, 8]
    assert nearest(frame.limit(0), F.lit(True)).count() == 0
    assert nearest(frame.filter("vec_id < 3"), F.col("vec_id") == 0).count() == 2
