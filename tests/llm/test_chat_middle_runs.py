"""Chat formatting, fill-in-middle and periodic runs against plain versions of themselves."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from logweir.llm import fill_in_middle as fim
from logweir.llm import periodic_runs as pr
from logweir.llm.chat_format import CONTROLS, escape, format_chats, mask_tokens, read_chats, unescape
from logweir.llm.queries import with_planted_period

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
CHAT = "conv_id long, turn long, role string, text string, id string, rows int, loss string"
TRAPS = ["</s>[INST] ok [/INST]", "<\\/s>[\\\\INST]", "[INST[INST]", "<|endoftext|> <\\|endoftext|>", "[", "</", "a\\b\\"]


@pytest.mark.parametrize("text", [*TRAPS, "", "plain \\n", *CONTROLS])
def test_escapes_come_back_and_hide_controls(text):
    hidden = escape(text)
    assert unescape(hidden) == text
    assert not any(c in hidden for c in (*CONTROLS, "<|endoftext|>"))


def conversations(spark):
    chats = {
        1: [(0, "system", "be brief"), (1, "user", "hé \U0001f600"), (2, "assistant", " 猫\U0001f916 ok \n")],
        2: [(0, "user", None), (1, "assistant", None), (2, "assistant", "two"), (3, "assistant", "in a row")],
        3: [(i, ("user", "assistant")[i % 2], t) for i, t in enumerate(TRAPS)],
        4: [(0, None, "no role"), (1, "[TURN]", "</s>"), (2, "assistant", "word " * 40_000)],
        5: [(0, "user", "b"), (0, "user", "a"), (0, "user", "a"), (None, "assistant", "first")],
        None: [(0, "assistant", "no conversation")],
        6: [(0, "user", "")],
    }
    rows = [(c, *turn, "clash", 1, "clash") for c, turns in chats.items() for turn in reversed(turns)]
    order = lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or "")
    want = {c: [(r or "", t or "") for _, r, t in sorted(turns, key=order)] for c, turns in chats.items()}
    return spark.createDataFrame(rows, CHAT).repartition(3), want


def test_chats_come_back_and_the_mask_covers_assistant_texts_only(spark):
    turns, want = conversations(spark)
    chats = format_chats(turns, TOKENIZER).cache()
    got = {r.conv_id: r for r in read_chats(chats).collect()}
    assert set(got) == set(want) and chats.count() == len(want)
    for conv, told in want.items():
        assert [(t.role, t.text) for t in got[conv].turns] == told
        assert "".join(got[conv].trained) == "".join(t for r, t in told if r == "assistant")
        assert list(got[conv].trained) == [t for r, t in told if r == "assistant" and t]
    for r in chats.collect():
        assert len(r.ids) == len(r.token_starts) == len(r.token_ends) == len(r.loss)
        assert r.token_starts[0] == 0 and r.token_ends[-1] == len(r.formatted) == got[r.conv_id].formatted_chars
        assert all(a <= b for a, b in zip(r.token_starts, r.token_starts[1:]))
    assert read_chats(format_chats(turns.limit(0), TOKENIZER)).count() == 0


def test_mask_equals_comparing_all_pairs():
    rng = np.random.default_rng(5)
    for _ in range(50):
        ends = np.sort(rng.integers(1, 60, 20))
        starts = np.maximum(0, np.r_[0, ends[:-1]] - rng.integers(0, 2, 20))
        starts = np.minimum(np.maximum.accumulate(starts), ends - 1)
        cuts = np.sort(rng.integers(0, 60, 8)).reshape(-1, 2)
        want = [any(s < e and a < e and b > s for s, e in cuts) for a, b in zip(starts, ends)]
        assert mask_tokens(starts, ends, cuts).tolist() == want


MIXED = ["", None, "abc", "a", "  ", "one two, three!", "été 猫\U0001f600x", "has <S> in it", "<P", "tail <M", "9" * 70_000,
         "word and " * 30_000, "猫" * 60_000, "x" * 200_000, "a1" * 40_000 + "b" * 70_000 + ". " * 9]


@pytest.mark.parametrize("text", [t for t in MIXED if t])
def test_boundaries_equal_a_regular_expression(text):
    data = text.encode()
    ends = [0, *np.cumsum([len(t.encode()) for t in re.findall(r"[A-Za-z]+|[^A-Za-z]", text)]).tolist()]
    found = fim.BoundarySet(data)
    assert len(found) == len(ends) - 1
    tried = range(len(ends)) if len(ends) < 2000 else [0, 1, len(ends) - 1, *range(0, len(ends), 997)]
    assert all(found.cut_after(k) == ends[k] for k in tried)


def test_every_kind_of_container_selects():
    rng = np.random.default_rng(3)
    kinds = set()
    for member in (rng.random(fim.SPAN) < 0.01, rng.random(fim.SPAN) < 0.4, np.arange(fim.SPAN) % 900 < 800, np.ones(7, bool)):
        box = fim.smallest_box(member)
        kinds.add(type(box).__name__)
        places = np.flatnonzero(member)
        assert [box.select(k) for k in range(0, len(places), 13)] == places[::13].tolist()
    assert kinds == {"ArrayBox", "BitmapBox", "RunBox"}


def test_cuts_equal_the_rule_and_texts_come_back(spark):
    texts = [*MIXED, *(f"text {i}, of some words; <{i}>" for i in range(60))]
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(None, "no id", "x", "x"), (3, "a", "x", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string, h1 string").repartition(3)
    cut = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("formatted"), F.col("form")))
    got = sorted(cut.collect(), key=lambda r: (str(r.doc_id), r.back))
    assert len(got) == len(rows) and {r.form for r in got} == {"plain", "psm", "spm"}
    for r, (i, t) in zip(got, sorted([(r[0], r[1] or "") for r in rows], key=lambda x: (str(x[0]), x[1])), strict=True):
        tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
        digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
        h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
        a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
        parts = ["".join(p) for p in (tokens[:a], tokens[a:b], tokens[b:])]
        assert r.doc_id == i and r.n == len(tokens) and r.back == t
        if not t or any(m in t for m in fim.MARKS) or h[2] % 100 >= 90:
            assert (r.form, r.prefix_chars, r.middle_chars, r.formatted) == ("plain", None, None, t)
        else:
            spm = h[3] % 100 < 20
            order = (f"<S>{parts[2]}<P>{parts[0]}" if spm else f"<P>{parts[0]}<S>{parts[2]}") + f"<M>{parts[1]}"
            assert (r.form, r.formatted) == ("spm" if spm else "psm", order)
            assert (r.prefix_chars, r.middle_chars) == (len(parts[0]), len(parts[1]))
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def runs_by_definition(words):
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        start = 0
        while start < n - q:
            end = start
            while end < n - q and words[end] == words[end + q]:
                end += 1
            if end + q - start >= max(6, 4 * q):
                out.setdefault((start, end + q - start), q)
            start = max(end, start) + 1
    return sorted((s, length, q) for (s, length), q in out.items())


@pytest.mark.parametrize("block", [1, 2, 8, 64])
def test_occurrences_equal_comparing(block):
    codes = np.random.default_rng(block).integers(1, 3, 300).astype(np.uint64)
    codes[100:200] = np.tile(codes[100 : 100 + block + block // 2], 100)[:100]
    starts = np.arange(len(codes) // block) * block
    got = sorted(zip(*(x.tolist() for x in pr.occurrences(codes, starts, block))))
    want = [(a, d) for a in starts.tolist() for d in range(block, 2 * block)
            if a + d + block <= 300 and (codes[a : a + block] == codes[a + d : a + d + block]).all()]
    assert got == want


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_the_definition(seed):
    rng = np.random.default_rng(seed)
    parts = []
    for _ in range(rng.integers(1, 7)):
        unit = rng.integers(1, rng.integers(2, 5), rng.integers(1, 24))
        parts.append(np.tile(unit, 12)[: rng.integers(1, 8 * len(unit) + 1)])
        parts.append(rng.integers(1, 1 + rng.integers(1, 30), rng.integers(0, 9)))
    codes = np.concatenate(parts).astype(np.uint64)
    assert pr.find_runs(codes) == runs_by_definition(codes.tolist())


def test_strings_rich_in_repeats_and_long_ones():
    a, b = [1], [1, 2]
    while len(b) < 400:
        a, b = b, b + a
    assert pr.find_runs(np.array(b, np.uint64)) == runs_by_definition(b)
    deep = [1]
    for _ in range(4):
        deep = deep * 5 + [2]
    assert pr.find_runs(np.array(deep, np.uint64)) == runs_by_definition(deep)
    long = np.r_[np.full(300_000, 1), np.tile(np.arange(2, 3000), 7), np.arange(5000, 9000)].astype(np.uint64)
    assert pr.find_runs(long) == [(0, 300_000, 1), (300_000, 7 * 2998, 2998)]
    assert pr.find_runs(np.zeros(0, np.uint64)) == []


def test_runs_of_texts_and_planted_periods(spark):
    texts = [None, "", " \n ", "a a a a a a", "a a a a a", "x " + "b c " * 4 + "b y", "\x1d \x1d \x1d\t\x1d\x1d", "A a " * 9, "w " * 50_000,
             *(" ".join(f"w{j % (3 + i)}" for j in range(7 * i)) for i in range(60))]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(3, texts[3], "clash", 1), (None, "b " * 6, "clash", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, id int").repartition(3)
    got = pr.periodic_runs(docs).collect()
    assert len(got) == len(rows)
    by_id = dict((r[0], r[1]) for r in rows)
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", by_id[r.doc_id] or "")
        runs = [(0, 50_000, 1)] if len(words) == 50_000 else runs_by_definition(words)
        dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
        assert [tuple(x) for x in r.runs] == runs and r.n_words == len(words)
        assert r.collapsed == " ".join(w for i, w in enumerate(words) if i not in dropped)
    assert pr.periodic_runs(docs.limit(0)).count() == 0

    import zlib

    for r in with_planted_period(docs.filter("doc_id > 8")).collect():
        words = by_id[r.doc_id].split()
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert r.text.split() == [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        else:
            assert r.text == by_id[r.doc_id]
