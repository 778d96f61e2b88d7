"""Quality rules, mixing, pseudonyms and the choice of near copies against plain versions."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from logweir.llm.language import identify_language
from logweir.llm.mixing import mix, taken_rows
from logweir.llm.pseudonyms import pseudonymise
from logweir.llm.quality import judge_quality, keep_good, text_statistics
from logweir.llm.shingle_join import near_duplicates, one_of_each
from logweir.llm.text import sampled

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " \n\t", "a b c", "a b c a b c", "x x x x x", "one two three\none two three\n\n \nfour", "# $ *a| <b>", "\x85w ",
         "w " * 3000, " ".join(f"w{i % 700} v{i % 11}" for i in range(40_000)), "A line\nA line\nA line"]


def statistics(text):
    words, lines = WORD.findall(text or ""), (text or "").split("\n")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(grams)
    held = {j for i, g in enumerate(grams) if times[g] > 1 for j in (i, i + 1, i + 2)}
    with_word = [x for x in lines if WORD.search(x)]
    n, repeat = len(words), len(held)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(with_word) - len(set(with_word)), repeat,
            n < 50 or 100 * repeat > 50 * n)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_statistics_equal_counting_in_python(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    for r in text_statistics(docs).collect():
        assert tuple(r[c] for c in COUNTS) == statistics(TEXTS[r.id]), r.id
    assert text_statistics(docs.limit(0)).count() == 0


def prose(i, upper=False):
    text = " ".join(f"word{(i * 131 + j * j * 7) % 5000}" for j in range(60 + i % 40))
    return text.upper() if upper else text


def test_rules_find_what_labels_tell(spark):
    rows = [(i, prose(i, upper=i % 5 == 0), "clash", 1.0) for i in range(400)] + [(900, None, "c", 0.0), (None, "short", "c", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rule string, n_words double")
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(0, 400, 2)] + [(2, None), (None, 0), (7777, 0)], "doc_id long, quality int")
    judged, rules = judge_quality(docs, labels)
    assert rules and {r.doc_id for r in judged.filter("kept").collect()} == {i for i in range(400) if i % 5}
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 320
    judged, rules = judge_quality(docs, labels.limit(0))
    assert not rules and judged.filter("kept").count() == 400
    assert judge_quality(docs.limit(0), labels)[0].count() == 0


def test_a_share_is_chosen_at_every_size(spark):
    ids = spark.range(20_000)
    for share in (0.0, 0.25, 1.0, 3.0):
        n = ids.filter(sampled(share, F.lit(1), F.col("id"))).count()
        assert abs(n - 20_000 * min(1, share)) <= 300
    assert "-9223372036854775624" in str(sampled(1e-17, F.col("id")))  # a bound above the least hash, not nothing


def seats(votes, n, most):
    """Sainte-Laguë one seat at a time."""
    got = dict.fromkeys(votes, 0)
    for _ in range(n):
        open_ = [k for k in votes if got[k] < most[k]]
        if not open_:
            break
        best = max(open_, key=lambda k: (votes[k] / (2 * got[k] + 1), -k))
        got[best] += 1
    return got


@pytest.mark.parametrize("words_each", [1, 3, 40])
def test_mix_takes_the_quotas(spark, words_each):
    rows = [(i, " ".join(["w"] * words_each), s, "clash", 1, 2) for i, s in enumerate(["b"] * 100 + ["a"] * 30 + [None] * 9)]
    rows += [(500, None, "a", "c", 1, 2), (501, "\n", "z", "c", 1, 2), (7, "w " * words_each, "b", "c", 1, 2), (None, "w", "b", "c", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_size string, _first int, ring int")
    got = mix(docs).collect()
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert r.mix_size == len(WORD.findall(r.row.text or "")) and 0 <= r.mix_taken <= 2 * r.mix_size
        assert r.mix_taken == r.mix_rounds * r.mix_size + sum(s["to"] - s["from"] for s in r.mix_spans)
        sizes[r.row.source] += r.mix_size
        taken[r.row.source] += r.mix_taken
        targets[r.row.source] = r.mix_target
    assert len(got) == len(rows) and {r.row.source: r.mix_source_size for r in got} == dict(sizes)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want, open_ = {}, list(order)
    left = 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = [s for s in open_ if level * weights[s] > 2 * sizes[s]]
        if not full:
            want |= {s: level * weights[s] for s in open_}
            break
        want |= {s: 2 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    assert targets == pytest.approx({s: want[s] for s in order})
    numbered = {i: want[s] for i, s in enumerate(order)}
    block = max(1, min(8, int(min(t for t in want.values() if t > 0) // 1000)))
    quota = seats(numbered, round(sum(want.values()) / block), {i: 2 * sizes[s] // block for i, s in enumerate(order)})
    assert dict(taken) == {s: quota[i] * block for i, s in enumerate(order)}
    assert sorted(map(str, mix(docs.repartition(5)).collect())) == sorted(map(str, got))
    out = taken_rows(mix(docs))
    assert out.columns == docs.columns
    assert sum(len(WORD.findall(r.text or "")) for r in out.collect()) == sum(taken.values())
    assert mix(docs.limit(0)).count() == 0


def test_mail_addresses_of_any_length(spark):
    texts = ["x@" + "a." * 1_000_000, "x@" + "ab." * 300 + "com", "y" * 1_000_000 + "@b.com", "joe.b@host.example.org.", "n.n@h.de, n.n@h.de", None]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, _found string")
    got = {r.doc_id: r for r in pseudonymise(docs, "key").collect()}
    assert [got[i].n_replaced for i in range(6)] == [0, 1, 0, 1, 2, 0]
    assert got[0].text == texts[0] and got[2].text == texts[2] and got[5].text is None
    assert re.fullmatch(r"[a-z]{3}\.[a-z]@host\.example\.org\.", got[3].text) and got[3].text != texts[3]
    one, two = got[4].text.split(", ")
    assert one == two
    assert "a very secret word" not in pseudonymise(docs, "a very secret word")._jdf.queryExecution().toString()


def test_pseudonyms_are_one_to_one_and_pass_their_checks(spark):
    def card(n):
        body = f"4{n:014d}"
        total = sum(d if i % 2 else (2 * d - 9 if 2 * d > 9 else 2 * d) for i, d in enumerate(map(int, reversed(body))))
        return body + str(-total % 10)

    def iban(n):
        rest = f"{n:018d}"
        return f"DE{98 - int(rest + '131400') % 97:02d}{rest}"

    values = [v for i in range(40) for v in (
        f"10.{i}.{i * 5}.{255 - i}", iban(i * 7919), f"20{i % 24:02d}-0{1 + i % 9}-{10 + i % 18}", f"1{i % 10}.0{1 + i % 9}.19{50 + i}",
        f"(2{i + 10}) 555-0{100 + i}", f"{1 + i:03d}-{10 + i}-{1000 + i}", card(i * 104729), f"user{i}@mail.example.com")]
    values = sorted(set(values))
    bad = ["999.1.1.1", "DE00123456789012345678", "2024-02-31", "000-12-3456", "4000000000000001"]
    docs = spark.createDataFrame([(i, f"see {v}, or {v} .") for i, v in enumerate(values + bad)], "doc_id long, text string")
    got = {r.doc_id: r for r in pseudonymise(docs, "k").collect()}
    made = []
    for i, v in enumerate(values):
        one, two = re.fullmatch(r"see (.+), or (.+) \.", got[i].text).groups()
        assert one == two and got[i].n_replaced == 2 and re.sub(r"\w+", "x", one) == re.sub(r"\w+", "x", v), v
        made.append(one)
    assert len(set(made)) == len(values)
    again = pseudonymise(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string"), "k").collect()
    assert all(r.n_replaced == 1 for r in again)  # each passes the check of its kind
    for i, v in enumerate(bad, len(values)):
        assert got[i].text == f"see {v}, or {v} ." and got[i].n_replaced == 0 and got[i].n_unchecked == 2


def test_near_copies_equal_all_pairs(spark):
    base = [" ".join(f"t{(k * 37 + j * j) % 400}" for j in range(60)) for k in range(12)]
    texts = [t for b in base for t in (b, b, b + " extra", "front " + b, " ".join(b.split()[:40]))] + [None, "", "a b", "a b"]
    rows = [(i, t, "clash", "clash", 1) for i, t in enumerate(texts)] + [(None, base[0], "c", "c", 1), (4, texts[4], "c", "c", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _class string, id string, nth int")
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if t and t.split() else set()
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = {r.doc_id: r.class_id for r in near_duplicates(docs.filter("doc_id IS NOT NULL")).collect()}
    assert got == {i: root(i) for i in sets}
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted(i for i in sets if root(i) == i)
    assert one_of_each(docs.limit(0)).count() == 0


def test_language_of_hyperdimensional_profiles(spark):
    words = {"xx": ["bako", "lumi", "teka", "omu"], "yy": ["schtr", "grz", "pfl", "knst"], "zz": ["oiea", "aeuo", "uuia", "eeo"]}
    rows = [(i, lang, " ".join(w[(i * 7 + j * j) % 4] for j in range(30)), "clash") for i in range(60) for lang, w in words.items()]
    rows += [(900, "xx", None, "c"), (901, "xx", "123 !", "c"), (902, None, "grz pfl knst", "c"), (903, "yy", "teka lumi " * 50_000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, score string")
    got = identify_language(docs, F.col("doc_id") < 50)
    assert got.count() == len(rows)
    told = {(r.doc_id, r.lang_pred) for r in got.filter("doc_id >= 50").collect()}
    assert told == {(i, lang) for i in range(50, 60) for lang in words} | {(900, "und"), (901, "und"), (902, "yy"), (903, "xx")}
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert {r.lang_pred for r in identify_language(docs, F.lit(False)).collect()} == {"und"}
    assert identify_language(docs.limit(0), F.lit(True)).count() == 0
