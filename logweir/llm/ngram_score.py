"""Log probabilities of texts under a trigram model held in Elias-Fano tries."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .elias_fano import EliasFano, mapped
from .text import whole

#: The token that ends a text: no word is empty. The hash that stands for the begin of a text.
END, BEGIN = b"", 0x6265676E
#: Bytes of text cut up in one go and per shard, tokens looked up in one go.
TOGETHER, SHARD_BYTES, AT_ONCE = 8_000_000, 8_000_000, 100_000
#: Tokens after one word before it is split over shards.
SPLIT_TOKENS = 300_000
#: Distinct words that a counting task holds before it hands them on. Counts that are held before they are added up.
HELD_WORDS, MOST_HELD = 1_000_000, 1_500_000
#: A word is common if it has at least one in so many bytes of text, and is among so many.
COMMON_SHARE, MOST_COMMON = 32_000_000, 400_000
#: Steps of one in sums of logarithms on their way.
FINE = 2.0**32
#: What a part keeps of its rows: counts and base scores are those of common words.
HOME = ("ids", "learned", "n_tokens", "n_known", "base")
#: Steps per halving of a quantised probability.
STEPS = 1024


def quantised(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-np.log2(p) * STEPS), 65535).astype(np.uint16)


def restored(codes: np.ndarray) -> np.ndarray:
    return np.exp2(codes / -STEPS)


class Trie:
    """Word -> next words, and word -> word before -> next words, of one shard.

    A next word below two words is written as its place among the next words of the later one.
    Levels are monotone: each list of siblings is moved up by where the lists before it end.
    """

    def __init__(self, u: np.ndarray, pair: np.ndarray, n: np.ndarray, n_words: int, discount: float, split: "Split") -> None:
        """Distinct ``u, v, w`` in order of ``pair = v * n_words + w``, then u, with their counts."""
        self.n_words, v = n_words, pair // n_words
        own = ~np.isin(v, split.words)
        at = np.flatnonzero(np.diff(pair[own], prepend=-1))
        pairs, counts = np.append(pair[own][at], split.pairs), np.append(_sums(n[own], at), split.counts)
        order = np.argsort(pairs)
        pairs, counts = pairs[order], counts[order]
        after = pairs // n_words
        listed = np.bincount(after, minlength=n_words)
        kinds, totals = listed.copy(), np.bincount(after, counts, n_words)
        kinds[split.words], totals[split.words] = split.kinds, split.totals
        first = np.concatenate([[0], np.cumsum(listed)])
        contexts, of = np.unique(v * n_words + u, return_inverse=True)
        seen, kinds3 = np.bincount(of, n, len(contexts)), np.bincount(of, minlength=len(contexts))
        ends = np.cumsum(listed[contexts // n_words])
        bases = np.concatenate([[0], ends])
        triples = bases[of] + np.searchsorted(pairs, pair) - first[v]
        order = np.argsort(triples)
        triples, owner, counts3 = triples[order], of[order], n[order]
        self.pairs, self.contexts, self.triples = EliasFano(pairs), EliasFano(contexts), EliasFano(triples)
        self.first, self.bases = EliasFano(first), EliasFano(bases)
        some = np.maximum(totals, 1)
        self.part2, self.rest2, self.part3, self.rest3 = mapped(
            quantised((counts - discount) / totals[after]),
            quantised(np.where(totals > 0, discount * kinds / some, 1.0)),
            quantised((counts3 - discount) / seen[owner]),
            quantised(discount * kinds3 / np.maximum(seen, 1)),
        )

    def probability(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, p1: np.ndarray) -> np.ndarray:
        """``p(w | u v)``, with ``p1`` as the probability of ``w`` alone."""
        pair = self.pairs.find(v * self.n_words + w)
        held = np.flatnonzero(pair >= 0)
        p = restored(self.rest2[v]) * p1
        p[held] += restored(self.part2[pair[held]])
        context = self.contexts.find(v * self.n_words + u)
        known = np.flatnonzero(context >= 0)
        p[known] *= restored(self.rest3[context[known]])
        both = np.flatnonzero((context >= 0) & (pair >= 0))
        triple = self.triples.find(self.bases[context[both]] + pair[both] - self.first[v[both]])
        hit = triple >= 0
        p[both[hit]] += restored(self.part3[triple[hit]])
        return p


@dataclass(frozen=True)
class Split:
    """What a shard is told of the words that are split over shards: how many tokens and different
    words follow each in all shards, and how often each pair asked for occurs in all."""

    words: np.ndarray
    totals: np.ndarray
    kinds: np.ndarray
    pairs: np.ndarray
    counts: np.ndarray


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows in groups of about :data:`TOGETHER` bytes of text, learned ones first: the rows without
    their texts, the row of each token, the words before it (u, v) and itself (w) as places in
    hashes, the hashes."""
    for batch in batches:
        batch = batch.take(pc.sort_indices(batch.column("learned"), sort_keys=[("", "descending")]))
        texts = batch.column("text").cast(pa.binary())
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, "right")))
            flat: list[bytes] = []
            lengths = np.zeros(to - at, np.int64)
            for i, text in enumerate(texts[at:to].to_pylist()):
                found = text.lower().split()
                flat += found
                flat.append(END)
                lengths[i] = len(found) + 1
            coded = pa.array(flat, pa.binary()).dictionary_encode()
            del flat
            hashes = np.append(hashed(coded.dictionary.to_pylist()), BEGIN)
            w = coded.indices.to_numpy()
            row = np.repeat(np.arange(to - at), lengths)
            place = np.arange(len(w)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            v, u = np.roll(w, 1), np.roll(w, 2)
            v[place < 1], u[place < 2] = len(hashes) - 1, len(hashes) - 1
            yield batch.slice(at, to - at).drop_columns("text"), row, u, v, w, hashes
            at = to


class Common:
    """Common words by falling frequency, as codes from 0; the begin has one too. ``tokens`` counts
    all tokens, ``counts`` those learned from, ``parts`` over how many shards a word before is split."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, tokens: np.ndarray) -> None:
        order = np.lexsort((words, -tokens))[:MOST_COMMON]
        words, self.counts = np.append(words[order], BEGIN), np.append(counts[order], 0)
        self.parts = np.append(-(-tokens[order] // SPLIT_TOKENS), 1)
        self.code = np.argsort(words)
        self.words = words[self.code]

    def __len__(self) -> int:
        return len(self.words)

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """The code of each word; -1 for the others."""
        at = np.minimum(np.searchsorted(self.words, hashes), len(self) - 1)
        return np.where(self.words[at] == hashes, self.code[at], -1)

    def shard(self, hashes: np.ndarray, code: np.ndarray, u: np.ndarray, v: np.ndarray, shards: int) -> np.ndarray:
        """The shard of each token: one for the word before, or, for a split word, one of several by the word before that."""
        home, parts = _spread(hashes, shards), np.where(code >= 0, self.parts[code], 1)
        shard = home[v]
        split = np.flatnonzero((parts > 1)[v])
        shard[split] += _spread(hashes[u[split]], parts[v[split]])
        shard[split] %= shards
        return shard


def _spread(hashes: np.ndarray, over: int | np.ndarray) -> np.ndarray:
    spread = hashes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((spread >> np.uint64(33)).astype(np.int64) % over).astype(np.int64)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the stretches that begin at the given places."""
    return np.add.reduceat(values, starts) if len(starts) else values[:0]


def _distinct(keys: tuple[np.ndarray, ...], n: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Distinct keys in order, the last one first in rank, and the sums of their numbers."""
    order = np.lexsort(keys)
    keys = tuple(k[order] for k in keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(new)
    return tuple(k[starts] for k in keys), _sums(n[order], starts)


class Tally:
    """Counts of keys. What it holds is made distinct whenever it has doubled."""

    def __init__(self, kinds: int) -> None:
        self.held: list[tuple] = [(*[np.zeros(0, np.int64)] * kinds, np.zeros(0, np.int64))]
        self.most, self.size = MOST_HELD, 0

    def add(self, *keys_and_n: np.ndarray) -> None:
        self.held.append(keys_and_n)
        self.size += len(keys_and_n[0])
        if self.size > self.most:
            self.result()
            self.most = max(MOST_HELD, 2 * self.size)

    def result(self) -> tuple[np.ndarray, ...]:
        *keys, n = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held = []
        keys, n = _distinct(tuple(keys), n)
        self.held, self.size = [(*keys, n)], len(n)
        return self.held[0]


def squeezed(*lists: np.ndarray) -> bytes:
    """Lists of whole numbers as planes of bytes, as few as the largest needs, compressed."""
    head, planes = [len(lists)], []
    for x in lists:
        x = np.ascontiguousarray(x, np.int64)
        width = -(-int(np.bitwise_or.reduce(x.view(np.uint64))).bit_length() // 8) if len(x) else 0
        head += [len(x), width]
        planes.append(x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(np.array(head, np.int64).tobytes() + b"".join(planes))


def opened(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    at, out = 8 + 16 * n, []
    for size, width in np.frombuffer(raw, np.int64, 2 * n, 8).reshape(-1, 2).tolist():
        wide = np.zeros((size, 8), np.uint8)
        wide[:, :width] = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size).T
        out.append(wide.view(np.int64).ravel())
        at += size * width
    return out


def _packed(u: np.ndarray, v: np.ndarray, w: np.ndarray, row: np.ndarray, learned: int, code: np.ndarray, hashes: np.ndarray, common: int) -> bytes:
    """Tokens as codes of common words, then places in a list of the other words, and rows as steps."""
    tokens = np.concatenate([u, v, w])
    values = code[tokens]
    rare = np.flatnonzero(values < 0)
    other, at = np.unique(hashes[tokens[rare]].view(np.uint64), return_inverse=True)
    values[rare] = common + at
    return squeezed(other.view(np.int64), *values.reshape(3, -1), np.diff(row, prepend=0), np.array([learned]))


def count_words(rows: DataFrame, least: int) -> tuple[int, int, Common]:
    """Training tokens, distinct ones, and the words with at least ``least`` tokens in all rows.

    A task adds up its own words, one shuffle the rest. The driver gets the common words and
    two numbers from each task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n, rest = (np.empty(0, np.int64) for _ in range(3))
        told = lambda: pa.RecordBatch.from_arrays([pa.array(words), pa.array(n), pa.array(rest)], ["word", "n", "rest"])
        for part, row, _, _, w, hashes in _cut(batches):
            last = np.searchsorted(row, pc.sum(part.column("learned")).as_py() or 0)
            own = [np.bincount(x, minlength=len(hashes) - 1) for x in (w[:last], w[last:])]
            words, at = np.unique(np.concatenate([words, hashes[:-1]]), return_inverse=True)
            n, rest = (np.bincount(at, np.concatenate(x), len(words)).astype(np.int64) for x in ((n, own[0]), (rest, own[1])))
            if len(words) > HELD_WORDS:
                yield told()
                words, n, rest = words[:0], n[:0], rest[:0]
        yield told()

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = distinct = 0
        for batch in batches:
            n = batch.column("n")
            total, distinct = total + (pc.sum(n).as_py() or 0), distinct + (pc.sum(pc.greater(n, 0)).as_py() or 0)
            yield batch.filter(pc.greater_equal(pc.add(n, batch.column("rest")), least))
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total]), pa.array([distinct])], ["word", "n", "rest"])

    kinds = "word long, n long, rest long"
    sums = rows.mapInArrow(count, kinds).groupBy("word").agg(F.sum("n").alias("n"), F.sum("rest").alias("rest"))
    found = sums.mapInArrow(chosen, kinds).toArrow()
    is_sum = pc.is_null(found.column("word"))
    numbers, words = found.filter(is_sum), found.filter(pc.invert(is_sum))
    word, n, rest = (words.column(c).to_numpy().astype(np.int64) for c in ("word", "n", "rest"))
    return pc.sum(numbers.column("n")).as_py() or 0, pc.sum(numbers.column("rest")).as_py() or 0, Common(word, n, n + rest)


def score_texts(
    docs: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", discount: float = 0.75
) -> DataFrame:
    """``id_col, learned, n_tokens, n_known, train_tokens, base_score, score`` for each row.

    Tokens are words with A-Z in lower case and one end. A token's base probability is its
    share of the training tokens, with half a count added; the model interpolates discounted
    shares after one and two words with it. ``score`` is the text's log10 probability.

    Rows are taken in parts. A part's tokens go to shards by the word before them, packed as
    codes; a word before many tokens is split over shards by the word before it. A task has all
    training and all scored tokens of its shard: it builds the shard's trie in mapped files,
    looks the tokens up and sends sums back to the parts, in the order the part gave them. What
    a shard cannot count alone, it asks for in one shuffle: how often each of its words occurs
    in all shards, unless the word is common, and each pair whose first word is split. Common
    words, whose number is bounded, are known to all tasks.

    The number of shards grows with the text; a task holds the packed tokens of its shard and
    its distinct triples of words. Words are told apart by 64-bit hashes. The begin of texts is
    not split, nor is a pair of words before a large share of all tokens.

    * A null text is empty: its one token is the end. A null in ``learn_from`` is false.
    * Rows equal in id and text are scored alike and each returned; each counts in training.
    * Without training rows all tokens are unknown. An empty table gives no rows.
    * Columns but the two, and those of ``learn_from``, are not looked at.
    """
    id_type, spark = docs.schema[id_col].dataType.simpleString(), docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(learn_from, F.lit(False)).alias("learned"), whole(F.col(text_col)).alias("text")
    )
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    shards = int(1 + size // SHARD_BYTES)
    spans = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = max(min(shards, spans), shards // 8)
    total, distinct, common = count_words(rows, int(1 + size // COMMON_SHARE))
    n_common, split, counts = len(common), np.flatnonzero(common.parts > 1), common.counts
    log_alone = lambda n: np.log10((n + 0.5) / (total + 0.5 * (distinct + 1)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, row, u, v, w, hashes in _cut(batches):
            code, n = common.codes(hashes), part.num_rows
            ids, learned = part.column("id"), part.column("learned")
            name = xxhash.xxh64(w.tobytes() + hashes.tobytes() + repr(ids.to_pylist()).encode(), seed=TaskContext.get().partitionId())
            name = np.uint64(name.intdigest()).astype(np.int64)
            count = counts[code]
            base = np.bincount(row, np.where(code < 0, 0, log_alone(count))[w], n)
            known = np.bincount(row, ((code >= 0) & (count > 0))[w], n)
            shard = common.shard(hashes, code, u, v, shards)
            order = np.argsort(shard.astype(np.uint16) if shards < 2**16 else shard, kind="stable")
            u, v, w, rows = u[order], v[order], w[order], row[order]
            present, starts = np.unique(shard[order], return_index=True)
            last = pc.sum(learned).as_py() or 0
            bounds = [*starts.tolist(), len(order)]
            blobs = [
                _packed(u[a:b], v[a:b], w[a:b], rows[a:b], int(np.searchsorted(rows[a:b], last)), code, hashes, n_common)
                for a, b in zip(bounds[:-1], bounds[1:], strict=True)
            ]
            home = [ids, learned, np.bincount(row, minlength=n), known.astype(np.int64), base]
            offsets = pa.array([0, n, *[n] * len(blobs)], pa.int32())
            only_first = pa.array([False] + [True] * len(blobs))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x) if isinstance(x, np.ndarray) else x, mask=only_first) for x in home]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(name) % shards, *present.tolist()], pa.int32()), pa.array([name] * (1 + len(blobs)), pa.int64()),
                 *lists, pa.array([None, *blobs], pa.binary())], ["shard", "part", *HOME, "blob"])

    home = f"ids array<{id_type}>, learned array<boolean>, n_tokens array<long>, n_known array<long>, base array<double>"
    dealt = rows.mapInArrow(pack, f"shard int, part long, {home}, blob binary").repartition(max(1, min(shards, spans)), "shard")

    def read(blobs: pa.ChunkedArray) -> Iterator[tuple]:
        """Tokens u, v, w, their rows, and how many are learned from; with hashes of words from ``n_common``."""
        for blob in blobs:
            other, u, v, w, steps, learned = opened(blob.as_py())
            yield other.view(np.uint64), u, v, w, np.cumsum(steps), int(learned[0])

    def asked(blobs: pa.ChunkedArray) -> tuple[np.ndarray, ...]:
        """What a shard asks for, in order of share, kind and key, with its own counts: words that are
        not common (kind -1), and the words after a split word (its code), by code or hash."""
        tally, is_split = Tally(2), np.zeros(n_common + 1, bool)
        is_split[split] = True
        for other, _, v, w, _, learned in read(blobs):
            hashes = np.append(other, np.uint64(0)).view(np.int64)
            key = lambda x: np.where(x < n_common, x, hashes[np.maximum(x - n_common, 0)])  # noqa: B023, E731
            here = (np.arange(len(w)) < learned).astype(np.int64)
            rare, after = np.flatnonzero(w >= n_common), np.flatnonzero(is_split[np.minimum(v, n_common)])
            tally.add(key(w[rare]), np.full(len(rare), -1), here[rare])
            tally.add(key(w[after]), v[after], here[after])
        key, kind, n = tally.result()
        share = _spread(key, shares)
        order = np.argsort(share, kind="stable")
        return share[order], kind[order], key[order], n[order]

    def tell(tokens: pa.Table) -> pa.Table:
        blobs = tokens.column("blob").drop_null()
        share, kind, key, n = asked(blobs)
        kinds = np.unique(kind)
        bounds = np.searchsorted(share, np.arange(shares + 1)).tolist()
        at = [i for i in range(shares) if bounds[i] < bounds[i + 1] or (kinds >= 0).any()]
        told = []
        for i in at:
            own = slice(bounds[i], bounds[i + 1])
            sizes = np.diff(np.searchsorted(kind[own], kinds), append=bounds[i + 1] - bounds[i])
            told.append(squeezed(kinds + 1, sizes, key[own], n[own]))
        shard = tokens.column("shard")[0].as_py()
        return pa.table({"share": pa.array(at, pa.int32()), "at": pa.array([shard] * len(at), pa.int32()), "told": pa.array(told, pa.binary())})

    def add_up(told: pa.Table) -> pa.Table:
        parts = [opened(t.as_py()) for t in told.column("told")]
        sizes = [len(key) for _, _, key, _ in parts]
        kind = np.concatenate([np.repeat(kinds, n) for kinds, n, _, _ in parts])
        key, n = (np.concatenate([p[i] for p in parts]) for i in (2, 3))
        order = np.lexsort((key, kind))
        new = (np.diff(kind[order], prepend=-1) != 0) | (np.diff(key[order], prepend=0) != 0)
        new[:1] = True
        starts = np.flatnonzero(new)
        sums = _sums(n[order], starts)
        back = np.empty(len(order), np.int64)
        back[order] = sums[np.cumsum(new) - 1]
        seen = kind[order][starts][sums > 0]
        answers = np.split(back, np.cumsum(sizes)[:-1])
        counted = [np.searchsorted(seen, p[0], "right") - np.searchsorted(seen, p[0]) for p in parts]
        blobs = [squeezed(a, c) for a, c in zip(answers, counted, strict=True)]
        return pa.table({"at": told.column("at"), "share": told.column("share"), "answer": pa.array(blobs, pa.binary())})

    told = dealt.groupBy("shard").applyInArrow(tell, "share int, at int, told binary").repartition(shares, "share")
    answers = told.groupBy("share").applyInArrow(add_up, "at int, share int, answer binary")

    def score(tokens: pa.Table, facts: pa.Table) -> pa.Table:
        texts = tokens.filter(pc.is_valid(tokens.column("blob")))
        homes = tokens.filter(pc.is_null(tokens.column("blob"))).select(["part", *HOME])
        homes = homes.append_column("tokens", pa.nulls(len(homes), pa.int64())).append_column("sums", pa.nulls(len(homes), pa.binary()))
        if not len(texts):
            return homes
        blobs = texts.column("blob")
        _, kind, key, _ = asked(blobs)
        parts = [opened(x) for x in facts.sort_by("share").column("answer").to_pylist()]
        n = np.concatenate([np.zeros(0, np.int64), *[p[0] for p in parts]])
        if len(n) != len(key):
            raise ValueError("a shard's tokens have changed since they were told")
        other = np.unique(np.concatenate([x[0] for x in read(blobs)]))
        n_words, rare = n_common + len(other), kind < 0
        place = lambda hashes: n_common + np.searchsorted(other, hashes.view(np.uint64))
        count = np.append(counts, np.zeros(len(other), np.int64))
        count[place(key[rare])] = n[rare]
        kinds = np.unique(kind)
        counted = sum((p[1] for p in parts), np.zeros(len(kinds), np.int64))[kinds >= 0]
        kinds = kinds[kinds >= 0]
        held = np.flatnonzero(~rare & (n > 0))
        follower = np.where((key[held] >= 0) & (key[held] < n_common), key[held], place(key[held]))
        known = Split(kinds, count[kinds], counted, kind[held] * n_words + follower, n[held])

        def placed() -> Iterator[tuple]:
            for own, u, v, w, row, learned in read(blobs):
                at = np.searchsorted(other, own)
                yield *(np.where(x < n_common, x, n_common + np.append(at, 0)[np.maximum(x - n_common, 0)]) for x in (u, v, w)), row, learned

        triples = Tally(2)
        for u, v, w, _, learned in placed():
            triples.add(u[:learned], (v * n_words + w)[:learned], np.ones(learned, np.int64))
        u, pair, n = triples.result()
        del triples
        trie = Trie(u, pair, n, n_words, discount, known)
        del u, pair, n
        alone, log_p1 = (count + 0.5) / (total + 0.5 * (distinct + 1)), log_alone(count)
        log_p1[:n_common] = 0
        told, sizes = [], []
        for some in _batches(placed()):
            u, v, w, row = (np.concatenate([x[i] for x in some]) for i in range(4))
            owner = np.repeat(np.arange(len(some)), [len(x[0]) for x in some])
            starts = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
            whole_numbers = lambda x: np.rint(-FINE * _sums(x, starts)).astype(np.int64)
            sums = [whole_numbers(np.log10(trie.probability(u, v, w, alone[w]))), whole_numbers(log_p1[w]),
                    _sums(((w >= n_common) & (count[w] > 0)).astype(np.int64), starts)]
            bounds = np.searchsorted(owner[starts], np.arange(len(some) + 1)).tolist()
            for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                told.append(squeezed(np.diff(row[starts[a:b]], prepend=0), *[x[a:b] for x in sums]))
                sizes.append(len(some[i][0]))
        sums = pa.table({"part": texts.column("part"), **{c: pa.nulls(len(texts), homes.schema.field(c).type) for c in HOME},
                         "tokens": pa.array(sizes, pa.int64()), "sums": pa.array(told, pa.binary())})
        return pa.concat_tables([homes, sums])

    def gather(told: pa.Table) -> pa.Table:
        home = told.filter(pc.is_null(told.column("sums")))
        if len(home) != 1:
            raise ValueError("a part's rows have changed since they were told")
        ids, learned, n_tokens, n_known, base = (home.column(c).combine_chunks().flatten() for c in HOME)
        known, base, score = n_known.to_numpy().copy(), base.to_numpy().copy(), np.zeros(len(ids), np.int64)
        rare = np.zeros(len(ids), np.int64)
        for blob in told.column("sums").drop_null():
            steps, of_model, of_base, more = opened(blob.as_py())
            row = np.cumsum(steps)
            score[row] += of_model
            rare[row] += of_base
            known[row] += more
        if (pc.sum(told.column("tokens")).as_py() or 0) != pc.sum(n_tokens).as_py():
            raise ValueError("a part's tokens have changed since they were told")
        return pa.table({"id": ids, "learned": learned, "n_tokens": n_tokens, "n_known": known,
                         "base_score": base - rare / FINE, "score": score / -FINE})

    sums = dealt.groupBy("shard").cogroup(answers.groupBy("at")).applyInArrow(score, f"part long, {home}, tokens long, sums binary")
    scored = sums.groupBy("part").applyInArrow(
        gather, f"id {id_type}, learned boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(
        F.col("id").alias(id_col), "learned", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def _batches(pieces: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Pieces in lists of about :data:`AT_ONCE` tokens."""
    some, n = [], 0
    for piece in pieces:
        some.append(piece)
        n += len(piece[0])
        if n >= AT_ONCE:
            yield some
            some, n = [], 0
    if some:
        yield some
