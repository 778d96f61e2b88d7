"""SentencePiece encoding and decoding: a relational lattice of pieces, folded word by word."""

import heapq
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import let, whole

SPACE = "▁"
#: Words up to this length go through the lattice, whose state is the bits of a long.
LATTICE_LETTERS = 62
#: Letters of a piece's begin that one look-up tells, with all pieces within it.
STEM = 4
#: Added to the code point of a letter that is no piece; ids of pieces are smaller.
NO_PIECE = 1 << 21
#: Bytes of text whose words form one vocabulary.
BLOCK_BYTES = 12_000_000
#: Partitions of distinct words for each block.
WORD_PARTS = 8
#: Bytes of text cut in one go.
TOGETHER = 4_000_000


@dataclass(frozen=True)
class PieceTable:
    """Pieces of a model: ``(piece, id, score)``, the id of byte 0, and whether it merges (BPE)."""

    pieces: tuple[tuple[str, int, float], ...]
    shown: tuple[bytes, ...]
    first_byte: int
    merges: bool

    @property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.pieces)

    @property
    def costs(self) -> list[float]:
        """The distinct costs of pieces, smallest first."""
        return sorted({-score for _, _, score in self.pieces})

    @property
    def pairs(self) -> frozenset[str]:
        """Neighbouring letters within a piece. No piece crosses a place between two others."""
        return frozenset(p[i : i + 2] for p, _, _ in self.pieces for i in range(len(p) - 1))


def load_pieces(path: str) -> PieceTable:
    """Read a model file on the driver. Its size is fixed, so its table may be broadcast."""
    from sentencepiece import sentencepiece_model_pb2 as model_pb2

    model = model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    kinds = model_pb2.ModelProto.SentencePiece
    if any(len(p.piece) > 1 and SPACE in p.piece.lstrip(SPACE) for p in model.pieces if p.type == kinds.NORMAL):
        raise ValueError("pieces that hold a space after a letter are not supported")
    if model.normalizer_spec.name != "identity" or model.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only models that leave the text as it is are supported")
    shown = [bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else b"" if p.type == kinds.CONTROL else p.piece.encode() for p in model.pieces]
    return PieceTable(
        tuple((p.piece, i, p.score) for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL),
        tuple(shown),
        next(i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE),
        model.trainer_spec.model_type == 2,
    )


def marked(text: Column) -> Column:
    """The text as a model sees it: a space in front, and a visible letter for spaces."""
    return F.when(whole(text) == "", F.lit("")).otherwise(F.concat(F.lit(SPACE), F.translate(whole(text), " ", SPACE)))


@dataclass(frozen=True)
class Edge:
    """A piece at a place of a word, packed into a long that sorts by cost, start and size.

    From the lowest bit: 22 bits of the id (a letter that is no piece has its code point, plus
    2 to the 21), 6 bits of the size, 6 bits of the start, then the rank of the cost.
    """

    packed: Column

    @staticmethod
    def pack(rank: int, size: int, code: int) -> int:
        return rank << 34 | size << 22 | code

    def bits(self, low: int, many: int) -> Column:
        return F.shiftright(self.packed, low).bitwiseAND(F.lit((1 << many) - 1)).cast("int")

    @property
    def rank(self) -> Column:
        return F.shiftright(self.packed, 34).cast("int")

    @property
    def start(self) -> Column:
        return self.bits(28, 6)

    @property
    def size(self) -> Column:
        return self.bits(22, 6)

    @property
    def span(self) -> Column:
        """Start and size: 64 times the start, plus the size."""
        return self.bits(22, 12)

    @property
    def id(self) -> Column:
        """The id; that of a letter without a piece is its code point, negative and less one."""
        code = self.bits(0, 22)
        return F.when(code < NO_PIECE, code).otherwise(F.lit(NO_PIECE - 1) - code)


def stems(table: PieceTable) -> Iterator[list[tuple[str, list[int], list[int]]]]:
    """For each depth to ``STEM``: the begins of pieces of so many letters, the pieces that begin
    them (packed, with the first letter's), and the sizes of the longer pieces that go on from them
    (at depth ``STEM`` only)."""
    rank = {c: i for i, c in enumerate(table.costs)}
    packed = {p: Edge.pack(rank[-score], len(p), i) for p, i, score in table.pieces}
    sizes: dict[str, set[int]] = {}
    for p in packed:
        for k in range(1, min(STEM, len(p)) + 1):
            sizes.setdefault(p[:k], set()).add(len(p))
    for depth in range(1, STEM + 1):
        yield [
            (stem, [packed.get(stem[0], Edge.pack(len(rank), 1, NO_PIECE + ord(stem[0])))]
             + [packed[stem[:k]] for k in range(2, depth + 1) if stem[:k] in packed],
             [0, *sorted(x for x in held if x > STEM)] if depth == STEM else [])
            for stem, held in sizes.items() if len(stem) == depth
        ]


def lattice(words: DataFrame, table: PieceTable, keys: list[str], carried: str) -> DataFrame:
    """Edges of each word: all its substrings that are pieces, as ``keys, carried, n, edges``.

    Each place of a word is joined to the longest begin of a piece found there, of at most ``STEM``
    letters, which tells all pieces up to that size at once. Only substrings as long as some longer
    piece with that begin are exploded and joined to the table. A single letter that is no piece is
    an edge too. Edges are packed longs (:class:`Edge`), sorted. Rows of a word are told by a number
    that falls in the order they come in, so that grouping finds them sorted; if ``words`` are
    partitioned by ``keys``, nothing is shuffled. ``carried`` goes with a word's first letter.
    """
    spark = words.sparkSession
    rank = {c: i for i, c in enumerate(table.costs)}
    rest = F.length("word") - F.col("start")
    part = lambda size: F.substring("word", F.col("start") + 1, size)
    places = words.withColumn("_nth", F.monotonically_increasing_id()).select(
        "_nth", *keys, carried, "word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("start"))
    begins, missed = [], F.lit(True)
    for depth, rows in reversed(list(enumerate(stems(table), 1))):
        begin, known, more = f"_begin{depth}", f"_known{depth}", f"_more{depth}"
        schema = T.StructType([
            T.StructField(begin, T.StringType(), False), T.StructField(known, T.ArrayType(T.LongType(), False), False),
            T.StructField(more, T.ArrayType(T.IntegerType(), False), False)])
        found = F.broadcast(spark.createDataFrame(rows, schema))
        places = places.withColumn("_key", F.when(missed & (rest >= depth), part(F.lit(depth)))).join(found, F.col("_key") == F.col(begin), "left")
        begins.append(F.col(known))
        missed &= F.col(begin).isNull()
    letter = F.lit(Edge.pack(len(rank), 1, NO_PIECE)) + F.ascii(part(F.lit(1)))
    sizes = F.coalesce(f"_more{STEM}", F.array(F.lit(0)))
    schema = T.StructType([T.StructField("piece", T.StringType(), False), T.StructField("packed", T.LongType(), False)])
    far = [(p, Edge.pack(rank[-score], len(p), i)) for p, i, score in table.pieces if STEM < len(p) <= LATTICE_LETTERS]
    edges = (
        places.select("_nth", *keys, carried, "word", "start", F.coalesce(*begins, F.array(letter)).alias("known"), F.explode(sizes).alias("size"))
        .join(F.broadcast(spark.createDataFrame(far, schema)), F.when(F.col("size").between(1, rest), part(F.col("size"))) == F.col("piece"), "left")
        .filter("size = 0 OR packed IS NOT NULL")
    )
    first = lambda c: F.when((F.col("start") == 0) & (F.col("size") == 0), c)
    here = F.when(F.col("size") == 0, F.col("known")).otherwise(F.array(F.coalesce("packed", F.lit(0).cast("long"))))
    moved = lambda c: F.transform(c["known"], lambda e: e + F.shiftleft(c["start"].cast("long"), 28))
    return (
        edges.select(
            "_nth", *keys, first(F.col(carried)).alias(carried), first(F.length("word")).alias("n"),
            F.struct("start", here.alias("known")).alias("here"))
        .groupBy("_nth", *keys)
        .agg(F.sort_array(F.flatten(F.transform(F.collect_list("here"), moved))).alias("edges"), F.first(carried, ignorenulls=True).alias(carried),
             F.first("n", ignorenulls=True).alias("n"))
    )


def masks() -> tuple[Column, Column]:
    """For each span the bits of the two places it joins, and of those between; 0 if it is too long."""
    spans = [(s, s + size) for s in range(64) for size in range(64)]
    ends = [1 << a | 1 << b if a < b <= LATTICE_LETTERS else 0 for a, b in spans]
    inner = [(1 << b) - (2 << a) if a < b <= LATTICE_LETTERS else 0 for a, b in spans]
    return tuple(F.split(F.lit(",".join(map(str, m))), ",").cast("array<long>") for m in (ends, inner))


def merge_edges(edges: Column, n: Column, table: PieceTable) -> Column:
    """The ids of a word by merging, for BPE models: a fold over its edges, best score first.

    The state has a bit for each place where a symbol starts. An edge whose two ends are such
    places with just one more between them is a merge of two neighbours; it clears that bit.
    """
    ends, inner = masks()
    bits = lambda held, by: F.call_function("shiftright", held, by)

    def merge(alive: Column, span: Column) -> Column:
        joins = (F.bit_count(alive.bitwiseAND(inner[span])) == 1) & (alive.bitwiseAND(ends[span]) == ends[span])
        return F.when(joins, alive.bitwiseAND(F.bitwise_not(inner[span]))).otherwise(alive)

    def spans(alive: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), n), lambda s: bits(alive, s).bitwiseAND(F.lit(1)) == 1)
        return let(starts, lambda at: F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda s, end: s * 63 + end))

    def chosen(taken: Column) -> Column:
        left = F.filter(edges, lambda e: F.array_contains(taken, Edge(e).span))
        ranked = F.sort_array(F.transform(left, lambda e: e.bitwiseAND(F.lit((1 << 34) - 1))))
        return F.transform(ranked, lambda e: Edge(e).id)

    every = F.call_function("shiftright", F.lit((1 << 63) - 1), F.lit(62) - n)
    alive = F.aggregate(F.transform(edges, lambda e: Edge(e).span), every, merge)
    return let(let(alive, spans), chosen)


def best_path(edges: Column, n: Column, table: PieceTable) -> Column:
    """The ids of a word by Viterbi, for unigram models: a fold over its edges by their end.

    The state has for each place the best score of a path to it, and the path's ids. A letter
    without a piece costs 1e6, more than any piece.
    """
    cell = lambda score, ids: F.struct(score.cast("double").alias("score"), ids.alias("ids"))
    nothing = F.lit(None).cast("array<int>")
    costs = F.split(F.lit(",".join(map(repr, [*table.costs, 1e6]))), ",").cast("array<double>")
    ordered = F.array_sort(F.transform(edges, lambda e: F.struct(
        (Edge(e).start + Edge(e).size).alias("end"), Edge(e).start.alias("start"),
        F.element_at(costs, Edge(e).rank + 1).alias("cost"), F.array(Edge(e).id).alias("ids"))))
    first = F.transform(F.sequence(F.lit(0), n), lambda i: F.when(i == 0, cell(F.lit(0.0), F.array().cast("array<int>"))).otherwise(
        cell(F.lit(float("-inf")), nothing)))

    def extend(best: Column, e: Column) -> Column:
        score = best[e["start"]]["score"] - e["cost"]
        return F.transform(best, lambda c, i: F.when(
            (i == e["end"]) & (score > c["score"]), cell(score, F.concat(best[e["start"]]["ids"], e["ids"]))).otherwise(c))

    return F.aggregate(ordered, first, extend, lambda best: F.element_at(best, -1)["ids"])


def merged(word: str, ids: dict[str, int], scores: dict[str, float], first_byte: int) -> list[int]:
    """The ids of one long word, by a heap of neighbouring pairs: what the fold gives, in n log n."""
    parts: list[str | None] = list(word)
    after, before = [*range(1, len(parts)), -1], [-1, *range(len(parts) - 1)]
    heap: list[tuple[float, int, str, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] >= 0 and (both := parts[i] + parts[after[i]]) in scores:
            heapq.heappush(heap, (-scores[both], i, both, after[i]))

    for i in range(len(parts)):
        offer(i)
    while heap:
        _, i, both, j = heapq.heappop(heap)
        if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
            continue
        parts[i], parts[j], after[i] = both, None, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [x for p in parts if p is not None for x in ([ids[p]] if p in ids else [first_byte + b for b in p.encode()])]


def gathered(starts: np.ndarray, sizes: np.ndarray, values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The lists ``values[start : start + size]`` of the places ``at``, one after the other."""
    taken = sizes[at]
    ends = np.cumsum(taken)
    return values[np.repeat(starts[at] - ends + taken, taken) + np.arange(ends[-1] if len(ends) else 0)]


def starts_of(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


@dataclass(frozen=True)
class Neighbours:
    """The letters of a model's pieces, numbered from 1, and which of them stand together in one."""

    number: np.ndarray
    held: np.ndarray

    @classmethod
    def of(cls, pairs: frozenset[str]) -> "Neighbours":
        letters = {c: i for i, c in enumerate(sorted(set("".join(pairs))), 1)}
        number = np.zeros(0x110000, np.uint16)
        number[[ord(c) for c in letters]] = list(letters.values())
        held = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        held[[letters[p[0]] for p in pairs], [letters[p[1]] for p in pairs]] = True
        return cls(number, held)

    def cut(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The parts of texts, cut where no piece holds both neighbours, and their number in each."""
        shown = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        joined = "".join(shown)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        number = self.number[points].astype(np.int32)
        begins = np.ones(len(points), bool)
        begins[1:] = ~self.held.ravel()[number[:-1] * self.held.shape[1] + number[1:]]
        ends = np.cumsum([len(t) for t in shown])
        begins[ends[ends < len(points)]] = True
        first = np.flatnonzero(begins)
        width = 1 + (points >= 0x80).view(np.uint8) + (points >= 0x800).view(np.uint8) + (points >= 0x10000).view(np.uint8)
        offsets = np.zeros(len(first) + 1, np.int32)
        np.cumsum(np.add.reduceat(width, first, dtype=np.int32) if len(first) else first, out=offsets[1:])
        parts = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(joined.encode()))
        return parts, np.diff(np.searchsorted(first, ends), prepend=0)


def cut_texts(texts: list[str | None], neighbours: Neighbours) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct parts of texts, commonest first, the place of each part of the texts, and
    how many parts each text has."""
    parts, lengths = neighbours.cut(texts)
    split = parts.dictionary_encode()
    codes = split.indices.to_numpy()
    order = np.argsort(-np.bincount(codes, minlength=len(split.dictionary)), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return split.dictionary.take(pa.array(order)), place[codes], lengths


def pack(ids: pa.Array, texts: pa.Array, neighbours: Neighbours) -> bytes:
    """Ids and the parts of texts, compressed. A text comes along as it is only if its parts do
    not tell it: null, empty, or with the letter that stands for spaces."""
    strings = texts.to_pylist()
    parts, codes, sizes = cut_texts(strings, neighbours)
    plain = pa.array([None if t and SPACE not in t else t for t in strings], pa.string())
    row = {"ids": ids, "plain": plain, "told": pa.array([bool(t) and SPACE not in t for t in strings], pa.bool_()),
           "sizes": pa.array(sizes.astype(np.int32))}
    lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in row.values()]
    offsets = np.frombuffer(parts.buffers()[1], np.int32, len(parts) + 1, 4 * parts.offset) if len(parts) else np.zeros(1, np.int32)
    letters = parts.buffers()[2][int(offsets[0]) : int(offsets[-1])] if len(parts) else b""
    blobs = [planes_of(codes), planes_of(np.diff(offsets)), letters]
    batch = pa.RecordBatch.from_arrays([*lists, *[pa.array([bytes(b)], pa.binary()) for b in blobs]], [*row, "codes", "lengths", "letters"])
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))
    with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(packed: pa.ChunkedArray) -> Iterator[dict[str, pa.Array]]:
    """Columns ``ids, plain, told, sizes, parts`` of each packed piece, and its codes."""
    for blob in packed:
        batch = pa.ipc.open_stream(blob.as_buffer()).read_next_batch()
        lengths = from_planes(batch.column("lengths"))
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        parts = pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), batch.column("letters")[0].as_buffer())
        yield {c: batch.column(c).flatten() for c in batch.schema.names[:4]} | {"parts": parts, "codes": batch.column("codes")}


def planes_of(values: np.ndarray) -> bytes:
    """Whole numbers as their lowest bytes, then the next ones: what compresses better than numbers, or than offsets."""
    return values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(column: pa.Array) -> np.ndarray:
    planes = np.frombuffer(column[0].as_buffer(), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(np.int64)


def codes_of(piece: dict[str, pa.Array]) -> np.ndarray:
    return from_planes(piece["codes"])


def cells(values: pa.Array) -> list[bytes]:
    """The bytes of each string; slices of one buffer, as a call to Arrow for each costs ten times that."""
    if not len(values):
        return []
    offsets = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, 4 * values.offset).tolist()
    held = values.buffers()[2].to_pybytes()
    return [held[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def vocabulary_of(pieces: list[dict[str, pa.Array]], shares: int) -> tuple[list[bytes], np.ndarray, list[np.ndarray], list[bytes]]:
    """The distinct parts of texts that go through the lattice, ordered by share (a hash) and part,
    and the share of each; the place there of each piece's parts; the longer parts, whose places
    come after. The first two do not depend on the order of the pieces."""
    every = pa.concat_arrays([piece["parts"] for piece in pieces]).dictionary_encode()
    parts, ends = every.dictionary, np.cumsum([len(piece["parts"]) for piece in pieces])
    order = pc.sort_indices(parts).to_numpy()
    words = cells(parts)
    short = pc.less_equal(pc.utf8_length(parts), LATTICE_LETTERS).to_numpy(zero_copy_only=False)
    share = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % shares
    share[~short] = shares
    order = order[np.argsort(share[order], kind="stable")]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    n, words = int(short.sum()), [words[i] for i in order.tolist()]
    return words[:n], share[order[:n]], np.split(place[every.indices.to_numpy()], ends[:-1]), words[n:]


def encode(docs: DataFrame, table: PieceTable, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, text_col, ids`` of each whole text, without begin or end.

    A text is cut where no piece holds both neighbouring letters, so before each space; then it
    is a list of places in a list of parts, and so, compressed, it crosses one shuffle to a
    block of bounded size, dealt by a hash. Each block tells its distinct parts, in lists by a
    hash of the part; where lists of the same hash meet, each distinct part becomes a lattice
    once, its edges are grouped and folded to ids, and the ids go back to the blocks in the order
    of their lists. Then a block's texts are written in ids, part by part. A part of more than 62
    letters, whose lattice would grow with its square, is merged by a heap while texts are written.

    For BPE models the fold merges by rank, as Viterbi over the scores would not give the ids of
    such a model; for unigram models it is Viterbi.

    * A null or empty text has no ids; a null stays null. Repeated rows give repeated rows.
    * Characters without a piece become the pieces of their bytes. A part of more than 62 letters
      raises an error if the model is a unigram model.
    * An empty table gives no rows; other columns are not looked at.
    """
    id_type, spark = docs.schema[id_col].dataType.simpleString(), docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 2 + size // BLOCK_BYTES
    parts = partitions_for(spark, blocks)
    merges, first_byte = table.merges, table.first_byte
    neighbours = Neighbours.of(table.pairs)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(0).to_numpy()
            order = np.argsort(block, kind="stable")
            taken, block = batch.take(pa.array(order)), block[order]
            sizes = pc.fill_null(pc.binary_length(taken.column(2)), 0).to_numpy().astype(np.int64)
            before = starts_of(sizes)
            first = np.flatnonzero(np.diff(block, prepend=-1))
            within = before - np.repeat(before[first], np.diff([*first, len(block)]))
            starts = np.flatnonzero((np.diff(block, prepend=-1) != 0) | (np.diff(within // TOGETHER, prepend=0) > 0)).tolist()
            for a, b in zip(starts, [*starts[1:], len(block)], strict=True):
                blob = pack(taken.column(1)[a:b], taken.column(2)[a:b], neighbours)
                yield pa.RecordBatch.from_arrays([pa.array(block[a : a + 1], pa.int32()), pa.array([blob], pa.binary())], ["block", "blob"])

    block = F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int").alias("block")
    dealt = rows.select(block, "id", "text").mapInArrow(packed, "block int, blob binary").repartition(parts, "block")

    # an edge takes many times the space of its word: partitions small enough to be sorted in memory
    word_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), WORD_PARTS * blocks)
    shares = 4 * word_parts

    def tell(texts: pa.Table) -> pa.Table:
        words, share, _, _ = vocabulary_of(list(unpack(texts.column("blob"))), shares)
        present, starts = np.unique(share, return_index=True)
        bounds = [*starts.tolist(), len(words)]
        lists = [[w.decode() for w in words[a:b]] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.table({
            "share": pa.array(present, pa.int32()),
            "block": pa.array([texts.column("block")[0].as_py()] * len(present), pa.int32()),
            "words": pa.array([json.dumps(w, ensure_ascii=False) for w in lists], pa.string())})

    told = dealt.groupBy("block").applyInArrow(tell, "share int, block int, words string").repartition(word_parts, "share")
    words = told.select("share", "block", F.posexplode(F.from_json("words", "array<string>")).alias("place", "word"))
    homes = words.groupBy("word", "share").agg(F.collect_list(F.struct("block", "place")).alias("homes"))
    fold = merge_edges if merges else best_path
    folded = lattice(homes, table, ["share"], "homes").select("share", "homes", fold(F.col("edges"), F.col("n"), table).alias("ids"))
    back = folded.select("share", F.explode("homes").alias("home"), "ids").select("share", "home.block", "home.place", "ids")
    placed = back.groupBy("block", "share").agg(F.sort_array(F.collect_list(F.struct("place", "ids"))).alias("placed"))
    known = placed.select(
        F.col("block").alias("known_block"), "share",
        F.flatten(F.transform("placed", lambda w: w["ids"])).alias("ids"),
        F.transform("placed", lambda w: F.size(w["ids"]).cast("tinyint")).alias("sizes"),  # at most LATTICE_LETTERS
    )
    ids = {p: i for p, i, _ in table.pieces}
    scores = {p: s for p, _, s in table.pieces}

    def write(texts: pa.Table, vocabulary: pa.Table) -> pa.Table:
        pieces = list(unpack(texts.column("blob")))
        _, share, places, far = vocabulary_of(pieces, shares)
        if far and not merges:
            raise ValueError("a word too long for the lattice of a unigram model")
        vocabulary = vocabulary.sort_by("share")
        flat = vocabulary.column("ids").combine_chunks().flatten().to_numpy()
        sizes = vocabulary.column("sizes").combine_chunks().flatten().to_numpy().astype(np.int64)
        told, counts = np.unique(share, return_counts=True)
        held = pc.list_value_length(vocabulary.column("sizes")).to_numpy()
        if not np.array_equal(vocabulary.column("share").to_numpy(), told) or not np.array_equal(held, counts):
            raise ValueError("a block's words have changed since they were told")
        # letters without a piece become the ids of their bytes
        here = np.flatnonzero(flat < 0)
        if len(here):
            letters, which = np.unique(flat[here], return_inverse=True)
            coded = [[first_byte + b for b in chr(-x - 1).encode()] for x in letters.tolist()]
            widths = np.array([len(c) for c in coded])
            grown = np.ones(len(flat), np.int64)
            grown[here] = widths[which]
            owner = np.repeat(np.arange(len(sizes)), sizes)
            flat = np.repeat(flat, grown)
            flat[flat < 0] = gathered(starts_of(widths), widths, np.concatenate(coded), which)
            sizes = np.bincount(owner, grown, len(sizes)).astype(np.int64)
        own = [merged(word.decode(), ids, scores, first_byte) for word in far]
        sizes = np.concatenate([sizes, np.array([len(x) for x in own], np.int64)])
        flat = np.concatenate([flat, *[np.array(x, flat.dtype) for x in own]])
        starts = starts_of(sizes)
        out = []
        for piece, place in zip(pieces, places, strict=True):
            codes, counts = codes_of(piece), piece["sizes"].to_numpy()
            bounds = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            coded = gathered(starts, sizes, flat, place[codes])
            ends = np.concatenate([[0], np.cumsum(sizes[place[codes]])])[bounds.to_numpy()]
            spelt = pc.binary_join(pa.ListArray.from_arrays(bounds, piece["parts"].take(pa.array(codes))), "")
            spelt = pc.replace_substring(pc.utf8_slice_codeunits(spelt, 1), SPACE, " ")
            out.append(pa.table({
                "id": piece["ids"], "text": pc.if_else(piece["told"], spelt, piece["plain"]),
                "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(coded, pa.int32()))}))
        return pa.concat_tables(out)

    written = dealt.groupBy("block").cogroup(known.groupBy("known_block")).applyInArrow(write, f"id {id_type}, text string, ids array<int>")
    return written.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "ids")


def partitions_for(spark: SparkSession, blocks: int) -> int:
    """One task for a few blocks, but no fewer tasks than other shuffles have, if there is work."""
    return max(1, min(int(blocks), max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(blocks) // 4)))


def decode(ids: Column, table: PieceTable) -> Column:
    """The text of an array of ids, as a column expression; null for null.

    Byte pieces join to characters; bytes that are none become U+FFFD. Control pieces vanish.
    The space that encoding puts in front is taken off.
    """
    shown = F.split(F.lit(",".join(x.replace(SPACE.encode(), b" ").hex() for x in table.shown)), ",")
    text = F.array_join(F.transform(ids, lambda i: shown[i]), "")
    plain = F.replace(F.make_valid_utf8(F.unhex(text).cast("string")), F.lit(SPACE), F.lit(" "))
    return let(plain, lambda p: F.when(F.startswith(p, F.lit(" ")), F.substring(p, F.lit(2), F.length(p))).otherwise(p))
