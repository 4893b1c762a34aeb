"""Language-model scores by a weighted backoff automaton.

All unigrams, bigrams and trigrams of the training tokens are counted exactly, those seen once too. Smoothing
is hierarchical: a context h (of two words, one, or none) has for its next word w

    p(w | h) = (c(h w) + m * p(w | shorter h)) / (c(h) + m),

with add-one unigrams at the root. As an automaton: contexts seen in training are states; a state has an arc for
each word seen after it, with that probability; any other word takes the failure arc to the shorter context's
state, which costs m / (c(h) + m). Unseen contexts are no states, and a path never stands on them. Over all
words, an unknown one included, the probabilities of a state add up to one.

The automaton grows with the corpus, so no task holds it whole: a task holds the states and arcs that its own
texts can reach. Three steps, each a plain shuffle of blobs that were aggregated before:

1. ``walks``: a chunk of up to ``CHUNK`` tokens becomes word numbers and a dictionary of the chunk's words.
2. ``arcs``: each chunk sends its distinct n-grams, with their counts in its training texts, to parts of the
   hash space; a part adds up all chunks' counts and sends each chunk the sums for the n-grams it sent. An
   n-gram of any frequency is one entry a chunk, so no word or pair makes a hot part.
3. ``scores``: a chunk with its sums is its automaton, and its texts are taken along it from left to right.
   Which state a path stands on depends on its last two words alone, so all steps are taken as arrays.

N-grams are told apart by 60 bits of a hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, encoded, materialise, remainder, table
from .windows import U, mix

FOLDS, HELD_OUT = 7, 2
END = b""
#: Weights of the shorter context; chosen by the held-out texts of a tenth of the smaller test input.
PAIR_PRIOR, TRIPLE_PRIOR = 500.0, 5.0
#: Tokens of a chunk, and of a text that goes into one chunk whole; a longer text is cut, and its parts overlap.
CHUNK, SEGMENT = 2_000_000, 500_000
#: Entries of a part of the hash space, about.
PART_ENTRIES = 1_500_000
KEY_BITS = 60
#: Numbers from which on they are compressed by planes.
FEW = 128
#: Stand before a text's first word. No word has this hash but by chance of 1 in 2**64.
START = U(0x5851F42D4C957F2D)


class Numbers(dict):
    """Numbers words in the order of their first lookup."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


def planes(values: np.ndarray) -> bytes:
    """Whole numbers below 2**64: the bytes that they need, for many of them as compressed planes, lowest first."""
    size = len(values)
    width = (int(values.max()).bit_length() + 7) // 8 if size else 0
    raw = np.ascontiguousarray(values.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width])
    if size < FEW:
        return bytes([size, width]) + raw.tobytes()
    out = [bytes([FEW, width]), size.to_bytes(8, "little")]
    for plane in np.ascontiguousarray(raw.T):
        packed = pa.compress(plane.tobytes(), codec="zstd", asbytes=True)
        out += [len(packed).to_bytes(8, "little"), packed]
    return b"".join(out)


def unplaned(data: bytes) -> np.ndarray:
    """The numbers again, as 32 bits each if they fit."""
    size, width = data[0], data[1]
    whole = 4 if width <= 4 else 8
    if size < FEW:
        out = np.zeros((size, whole), np.uint8)
        out[:, :width] = np.frombuffer(data, np.uint8, offset=2).reshape(size, width)
    else:
        size, at = int.from_bytes(data[2:10], "little"), 10
        out = np.zeros((size, whole), np.uint8)
        for i in range(width):
            n = int.from_bytes(data[at : at + 8], "little")
            out[:, i] = np.frombuffer(pa.decompress(data[at + 8 : at + 8 + n], size, codec="zstd"), np.uint8)
            at += 8 + n
    return out.reshape(-1).view(f"<u{whole}")


def sorted_planes(values: np.ndarray) -> bytes:
    """The same for ascending numbers, by their differences."""
    return planes(np.diff(values, prepend=U(0)))


def unplaned_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unplaned(data), dtype=np.uint64)


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def keys(u: np.ndarray | None, v: np.ndarray | None, w: np.ndarray) -> np.ndarray:
    """60-bit keys of n-grams, given their words' hashes."""
    h = mix(w ^ U(0x2545F4914F6CDD1D))
    if v is not None:
        h = mix(h + mix(v ^ U(0x9E3779B97F4A7C15)))
    if u is not None:
        h = mix(h + mix(u ^ U(0xD1B54A32D192ED03)) * U(3))
    return h >> U(64 - KEY_BITS)


class Walk:
    """The paths of a chunk: hashes of each token and the two before, and what counts."""

    def __init__(self, row: dict):
        self.dictionary = np.frombuffer(row["dictionary"], "<u8")
        self.ids = unplaned(row["ids"])
        self.sizes, self.lead, self.train = np.array(row["sizes"], np.int64), np.array(row["lead"], np.int64), np.array(row["train"], bool)
        ends = np.cumsum(self.sizes)
        self.first = ends - self.sizes
        #: 0 for a segment's first token, 1 for its second, 2 for all others.
        self.place = np.full(len(self.ids), 2, np.uint8)
        second = self.first[self.sizes > 1] + 1
        self.place[second] = 1
        self.place[self.first] = 0
        # A segment's leading tokens were counted and scored in the segment before.
        self.own = np.ones(len(self.ids), bool)
        for i in np.flatnonzero(self.lead):
            self.own[self.first[i] : self.first[i] + self.lead[i]] = False
        self.counted = np.repeat(self.train, self.sizes) & self.own
        self.led = np.zeros(len(self.ids), bool)  # a text's true second word has START before its first
        for i in np.flatnonzero(self.lead):
            self.led[self.first[i] : self.first[i] + 2] = True

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(keys, which): of all n-grams of ``order``, at the tokens ``which``."""
        if order == 1:
            return keys(None, None, self.dictionary), np.arange(len(self.dictionary))
        w = self.dictionary[self.ids]
        v = np.roll(w, 1)
        v[self.first] = START
        if order == 2:
            valid = ~(self.led & (self.place == 0))
            return keys(None, v, w)[valid], np.flatnonzero(valid)
        u = np.roll(v, 1)
        valid = (self.place > 0) & ~self.led
        return keys(u, v, w)[valid], np.flatnonzero(valid)

    def distinct(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(distinct keys ascending, their counts in training) of an order."""
        if order == 1:
            found, _ = self.grams(1)
            counts = np.bincount(self.ids[self.counted], minlength=len(found))
            by = np.argsort(found)
            return found[by], counts[by]
        found, which = self.grams(order)
        found = found << U(1) | self.counted[which].astype(np.uint64)
        found.sort()
        key = found >> U(1)
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        ones = np.concatenate(([0], np.cumsum((found & U(1)).astype(np.int64))))
        return key[heads], np.diff(ones[np.append(heads, len(key))])

    def local_counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys ascending, their counts in training, whether they are words) of all orders."""
        each = [self.distinct(order) for order in (1, 2, 3)]
        key = np.concatenate([k for k, _ in each])
        counts = np.concatenate([c for _, c in each])
        word = np.arange(len(key)) < len(each[0][0])
        by = np.argsort(key)
        return key[by], counts[by], word[by]

    def spread(self, order: int, keys_: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """The sums of the chunk's keys, given for each n-gram's token (or for each word of the dictionary)."""
        found, which = self.grams(order)
        by = np.argsort(found)
        found = found[by]
        out = np.zeros(len(self.dictionary) if order == 1 else len(self.ids), sums.dtype)
        if len(by):
            new = np.concatenate(([True], found[1:] != found[:-1]))
            own = sums[np.searchsorted(keys_, found[new])]
            out[which[by]] = own[np.cumsum(new, dtype=np.uint32) - np.uint32(1)]
        return out


def steps(walk: Walk, sums: np.ndarray, tokens: int, distinct: int, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log10 probability, unigram count, unigram log10 probability) of each step along the automaton."""
    keys_ = walk.local_counts()[0]
    one = walk.spread(1, keys_, sums)[walk.ids]
    # The root's arc, or the unknown word's.
    base = (one + 1.0) / (tokens + distinct + 1)
    p = base * PAIR_PRIOR
    pair = walk.spread(2, keys_, sums)
    p += pair
    context = np.roll(one, 1).astype(np.float64)
    context[walk.first] = texts
    p /= context + PAIR_PRIOR
    del context
    # A first word has no state of two words; all counts are 0 there, and the arc is the shorter context's.
    before = np.roll(pair, 1)
    before[walk.first] = 0
    del pair
    p *= TRIPLE_PRIOR
    triple = walk.spread(3, keys_, sums)
    p += triple
    del triple
    p /= before + TRIPLE_PRIOR
    return np.log10(p, out=p), one, np.log10(base, out=base)


WALK = "sizes array<int>, lead array<int>, train array<boolean>, ids binary, dictionary binary"


def walks(docs: DataFrame, training: Column, key: str, text: str, most: int) -> DataFrame:
    """One row a chunk: (chunk, rows, keys, sizes, lead, train, ids, dictionary, tokens, texts), the last two of training."""
    marked = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(marked.schema["key"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        row, chunk = base, base
        numbers, held, segments, size = Numbers(), [], [], 0

        def out() -> pa.RecordBatch:
            ids = np.concatenate(held)
            order = np.argsort(-np.bincount(ids, minlength=len(numbers)), kind="stable")  # frequent words get small numbers
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            hashes = np.fromiter(map(word_hash, numbers), np.uint64, len(numbers))[order]
            rows, names, lead, train = zip(*segments)
            sizes = [len(x) for x in held]
            learnt = sum(n - m for n, m, t in zip(sizes, lead, train) if t)
            starts = sum(1 for m, t in zip(lead, train) if t and not m)
            arrays = [pa.array([x], t) for x, t in ((chunk, pa.int64()), (rows, pa.list_(pa.int64())), (names, pa.list_(kind)), (sizes, pa.list_(pa.int32())), (lead, pa.list_(pa.int32())), (train, pa.list_(pa.bool_())), (planes(rank[ids]), pa.binary()), (hashes.astype("<u8").tobytes(), pa.binary()), (learnt, pa.int64()), (starts, pa.int64()))]
            return pa.RecordBatch.from_arrays(arrays, ["chunk", "rows", "keys", "sizes", "lead", "train", "ids", "dictionary", "tokens", "texts"])

        for batch in batches:
            for name, data, train in zip(batch.column("key").to_pylist(), encoded(batch), batch.column("train").to_pylist()):
                words = data.lower().split()
                words.append(END)
                for at in range(0, len(words), SEGMENT):
                    lead = min(at, 2)
                    part = words[at - lead : at + SEGMENT]
                    held.append(np.fromiter(map(numbers.__getitem__, part), np.uint32, len(part)))
                    segments.append((row, name, lead, train))
                    size += len(part)
                    if size >= most:
                        yield out()
                        chunk += 1
                        numbers, held, segments, size = Numbers(), [], [], 0
                row += 1
        if held:
            yield out()

    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("rows", T.ArrayType(T.LongType())), T.StructField("keys", T.ArrayType(marked.schema["key"].dataType)), *T._parse_datatype_string(WALK).fields, T.StructField("tokens", T.LongType()), T.StructField("texts", T.LongType())])
    return arrow_map(marked, run, schema)


def arcs(walked: DataFrame, parts: int) -> DataFrame:
    """(chunk, part, known, sums): for each chunk and part, training counts of the n-grams it has there.

    ``known`` is, in one row of a part and 0 in the others, how many of its words occur in training. A chunk
    sends nothing to a part in which it has no n-gram.
    """
    shift = U(KEY_BITS - (parts - 1).bit_length())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                key, counts, word = Walk(row).local_counts()
                counts = counts.astype(np.uint64) << U(1) | word.astype(np.uint64)
                cuts = np.searchsorted(key, np.arange(1, parts, dtype=np.uint64) << shift) if parts > 1 else np.zeros(0, np.int64)
                borders = [0, *cuts.tolist(), len(key)]
                held: list[tuple] = []
                size = 0
                for part, (a, b) in enumerate(zip(borders, borders[1:])):
                    if a < b:
                        held.append((row["chunk"], part, sorted_planes(key[a:b]), planes(counts[a:b])))
                        size += b - a
                    if held and (size > 200_000 or part == parts - 1):
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["chunk", "part", "keys", "counts"])
                        held, size = [], 0

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(part: int, held: list[dict]) -> Iterator[pa.RecordBatch]:
            each = [unplaned_sorted(x["keys"]) for x in held]
            borders = np.cumsum([0, *map(len, each)])
            key = np.concatenate(each)
            del each
            counts = np.concatenate([unplaned(x["counts"]) for x in held]).astype(np.int64)
            by = np.argsort(key)
            key = key[by]
            new = np.concatenate(([True], key[1:] != key[:-1]))
            heads = np.flatnonzero(new)
            totals = np.add.reduceat(counts[by] >> 1, heads)
            known = int((totals[(counts[by[heads]] & 1) == 1] > 0).sum())
            whole = np.empty(len(key), np.uint64)
            whole[by] = totals[np.cumsum(new) - 1]
            for i, x in enumerate(held):
                columns = [pa.array([v], t) for v, t in ((x["chunk"], pa.int64()), (part, pa.int32()), (0 if i else known, pa.int64()), (planes(whole[borders[i] : borders[i + 1]]), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "part", "known", "sums"])

        now, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != now and held:
                    yield from out(now, held)
                    held = []
                now = row["part"]
                held.append(row)
        if held:
            yield from out(now, held)

    sent = arrow_map(walked.select("chunk", *[x.split()[0] for x in WALK.split(", ")]), send, "chunk long, part int, keys binary, counts binary")
    return arrow_map(sent.repartition("part").sortWithinPartitions("part"), add, "chunk long, part int, known long, sums binary")


def scores(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text", chunk: int | None = None, entries: int | None = None) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every text of ``docs``.

    The model learns from the rows for which ``training`` is true (null: not). A null or empty text is its end
    alone. Null keys and repeated rows each give a row, and a repeated row counts each time. Without training
    tokens every probability is 1, the unknown word's. Texts of any length go in parts of SEGMENT tokens.
    Only the named columns are read.

    A task holds a chunk of ``chunk`` tokens (CHUNK), or ``entries`` of a part (PART_ENTRIES), at about 150 bytes
    for each. Chunks and parts both grow with the corpus, and a chunk sends each part a row: on a large corpus
    both should be as large as memory allows, so that a row has many entries.
    """
    chunk, entries = chunk or CHUNK, entries or PART_ENTRIES
    walked = materialise(walks(docs, training, key, text, chunk), "walks")
    size = walked.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("texts"), F.lit(0)), F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()
    tokens, texts, whole = map(int, size)
    parts = 1 << max(0, math.ceil(math.log2(max(1.0, 1.5 * whole / entries))))
    summed = materialise(arcs(walked, parts), "arcs")
    distinct = int(summed.agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0])
    fields = [x.split()[0] for x in WALK.split(", ")]
    empty = lambda names: [F.lit(None).cast(kind).alias(n) for n, kind in names]
    mine = walked.select("chunk", F.lit(-1).alias("part"), "rows", "keys", *fields, *empty([("sums", "binary")]))
    sums = summed.select("chunk", "part", *empty((n, dict(walked.dtypes)[n]) for n in ("rows", "keys", *fields)), "sums")
    kind = docs.schema[key].dataType
    names = ["_row", key, "n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(walk_row: dict, keys_: pa.Array, held: list[dict]) -> pa.RecordBatch:
            walk = Walk(walk_row)
            found, one, base = steps(walk, np.concatenate([unplaned(x["sums"]) for x in held]), tokens, distinct, texts)
            per = lambda x: np.add.reduceat(np.where(walk.own, x, 0), walk.first)
            arrays = [pa.array(walk_row["rows"], pa.int64()), keys_, *(pa.array(x) for x in (walk.sizes - walk.lead, per((one > 0).astype(np.int64)), per(base), per(found)))]
            return pa.RecordBatch.from_arrays(arrays, names)

        now, row, names_, held = None, None, None, []
        for batch in batches:
            kept = batch.column("keys")
            for i, x in enumerate(batch.drop_columns(["keys"]).to_pylist()):
                if x["chunk"] != now and row:
                    yield out(row, names_, held)
                if x["chunk"] != now:
                    now, row, held = x["chunk"], x, []
                    names_ = kept[i].values
                else:
                    held.append(x)
        if row:
            yield out(row, names_, held)

    schema = T.StructType([T.StructField("_row", T.LongType()), T.StructField(key, kind), *T._parse_datatype_string("n_tokens long, n_known long, base_score double, score double").fields])
    dealt = mine.unionByName(sums).repartition("chunk").sortWithinPartitions("chunk", "part")
    pieces = arrow_map(dealt, run, schema)
    total = pieces.groupBy("_row").agg(F.first(key).alias(key), *[F.sum(n).alias(n) for n in names[2:]])
    return total.select(key, "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op7_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` scored by a model of those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), FOLDS) == HELD_OUT
    return scores(docs, ~held_out).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op7_automaton": op7_automaton}
SQL: dict[str, str] = {}
