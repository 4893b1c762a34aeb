"""Packing documents into sequences by order-preserving dynamic programming.

The tokens of a task's documents form one stream, in order. A sequence is a window of the stream of at most
``WIDTH`` tokens. Windows end at a document's end (free) or at a sentence's end (``CUT_SENTENCE``). Only within
a sentence that is longer than a window may they end elsewhere, every ``GRID`` tokens (``CUT_INSIDE``). A window
also costs its padding. The least total cost of packing everything up to a cut is the least, over the cuts at
most WIDTH before it, of that cut's cost plus the padding between; as the padding is WIDTH - (place - place
before), the minimum of cost + place over a sliding window serves, which a monotone queue gives in constant
time. A window of a power of two takes no padding: for each such length one more cut before is tried, at the
cost ``CUT_SHORT``.

A task reads its part of the table in order. After each block of tokens it keeps what is still undecided: the
cheapest ways to all places that the next window may start from are followed back to where they meet, and the
windows up to there are final, whatever follows. So the block's size changes no cut, and memory is bounded by a
block and the little that is carried on. (Should the ways not have met in four blocks, the cheapest is taken.)
The stream's last window is padded, or cut into powers of two where that costs less. Nothing is shuffled;
sequence ids are the task's number in the high bits and a running number below.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .bpe import SPACE_SET, byte_letters
from .common import arrow_map, crc, table, texts_of

WIDTH = 2048
END = 1
#: Penalties, in tokens of padding: a cut at a sentence's end, one within a sentence, a window below WIDTH.
CUT_SENTENCE, CUT_INSIDE, CUT_SHORT = 1, 64, 4
#: Windows of these lengths take no padding either. Shorter ones are left to the stream's end.
SHORT = (1024, 512, 256, 128, 64)
#: A sentence that is longer than a window may be cut every so many tokens.
GRID = 128
#: Tokens that a task gathers before it packs.
BLOCK = 400_000
#: A token that ends like this, perhaps with closing marks, and has white space or nothing after it ends a sentence.
STOPS, CLOSING = (".", "!", "?", "\u3002", "\n"), "\"')]}\u00bb\u201d\u2019"
#: The pattern of byte-level pre-tokenizers, which their definitions name but do not spell out.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space so long is split off, as the pattern's look-ahead would step back over all of it.
LONG_SPACE = re.compile(f"[{SPACE_SET}]{{5000,}}")


class Tokens:
    """Token ids of byte-level BPE, by ``tiktoken`` with the ranks taken from the tokenizer's JSON file."""

    def __init__(self, definition: str):
        import tiktoken

        d = json.loads(definition)
        before = d.get("pre_tokenizer") or {}
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or d.get("normalizer"):
            raise ValueError("not a byte-level vocabulary of the kind this operator reads")
        byte = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(byte[c] for c in piece): i for piece, i in d["model"]["vocab"].items() if all(c in byte for c in piece)}
        special = {x["content"]: x["id"] for x in d["added_tokens"]}
        self.special = set(special)
        self.specials = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.coder = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks={k: v for k, v in ranks.items() if k}, special_tokens=special)
        self.closes, self.opens = np.zeros(self.coder.n_vocab, bool), np.zeros(self.coder.n_vocab, bool)
        for piece, i in ranks.items():
            text = piece.decode(errors="replace")
            self.opens[i] = text[:1].isspace()
            self.closes[i] = text.endswith("\n") or text.strip().rstrip(CLOSING).endswith(STOPS)
        self.end = np.array([END], "<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids as the pattern gives them. A long run of white space is a piece of its own, but for its last
        character if text follows."""
        found = LONG_SPACE.search(text) if len(text) > 5000 else None
        if not found:
            return self.coder.encode_to_numpy(text, allowed_special=self.special)
        out, at = [], 0
        for run in LONG_SPACE.finditer(text):
            a, b = run.span()
            follows = b < len(text) and not (self.specials and self.specials.match(text, b))
            b -= follows
            out += [self.coder.encode_to_numpy(text[at:a], allowed_special=self.special), np.array(self.coder._encode_single_piece(text[a:b]), np.uint32)]
            at = b
        return np.concatenate([*out, self.coder.encode_to_numpy(text[at:], allowed_special=self.special)])

    def document(self, text: str) -> tuple[bytes, np.ndarray]:
        """A text's ids with the end id, and the counts of tokens after which a sentence ends."""
        if not text:
            return self.end, np.zeros(0, np.int64)
        ids = self.encode(text)
        return ids.astype("<u4", copy=False).tobytes() + self.end, np.flatnonzero(self.closes[ids[:-1]] & self.opens[ids[1:]]) + 1


def ways(places: np.ndarray, costs: np.ndarray, width: int) -> tuple[list[float], list[int]]:
    """For each cut, the least cost of all windows up to it, and the cut before it on that way.

    ``places`` ascend from 0, none over ``width`` from the next.
    """
    n = len(places)
    place, cost = places.tolist(), costs.tolist()
    total: list[float] = [0] * n
    back = [0] * n
    jumps = []
    for size in SHORT:
        if size < width:
            at = np.searchsorted(places, places - size)
            jumps.append(np.where((places >= size) & (places[np.minimum(at, n - 1)] == places - size), at, -1).tolist())
    queue: deque[int] = deque([0])  # cuts in reach, total + place ascending
    for j in range(1, n):
        p = place[j]
        while place[queue[0]] < p - width:
            queue.popleft()
        i = queue[0]
        t = total[i] + place[i] + width - p
        for jump in jumps:
            k = jump[j]
            if k >= 0 and total[k] + CUT_SHORT < t:
                i, t = k, total[k] + CUT_SHORT
        back[j] = i
        total[j] = t = t + cost[j]
        key = t + p
        while queue and total[queue[-1]] + place[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    return total, back


def path(back: list[int], at: int) -> list[int]:
    """The cuts on the way to ``at``, it included."""
    out = []
    while at > 0:
        out.append(at)
        at = back[at]
    return out[::-1]


def decided(places: np.ndarray, total: list[float], back: list[int], width: int) -> int:
    """The cut at which the ways to all places that a later window may start from have met."""
    open_ = set(range(int(np.searchsorted(places, places[-1] - width, side="right")), len(places)))
    while len(open_) > 1:
        last = max(open_)
        open_.remove(last)
        open_.add(back[last])
    return open_.pop()


def last_cuts(places: np.ndarray, total: list[float], back: list[int], width: int) -> tuple[list[int], bool]:
    """The cuts of a stream that ends at the last place, and whether its last window is cut into powers of two."""
    n = len(places)
    best, at = total[-1], -1
    for i in range(int(np.searchsorted(places, places[-1] - width)), n - 1):
        pieces = (int(places[-1]) - int(places[i])).bit_count()
        if total[i] + CUT_INSIDE * (pieces - 1) < best:
            best, at = total[i] + CUT_INSIDE * (pieces - 1), i
    return ([*path(back, at), n - 1], True) if at >= 0 else (path(back, n - 1), False)


class Packer:
    """Packs a stream of documents, block by block."""

    def __init__(self, width: int = WIDTH):
        self.width = width
        self.keys: list = []
        self.ids: list[bytes] = []
        self.sizes: list[int] = []
        self.sent: list[int] = []  # tokens of a document that are packed already
        self.cuts: list[np.ndarray] = []
        self.held = 0
        self.sequence = 0

    def add(self, key, ids: bytes, cuts: np.ndarray) -> None:
        self.keys.append(key)
        self.ids.append(ids)
        self.sizes.append(len(ids) // 4)
        self.sent.append(0)
        self.cuts.append(cuts)
        self.held += self.sizes[-1]

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the tokens not yet packed may be cut, and what that costs."""
        left = np.array(self.sizes) - np.array(self.sent)
        ends = np.cumsum(left)
        begins = ends - left
        sentence = np.concatenate([c[c > s] - s + b for c, s, b in zip(self.cuts, self.sent, begins.tolist())] or [np.zeros(0, np.int64)])
        places = np.unique(np.concatenate(([0], sentence, ends)))
        costs = np.full(len(places), CUT_SENTENCE)
        costs[np.searchsorted(places, ends)] = 0
        long = np.flatnonzero(np.diff(places) > self.width)
        if len(long):
            # The grid counts from the sentence's first token that is left.
            more = np.concatenate([np.arange(places[i] + min(GRID, self.width), places[i + 1], min(GRID, self.width)) for i in long])
            places, costs = np.concatenate((places, more)), np.concatenate((costs, np.full(len(more), CUT_INSIDE)))
            by = np.argsort(places, kind="stable")
            places, costs = places[by], costs[by]
        return places, costs

    def pack(self, last: bool) -> list[tuple]:
        """Pieces (key, start, length, crc, document tokens, sequence, offset) of all windows that are decided."""
        if not self.held:
            return []
        places, costs = self.places()
        total, back = ways(places, costs, self.width)
        if last:
            chosen, split = last_cuts(places, total, back, self.width)
        else:
            at, split = decided(places, total, back, self.width), False
            if not at and self.held > 4 * BLOCK:
                near = range(int(np.searchsorted(places, places[-1] - self.width, side="right")), len(places))
                at = min(near, key=lambda i: (total[i], -i))
            chosen = path(back, at)
        stops = places[chosen].tolist()
        if split:
            at = stops[-2] if len(stops) > 1 else 0
            rest = stops.pop() - at
            while rest:
                size = 1 << (rest.bit_length() - 1)
                at += size
                rest -= size
                stops.append(at)
        out, d, at = [], 0, 0
        left = [a - b for a, b in zip(self.sizes, self.sent)]
        for stop in stops:
            offset = 0
            while at < stop:
                size = min(left[d], stop - at)
                if size:
                    s = self.sent[d]
                    out.append((self.keys[d], s, size, crc(self.ids[d][4 * s : 4 * (s + size)]), self.sizes[d], self.sequence, offset))
                    self.sent[d] += size
                    left[d] -= size
                    at += size
                    offset += size
                if not left[d] and at < stop:
                    d += 1
            self.sequence += 1
        while d < len(left) and not left[d]:
            d += 1
        self.keys, self.ids, self.sizes, self.sent, self.cuts = (x[d:] for x in (self.keys, self.ids, self.sizes, self.sent, self.cuts))
        self.held = sum(self.sizes) - sum(self.sent)
        return out


PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_tokens: dict[int, Tokens] = {}


def tokens_of(definition: str) -> Tokens:
    key = hash(definition)
    if key not in _tokens:
        _tokens.clear()
        _tokens[key] = Tokens(definition)
    return _tokens[key]


def pack(docs: DataFrame, definition: str, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents: (key, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A null or empty text is the end id alone. Null keys and repeated rows are documents like any other, an
    empty table has no piece, and only the named columns are read. A text of any length is encoded whole. The
    order of the table's parts is kept within each task; a table of any size needs no shuffle.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(definition)
    kind = dict(docs.dtypes)[key]
    key_type = T.DataType.fromDDL(kind)
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_key = to_arrow_type(key_type)
    kinds = [arrow_key, *[pa.int64()] * 6]
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        tokens, packer = tokens_of(shipped.value), Packer(width)

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            rows = [(*r[:5], base + r[5], r[6]) for r in packer.pack(last)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

        due = BLOCK
        for batch in batches:
            for k, value in zip(batch.column(key).to_pylist(), texts_of(batch, text)):
                packer.add(k, *tokens.document(value))
                if packer.held >= due:
                    yield from out(False)
                    due = packer.held + BLOCK
        yield from out(True)

    return arrow_map(docs.select(key, text), run, f"{key} {kind}, {PIECE}")


def definition(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op3_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """All ``documents`` packed into sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"), definition(path))


QUERIES = {"op3_packing": op3_packing}
SQL: dict[str, str] = {}
