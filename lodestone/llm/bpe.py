"""Byte-pair encoding and decoding over a contiguous rank array.

A word is a row of parts. The array holds, for each part boundary, the rank of the merge of the two parts
that meet there. The smallest rank is looked for by a scan, its boundary deleted, and the two neighbouring
ranks refreshed, until no boundary has a rank. Words are short, so scans beat a heap; a word of over
``LONG`` parts (a run of symbols, or text without spaces) goes through a heap with the same result, so that
no text takes time in the square of its length.

Corpora repeat their words, so each worker keeps encodings of white-space separated pieces in a cache of at
most ``CACHE`` entries, emptied when full. The cache changes no result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, table, texts_of

LONG = 64
CACHE = 400_000
NONE = 1 << 60
SPACE_SET = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = re.compile(f"[{SPACE_SET}]+")
#: str.split() also splits here, where the vocabulary's own rules see a symbol.
SEPARATORS = re.compile("[\x1c-\x1f]")


@cache
def general_category(initial: str) -> str:
    """Ranges of a character class for the code points whose general category begins with ``initial``."""
    flags = np.array([unicodedata.category(chr(i))[0] == initial for i in range(sys.maxunicode + 1)], np.int8)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags, [0]))))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.reshape(-1, 2))


def with_classes(pattern: str) -> str:
    """A vocabulary's pattern for ``re``: its classes spelt out, from one Unicode table."""
    pattern = re.sub(r"\[\\p\{([LN])\}\]", r"\\p{\1}", pattern)
    out, inside, i = [], False, 0
    while i < len(pattern):
        if m := re.compile(r"\\p\{([LN])\}|\\s|\\S").match(pattern, i):
            plain = f"^{SPACE_SET}" if m[0] == r"\S" else SPACE_SET if m[0] == r"\s" else general_category(m[1])
            out.append(plain if inside else f"[{plain}]")
            i = m.end()
        else:
            inside = (inside or pattern[i] == "[") and pattern[i] != "]"
            out.append(pattern[i])
            i += 1
    return "".join(out)


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


def merge_word(parts: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Ids after all merges. ``ranks`` maps two ids to (rank, merged id)."""
    if len(parts) > LONG:
        return merge_long(parts, ranks)
    parts = list(parts)
    best = [ranks.get(pair, (NONE, 0)) for pair in zip(parts, parts[1:])]
    while best:
        low = min(best)
        if low[0] == NONE:
            break
        at = best.index(low)
        parts[at : at + 2] = [low[1]]
        del best[at]
        if at < len(best):
            best[at] = ranks.get((parts[at], parts[at + 1]), (NONE, 0))
        if at:
            best[at - 1] = ranks.get((parts[at - 1], parts[at]), (NONE, 0))
    return parts


def merge_long(parts: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The same for a long word: boundaries in a heap by (rank, place), dead ones skipped."""
    n = len(parts)
    ids, after, before = list(parts), [*range(1, n), -1], [-1, *range(n - 1)]
    alive = [True] * n
    heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := ranks.get((ids[i], ids[i + 1])))]
    heapq.heapify(heap)
    while heap:
        _, i, left, right, new = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j < 0 or ids[i] != left or ids[j] != right:
            continue
        ids[i], alive[j], after[i] = new, False, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b >= 0 and (m := ranks.get((ids[a], ids[b]))):
                heapq.heappush(heap, (m[0], a, ids[a], ids[b], m[1]))
    return [x for x, keep in zip(ids, alive) if keep]


class Codec:
    """Encodes and decodes by the definition in a ``tokenizers`` JSON file with word-end suffixes."""

    def __init__(self, definition: dict):
        model = definition["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.ranks = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        letters = byte_letters()
        self.inner, self.last = [vocab[x] for x in letters], [vocab[x + suffix] for x in letters]
        self.special = {x["content"]: x["id"] for x in definition["added_tokens"]}
        self.specials = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        pattern = definition["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = re.compile(with_classes(pattern))
        pieces = {i: x for x, i in vocab.items()} | {i: x for x, i in self.special.items()}
        self.pieces = [pieces.get(i, "") for i in range(max(pieces) + 1)]
        self.cache: dict[str, bytes] = {}

    def encode_piece(self, piece: str) -> bytes:
        """Ids of text without white space, as little-endian unsigned 32-bit integers."""
        out: list[int] = []
        for word in self.words.findall(piece):
            data = word.encode()
            out += merge_word([*map(self.inner.__getitem__, data[:-1]), self.last[data[-1]]], self.ranks)
        return np.array(out, "<u4").tobytes()

    def encode_plain(self, text: str) -> list[bytes]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # sigma: no final form
        text = text.lower()
        parts = SPACES.split(text) if SEPARATORS.search(text) else text.split()
        cache = self.cache
        try:
            return [cache[p] for p in parts]
        except KeyError:
            pass
        if len(cache) > CACHE:
            cache.clear()
        out = []
        for p in parts:
            ids = cache.get(p)
            if ids is None:
                ids = self.encode_piece(p)
                if len(p) <= LONG:
                    cache[p] = ids
            out.append(ids)
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian unsigned 32-bit integers."""
        if self.specials is None or "<|" not in text:
            return b"".join(self.encode_plain(text))
        out: list[bytes] = []
        for i, part in enumerate(self.specials.split(text)):
            out += [np.array([self.special[part]], "<u4").tobytes()] if i % 2 else self.encode_plain(part)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The vocabulary has no decoder, so its pieces are joined by spaces; special tokens stay."""
        return " ".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[int, Codec] = {}


def codec_of(definition: str) -> Codec:
    """One codec per worker and definition: its cache outlives a task."""
    key = hash(definition)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(json.loads(definition))
    return _codecs[key]


def encode_decode(docs: DataFrame, definition: str, key: str = "doc_id", text: str = "text", keep_output: bool = False) -> DataFrame:
    """Encode and decode every text: (key, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]).

    ``definition`` is the content of the tokenizer's JSON file, which the driver reads: executors need no
    file. A null or empty text has no tokens. A null key stays null; repeated rows each give a row. One
    narrow stage without a shuffle; other columns are not read.
    """
    extra = ", ids binary, decoded string" if keep_output else ""
    shipped = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shipped.value)
        for batch in batches:
            sizes, hashes, decodes, ids_out, texts_out = [], [], [], [], []
            for value in texts_of(batch, text):
                ids = codec.encode(value)
                back = codec.decode(ids)
                sizes.append(len(ids) // 4)
                hashes.append(hashlib.sha256(ids).hexdigest())
                decodes.append(hashlib.sha256(back.encode()).hexdigest())
                if keep_output:
                    ids_out.append(ids)
                    texts_out.append(back)
            columns = [batch.column(key), pa.array(sizes, pa.int64()), pa.array(hashes, pa.string()), pa.array(decodes, pa.string())]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_output:
                columns += [pa.array(ids_out, pa.binary()), pa.array(texts_out, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = dict(docs.dtypes)[key]
    return arrow_map(docs.select(key, text), run, f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")


def op1_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """BPE round trip of every whole text of ``documents`` with the word-level public vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        definition = f.read()
    return encode_decode(table(spark, sf_dir, "documents"), definition)


QUERIES = {"op1_bpe": op1_bpe}
SQL: dict[str, str] = {}
