"""The plan behind both passage removers: which windows also start earlier, at any number of documents.

1. Each task sketches its anchors: two lanes of cells, counted to two. The sketches merge by addition, so
   an anchor's estimate is never below its count, and no repeated window is lost. The merged sketch is two
   bitmaps of ``MAX_BITS`` bits at most, whatever the input; a fuller sketch lets more anchors through, which
   costs time and changes nothing.
2. Runs whose anchor is estimated repeated become occurrences (anchor, context hash, document, place). One
   aggregation, partial at the map side, finds each context's first document. In a later document all
   windows of that context are repeats.
3. What remains are first occurrences of contexts whose anchor also has other contexts. Only those give
   their contents, once for each distinct context, and a *resolver* finds the windows that two of them share.
4. Repeats within a document are found where the document is read.

A key that a third of the rows share meets partial aggregation or a sort-merge join between two plain
scans, which AQE splits; no group of rows is ever gathered in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, encoded, materialise, signed
from .windows import U, Prefix, mix, runs

SLICE_BITS = 16
MIN_BITS, MAX_BITS = 18, 29
#: Cells per expected entry.
ROOM = 4
#: Bytes of text that are worked on at once, so that arrays stay in cache.
BLOCK_BYTES = 100_000
#: Hashed values that a task holds before it sends its sketch on.
FLUSH = 1 << 20
#: Contexts of one anchor from which on they are compared by window rather than by the resolver: some megabytes.
HOT = 1 << 14
OCCURRENCE = "a long, h long, doc long, p long"
#: Null keys come first of all, in the order of 40 bits of their text's hash.
NULL_BITS = 40
SEED, FOLD_BITS = 42, 24


def fold(text: bytes) -> int:
    """24 bits of a text, to tell apart rows that share a key."""
    return xxhash.xxh64_intdigest(text, SEED) >> (64 - FOLD_BITS)


def identity(key: Column, text: Column) -> tuple[Column, Column]:
    """(doc, fold): a row's place in the order of documents, and its text's fold."""
    h = F.xxhash64(F.coalesce(text, F.lit("")))
    null = F.lit(-(1 << 63)) + F.shiftrightunsigned(F.shiftleft(h, FOLD_BITS), 64 - NULL_BITS)
    return F.coalesce(key.cast("long"), null), F.shiftrightunsigned(h, 64 - FOLD_BITS)


def blocks(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of stretches of a batch."""
    texts, first, held = encoded(batch, text), 0, 0
    for i, x in enumerate(texts):
        held += len(x)
        if held >= BLOCK_BYTES:
            yield first, texts[first : i + 1]
            first, held = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def cells(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cells of hashed values in both lanes."""
    shift = U(64 - bits)
    return [(values >> shift).astype(np.int64), (mix(values * U(0x9FB21C651E98DF25)) >> shift).astype(np.int64)]


class Bitmap:
    """Two lanes of packed bits; a value is in it if its cells in both lanes are."""

    def __init__(self, bits: int, lanes: list[np.ndarray]):
        self.bits, self.lanes = bits, lanes

    def has(self, values: np.ndarray) -> np.ndarray:
        out = np.ones(len(values), bool)
        for lane, c in zip(self.lanes, cells(values, self.bits)):
            out &= (lane[c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
        return out


def bits_for(entries: float) -> int:
    return min(MAX_BITS, max(MIN_BITS, int(np.ceil(np.log2(max(1.0, entries * ROOM))))))


def sketched(df: DataFrame, values: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, least: int) -> Bitmap:
    """The bitmap of hashed values that are estimated to occur ``least`` (1 or 2) times or more in ``df``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            joined = np.concatenate(held)
            rows = []
            for lane, c in enumerate(cells(joined, bits)):
                c.sort()
                new = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
                own, counts = c[new], np.diff(np.append(new, len(c)))
                parts = np.flatnonzero(np.concatenate(([True], own[1:] >> SLICE_BITS != own[:-1] >> SLICE_BITS)))
                for a, b in zip(parts, [*parts[1:], len(own)]):
                    local, often = (own[a:b] & (1 << SLICE_BITS) - 1).astype("<u2"), counts[a:b] > 1
                    rows.append((lane, int(own[a] >> SLICE_BITS), local[~often].tobytes(), local[often].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["lane", "slice", "once", "often"])

        for batch in batches:
            for found in values(batch):
                if len(found):
                    held.append(found)
                    size += len(found)
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts = None, None

        def out() -> pa.RecordBatch:
            packed = np.packbits(counts >= least).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*now, packed), (pa.int32(), pa.int32(), pa.binary()))], ["lane", "slice", "bits"])

        for batch in batches:
            for lane, part, once, often in zip(*(batch.column(n).to_pylist() for n in ("lane", "slice", "once", "often"))):
                if (lane, part) != now:
                    if now is not None:
                        yield out()
                    now, counts = (lane, part), np.zeros(1 << SLICE_BITS, np.uint8)
                for data, more in ((once, 1), (often, 2)):
                    at = np.frombuffer(data, "<u2")
                    counts[at] = np.minimum(counts[at] + more, 2)
        if now is not None:
            yield out()

    slices = arrow_map(df, build, "lane int, slice int, once binary, often binary")
    merged = arrow_map(slices.repartition("lane", "slice").sortWithinPartitions("lane", "slice"), merge, "lane int, slice int, bits binary")
    # The driver receives two lanes of at most 2**MAX_BITS bits, whatever the input.
    lanes = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(2)]
    width = (1 << SLICE_BITS) // 8
    for lane, part, data in merged.toLocalIterator() if bits > 26 else merged.collect():
        lanes[lane][part * width : (part + 1) * width] = np.frombuffer(data, np.uint8)
    return Bitmap(bits, lanes)


def first_key(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A hash of a context in a document."""
    return mix(h.view(np.uint64) ^ mix(doc.view(np.uint64) + U(0x632BE59BD9B4E019)))


def places(starts: np.ndarray, counts: np.ndarray, folds: np.ndarray) -> np.ndarray:
    """Place of a stretch of windows in its document: first window (31 bits), text's fold, windows less one."""
    return (starts << (FOLD_BITS + 8)) | (folds << 8) | (counts - 1)


def placed(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, fold, windows) again."""
    return p >> (FOLD_BITS + 8), p >> 8 & (1 << FOLD_BITS) - 1, (p & 0xFF) + 1


def stretches(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that follow each other in a document, as (document, first, count) of at most 256."""
    if not len(doc):
        return doc, start, start
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)))
    at = np.flatnonzero(new)
    since = np.arange(len(doc)) - np.repeat(at, np.diff(np.append(at, len(doc))))
    new |= since % 256 == 0
    at = np.flatnonzero(new)
    return doc[at], start[at], np.diff(np.append(at, len(doc)))


def repeated_runs(doc: np.ndarray, a: np.ndarray, tied: np.ndarray) -> np.ndarray:
    """Runs that may repeat windows of their own document: their anchor has another run in it, or is tied."""
    order = np.lexsort((a, doc))
    d, v = doc[order], a[order]
    same = np.concatenate(([False], (d[1:] == d[:-1]) & (v[1:] == v[:-1])))
    same[:-1] |= same[1:]
    return np.sort(order[same | tied[order]])


def own_windows(doc: np.ndarray, first: np.ndarray, last: np.ndarray, prefix: Prefix, raw, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, window) of windows of the given runs that also start earlier in the same document, by their hashes."""
    sizes = last - first + 1
    of = np.repeat(np.arange(len(doc)), sizes)
    start = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[of]
    w = prefix.stretch(start, start + length)
    by = np.lexsort((start, w, doc[of]))
    d, w, start = doc[of][by], w[by], start[by]
    again = np.concatenate(([False], (d[1:] == d[:-1]) & (w[1:] == w[:-1]))) if len(d) else np.zeros(0, bool)
    return d[again], start[again]


def arrow(columns: list[np.ndarray], names: list[str], nulls: int = 0) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)


def repeated_spans(docs: DataFrame, codec, own: Callable, resolver: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """(doc, fold, spans), written: of every document with repeats, the stretches of windows that also start earlier.

    ``docs`` has doc (never null) and text. ``own`` finds windows that repeat within a document, as
    ``own_windows`` does. ``resolver`` turns (a, doc, p, content) rows, grouped by anchor, into (doc, p) rows;
    without one, all contexts are compared window by window.
    """
    length, gram, context = codec.length, codec.gram, docs.sparkSession.sparkContext
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def anchors(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, texts in blocks(batch, "text"):
            starts, symbols, _ = codec.symbols(texts)
            _, a, _, _, ties = runs(Prefix(symbols), starts, length, gram)
            yield a
            yield np.repeat(ties, 2)

    often = context.broadcast(sketched(docs.select("text"), anchors, bits_for(size / codec.bytes_per_anchor), 2))

    def found(batch: pa.RecordBatch):
        """Runs of a batch whose anchor is estimated repeated, block by block."""
        ids = batch.column("doc").to_numpy(zero_copy_only=False)
        for row, texts in blocks(batch, "text"):
            starts, symbols, raw = codec.symbols(texts)
            prefix = Prefix(symbols)
            doc, a, first, last, ties = runs(prefix, starts, length, gram)
            keep = often.value.has(a)
            if keep.any():
                doc, a, first, last = doc[keep], a[keep], first[keep], last[keep]
                folds = np.fromiter(map(fold, texts), np.int64, len(texts))
                h = mix(prefix.stretch(first, last + length) + (last - first).astype(np.uint64))
                yield ids[row : row + len(texts)], folds, starts, prefix, raw, doc, a, h, first, last, np.isin(a, ties)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = lambda n: pa.nulls(n, pa.int64())
        for batch in batches:
            for ids, folds, starts, prefix, raw, doc, a, h, first, last, tied in found(batch):
                yield arrow([signed(a), signed(h), ids[doc], places(first - starts[doc], last - first + 1, folds[doc])], ["a", "h", "doc", "p"])
                row = repeated_runs(doc, a, tied)
                d, s, n = stretches(*own(doc[row], first[row], last[row], prefix, raw, length))
                if len(d):
                    yield pa.RecordBatch.from_arrays([none(len(d)), none(len(d)), pa.array(ids[d]), pa.array(places(s - starts[d], n, folds[d]))], ["a", "h", "doc", "p"])

    seen = materialise(arrow_map(docs, occurrences, OCCURRENCE), "occurrences")
    contexts = materialise(seen.where("a IS NOT NULL").groupBy("a", "h").agg(F.min("doc").alias("first"), F.max("doc").alias("final")), "contexts")
    several = materialise(contexts.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "several", narrow=True)
    total, hot_total = several.agg(F.count(F.lit(1)), F.count(F.when(F.col("n") > HOT, 1))).first()
    of = lambda name: lambda batch: iter([batch.column(name).to_numpy(zero_copy_only=False).view(np.uint64)])
    shared = context.broadcast(sketched(several.select("a"), of("a"), bits_for(4 * total), 1))
    hot = context.broadcast(sketched(several.where(F.col("n") > HOT).select("a"), of("a"), bits_for(64 * hot_total), 1))

    def firsts(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        a, h, doc = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("a", "h", "first"))
        keep = shared.value.has(a.view(np.uint64))
        yield first_key(h[keep], doc[keep])

    expected = contexts.join(several, "a", "left_semi").count() if total else 0
    wanted = context.broadcast(sketched(contexts.select("a", "h", "first"), firsts, bits_for(2 * expected), 1))

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """First occurrences: contexts whole for the resolver, others by window."""
        for batch in batches:
            for ids, folds, starts, prefix, raw, doc, a, h, first, last, _ in found(batch):
                keep = shared.value.has(a)
                keep[keep] = wanted.value.has(first_key(h[keep], ids[doc[keep]]))
                single = keep & (hot.value.has(a) if resolver else True)
                row = np.flatnonzero(single)
                if len(row):
                    sizes = last[row] - first[row] + 1
                    of = np.repeat(row, sizes)
                    start = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[of]
                    w = mix(prefix.stretch(start, start + length))
                    p = places(start - starts[doc[of]], np.ones(len(of), np.int64), folds[doc[of]])
                    yield pa.RecordBatch.from_arrays([pa.array(signed(a[of])), pa.array(signed(w)), pa.array(ids[doc[of]]), pa.array(p), pa.nulls(len(of), pa.binary())], ["a", "h", "doc", "p", "content"])
                row = np.flatnonzero(keep & ~single)
                if len(row):
                    data = raw.tobytes()
                    content = [data[i:j] for i, j in zip(first[row].tolist(), (last[row] + length).tolist())]
                    p = places(first[row] - starts[doc[row]], last[row] - first[row] + 1, folds[doc[row]])
                    yield pa.RecordBatch.from_arrays([pa.array(signed(a[row])), pa.array(signed(h[row])), pa.array(ids[doc[row]]), pa.array(p), pa.array(content, pa.binary())], ["a", "h", "doc", "p", "content"])

    parts = materialise(arrow_map(docs, contents, "a long, h long, doc long, p long, content binary"), "contents")
    windows = parts.where("content IS NULL").drop("content")
    twice = windows.groupBy("a", "h").agg(F.min("doc").alias("first"), F.max("doc").alias("final")).where("first < final").drop("final")
    spans = [
        seen.where("a IS NULL").select("doc", "p"),
        seen.where("a IS NOT NULL").join(contexts.where("first < final").drop("final"), ["a", "h"]).where("doc > first").select("doc", "p"),
        windows.join(twice, ["a", "h"]).where("doc > first").select("doc", "p"),
    ]
    if resolver:
        spans.append(resolver(parts.where("content IS NOT NULL").drop("h")))
    every = spans[0]
    for x in spans[1:]:
        every = every.unionByName(x)
    # Rows that share key and text have the same spans; a set holds them once.
    folded = every.select("doc", F.shiftright("p", 8).bitwiseAND(F.lit((1 << FOLD_BITS) - 1)).alias("fold"), "p")
    spans = materialise(folded.groupBy("doc", "fold").agg(F.collect_set("p").alias("spans")), "spans")
    discard(seen, contexts, several, parts)
    return spans


def removed(spans: list[int] | None, length: int) -> list[tuple[int, int]]:
    """Maximal stretches (start, stop) of symbols that a text loses."""
    if spans is None or not len(spans):
        return []
    start, _, count = placed(np.asarray(spans, np.int64))
    stop = start + count - 1 + length
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.flatnonzero(np.concatenate(([True], start[1:] > stop[:-1])))
    return [*zip(start[new].tolist(), stop[np.append(new[1:], len(stop)) - 1].tolist())]


def with_spans(docs: DataFrame, key: str, text: str, codec, own: Callable = own_windows, resolver=None) -> DataFrame:
    """``docs``, of the columns key and text or of one struct ``row``, with doc, fold, and ``spans``, null where
    nothing repeats. Texts cross one shuffle."""
    doc, folded = identity(F.col(key), F.col(text))
    spans = repeated_spans(docs.select(doc.alias("doc"), F.col(text).alias("text")), codec, own, resolver)
    return docs.withColumns({"doc": doc, "fold": folded}).join(spans, ["doc", "fold"], "left")
