"""Repeated byte strings by suffix sorting in two stages.

Texts first give up all they cannot share (see ``repeats``); what is left are the contexts of anchors that stand
in several places. Equal contexts are one entry, with the first document that has it, so that copies of a
passage, however many, are sorted once. The contexts of an anchor meet in a task, are joined into one text, and
the text's suffixes sorted in two stages: only suffixes smaller than their successors are sorted directly,
the others are induced by a scan over the buckets of first bytes, as each is its successor with a byte put
in front. Then the common prefix of each suffix with its neighbour in that order is computed; where it reaches
the window's length, the two begin with the same window. Repeats within a document are found in the same way,
where the document is read, among the contexts whose anchor it has twice.

Only the first bytes up to the window's length matter, so the direct sort stops there. An anchor with over
``repeats.HOT`` different contexts, which no task should sort, has its windows dealt out by hash instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, encoded, table, whole_rows
from .repeats import placed, places, removed, stretches, with_spans
from .windows import Bytes

WINDOW = 100
#: Bytes of contexts that are sorted together, if an anchor's contexts end there.
TEXT = 1 << 20
#: Runs of one text that are sorted as one stretch.
RUNS = 16


def eights(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number that sorts like them."""
    padded = np.concatenate((text, np.zeros(8, np.uint8))).astype(np.uint64)
    n = len(text)
    out = padded[:n] << np.uint64(56)
    for j in range(1, 8):
        out |= padded[j : n + j] << np.uint64(56 - 8 * j)
    return out


def sort_directly(places_: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Places by the ``depth`` bytes from there on: by eight bytes, then ties by the next eight."""
    order = np.argsort(words[places_], kind="stable")
    out = places_[order]
    key = words[out]
    border = np.concatenate(([True], key[1:] != key[:-1])) if len(out) else np.zeros(0, bool)
    for at in range(8, depth, 8):
        tied = ~border
        tied[:-1] |= ~border[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        group = np.cumsum(border)[slots]
        held = out[slots]
        there = held + at
        key = np.where(there < len(words), words[np.minimum(there, len(words) - 1)], 0)
        order = np.lexsort((key, group))
        out[slots], key = held[order], key[order]
        border[slots[1:]] |= key[1:] != key[:-1]
    return out


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a byte text in order of their first ``depth`` bytes at least."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    # Smaller than the successor: the next byte that differs is larger. The last suffix is larger than nothing.
    differ = np.flatnonzero(text[:-1] != text[1:])
    nearest = np.searchsorted(differ, np.arange(n))
    safe = differ[np.minimum(nearest, len(differ) - 1)] if len(differ) else np.zeros(n, np.int64)
    smaller = (nearest < len(differ)) & (text[safe] < text[np.minimum(safe + 1, n - 1)])
    direct = sort_directly(np.flatnonzero(smaller), eights(text), depth)
    counts = np.bincount(text, minlength=256)
    first = np.concatenate(([0], np.cumsum(counts)))
    own = np.bincount(text[direct], minlength=256)
    out = np.full(n, -1, np.int64)
    # In a bucket, the larger suffixes stand before the smaller ones.
    done = np.concatenate(([0], np.cumsum(own)))
    for c in np.flatnonzero(own):
        out[first[c + 1] - own[c] : first[c + 1]] = direct[done[c] : done[c + 1]]
    fill = first[:-1].copy()

    def induce(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[~smaller[before]]
        if len(before):
            byte = text[before]
            order = np.argsort(byte, kind="stable")
            before, byte = before[order], byte[order]
            new = np.flatnonzero(np.concatenate(([True], byte[1:] != byte[:-1])))
            sizes = np.diff(np.append(new, len(byte)))
            out[np.repeat(fill[byte[new]] - new, sizes) + np.arange(len(byte))] = before
            fill[byte[new]] += sizes

    out[fill[text[-1]]] = n - 1
    fill[text[-1]] += 1
    for c in np.flatnonzero(counts):
        at = first[c]
        while at < fill[c]:  # a run of one byte adds to the bucket that is being scanned
            at, upto = fill[c], at
            induce(out[upto:at])
        induce(out[first[c + 1] - own[c] : first[c + 1]])
    return out


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes, up to ``most``, that each suffix of the order has in common with the one before it; 0 for the first."""
    words, n = eights(text), len(order)
    out = np.zeros(n, np.int64)
    live = np.arange(1, n)
    for at in range(0, most, 8):
        x, y = order[live - 1] + at, order[live] + at
        differ = np.where(x < len(words), words[np.minimum(x, len(words) - 1)], 0) ^ np.where(y < len(words), words[np.minimum(y, len(words) - 1)], 0)
        ended = differ != 0
        d = differ[ended]
        out[live[ended]] = at + sum((d < np.uint64(1 << 8 * j)).astype(np.int64) for j in range(1, 8))
        live = live[~ended]
        if not len(live):
            break
    out[live] = most
    return np.minimum(out, most)


def windows_in_order(contents: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, offset, group) of all windows, in suffix order; windows are equal exactly if their group is."""
    sizes = np.array([len(x) for x in contents])
    # UTF-8 has no byte 255, so that one more than a byte is a byte, and 0 stands between contexts.
    text = np.frombuffer(b"\xff".join([*contents, b""]), np.uint8) + np.uint8(1)
    begins = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    of = np.repeat(np.arange(len(contents)), sizes + 1)
    order = suffix_array(text, length + 4)
    prefixes = common_prefixes(text, order, length)
    group = np.cumsum(prefixes < length)
    context = of[order]
    valid = order + length <= begins[context] + sizes[context]
    order, context = order[valid], context[valid]
    return context, order - begins[context], group[valid]


def shared_windows(contents: list[bytes], docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, offset) of the windows that a smaller document's context also has."""
    context, offset, group = windows_in_order(contents, length)
    if not len(context):
        return context, offset
    heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    least = np.minimum.reduceat(docs[context], heads)
    later = docs[context] > np.repeat(least, np.diff(np.append(heads, len(group))))
    return context[later], offset[later]


def own_windows(doc: np.ndarray, first: np.ndarray, last: np.ndarray, prefix, raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, window) of windows of the given runs that also start earlier in the same document."""
    if not len(doc):
        return doc, first
    # Runs that follow each other are one stretch, of RUNS at most: a long stretch of one byte takes a scan for each.
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (first[1:] != last[:-1] + 1)))
    at = np.flatnonzero(new)
    new[(np.arange(len(doc)) - np.repeat(at, np.diff(np.append(at, len(doc))))) % RUNS == 0] = True
    new = np.flatnonzero(new)
    doc, first, last = doc[new], first[new], last[np.append(new[1:], len(last)) - 1]
    data = raw.tobytes()
    context, offset, group = windows_in_order([data[i:j] for i, j in zip(first.tolist(), (last + length).tolist())], length)
    d, start = doc[context], first[context] + offset
    by = np.lexsort((start, d, group))
    d, start, group = d[by], start[by], group[by]
    again = np.concatenate(([False], (d[1:] == d[:-1]) & (group[1:] == group[:-1])))
    return d[again], start[again]


def resolve(contexts: DataFrame, length: int) -> DataFrame:
    """(doc, p) of windows that contexts of a smaller document share. ``contexts``: a, doc, p, content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, now = 0, None

        def out() -> pa.RecordBatch:
            _, docs, p, contents = zip(*held)
            docs, p = np.array(docs, np.int64), np.array(p, np.int64)
            c, start, n = stretches(*shared_windows(list(contents), docs, length))
            at, folds, _ = placed(p[c])
            return pa.RecordBatch.from_arrays([pa.array(docs[c]), pa.array(places(at + start, n, folds))], ["doc", "p"])

        for batch in batches:
            for row in zip(*(batch.column(x).to_pylist() for x in ("a", "doc", "p", "content"))):
                if size >= TEXT and row[0] != now:
                    yield out()
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
                now = row[0]
        if held:
            yield out()

    return arrow_map(contexts.repartition("a").sortWithinPartitions("a").select("a", "doc", "p", "content"), run, "doc long, p long")


def cut(docs: DataFrame, length: int, key: str, text: str) -> DataFrame:
    """``docs`` with ``spans``: where each text repeats an earlier one."""
    return with_spans(docs, key, text, Bytes(length), own_windows, lambda contexts: resolve(contexts, length))


def kept_bytes(data: bytes, stretches_: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for start, stop in stretches_:
        out.append(data[at:start])
        at = stop
    return b"".join([*out, data[at:]]) if at else data


def remove_repeats(docs: DataFrame, length: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256): bytes covered by a string that also starts earlier go.

    Earlier is a smaller key, or an earlier start in the same row; rows that share a key are not earlier than
    each other. Null keys come before all others, in the order of a hash of their texts, and stay null; a null
    text is empty. Texts of fewer than ``length`` bytes keep all. Matches never cross documents. An empty table
    gives none. Other columns are not read.
    """
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, spans in zip(encoded(batch), batch.column("spans").to_pylist()):
                gone = removed(spans, length)
                kept = kept_bytes(data, gone)
                rows.append((len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(x, t) for x, t in zip([*zip(*rows)] or [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string())))], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return arrow_map(cut(named, length, "key", "text"), run, f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("key", key)


def clean_texts(docs: DataFrame, length: int = WINDOW) -> DataFrame:
    """``docs`` with repeats cut out of ``text`` and n_chars to match, without documents that have no word left.

    A cut inside a character takes the whole character. A null text has no word. Which of equal strings stays
    is as in ``remove_repeats``. Rows and columns, whatever their names, are otherwise as they were; an empty
    table stays empty.
    """

    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for data, spans in zip(encoded(batch), batch.column("spans").to_pylist()):
                texts.append(kept_bytes(data, removed(spans, length)).decode(errors="ignore"))
            row = batch.column("row")
            out = {c: row.field(i) for i, c in enumerate(columns)}
            out["text"] = pa.array(texts, pa.string())
            if "n_chars" in out:
                out["n_chars"] = pa.array([len(x) for x in texts], pa.int64()).cast(out["n_chars"].type)
            yield pa.RecordBatch.from_arrays([*out.values()], [*out]).filter(pa.array([bool(x.strip()) for x in texts], pa.bool_()))

    return arrow_map(cut(whole_rows(docs), length, "row.doc_id", "row.text"), run, docs.schema)


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all ``documents`` that a repeated string of 100 bytes covers, removed."""
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op6_suffixes": op6_suffixes}
#: Bytes are pairs of hexadecimal digits here.
SQL = {
    "op6_suffixes": f"""WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), p AS (SELECT doc_id, h, unnest(range(1, length(h) // 2 + 1)) AS i FROM t),
g AS (SELECT doc_id, i, substr(h, 2 * i - 1, 2) AS b, CASE WHEN 2 * i + {2 * WINDOW - 2} <= length(h) THEN md5(substr(h, 2 * i - 1, {2 * WINDOW})) END AS win FROM p),
f AS (SELECT doc_id, i, b, win IS NOT NULL AND row_number() OVER (PARTITION BY coalesce(win, concat(doc_id, '-', i)) ORDER BY doc_id, i) > 1 AS again FROM g),
c AS (SELECT doc_id, i, b, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM f),
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM c),
s AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM documents d LEFT JOIN s USING (doc_id)"""
}
