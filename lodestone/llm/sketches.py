"""Repeated word windows, found through a count-min sketch and grouped exactly.

The sketch of all tasks overestimates how often a window's anchor, and so the window, occurs. A second pass
groups exactly only what the sketch lets through (see ``repeats``), so no repeat is lost and no estimate
reaches the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, encoded, table
from .repeats import removed, with_spans
from .windows import Words

WINDOW = 20


def remove_repeats(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256[, kept]): words covered by a window that also starts earlier go.

    Earlier is a smaller key, or an earlier start in the same row; rows that share a key are not earlier than
    each other. Null keys come before all others, in the order of a hash of their texts, and stay null; a null
    text has no words. Documents of fewer than ``window`` words keep all. An empty table gives none. Other
    columns are not read.
    """
    kind = dict(docs.dtypes)[key]
    found = with_spans(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key", "text", Words(window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, spans in zip(encoded(batch), batch.column("spans").to_pylist()):
                words = data.split()
                kept, at, gone = [], 0, 0
                for start, stop in removed(spans, window):
                    kept += words[at:start]
                    gone += stop - start
                    at = stop
                kept = b" ".join(kept + words[at:] if at else words)
                rows.append((len(words), gone, hashlib.sha256(kept).hexdigest(), *([kept.decode(errors="ignore")] if keep_text else [])))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(x, t) for x, t in zip([*zip(*rows)] or [[]] * 4, kinds[: 3 + keep_text]))], ["key", "n_words", "n_removed", "kept_sha256", *["kept"] * keep_text])

    return arrow_map(found, run, f"key {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text).withColumnRenamed("key", key)


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all ``documents`` that a repeated window of 20 words covers, removed."""
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op10_substrings": op10_substrings}
SQL = {
    "op10_substrings": rf"""WITH w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)),
g AS (SELECT doc_id, i, w, string_agg(w, ' ') OVER o AS win, count(*) OVER o AS n FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
f AS (SELECT doc_id, i, w, n = {WINDOW} AND row_number() OVER (PARTITION BY CASE WHEN n = {WINDOW} THEN md5(win) ELSE concat(doc_id, '-', i) END ORDER BY doc_id, i) > 1 AS again FROM g),
c AS (SELECT doc_id, i, w, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM f),
s AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN s USING (doc_id)"""
}
