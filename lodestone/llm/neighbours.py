"""Quality by the votes of nearest labelled neighbours in a latent-semantic space.

A text becomes a vector of hashed byte pairs (damped counts, weighted by rarity) and of shape terms (how
varied its words are, its capitals, symbols, line and word lengths, each in bands). A singular value
decomposition over a bounded sample of labelled texts gives the latent space. The sample's vectors are
broadcast; every text of the corpus is compared with all of them, exactly, as blocks of a matrix product,
and its nearest neighbours vote with weights that grow with their cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, encoded, remainder, rows_again, table, whole_rows

#: Labelled texts that the space is fitted on and that vote, at most, of each label; bytes they may have.
SAMPLE = 1500
SAMPLE_BYTES = 100_000
HASHED = 1024
LATENT = 48
#: Chosen on a validation fold of the training rows (crc32 mod 5 = 1): fewest errors, then least log loss.
NEIGHBOURS = 9
SHARPNESS = 30
FOLDS = 5
THRESHOLD = 0.3
BANDS = 12
SHAPES = 9
SHAPE_WEIGHT = 4
WIDTH = HASHED + SHAPES * (BANDS + 1)
SLOT = (np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(54)).astype(np.int64)
UPPER = bytes(set(range(256)) - set(range(65, 91)))
LETTERS = bytes(set(range(256)) - set(range(65, 91)) - set(range(97, 123)) - set(range(128, 256)))
DIGITS = bytes(set(range(256)) - set(range(48, 58)))
MARKS = bytes(set(range(256)) - set(b"#*$%&|<>!@^~_=+\\{}[]"))


def shape(data: bytes) -> list[float]:
    """Nine properties of a whole text between 0 and 1."""
    words = data.split()
    n, size = len(words), max(1, len(data))
    lines = [x for x in data.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:])))
    ratio = lambda a, b: min(1.0, a / b) if b else 0.0
    return [
        ratio(pairs, n - 1),
        ratio(len(set(words)), n**0.85) if n else 0.0,
        ratio(len(data.translate(None, UPPER)), len(data.translate(None, LETTERS))),
        ratio(len(data.translate(None, MARKS)) * 4, size),
        ratio(len(data.translate(None, DIGITS)) * 4, size),
        ratio(len(data) / max(1, n), 16),
        ratio(len(set(lines)), len(lines)),
        ratio(np.log1p(n), 10.0),
        ratio(np.log1p(n / max(1, len(lines))), 8.0),
    ]


def terms(texts: list[bytes]) -> np.ndarray:
    """Damped term counts, one row per text: hashed byte pairs, then bands of the shape properties."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    for row, data in zip(out, texts):
        raw = np.frombuffer(data, np.uint8)
        if len(raw) > 1:
            counts = np.bincount(SLOT[raw[:-1].astype(np.int64) << 8 | raw[1:]], minlength=HASHED)[:HASHED]
            row[:HASHED] = np.sqrt(counts / len(raw))
        for i, x in enumerate(shape(data)):
            at = x * BANDS
            low = int(at)
            base = HASHED + i * (BANDS + 1)
            row[base + low] += SHAPE_WEIGHT * (1 - at + low) / SHAPES**0.5
            if low < BANDS:
                row[base + low + 1] += SHAPE_WEIGHT * (at - low) / SHAPES**0.5
    return out


class Space:
    """The latent space, its labelled vectors and their votes."""

    def __init__(self, texts: list[bytes] | np.ndarray, labels: list[int]):
        """Of labelled texts, or of their ``terms``."""
        found = texts if isinstance(texts, np.ndarray) else terms(texts)
        self.rarity = np.ones(WIDTH, np.float32)
        if len(found):
            self.rarity[:HASHED] = np.log((1 + len(found)) / (1 + (found[:, :HASHED] > 0).sum(axis=0))) + 0.5
        weighted = found * self.rarity
        # Right singular vectors from the terms' Gram matrix.
        values, vectors = np.linalg.eigh(weighted.T.astype(np.float64) @ weighted)
        self.axes = vectors[:, np.argsort(values)[::-1][:LATENT]].astype(np.float32)
        self.labels = np.array(labels, np.float32)
        self.points = self.place(found)

    def place(self, found: np.ndarray) -> np.ndarray:
        at = (found * self.rarity) @ self.axes
        return at / np.maximum(np.linalg.norm(at, axis=1, keepdims=True), 1e-9)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Share of the neighbours' weight that has label 1; one half without neighbours."""
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        near = self.place(terms(texts)) @ self.points.T
        k = min(NEIGHBOURS, near.shape[1])
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, best, axis=1), 0).astype(np.float64) ** SHARPNESS
        total = weight.sum(axis=1)
        return np.where(total > 0, (weight * self.labels[best]).sum(axis=1) / np.maximum(total, 1e-300), 0.5).clip(0, 1)


def term_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, quality, terms): the ``terms`` of each text as little-endian floats, of one size for any text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.astype("<f4").tobytes() for x in terms(encoded(batch))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(found, pa.binary())], ["doc_id", "quality", "terms"])

    return arrow_map(docs.select("doc_id", "quality", "text"), run, T.StructType([docs.schema["doc_id"], docs.schema["quality"], T.StructField("terms", T.BinaryType())]))


def fit(docs: DataFrame, labels: DataFrame) -> Space:
    """The space of up to SAMPLE labelled texts of each label, none of them held out.

    The sample is the first rows by a hash of their key, so it is the same at every run; it is bounded by
    SAMPLE rows a label, and by leaving out texts of over SAMPLE_BYTES, whatever the size of the corpus. Terms are
    counted on the executors: the driver gets 4 * WIDTH bytes a text, 14 MB at most, and no text.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), FOLDS) != 0))
    known = known.groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"), F.max(F.col("quality").cast("int")).alias("other")).where("quality = other")
    parts = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for q in (0, 1)]
    chosen = {r.doc_id: r.quality for part in parts for r in part.collect()}
    spark = docs.sparkSession
    # At most 2 * SAMPLE keys.
    small = F.broadcast(spark.createDataFrame([*chosen.items()], "doc_id long, quality int"))
    short = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES)
    taught = short.join(small, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    rows = sorted((r.doc_id, r.quality, bytes(r.terms)) for r in term_rows(taught).collect())
    found = np.frombuffer(b"".join(x for _, _, x in rows), "<f4").reshape(-1, WIDTH)
    return Space(found, [int(q > 0) for _, q, _ in rows])


def scored(docs: DataFrame, space: Space) -> DataFrame:
    """``docs``, of a key and text or of one struct ``row``, with a column ``score`` and without ``text``. One narrow stage."""
    shipped = docs.sparkSession.sparkContext.broadcast(space)
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(shipped.value.score(encoded(batch)) if batch.num_rows else [], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), found], [*kept, "score"])

    return arrow_map(docs, run, T.StructType([*(docs.schema[c] for c in kept), T.StructField("score", T.DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every text.

    Null and empty texts are scored by their shape; a null doc_id is held out. Repeated rows each give a row,
    and of rows that share a doc_id one teaches, the one with the smallest text. A doc_id with different labels
    teaches nothing. Without labels every score is one half. An empty table gives none; other columns are not
    read.
    """
    out = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def filter_documents(docs: DataFrame, training: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted good, with all columns, whatever their names; the space is fitted
    on ``training``. Nulls, empty texts and repeated rows are scored as in ``quality``."""
    return rows_again(scored(whole_rows(docs), fit(training, labels)).where(F.col("score") >= THRESHOLD))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all ``documents``, learnt from ``labels``."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op2_neighbours": op2_neighbours}
SQL: dict[str, str] = {}
