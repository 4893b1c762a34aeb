"""Near-duplicate documents by SimHash, with pigeonring filtering.

A fingerprint is cut into segments that stand in a ring. If two fingerprints differ in few bits, some
segment begins a chain along which the differences, summed over the first l segments, never exceed l times
the budget of one segment (the total budget over the number of segments). With 2 bits and 5 segments a
chain allows 0, 0, 1, 1, 2: its first two segments are equal. So fingerprints are dealt by each pair of
neighbouring segments, five keys of 25 or 26 bits; pairs under a key must pass the rest of the chain, and
then the full Hamming check.

Fingerprints are made distinct first. A key that more than ``CROWD`` of them share is searched another way,
without pairs: two fingerprints differ in at most 2 bits exactly if flipping at most one bit of each gives
one value, and a value has no more than 65 such fingerprints.

Documents that share most of their word shingles need not have such close fingerprints: at a similarity of 0.8
about nine of 64 sign bits differ. ``copies`` therefore fills the ring with 20 minima of hashed shingles, of
which two documents of similarity s agree in each with probability s. It is searched in the same way: with 9
differing segments of 20 a chain allows 0, 0, 1, 1, 2, 2, 3, 3, 4, 4, ... differences, so documents are dealt by
each two neighbouring minima, and pairs must pass the rest of the chain before their whole shingle sets are
compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, discard, encoded, materialise, release, table
from .windows import U, mix

SEED = 42
SHINGLE = 3
DISTANCE = 2
SEGMENTS = (13, 13, 13, 13, 12)
CROWD = 128
#: Near copies: words in a shingle, least similarity, segments of the ring, and how many may differ.
COPY_SHINGLE, COPY_SIMILARITY, COPY_SEGMENTS, COPY_DIFFERENCES = 5, 0.8, 20, 9
#: Bits of a minimum that stand in the ring of marks; equal minima have equal marks.
MARK = 3
#: Up to so many documents under a key, all pairs are candidates.
SMALL = 48
#: Documents, and bytes of their shingle sets, in a block of a larger key.
BLOCK, BLOCK_BYTES = 256, 1 << 24
#: Shingles of a document, the first in hash order, that tell how near it is to the middle of its crowd.
SKETCH = 256


def shingle_hashes(data: bytes, size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of ``size`` words; of the whole sequence if it is shorter; none without words."""
    words = data.split()
    if not words:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([h(b" ".join(words), seed)], np.uint64)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    stops = np.cumsum(sizes) - 1
    starts = stops - sizes + 1
    pairs = zip(starts[: len(words) - size + 1].tolist(), stops[size - 1 :].tolist())
    return np.array([h(line[a:b], seed) for a, b in pairs], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """64 bits, each set if it is in over half of the hashes; 0 for none."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, size: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): the fingerprint of each text as a LONG. Null texts have no words."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash(shingle_hashes(x.lower(), size)) for x in encoded(batch, text)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found.view(np.int64))], [key, "fp"])

    return arrow_map(docs.select(key, text), run, f"{key} {kind}, fp long")


def ring(widths: tuple[int, ...] = SEGMENTS) -> list[list[int]]:
    """For each start, the masks of the first 1, 2, ... segments of these widths from there."""
    spans, at = [], 0
    for width in widths:
        spans.append(((1 << width) - 1) << at)
        at += width
    out = []
    for i in range(len(spans)):
        masks, now = [], 0
        for j in range(len(spans)):
            now |= spans[(i + j) % len(spans)]
            masks.append(now - (1 << 64) if now >> 63 else now)
        out.append(masks)
    return out


def masked(column, masks: list[int], which):
    return F.element_at(F.array(*[F.lit(m).cast("long") for m in masks]), which + 1).bitwiseAND(column)


def in_budget(differences, start, masks: list[list[int]], most: int, first: int) -> Column:
    """Whether the chain from ``start`` keeps in budget from its ``first`` segments on.

    ``differences`` has set bits where segments differ; with ``most`` differences in all segments, the first l
    may have l / segments of them.
    """
    keep = F.lit(True)
    for length in range(first, len(masks) + 1):
        keep = keep & (F.bit_count(masked(differences, [m[length - 1] for m in masks], start)) <= length * most // len(masks))
    return keep


def close_pairs(distinct: DataFrame) -> DataFrame:
    """(u, v), u < v: links between distinct fingerprints ``fp`` that keep every group connected.

    All pairs at ``DISTANCE`` or less under a key of up to CROWD fingerprints; under larger keys, enough links
    to connect whatever is linked there.
    """
    masks = ring()
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(m[1]).cast("long")).alias("v")) for i, m in enumerate(masks)])).alias("x")).select("fp", "x.k", "x.v")
    sizes = keyed.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = materialise(keyed.join(sizes, ["k", "v"]), "dealt")
    few = dealt.where(F.col("n") <= CROWD)
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    keep = (F.col("a.fp") < F.col("b.fp")) & (F.col("a.k") == F.col("b.k")) & (F.col("a.v") == F.col("b.v"))
    keep = keep & in_budget(x, F.col("a.k"), masks, DISTANCE, 3)
    pairs = few.alias("a").join(few.alias("b"), keep).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    # Crowded keys: each fingerprint with up to one bit outside the key flipped. At most 65 of them give one value.
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b).cast("long") for b in range(64)])
    many = dealt.where(F.col("n") > CROWD).select("fp", "k", F.explode(F.filter(flips, lambda f: masked(f, [m[1] for m in masks], F.col("k")) == 0)).alias("flip"))
    met = many.groupBy("k", F.col("fp").bitwiseXOR(F.col("flip")).alias("value")).agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = met.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).where("u < v")
    return pairs.unionByName(stars).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of ``links`` (u, v) reaches.

    Each round takes the least label among a node's neighbours and then that node's label, so that long
    chains shorten by powers. Rounds are written to shared storage; joins are between plain scans, so AQE
    splits a node with many links. Only the count of changes comes to the driver.
    """
    edges = materialise(links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges", narrow=True)
    labels = materialise(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels", narrow=True)
    while True:
        near = edges.join(labels, edges["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("near"))
        up = labels.select(F.col("node").alias("_n"), F.col("label").alias("up"))
        hooked = labels.join(near, labels["node"] == near["u"]).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jumped = materialise(hooked.join(up, hooked["label"] == up["_n"], "left").select("node", "was", F.least("label", F.coalesce("up", "label")).alias("label")), "labels", narrow=True)
        changed = jumped.where("label <> was").limit(1).count()
        discard(labels)
        labels = jumped
        if not changed:
            discard(edges)
            return labels.drop("was")


def groups(docs: DataFrame, size: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component): each document's fingerprint and the smallest key that it reaches over links.

    Null keys reach others but name no component, unless all its keys are null. Repeated rows each give a
    row. Documents without words have fingerprint 0 and link like any other. An empty table gives none.
    """
    marked = materialise(fingerprints(docs, size, key, text), "fingerprints")
    distinct = materialise(marked.groupBy("fp").agg(F.min(key).alias("least")), "distinct")
    labels = components(close_pairs(distinct.select("fp")))
    named = materialise(distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label")), "named")
    least = materialise(named.groupBy("label").agg(F.min("least").alias("component")), "least")
    by = materialise(named.join(least, "label").select("fp", "component"), "components")
    return marked.join(by, "fp").select(key, "fp", "component")


def signatures(docs: DataFrame, size: int, segments: int, key: str, text: str) -> DataFrame:
    """(key, ring, marks, shingles): minima of hashed shingles, MARK bits of each side by side, and the sorted
    32-bit shingle set, where there are words."""
    kind = dict(docs.dtypes)[key]
    seeds = mix(np.arange(1, segments + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rings, marks, sets, there = [], [], [], []
            for data in encoded(batch, text):
                h = np.unique(shingle_hashes(data.lower(), size))
                there.append(bool(len(h)))
                if len(h):
                    least = np.array([mix(h ^ seed).min() for seed in seeds], np.uint64)
                    rings.append(least.view(np.int64))
                    marks.append(sum((int(x) & (1 << MARK) - 1) << MARK * i for i, x in enumerate(least)))
                    sets.append(np.unique((h >> U(32)).astype("<u4")).tobytes())
            held = batch.column(key).filter(pa.array(there, pa.bool_()))
            yield pa.RecordBatch.from_arrays([held, pa.array(rings, pa.list_(pa.int64())), pa.array(marks, pa.int64()), pa.array(sets, pa.binary())], [key, "ring", "marks", "shingles"])

    return arrow_map(docs.select(key, text), run, f"{key} {kind}, ring array<long>, marks long, shingles binary")


def crowding(signed: DataFrame) -> DataFrame:
    """(doc_id, crowd): how many of the given documents hold each of a document's first SKETCH shingles, on average."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            sets = [np.frombuffer(x, "<u4")[:SKETCH].astype(np.int64) for x in batch.column("shingles").to_pylist()]
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(x) for x in sets])), pa.array(np.concatenate(sets))], ["doc_id", "s"])

    held = materialise(arrow_map(signed.select("doc_id", "shingles"), run, "doc_id long, s long"), "sketches")
    counts = held.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    return held.join(counts, "s").groupBy("doc_id").agg(F.avg("n").alias("crowd"))


def similar(pairs: DataFrame, least: float) -> DataFrame:
    """(u, v) of the pairs whose shingle sets ``s``, ``t`` have Jaccard similarity ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for s, t in zip(batch.column("s").to_pylist(), batch.column("t").to_pylist()):
                a, b = np.frombuffer(s, "<u4"), np.frombuffer(t, "<u4")
                if s == t or min(len(a), len(b)) >= least * max(len(a), len(b)):
                    both = len(a) if s == t else len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(both >= least * (len(a) + len(b) - both))
                else:
                    keep.append(False)
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return arrow_map(pairs.select("u", "v", "s", "t"), run, "u long, v long")


def across(many: DataFrame, labels: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(u, v) of all pairs that share a key of ``many``, differ in label and have similarity ``least`` or more.

    Under each key, the documents outside its most frequent label meet all. Both sides are dealt by hash into
    blocks of bounded size, and each pair of blocks is compared in a task: no group of rows grows with the key.
    """
    named = many.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("k", "v", "doc_id", "bytes", F.coalesce("label", "doc_id").alias("label"))
    named = materialise(named.groupBy("k", "v", "doc_id", "label").agg(F.sum("bytes").alias("bytes")), "named")
    parts = named.groupBy("k", "v", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    crowds = parts.groupBy("k", "v").agg(F.sum("n").alias("n"), F.sum("bytes").alias("b"), F.max(F.struct("n", "bytes", "label")).alias("top")).where("n > top.n")
    blocks = lambda n, b: F.ceil(F.greatest(n / BLOCK, b / BLOCK_BYTES)).cast("int")
    crowds = materialise(crowds.select("k", "v", F.col("top.label").alias("most"), blocks(F.col("n") - F.col("top.n"), F.col("b") - F.col("top.bytes")).alias("rows"), blocks(F.col("n"), F.col("b")).alias("columns")), "crowds")
    held = materialise(named.drop("bytes").join(crowds, ["k", "v"]), "apart").join(sets, "doc_id")
    own = lambda size: F.pmod(F.xxhash64("doc_id"), F.col(size)).cast("int")
    every = lambda size: F.explode(F.sequence(F.lit(0), F.col(size) - 1))
    rest = held.where("label <> most").select("k", "v", own("rows").alias("i"), every("columns").alias("j"), F.lit(True).alias("rest"), "doc_id", "label", "shingles")
    whole = held.select("k", "v", every("rows").alias("i"), own("columns").alias("j"), F.lit(False).alias("rest"), "doc_id", "label", "shingles")

    def run(cell: pa.Table) -> pa.Table:
        one, all_ = cell.filter(cell["rest"]), cell.filter(pc.invert(cell["rest"]))
        found_u, found_v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if one.num_rows and all_.num_rows:
            ids, names = all_["doc_id"].to_numpy(), all_["label"].to_numpy()
            each = [np.frombuffer(x, "<u4") for x in all_["shingles"].to_pylist()]
            sizes = np.array([len(x) for x in each])
            values, owners = np.concatenate(each), np.repeat(np.arange(len(each)), sizes)
            order = np.argsort(values, kind="stable")
            owners = owners[order]
            values, starts = np.unique(values[order], return_index=True)
            counts = np.diff(np.append(starts, len(owners)))
            for doc, label, x in zip(one["doc_id"].to_pylist(), one["label"].to_pylist(), one["shingles"].to_pylist()):
                mine = np.frombuffer(x, "<u4")
                at = np.minimum(np.searchsorted(values, mine), len(values) - 1)
                at = at[values[at] == mine]
                n = counts[at]
                runs = np.repeat(starts[at] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum()) if len(at) else np.zeros(0, np.int64)
                both = np.bincount(owners[runs], minlength=len(each))
                hit = (both >= least * (len(mine) + sizes - both)) & (names != label)
                found_u.append(np.minimum(ids[hit], doc))
                found_v.append(np.maximum(ids[hit], doc))
        out = pa.table({"u": np.concatenate(found_u), "v": np.concatenate(found_v)})
        release()
        return out

    return rest.unionByName(whole).groupBy("k", "v", "i", "j").applyInArrow(run, "u long, v long").distinct()


def copies(docs: DataFrame, size: int = COPY_SHINGLE, least: float = COPY_SIMILARITY, segments: int = COPY_SEGMENTS, differences: int = COPY_DIFFERENCES) -> DataFrame:
    """(node, label): near copies by doc_id, with the smallest doc_id of their group.

    The ring has ``segments`` minima, of which ``differences`` may differ; two documents of similarity s agree in
    each with probability s. Chains begin with equal segments, and documents are dealt by those. Under a key of
    up to SMALL documents all pairs whose chain keeps in budget are candidates. Under a larger one, each document
    first meets four others: the smallest, and the three whose shingles are the most common in the crowd,
    which are nearest to the text that the copies come from. That links most groups without pairs in the
    square of their size. Pairs of a crowd that it leaves in different groups are then all compared
    (``across``), so a crowd is connected as all its pairs would connect it. Candidates are checked on their
    whole shingle sets.

    Null doc_ids, null texts and texts without words are in no group. Rows that share a doc_id are one document
    with several texts, and equal texts of fewer words than a shingle are copies. An empty table gives none.
    """
    equal = next(n for n in range(segments, 0, -1) if n * differences < segments)  # segments of a chain that must be equal
    signed = materialise(signatures(docs.where("doc_id IS NOT NULL"), size, segments, "doc_id", "text"), "rings")
    starts = [F.struct(F.lit(i).alias("k"), F.xxhash64(*[F.col("ring")[(i + j) % segments] for j in range(equal)]).alias("v")) for i in range(segments)]
    keyed = signed.select("doc_id", "marks", F.length("shingles").cast("long").alias("bytes"), F.explode(F.array(*starts)).alias("x")).select("doc_id", "marks", "bytes", "x.k", "x.v")
    sizes = keyed.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = materialise(keyed.join(sizes, ["k", "v"]), "dealt")
    few = dealt.where(F.col("n") <= SMALL)
    x = F.col("a.marks").bitwiseXOR(F.col("b.marks"))
    parts = [F.shiftrightunsigned(x, i) for i in range(MARK)]
    differ = reduce(lambda p, q: p.bitwiseOR(q), parts).bitwiseAND(F.lit(sum(1 << MARK * i for i in range(segments))))
    met = few.alias("a").join(few.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.v") == F.col("b.v")) & (F.col("a.doc_id") < F.col("b.doc_id")))
    pairs = met.where(in_budget(differ, F.col("a.k"), ring((MARK,) * segments), differences, equal + 1)).select(F.col("a.doc_id").alias("u"), F.col("b.doc_id").alias("v"))
    many = dealt.where(F.col("n") > SMALL).drop("marks")
    central = crowding(signed.join(many.select("doc_id").distinct(), "doc_id", "left_semi"))
    known = materialise(many.join(central, "doc_id"), "many")
    # Catalyst limits each task's groups to three rows before the shuffle.
    order = Window.partitionBy("k", "v").orderBy(F.desc("crowd"), "doc_id")
    middle = known.withColumn("i", F.row_number().over(order)).where("i <= 3").select("k", "v", F.col("doc_id").alias("w"))
    first = known.groupBy("k", "v").agg(F.min("doc_id").alias("w"))
    met = materialise(middle.unionByName(first).groupBy("k", "v").agg(F.collect_set("w").alias("w")), "pivots", narrow=True)
    stars = known.select("k", "v", "doc_id").join(met, ["k", "v"]).select("doc_id", F.explode("w").alias("w"))
    stars = stars.where("w <> doc_id").select(F.least("w", "doc_id").alias("u"), F.greatest("w", "doc_id").alias("v"))
    candidates = materialise(pairs.unionByName(stars).distinct(), "candidates")
    sets = signed.select("doc_id", "shingles")
    one = candidates.join(sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("s")), "u")
    both = one.join(sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("t")), "v")
    links = materialise(similar(both, least), "links")
    labels = components(links)
    more = materialise(across(many, labels, sets, least), "more")
    discard(signed, dealt, known, candidates)
    return labels if more.isEmpty() else components(links.unionByName(more))


def without_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one with the smallest doc_id.

    Documents without words or with a null doc_id stay. Rows that share a doc_id stay or go together. Columns are
    as they were; an empty table stays empty.
    """
    labels = copies(docs)
    gone = materialise(labels.where("node <> label").select(F.col("node").alias("doc_id")), "gone", narrow=True)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all ``documents`` and the component of each."""
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES = {"op9_simhash": op9_simhash}
SQL: dict[str, str] = {}
