"""The pipeline against brute force, stage by stage, and whole."""

import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import neighbours, rules, simhash

from .fixtures import documents
from .test_repeats import brute

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def expected():
    """doc_id -> text after each stage, in plain Python and SQL."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    labels = {k: q for k, q in con.execute(f"SELECT doc_id, quality FROM '{SMALL}/labels.parquet'").fetchall() if zlib.crc32(str(k).encode()) % 5}
    stages = [{k: texts[k] for (k,) in con.execute(f"WITH {rules.verdict_sql()} SELECT doc_id FROM judged WHERE kept").fetchall()}]

    space = neighbours.Space([texts[k].encode() for k in sorted(labels)], [labels[k] for k in sorted(labels)])
    good = {}
    for k, text in stages[-1].items():
        at = space.place(neighbours.terms([text.encode()]))[0]
        near = sorted(zip((space.points @ at).tolist(), space.labels.tolist()), reverse=True)[: neighbours.NEIGHBOURS]
        weights = [max(c, 0) ** neighbours.SHARPNESS for c, _ in near]
        if sum(w * q for w, (_, q) in zip(weights, near)) >= 0.3 * sum(weights):
            good[k] = text
    stages.append(good)

    sets = {k: set(simhash.shingle_hashes(t.lower().encode(), 5).tolist()) for k, t in good.items()}
    name = {k: k for k in good}

    def root(k):
        while name[k] != k:
            k = name[k]
        return k

    ids = sorted(good)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                name[y] = x
    stages.append({k: good[k] for k in ids if root(k) == k})

    cut = {}
    for k, kept, *_ in brute(list(stages[-1].items()), lambda t: t.encode(), 100):
        text = bytes(kept).decode(errors="ignore")
        if text.strip():
            cut[k] = text
    stages.append(cut)
    return stages


def test_stages_as_brute_force(spark, expected):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "near dedup", "passage dedup", "packing"]
    now, sizes = docs, [docs.count()]
    for (name, stage), want in zip(corpus_pipeline.STAGES, expected):
        now = stage(spark, now, SMALL)
        assert now.dtypes == docs.dtypes, name
        now = spark.createDataFrame(now.collect(), docs.schema)
        assert {r.doc_id: r.text for r in now.collect()} == want, name
        sizes.append(len(want))
    assert sizes == sorted(sizes, reverse=True) and sizes[1] < sizes[0] and sizes[3] < sizes[2]
    assert all(r.n_chars == len(r.text) for r in now.collect())


def test_whole_run_as_brute_force(spark, expected):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {k: [*library.encode(t, add_special_tokens=False).ids, 1] for k, t in expected[-1].items()}
    covered, filled = defaultdict(int), defaultdict(list)
    for r in corpus_pipeline.run(spark, SMALL).collect():
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
        covered[r.doc_id] += r.length
        filled[r.sequence_id].append((r.offset, r.length))
    assert covered == {k: len(x) for k, x in ids.items()}
    for pieces in filled.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at <= 2048


def test_stages_take_awkward_rows(spark):
    """Nulls, empty and very long texts, repeated rows, and columns named like the stages' own."""
    docs = documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.dtypes == docs.dtypes
        kept = out.collect()
        assert len(kept) <= docs.count() and all(r.kept == r.score == r.row == "clash" for r in kept)
        none = stage(spark, docs.limit(0), SMALL)
        assert none.dtypes == docs.dtypes and none.count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}
