"""Learned ranking, numbered features, crawl and sync."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.engine import Engine
from lodestone.functions import web
from lodestone.operators import graph, learning, legacy, ranking
from lodestone.sources import readers
from lodestone.streaming import ingest

FOLDER = "/root/testdata/sf0.001"


def test_lambda_gradients_by_pairs():
    rng = np.random.default_rng(1)
    for k in (None, 3):
        label, score = rng.integers(0, 4, 9).astype(float), rng.normal(size=9)
        order = sorted(range(9), key=lambda i: -score[i])
        place = {d: i for i, d in enumerate(order)}
        discount = [1 / math.log2(place[i] + 2) if k is None or place[i] < k else 0 for i in range(9)]
        ideal = sum((2**x - 1) / math.log2(i + 2) for i, x in enumerate(sorted(label, reverse=True)[: k or 9]))
        pull, bend = [0.0] * 9, [0.0] * 9
        for i in range(9):
            for j in range(9):
                if label[i] > label[j]:
                    change = abs((2 ** label[i] - 2 ** label[j]) * (discount[i] - discount[j])) / ideal
                    p = 1 / (1 + math.exp(score[i] - score[j]))
                    pull[i] += change * p
                    pull[j] -= change * p
                    bend[i] += change * p * (1 - p)
                    bend[j] += change * p * (1 - p)
        got = learning.lambda_gradients(label, score, k)
        assert got[0] == pytest.approx(pull) and got[1] == pytest.approx(bend)
    assert not learning.lambda_gradients(np.zeros(4), np.arange(4.0))[0].any()


def test_lambda_gradients_hold_no_square():
    import tracemalloc

    rng = np.random.default_rng(2)
    label, score = rng.integers(0, 4, 6000).astype(float), rng.integers(0, 300, 6000) / 8
    tracemalloc.start()
    pull, bend = learning.lambda_gradients(label, score)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6 and abs(pull.sum()) < 1e-6 * np.abs(pull).sum() and (bend > 0).all()
    # Many equal scores, some alone: as by pairs.
    label, score = rng.integers(0, 3, 60).astype(float), np.r_[rng.integers(0, 3, 50) / 2, rng.normal(size=10)]
    for k in (None, 10):
        rank = np.empty(60, int)
        rank[np.lexsort((np.arange(60), -score))] = np.arange(60)
        discount = np.where(rank < (k or 60), 1 / np.log2(rank + 2.0), 0)
        gain = np.exp2(label) - 1
        ideal = (np.sort(gain)[::-1] / np.log2(np.arange(60) + 2.0))[: k or 60].sum()
        p = 1 / (1 + np.exp(score[:, None] - score[None, :]))
        change = np.where(label[:, None] > label[None, :], np.abs((gain[:, None] - gain) * (discount[:, None] - discount)) / ideal, 0) * p
        pull, bend = learning.lambda_gradients(label, score, k)
        assert pull == pytest.approx(change.sum(1) - change.sum(0)) and bend == pytest.approx((change * (1 - p)).sum(1) + (change * (1 - p)).sum(0))


def test_ranker_beats_first_stage_on_new_queries(spark):
    rng = random.Random(4)
    rows, judged = [], []
    for q in range(24):
        for d in range(30):
            first, a, b = rng.random(), rng.random(), rng.random()
            grade = 3 if a > 0.7 and b < 0.5 else 1 if a > 0.7 else 0
            rows.append((q, q * 100 + d, first, a, b, float(grade)))
            judged.append((q, q * 100 + d, grade))
    df = spark.createDataFrame(rows, "query_id int, doc_id int, score double, a double, b double, label double")
    marks = spark.createDataFrame(judged, "query_id int, doc_id int, relevance int").where("query_id >= 18")
    ranker = learning.LambdaRanker(["score", "a", "b"], rounds=6, depth=3, at=10).fit(df.where("query_id < 18"))
    asked = df.where("query_id >= 18")
    mean = lambda run: ranking.ndcg(run, marks).agg(F.avg("ndcg")).first()[0]
    reranked = ranker.rerank(asked, 30)
    first_stage = learning.top_k(asked, 30).select("query_id", "rank", "doc_id")
    assert mean(reranked) > 0.95 > mean(first_stage) + 0.2
    assert ranker.importance()["a"] > 0 and ranker.importance()["score"] <= ranker.importance()["a"] + ranker.importance()["b"]
    again = learning.LambdaRanker.from_json(ranker.to_json())
    assert again.rerank(asked, 5).collect() == ranker.rerank(asked, 5).collect()


def test_engine_reranks(spark, tmp_path):
    engine = Engine(spark, FOLDER)
    queries = [(1, "rean ingti"), (2, "erth anst"), (3, "enhe atin")]
    with pytest.raises(ValueError):
        engine.rerank(queries)
    found = engine.features(queries, 20)
    assert set(ranking.FEATURES) <= set(found.columns) and len(ranking.FEATURES) == 20
    judged = found.select("query_id", "doc_id", (F.col("body_stream_length") > 0.3).cast("int").alias("relevance"))
    engine.learn(queries, judged, 20, rounds=3, depth=2)
    run = engine.rerank(queries, 20)
    assert ranking.ndcg(run, judged).agg(F.min("ndcg")).first()[0] > 0.99
    engine.index(str(tmp_path / "index"), method="lucene")
    assert [r.doc_id for r in engine.batch(queries, 5).orderBy("query_id", "rank").collect()] == [r.doc_id for r in Engine(spark, FOLDER).batch(queries, 5, method="lucene").orderBy("query_id", "rank").collect()]


def test_numbered_features_by_hand(spark):
    rows = [(1, "a b c d e f g h i Tower", "The Tower", "https://www.town.de/tower", "https://x.de,https://y.de/a", 0.002), (2, "", "none", "https://h", "", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id int, content string, title string, url string, outgoing_links string, pagerank double")
    got = {r.doc_id: r for r in legacy.numbered_features(docs, [(7, "Tower town c zzz")]).collect()}
    assert len([c for c in got[1].asDict() if c[0] == "f"]) == 64
    # content without its first and last two words: c d e f g h
    assert (got[1].f1, got[1].f6, got[1].f11, got[1].f21) == (1, 0.25, 6, 1)
    assert (got[1].f3, got[1].f13, got[1].f4, got[1].f14) == (1, 2, 2, 4)
    idf = [1 / 2, 1 / 2, 1 / 2, 1 / 2]  # tower and c in one document; town and zzz nowhere as words
    assert got[1].f16 == pytest.approx(sum(idf) / 4) and got[1].f71 == pytest.approx(0.5)
    assert (got[1].f126, got[1].f127, got[1].f129, got[1].f130) == (3, 25, 2, 200) and got[2].f129 == 1
    assert got[1].f108 > 0 and got[2].f1 == 0


def test_older_pagerank(spark):
    pages = {"a": ["b", "b", "c", "x"], "b": ["c"], "c": ["a"], "d": []}
    rank = {u: 1 / 4 for u in pages}
    for _ in range(10):
        new = {u: 0.15 / 4 + 0.85 * sum(rank[v] / len(pages[v]) for v in pages if u in pages[v]) for u in pages}
        total = sum(new.values())
        new = {u: x / total for u, x in new.items()}
        if all(abs(new[u] - rank[u]) < 1e-6 for u in pages):
            break
        rank = new
    df = spark.createDataFrame([*pages.items()], "url string, outgoing_links array<string>")
    got = graph.pagerank(df.select(F.col("url").alias("node")), graph.edges_of(df), rounds=10, normalise=True, members=True, each=True)
    assert {r.node: r.rank for r in got.collect()} == pytest.approx(rank, abs=1e-9)


@pytest.mark.parametrize(
    ("url", "noise"),
    [
        ("https://en.wikipedia.org/wiki/T", False),
        ("https://en.wikipedia.org/w/index.php?title=T", True),
        ("https://x.org/?oldid=3", True),
        ("https://en.wikipedia.org/wiki/User:T", False),
        ("https://en.wikipedia.org/wiki/Category:T", False),
        ("https://www.wikipedia.org/", True),
        ("http://de.wikipedia.org/", False),
        ("https://x.org/?action=view", False),
        ("https://x.org/?a=1&action=view", True),
        ("https://x.org/?action=edit", True),
        ("https://www.wikidata.org/wiki/Q1", True),
        ("https://en.wikipedia.org/wiki/help:T", False),
    ],
)
def test_encyclopedia_noise(spark, url, noise):
    assert spark.range(1).select(web.encyclopedia_noise(F.lit(url)).alias("x")).first().x is noise


def test_crawl_marks_links_and_faults(spark, tmp_path):
    source = str(tmp_path / "in")
    pages = lambda rows: spark.createDataFrame(rows, ingest.PAGES).coalesce(1).write.mode("append").parquet(source)
    pages([(1, "https://h/a#x", "<p>the town</p><a href='#'></a><a href=\"/b\">b</a><a href=\"/a\">a</a>"), (2, "https://h/faulty", None)])
    stream = lambda: ingest.page_stream(spark, source)
    store, checkpoint = str(tmp_path / "crawl"), str(tmp_path / "checkpoint")
    ingest.crawl(stream(), store, checkpoint, ["town"])
    state = lambda: {r.url: (r.crawled, r.error) for r in ingest.frontier(spark, store).collect()}
    assert state() == {"https://h/a": (True, False), "https://h/faulty": (True, True), "https://h/b": (False, False)}
    pages([(3, "https://h/b", '<p>nothing</p><a href="/c">c</a>'), (4, "https://h/a", "<p>town again</p>")])
    ingest.crawl(stream(), store, checkpoint, ["town"])
    # An irrelevant page is crawled all the same, and its links are not followed.
    assert state() == {"https://h/a": (True, False), "https://h/faulty": (True, True), "https://h/b": (True, False)}
    assert [(r.page_id, r.url) for r in ingest.crawled_documents(spark, store).collect()] == [(1, "https://h/a")]


def test_sync_takes_the_last_row(spark, tmp_path):
    source = str(tmp_path / "in")
    put = lambda rows: spark.createDataFrame(rows, ingest.PAGES).coalesce(1).write.mode("append").parquet(source)
    put([(1, "https://h/a", "<p>old</p>"), (2, "https://h/b", "<p>b</p>"), (3, "https://h/a", "<p>newer</p>")])
    docs = lambda: ingest.documents_of(ingest.page_stream(spark, source))
    where = (str(tmp_path / "store"), str(tmp_path / "checkpoint"))
    read = lambda df: {r.url: (r.page_id, r.content) for r in df.collect()}
    assert read(ingest.sync(docs(), *where)) == {"https://h/a": (3, "newer"), "https://h/b": (2, "b")}
    put([(4, "https://h/b", "<p>changed</p>")])
    assert read(ingest.sync(docs(), *where)) == {"https://h/a": (3, "newer"), "https://h/b": (4, "changed")}
    assert read(ingest.sync(docs(), *where)) == {"https://h/a": (3, "newer"), "https://h/b": (4, "changed")}


def test_batches_in_any_order_give_the_same_rows(spark, tmp_path):
    source = str(tmp_path / "in")
    put = lambda rows: spark.createDataFrame(rows, ingest.PAGES).coalesce(1).write.mode("append").parquet(source)
    docs = lambda: ingest.page_stream(spark, source)
    store, crawl = (str(tmp_path / "store"), str(tmp_path / "checkpoint")), (str(tmp_path / "crawl"), str(tmp_path / "checkpoint2"))
    # The last page by its number comes first, the first last.
    for page in (3, 2, 1):
        put([(page, "https://h/a", f"<p>town {page}</p>")])
        synced = ingest.sync(ingest.documents_of(docs()), *store)
        ingest.crawl(docs(), *crawl, ["town"])
    assert [(r.page_id, r.content) for r in synced.collect()] == [(3, "town 3")]
    assert [(r.page_id, r.content) for r in ingest.crawled_documents(spark, crawl[0]).collect()] == [(1, "town 1")]


def test_alternate():
    log = []
    calls = ingest.alternate(lambda: log.append("w"), lambda: log.append("s"), seconds=0.05, rounds=3, pause=0.02)
    assert log.count("s") == 3 and log.count("w") == calls >= 6 and log[-1] == "s"


def test_ranking_files(spark, tmp_path):
    (tmp_path / "X.csv").write_text("feature_0,feature_1\n0.5,1\n2,-3\n")
    assert [tuple(r) for r in readers.ranking_features(spark, str(tmp_path)).orderBy("feature_0").collect()] == [(0.5, 1.0), (2.0, -3.0)]
    (tmp_path / "m.txt").write_text("1 qid:10 1:0.5 3:NaN\n0 qid:10 1:1\n2 qid:9 1:2\n")
    rows = readers.svm_rank(spark, str(tmp_path / "m.txt"), 3)
    assert readers.filled_columns(rows).columns == ["label", "qid", "f1"]
    assert [tuple(r) for r in readers.query_groups(rows).collect()] == [(9, 1), (10, 2)]
    judged = spark.createDataFrame([("1", "2", 1)], "`query-id` string, `corpus-id` string, score int")
    assert [tuple(r) for r in readers.merged_judgements({"x": judged, "y": judged}).collect()] == [("x_1", "x_2", 1), ("y_1", "y_2", 1)]
