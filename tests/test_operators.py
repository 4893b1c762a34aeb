"""Golden values and brute force for operators."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.engine import Engine, TableRewriter
from lodestone.functions import scoring, text, web
from lodestone.operators import corpus, graph, ranking, retrieval

FOLDER = "/root/testdata/sf0.001"
GOLDEN = [(0, "hello world ddifern"), (1, "foo bar baz"), (2, "lorem ipsum dolor sit amet"), (3, "hello foo"), (4, "term long long " + " ".join(f"w{i}" for i in range(68)))]


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame(GOLDEN, "doc_id int, text string")


def scores(df):
    return {(r.query_id, r.doc_id): r.score for r in df.collect()}


def test_own_bm25(golden):
    queries = [(1, "hello term"), (2, "hello foo"), (3, "hello ipsum"), (4, "hello long long")]
    found = retrieval.bm25(golden, queries, method="own", k1=1.2, tokens=text.space_tokens(F.col("text")))
    want = {(1, 0): 0.599343, (1, 3): 0.622161, (1, 4): 0.271632, (2, 0): 0.599343, (2, 1): 0.599343, (2, 3): 1.244321, (3, 0): 0.599343, (3, 2): 0.884197, (3, 3): 0.622161, (4, 0): 0.599343, (4, 3): 0.622161, (4, 4): 0.908514}
    got = scores(found)
    assert set(got) == set(want) and all(abs(got[k] - v) < 2e-6 for k, v in want.items())
    fused = retrieval.combsum(found.withColumn("query_id", F.lit(1)), 5).orderBy("rank").collect()
    assert [r.doc_id for r in fused] == [3, 0, 4, 2, 1]


@pytest.mark.parametrize(
    ("method", "want"),
    [
        ("robertson", [0.213512, 0.213512, None, 0.445975, None]),
        ("lucene", [0.555538, 0.555538, None, 1.160385, None]),
        ("atire", [1.453606, 1.453606, None, 3.036230, None]),
        ("bm25l", [2.022863, 2.022863, 1.094336, 3.050170, 1.094336]),
        ("bm25+", [2.841453, 2.841453, 1.098612, 4.738984, 1.098612]),
    ],
)
def test_variants(golden, method, want):
    got = scores(retrieval.bm25(golden, [(1, "hello foo")], method=method, tokens=text.space_tokens(F.col("text"))))
    for doc, value in enumerate(want):
        assert (value is None and (1, doc) not in got) or abs(got[1, doc] - value) < 2e-6


def test_top_k_beyond_the_corpus(golden):
    assert retrieval.bm25(golden, [(1, "hello")], k=50, pad=True).count() == 5


def test_vector_space_as_by_hand(golden):
    docs = {k: t.split() for k, t in GOLDEN}
    df = Counter(t for d in docs.values() for t in set(d))
    weigh = lambda words: {t: c / len(words) * math.log10(5 / df[t]) for t, c in Counter(words).items() if t in df}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    q = weigh("hello ipsum unknown".split())
    want = {}
    for k, d in docs.items():
        w = weigh(d)
        if any(t in w for t in q):
            want[k] = sum(w.get(t, 0) * x for t, x in q.items()) / (size(w) * size(q))
    got = {r.doc_id: r.score for r in retrieval.VectorSpace.fit(golden, text.space_tokens(F.col("text"))).query("hello ipsum unknown", text.space_tokens(F.col("text"))).collect()}
    assert got == pytest.approx(want, abs=2e-6)


def test_parametric(spark):
    rows = [(0, "2023-01-01", 5.0), (1, "2023-01-02", 4.0), (2, "2023-01-01", 4.0), (3, "2023-02-01", 3.5), (4, "2023-02-01", 4.0)]
    docs = spark.createDataFrame(rows, "doc_id int, date string, rating double")
    marks = docs.select("doc_id", F.lit(1.0).alias("score"))
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(retrieval.parametric(marks, docs, {"date": "2023-01-01"}, {"rating": (4, 5)})) == [0, 2]
    assert ids(retrieval.parametric(marks, docs, ranges={"rating": (3.2, 3.9)})) == [3]
    assert ids(retrieval.parametric(marks, docs, ranges={"rating": (3.2, 3.9)}, grid=True)) == [1, 2, 4]


def test_pagerank(spark):
    pages = spark.createDataFrame([("a", ["b", "c", "x"]), ("b", ["c"]), ("c", ["a", "a"]), ("d", ["c"])], "url string, outgoing_links array<string>")
    nodes = pages.select(F.col("url").alias("node"))
    got = {r.node: r.rank for r in graph.pagerank(nodes, graph.edges_of(pages)).collect()}
    want = {"a": 0.222854, "b": 0.100642, "c": 0.218063, "d": 0.0375}
    assert got == pytest.approx(want, abs=5e-6) and sum(got.values()) < 1


def test_scalar_edge_cases(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(text.simple_tokens(F.lit(""))) == [""]
    assert one(text.simple_tokens(F.lit("Food, and  drinks!"))) == ["food", "and", "drinks"]
    assert one(text.word_tokens(F.lit("Été x ab_1 naïve"))) == ["été", "ab_1", "naïve"]
    assert one(web.without_fragment(F.lit("https://h/en/25#top"))) == "https://h/en/25"
    assert one(web.authority(F.lit("http://u@h.example.com:80/x"))) == "u@h.example.com:80"
    assert one(web.host(F.lit("http://u@H.example.com:80/x"))) == "h.example.com"
    assert one(F.length(F.try_element_at(web.url_terms(F.lit("https://www.tuebingen.de")), F.lit(3)))) == 9
    assert one(scoring.min_max(F.lit(3.0), F.lit(3.0), F.lit(3.0))) == 0
    assert one(web.encyclopedia_noise(F.lit("https://de.wikipedia.org/wiki/X"))) and not one(web.encyclopedia_noise(F.lit("https://en.wikipedia.org/wiki/X")))
    assert one(web.links(F.lit('<a href="/a#b">x</a><a href="c">y</a><a href="//h2/z">z</a><a href="mailto:q">m</a>'), F.lit("https://h/d/e?f"))) == ["https://h/a", "https://h/d/c", "https://h2/z"]
    assert one(web.block_text(F.lit('<script>"</p>"</script><p>one<p>two</p><li>three<div>no</div>'))) == "one two three"


def test_distances(spark):
    assert scoring.geodesic_km(*scoring.CENTRE) == 0
    assert scoring.geodesic_km(52.52, 13.405) == pytest.approx(537, abs=5)
    row = spark.range(1).select(scoring.haversine(F.lit(52.52), F.lit(13.405)).alias("km")).first()
    assert row.km == pytest.approx(scoring.geodesic_km(52.52, 13.405), rel=0.006)


def test_grades():
    assert scoring.GRADE_WEIGHTS[1] == pytest.approx(2.098940, abs=1e-6)
    assert scoring.GRADE_WEIGHTS[2] - 4.692 == pytest.approx(3.674197, abs=1e-6)
    assert scoring.GRADE_WEIGHTS[3] == pytest.approx(11.423077, abs=1e-6)


def test_simhash_blocks_lose_no_pair(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(60) for _ in range(10)]
    rows = []
    for i in range(150):
        x = rng.choice(base)
        for _ in range(rng.randrange(4)):
            x ^= 1 << rng.randrange(60)
        rows.append((i, x))
    want = {(i, j) for i, a in rows for j, b in rows if i < j and bin(a ^ b).count("1") <= 2}
    got = {(r.early, r.late) for r in corpus.simhash_pairs(spark.createDataFrame(rows, "doc_id long, simhash long")).collect()}
    assert got == want


def test_rake(spark):
    docs = spark.createDataFrame([(1, "deep learning of deep networks, and graph search"), (2, "the of and"), (3, None)], "doc_id int, text string")
    got = {(r.doc_id, r.phrase): r.score for r in corpus.rake(docs).collect()}
    assert got == {(1, "deep learning"): 4.0, (1, "deep networks"): 4.0, (1, "graph search"): 4.0}


def test_evaluation(spark):
    run = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12), (2, 1, 10)], "query_id int, rank int, doc_id int")
    judged = spark.createDataFrame([(1, 11, 2), (1, 12, 1), (1, 99, 3), (2, 50, 1)], "query_id int, doc_id int, relevance int")
    of = lambda df, c: {r.query_id: r[c] for r in df.collect()}
    dcg = 3 / math.log2(3) + 1 / 2
    ideal = 7 + 3 / math.log2(3) + 1 / 2
    assert of(ranking.ndcg(run, judged), "ndcg") == pytest.approx({1: dcg / ideal, 2: 0}, abs=1e-6)
    assert of(ranking.average_precision(run, judged), "ap") == pytest.approx({1: (1 / 2 + 2 / 3) / 3, 2: 0}, abs=1e-6)
    assert of(ranking.reciprocal_rank(run, judged), "rr") == {1: 0.5, 2: 0}


def test_engine(spark, tmp_path):
    engine = Engine(spark, FOLDER, TableRewriter({"rean": ["erth", "onsh"]}))
    found = engine.retrieve("rean ingti", 5).collect()
    assert [r["rank"] for r in found] == [1, 2, 3, 4, 5] and found[0].relevance == 1 and found[0].score >= found[1].score
    assert engine.sql("SELECT count(*) AS n FROM documents").first().n == engine.table("documents").count()
    index = engine.index(str(tmp_path / "index"), method="bm25+")
    direct = retrieval.bm25(engine.table("documents"), [(1, "rean erth")], method="bm25+", k=5)
    assert [r.doc_id for r in index.topk([(1, "rean erth")], 5).orderBy("rank").collect()] == [r.doc_id for r in direct.orderBy("rank").collect()]
    assert engine.answer("rean", 3).count() == 3
    store = engine.crawl(str(tmp_path / "store"), str(tmp_path / "checkpoint"))
    first = store.count()
    assert first > 0 and engine.crawl(str(tmp_path / "store2"), str(tmp_path / "checkpoint2"), ["zzznothing"]).count() == 0


def test_all_scores_have_no_last_rank(spark, tmp_path):
    from pyspark.sql import functions as F

    from lodestone import registry

    n = 1_000_010
    spark.range(n).select(F.col("id").alias("doc_id"), F.lit("ingti").alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.QUERIES["bm25_own_all_scores"](spark, str(tmp_path)).agg(F.count(F.lit(1)), F.max("rank")).first()
    assert tuple(got) == (n, n)


def test_workers_hold_few_rows_at_once(spark):
    import pyarrow as pa

    seen = lambda df: corpus._in_arrow(df, lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "bytes"]) for b in batches), StructType.fromDDL("rows long, bytes long")).collect()
    found = seen(spark.range(0, 5000, 1, 1))
    assert sum(r.rows for r in found) == 5000 and max(r.rows for r in found) <= corpus.BATCH_ROWS
    found = seen(spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 40_000).alias("text")))
    assert sum(r.rows for r in found) == 400 and max(r.bytes for r in found) <= 2 * corpus.BATCH_BYTES
    batch = pa.RecordBatch.from_arrays([pa.array(range(1201))], ["a"])
    assert [x for b in corpus._slices(iter([batch])) for x in b.column("a").to_pylist()] == list(range(1201))


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_postings_are_counted_where_they_are_read(spark, golden):
    docs = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None), (4, "c c a")], "doc_id int, text string")
    split = F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda t: t != "")
    found = retrieval.counted(docs, split)
    assert {tuple(r) for r in found.collect()} == {(1, 3, "a", 1), (1, 3, "b", 2), (4, 3, "a", 1), (4, 3, "c", 2)}
    assert shuffles(found) == 0
    # Rows of one key and length add up.
    again = {tuple(r) for r in retrieval.counted(docs.union(docs), split).collect()}
    assert again == {(1, 3, "a", 2), (1, 3, "b", 4), (4, 3, "a", 2), (4, 3, "c", 4)}
    # Frequent terms are broadcast and the others shuffled: the same rows, whatever the bound.
    posting = spark.createDataFrame([(d, t, 1) for d in range(40) for t in range(20) if d % (t + 1) == 0], "doc_id int, term int, tf int")
    terms = retrieval.term_stats(posting)
    want = {tuple(r) for r in posting.join(terms, "term").collect()}
    for head in (0, 1, 5, 100):
        got = [tuple(r) for r in retrieval.with_term(posting, terms, head=head).collect()]
        assert len(got) == len(want) and set(got) == want
    # Impacts and norms move no postings of frequent terms.
    assert shuffles(retrieval.impacts(golden, "lucene")) == 0


def test_numbers_without_words_and_words_with_two_numbers(spark):
    docs = spark.createDataFrame([(1, [1, 2, 9]), (2, [3, 2]), (3, [4])], "doc_id int, ids array<int>")
    words = spark.createDataFrame([(1, "rean"), (2, "onsh"), (3, "rean"), (4, "erth")], "number int, term string")
    text = spark.createDataFrame([(1, "rean onsh"), (2, "rean onsh"), (3, "erth")], "doc_id int, text string")
    asked = [(1, "rean erth")]
    got = retrieval.Bm25Index.from_numbers(docs, words).topk(asked).collect()
    assert got and got == retrieval.Bm25Index.build(text).topk(asked).collect()


def test_ranks_of_a_large_graph_are_not_broadcast(spark, monkeypatch):
    nodes = spark.range(50).select(F.col("id").alias("node"))
    edges = spark.range(100).select((F.col("id") % 50).alias("src"), (F.col("id") * 7 % 50).alias("dst"), F.lit(0.5).alias("w"))
    ranks = lambda: graph.pagerank(nodes, edges, rounds=3, tolerance=None, every=5)
    small = {r.node: r.rank for r in ranks().collect()}
    monkeypatch.setattr(graph, "BROADCAST_NODES", 10)
    large = ranks()
    assert {r.node: r.rank for r in large.collect()} == pytest.approx(small)
    assert "BroadcastHashJoin" not in large._jdf.queryExecution().executedPlan().toString()


def test_features_move_no_terms_that_they_can_do_without(spark):
    rows = [(q, d, f"the {w} rean {w}", w, f"https://h.org/{w}") for q in (0, 1) for d, w in enumerate(("onsh", "erth", "anst", "", "onsh"))]
    candidates = spark.createDataFrame(rows, "query_id int, doc_id int, body string, title string, url string")
    queries = spark.createDataFrame([(0, "the onsh"), (1, "erth zzz")], "query_id int, text string")
    alone = [c for c in ranking.FEATURES if c.endswith("embedding")]
    part = ranking.lexical_features(candidates, queries, wanted=alone)
    assert shuffles(part) == 0
    whole = ranking.lexical_features(candidates, queries)
    assert shuffles(whole) <= 4
    held = {(r.query_id, r.doc_id): r.asDict() for r in whole.collect()}
    assert len(held) == 10 and all(held[r.query_id, r.doc_id][c] == r[c] for r in part.collect() for c in alone)
    assert held[0, 0]["body_sum_tf"] == 3 and held[1, 1]["body_sum_tf"] == 2 and held[1, 0]["body_sum_tf"] == 0
    by_window, by_join = (sorted(map(tuple, ranking.normalized(whole, ranking.FEATURES, written=w).collect())) for w in (False, True))
    assert by_window == by_join
    assert "Window" not in ranking.normalized(whole, ranking.FEATURES, written=True)._jdf.queryExecution().optimizedPlan().toString()
