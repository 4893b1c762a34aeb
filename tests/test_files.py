"""File formats: what is written is read again, and odd input is taken."""

import json

from pyspark.sql import functions as F

from lodestone.sources import readers, writers


def test_token_blocks(spark, tmp_path):
    path = tmp_path / "blocks.txt"
    path.write_text("Title: A\nURL: http://a/\nTokens: one two\nthree\n\nTitle: B\nURL: http://b/\nTokens:\n\n")
    got = [tuple(r) for r in readers.token_blocks(spark, str(path)).orderBy("title").collect()]
    assert got == [("A", "http://a/", ["one", "two", "three"]), ("B", "http://b/", [])]
    assert [r.url for r in readers.block_column(spark, str(path), "URL").orderBy("url").collect()] == ["http://a/", "http://b/"]
    rows = readers.token_blocks(spark, str(path))
    writers.write_token_blocks(rows.coalesce(1), str(tmp_path / "again"))
    assert readers.token_blocks(spark, str(tmp_path / "again")).orderBy("title").collect() == rows.orderBy("title").collect()


def test_json(spark, tmp_path):
    (tmp_path / "rows.json").write_text(json.dumps([{"title": "t", "content": "c", "url": "u"}, {"title": None, "url": "v"}]))
    (tmp_path / "bad.json").write_text("{not json")
    assert readers.json_rows(spark, str(tmp_path / "rows.json")).count() == 2
    assert readers.json_rows(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "rows.jsonl").write_text('{"doc_id": 1, "text": "a"}\n{"doc_id": 2, "text": "b"}\n')
    assert [r.text for r in readers.by_ids(readers.jsonl(spark, str(tmp_path / "rows.jsonl")), [2]).collect()] == ["b"]


def test_batch_queries(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("1\tfood and drinks\nno tab here\n2\ta\tb\n")
    got = sorted(tuple(r) for r in readers.batch_queries(spark, str(tmp_path / "q.tsv")).collect())
    assert got == [("1", "food and drinks"), ("2", "a\tb")]


def test_runs(spark, tmp_path):
    rows = spark.createDataFrame([("1", 2, "u2", "0.5"), ("1", 1, "u1", "0.75"), ("1", 3, "u3", "none")], "query_number string, rank int, url string, score string")
    writers.write_run(rows, str(tmp_path / "run"))
    assert "\n".join(r.value for r in spark.read.text(str(tmp_path / "run")).collect()) == "1\t1\tu1\t0.75\n1\t2\tu2\t0.5"


def test_ranked_results(spark, tmp_path):
    rows = spark.createDataFrame([(0, "t", "u", ["a", "b"], 0.5)], "index int, title string, url string, tokens array<string>, score double")
    writers.write_ranked_results(rows, str(tmp_path / "ranked"))
    assert [tuple(r) for r in readers.ranked_results(spark, str(tmp_path / "ranked")).collect()] == [(0, "t", "u", ["a", "b"], 0.5)]
    (tmp_path / "odd.csv").write_text("x|only\n1|t|u|['c']|0.25\n")
    assert [r.tokens for r in readers.ranked_results(spark, str(tmp_path / "odd.csv")).collect()] == [["c"]]


def test_ranking_files(spark, tmp_path):
    (tmp_path / "y.csv").write_text("target1,target2\n2,-4.5\n0,-6\n")
    (tmp_path / "groups.csv").write_text("group\n2\n")
    y, groups = readers.ranking_csv(spark, str(tmp_path))
    assert y.count() == 2 and groups.first()[0] == 2
    (tmp_path / "m.txt").write_text("1 qid:10 1:0.5 3:2\n0 qid:10 2:1\n")
    got = readers.svm_rank(spark, str(tmp_path / "m.txt"), 3).orderBy("label").collect()
    assert [tuple(r) for r in got] == [(0, 10, None, 1.0, None), (1, 10, 0.5, None, 2.0)]


def test_other_writers(spark, tmp_path):
    counts = spark.createDataFrame([("a", 2), ("b", 5)], "term string, n long")
    writers.write_keyword_counts(counts, str(tmp_path / "kw"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "kw")).collect()) == ["a: 2", "b: 5"]
    writers.write_csv(counts, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    results = spark.createDataFrame([(1, "T", "u", 0.5), (2, "S", "v", 0.25)], "rank int, title string, url string, score double")
    writers.write_readable(results, str(tmp_path / "txt"), 1)
    assert [r.value for r in spark.read.text(str(tmp_path / "txt")).collect()] == ["1. T (u) 0.5000"]
    assert json.loads(results.select(writers.payload("rank", "title").alias("p")).first().p) == {"rank": 1, "title": "T"}
    merged = readers.merged_subcorpora({"x": spark.createDataFrame([("1",)], "_id string"), "y": spark.createDataFrame([("1",)], "_id string")})
    assert sorted(r._id for r in merged.collect()) == ["x_1", "y_1"]
    (tmp_path / "gaz.tsv").write_text("place\t48.5\t9.0\tDE\tP\n")
    assert readers.gazetteer_file(spark, str(tmp_path / "gaz.tsv")).where(F.col("country_code") == "DE").count() == 1


def test_sweep(spark):
    from lodestone.storage import materialise, sweep

    held, other = materialise(spark.range(5), "held"), materialise(spark.range(3), "other")
    assert other.count() == 3 and sweep(spark, keep=held) >= 1 and held.count() == 5


def test_discard_and_drop_since(spark):
    from lodestone.storage import discard, drop_since, materialise, position

    one = materialise(spark.range(4), "one")
    begin = position(spark)
    two, three = materialise(spark.range(5), "two", narrow=True), materialise(spark.range(6), "three")
    assert position(spark) == begin + 2 and two.count() == 5
    drop_since(spark, begin, three)
    assert position(spark) == begin + 1 and three.count() == 6 and one.count() == 4
    discard(one, one, spark.range(1))
    assert position(spark) == begin


def test_shared_folder_is_asked_for():
    from types import SimpleNamespace

    import pytest

    from lodestone.storage import shared_folder

    conf = SimpleNamespace(get=lambda *a: None, set=lambda *a: None)
    session = lambda master: SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master=master), conf=conf)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_folder(session(master))
    assert shared_folder(session("local[4]")).startswith("file://")
