"""File formats as queries: what a writer writes, its reader gives back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import web as W
from ..operators import retrieval as R
from ..sources import readers, writers
from ..sources.readers import table
from ..storage import shared_folder
from .common import MAIN_TEXT, PIPELINE_TOKENS, SPACE, TITLE, query, tok
from .search import BATCH, bm25_sql


def _path(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


BLOCKS = f"SELECT page_id, title, url, array_to_string({PIPELINE_TOKENS}, ' ') AS tokens FROM (SELECT page_id, {TITLE} AS title, url, {MAIN_TEXT} AS text FROM pages)"


def _blocks(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select(W.title(F.col("html")).alias("title"), "url", T.pipeline_tokens(W.main_text(F.col("html"))).alias("tokens"))


@query("file_token_blocks", f"SELECT title, url, tokens FROM ({BLOCKS})")
def file_token_blocks(spark, sf):
    path = _path(spark, "blocks")
    writers.write_token_blocks(_blocks(spark, sf), path)
    return readers.token_blocks(spark, path).select("title", "url", F.array_join("tokens", " ").alias("tokens"))


@query("file_block_urls", f"SELECT url FROM ({BLOCKS})")
def file_block_urls(spark, sf):
    path = _path(spark, "blocks")
    writers.write_token_blocks(_blocks(spark, sf), path)
    return readers.block_column(spark, path, "URL")


@query("file_jsonl", "SELECT doc_id, text FROM documents")
def file_jsonl(spark, sf):
    path = _path(spark, "jsonl")
    table(spark, sf, "documents").select("doc_id", "text").write.json(path)
    return readers.jsonl(spark, path, "doc_id long, text string")


@query("file_json_rows", "SELECT name AS title, comment AS content, 'https://' || name AS url FROM (SELECT r_name AS name, r_name || ' of ' || r_regionkey AS comment FROM region)")
def file_json_rows(spark, sf):
    """One JSON array a file, as small exports are; here one of each region."""
    path = _path(spark, "json")
    rows = table(spark, sf, "region").select(F.col("r_name").alias("title"), F.concat("r_name", F.lit(" of "), "r_regionkey").alias("content"), F.concat(F.lit("https://"), "r_name").alias("url"))
    rows.select(F.concat(F.lit("["), F.to_json(F.struct("title", "content", "url")), F.lit("]")).alias("value")).repartition(5, "value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.json_rows(spark, path)


LINE = rf"trim(regexp_replace(left(coalesce(text, ''), 60), '{SPACE}', ' ', 'g'))"


@query("file_batch_queries", f"SELECT doc_id::VARCHAR AS query_number, {LINE} AS query FROM documents")
def file_batch_queries(spark, sf):
    path = _path(spark, "queries")
    line = F.trim(F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), 1, 60), SPACE, " "))
    table(spark, sf, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit("\t"), line).alias("value")).write.text(path)
    return readers.batch_queries(spark, path)


@query("file_run", f"SELECT query_id::VARCHAR AS query_number, rank::INTEGER AS rank, 'doc/' || doc_id AS url, score FROM ({bm25_sql('own', k1=1.2, k=50)})")
def file_run(spark, sf):
    path = _path(spark, "run")
    found = R.bm25(table(spark, sf, "documents"), BATCH, method="own", k1=1.2, k=50)
    writers.write_run(found.select(F.col("query_id").cast("string").alias("query_number"), "rank", F.concat(F.lit("doc/"), "doc_id").alias("url"), F.col("score").cast("string").alias("score")), path)
    return spark.read.option("sep", "\t").schema("query_number string, rank int, url string, score double").csv(path)


RANKED = f"SELECT page_id::INTEGER AS i, replace(title, '|', ' ') AS title, url, array_to_string(list_slice(string_split(tokens, ' '), 1, 5), ' ') AS tokens, round(1.0::DOUBLE / (page_id + 1), 6) AS score FROM ({BLOCKS})"


@query("file_ranked_results", f"SELECT i AS index, title, url, tokens, score FROM ({RANKED})")
def file_ranked_results(spark, sf):
    path = _path(spark, "ranked")
    pages = table(spark, sf, "pages")
    tokens = F.slice(T.pipeline_tokens(W.main_text(F.col("html"))), 1, 5)
    rows = pages.select(F.col("page_id").cast("int").alias("index"), F.replace(W.title(F.col("html")), F.lit("|"), F.lit(" ")).alias("title"), "url", tokens.alias("tokens"), F.round(1.0 / (F.col("page_id") + 1), 6).alias("score"))
    writers.write_ranked_results(rows, path)
    return readers.ranked_results(spark, path).select("index", "title", "url", F.array_join("tokens", " ").alias("tokens"), "score")


@query("file_keyword_counts", f"WITH {tok()} SELECT term || ': ' || count(*) AS line FROM (SELECT unnest(toks) AS term FROM tok) GROUP BY term")
def file_keyword_counts(spark, sf):
    path = _path(spark, "keywords")
    counts = table(spark, sf, "documents").select(F.explode(T.word_tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    writers.write_keyword_counts(counts, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("file_readable_results", f"SELECT rank || '. ' || lang || ' (' || source || ') ' || printf('%.4f', score) AS line FROM ({bm25_sql('own', k1=1.2, k=10)}) JOIN documents USING (doc_id)")
def file_readable_results(spark, sf):
    path = _path(spark, "readable")
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("title"), F.col("source").alias("url"))
    writers.write_readable(R.bm25(table(spark, sf, "documents"), BATCH, method="own", k1=1.2, k=10).join(docs, "doc_id"), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("file_svm_rank", "SELECT toxic AS label, (doc_id % 20)::BIGINT AS qid, quality::DOUBLE AS f1, CASE WHEN doc_id % 2 = 0 THEN doc_id / 4.0::DOUBLE END AS f3 FROM labels")
def file_svm_rank(spark, sf):
    """Sparse rows; the feature that no row has is left out."""
    path = _path(spark, "svm")
    i = F.col("doc_id")
    third = F.when(i % 2 == 0, F.concat(F.lit(" 3:"), (i / 4.0).cast("string"))).otherwise(F.lit(""))
    table(spark, sf, "labels").select(F.concat(F.col("toxic").cast("string"), F.lit(" qid:"), (i % 20).cast("string"), F.lit(" 1:"), F.col("quality").cast("string"), third).alias("value")).write.text(path)
    return readers.filled_columns(readers.svm_rank(spark, path, 4))


@query("file_svm_groups", "SELECT (doc_id % 20)::BIGINT AS qid, count(*) AS n FROM labels GROUP BY 1")
def file_svm_groups(spark, sf):
    return readers.query_groups(file_svm_rank(spark, sf))


@query("file_ranking_set", "SELECT quality AS target1, round(doc_id / 8.0::DOUBLE, 6) AS target2 FROM labels")
def file_ranking_set(spark, sf):
    path = _path(spark, "set")
    labels = table(spark, sf, "labels").select(F.col("quality").alias("target1"), F.round(F.col("doc_id") / 8.0, 6).alias("target2"))
    writers.write_csv(labels, f"{path}/y.csv")
    writers.write_csv(labels.groupBy("target1").agg(F.count(F.lit(1)).alias("group")).select("group"), f"{path}/groups.csv")
    return readers.ranking_csv(spark, path)[0]


@query("file_ranking_features", "SELECT quality::DOUBLE AS feature_0, round(doc_id / 8.0::DOUBLE, 6) AS feature_1 FROM labels")
def file_ranking_features(spark, sf):
    path = _path(spark, "set")
    writers.write_csv(table(spark, sf, "labels").select(F.col("quality").alias("feature_0"), F.round(F.col("doc_id") / 8.0, 6).alias("feature_1")), f"{path}/X.csv")
    return readers.ranking_features(spark, path)


@query("file_gazetteer", "SELECT lower(n_name) AS name, round(n_nationkey * 1.5::DOUBLE, 3) AS latitude, round(n_regionkey * 2.5::DOUBLE, 3) AS longitude FROM nation WHERE n_regionkey = 3")
def file_gazetteer(spark, sf):
    path = _path(spark, "gazetteer")
    nation = table(spark, sf, "nation")
    rows = nation.select("n_name", F.round(F.col("n_nationkey") * 1.5, 3), F.round(F.col("n_regionkey") * 2.5, 3), F.when(F.col("n_regionkey") == 3, "DE").otherwise("XX"), F.lit("P"))
    rows.write.option("sep", "\t").csv(path)
    return readers.gazetteer_file(spark, path).where("country_code = 'DE' AND feature_class = 'P'").select(F.lower("name").alias("name"), "latitude", "longitude")


@query("merge_judgements", "SELECT 'docs_' || (doc_id % 7) AS query, 'docs_' || doc_id AS document, quality AS score FROM labels UNION ALL SELECT 'bench_' || (item_id % 3), 'bench_' || item_id, 1 FROM benchmark")
def merge_judgements(spark, sf):
    docs = table(spark, sf, "labels").select((F.col("doc_id") % 7).alias("query"), F.col("doc_id").alias("document"), F.col("quality").cast("int").alias("score"))
    bench = table(spark, sf, "benchmark").select((F.col("item_id") % 3).alias("query"), F.col("item_id").alias("document"), F.lit(1).alias("score"))
    return readers.merged_judgements({"docs": docs, "bench": bench}, ("query", "document"))


@query("ltr_judged_first", f"SELECT r.query_id, r.doc_id, r.score FROM ({bm25_sql('own', k1=1.2, k=100)}) r JOIN labels l USING (doc_id) ORDER BY r.query_id, r.doc_id LIMIT 25")
def ltr_judged_first(spark, sf):
    """The first 25 judged rows, as a quick look at a data set takes them."""
    docs = table(spark, sf, "documents")
    run = R.bm25(docs, BATCH, method="own", k1=1.2, k=100).select("query_id", "doc_id", "score")
    judged = run.select("query_id", "doc_id").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return readers.judged_rows(run, spark.createDataFrame(BATCH, "query_id int, query string"), judged, docs.select("doc_id", "n_chars"), 25).select("query_id", "doc_id", "score")


@query("index_of_numbers", bm25_sql("bm25l"))
def index_of_numbers(spark, sf):
    """An index of word numbers and their vocabulary answers as one of the texts."""
    docs = table(spark, sf, "documents")
    vocabulary = docs.select(F.explode(T.word_tokens(F.col("text"))).alias("term")).distinct().select(F.xxhash64("term").alias("number"), "term")
    numbers = docs.select("doc_id", F.transform(T.word_tokens(F.col("text")), lambda t: F.xxhash64(t)).alias("ids"))
    path = _path(spark, "index")
    R.Bm25Index.from_numbers(numbers, vocabulary, method="bm25l").save(path, corpus=docs)
    return R.Bm25Index.load(spark, path, corpus=True).topk(BATCH, 10)


@query("index_with_corpus", f"SELECT r.query_id, r.rank, r.doc_id, r.score, d.lang FROM ({bm25_sql('lucene')}) r JOIN documents d USING (doc_id)")
def index_with_corpus(spark, sf):
    path = _path(spark, "index")
    docs = table(spark, sf, "documents")
    R.Bm25Index.build(docs).save(path, corpus=docs.select("doc_id", "lang"))
    return R.Bm25Index.load(spark, path, corpus=True).documents(BATCH, 10).select("query_id", "rank", "doc_id", "score", "lang")
