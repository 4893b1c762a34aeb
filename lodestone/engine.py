"""The library's front: index, crawl, retrieve and batch over one folder of tables, and SQL over all of them."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import learning, ranking, retrieval
from .sources import readers, writers
from .storage import materialise
from .streaming import ingest


class QueryRewriter(Protocol):
    """Gives further wordings of a query; a service or a model may stand behind it."""

    def rewrite(self, text: str) -> list[str]: ...


class TableRewriter:
    """Rewrites by a table of expansions: each replaces its word in the query."""

    def __init__(self, expansions: dict[str, list[str]], most: int = 8):
        self.expansions, self.most = expansions, most

    def rewrite(self, text: str) -> list[str]:
        words = text.split()
        out = [" ".join([*words[:i], e, *words[i + 1 :]]) for i, w in enumerate(words) for e in self.expansions.get(w, [])]
        return out[: self.most]


class Engine:
    """Answers from the index once one is built or opened, else from the documents. With a ranker, the first stage's
    candidates are reranked by it."""

    def __init__(self, spark: SparkSession, folder: str, rewriter: QueryRewriter | None = None, ranker: learning.LambdaRanker | None = None):
        self.spark, self.folder, self.rewriter, self.ranker = spark, folder, rewriter, ranker
        self.held: retrieval.Bm25Index | None = None

    def table(self, name: str) -> DataFrame:
        return readers.table(self.spark, self.folder, name)

    def sql(self, text: str) -> DataFrame:
        """Any Spark SQL over the folder's tables."""
        readers.register(self.spark, self.folder)
        return self.spark.sql(text)

    def index(self, path: str, method: str = "lucene", **settings) -> retrieval.Bm25Index:
        """Build an index of the documents and store it."""
        retrieval.Bm25Index.build(self.table("documents"), method, **settings).save(path)
        return self.open(path)

    def open(self, path: str) -> retrieval.Bm25Index:
        """Answer from the index at ``path`` from now on."""
        self.held = retrieval.Bm25Index.load(self.spark, path)
        return self.held

    def crawl(self, store: str, checkpoint: str, keywords: list[str] | None = None) -> DataFrame:
        """Take in the pages that have arrived since the last call."""
        stream = ingest.page_stream(self.spark, self.folder, "pages.parquet")
        return ingest.sync(ingest.documents_of(stream, keywords), store, checkpoint)

    def retrieve(self, text: str, k: int = 100, **settings) -> DataFrame:
        """(rank, doc_id, score) of one query, its rewrites fused in."""
        return self.batch([(1, text)], k, **settings).drop("query_id")

    def batch(self, queries: list[tuple[int, str]], k: int = 100, **settings) -> DataFrame:
        """(query_id, rank, doc_id, score, relevance) of many queries in one job."""
        texts = [(q, [*(self.rewriter.rewrite(t) if self.rewriter else []), t]) for q, t in queries]
        width = max((len(t) for _, t in texts), default=1)
        flat = [(q * width + i, t) for q, own in texts for i, t in enumerate(own)]
        if self.held is not None and not settings:
            found = self.held.topk(flat, k)
        else:
            found = retrieval.bm25(self.table("documents"), flat, k=k, **settings)
        split = found.select(F.floor(F.col("query_id") / width).cast("int").alias("query_id"), "doc_id", "score")
        fused = retrieval.combsum(split, k)
        return ranking.normalized(fused.withColumn("relevance", F.col("score")), ["relevance"])

    def candidates(self, queries: list[tuple[int, str]], k: int = 100) -> DataFrame:
        """The first stage's documents with what features need: (query_id, doc_id, score, body, title, url).

        A document's title is its first words, and its source stands for a URL.
        """
        found = self.batch(queries, k).select("query_id", "doc_id", "score")
        text = F.coalesce("text", F.lit(""))
        docs = self.table("documents").select("doc_id", text.alias("body"), F.substring_index(text, " ", 8).alias("title"), F.concat(F.lit("https://"), F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit(""))).alias("url"))
        return docs.join(found, "doc_id").select("query_id", "doc_id", "score", "body", "title", "url")

    def features(self, queries: list[tuple[int, str]], k: int = 100) -> DataFrame:
        """(query_id, doc_id, score, the 20 features scaled within the query) of the first stage's documents."""
        found = materialise(self.candidates(queries, k), "candidates")
        asked = self.spark.createDataFrame(queries, "query_id int, text string")
        scaled = ranking.normalized(ranking.lexical_features(found.drop("score"), asked), ranking.FEATURES)
        return found.select("query_id", "doc_id", "score").join(scaled, ["query_id", "doc_id"])

    def learn(self, queries: list[tuple[int, str]], judged: DataFrame, k: int = 100, **settings) -> learning.LambdaRanker:
        """Train a ranker on the judged (query_id, doc_id, relevance) candidates of queries, and rank by it from now on."""
        found = self.features(queries, k)
        rows = learning.training_rows(found.select("query_id", "doc_id", "score"), found.drop("score"), judged)
        self.ranker = learning.LambdaRanker(["score", *ranking.FEATURES], **settings).fit(rows)
        return self.ranker

    def rerank(self, queries: list[tuple[int, str]], k: int = 100) -> DataFrame:
        """(query_id, rank, doc_id, prediction): the first stage's best k in the ranker's order."""
        if self.ranker is None:
            raise ValueError("no ranker was given or trained")
        return self.ranker.rerank(self.features(queries, k), k)

    def answer(self, text: str, k: int = 10) -> DataFrame:
        """One JSON row per result, as a service would send it."""
        return self.retrieve(text, k).select(writers.payload("rank", "doc_id", "score").alias("payload"))
