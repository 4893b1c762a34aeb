"""Index building and retrieval: BM25 in six variants, vector space, fusion."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scoring import SHIFTED, absent, idf, saturation
from ..functions.text import word_tokens
from ..storage import materialise


def postings(docs: DataFrame, tokens: Column | None = None, key: str = "doc_id") -> DataFrame:
    """(key, term, tf): counts of terms per document."""
    tokens = word_tokens(F.col("text")) if tokens is None else tokens
    return docs.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def term_stats(posting: DataFrame) -> DataFrame:
    """(term, df, cf)."""
    return posting.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


#: Terms that are joined by broadcast: the most frequent ones, which make up most of the postings.
HEAD = 100_000


def counted(docs: DataFrame, tokens: Column, key: str = "doc_id", name: str = "term") -> DataFrame:
    """(key, dl, term, tf) of documents with their lengths, counted within each row, so that nothing is shuffled.

    Sorted tokens are cut where they change. Where keys repeat, rows of one key and length add up.
    """
    split = docs.select(key, F.sort_array(tokens).alias("_s"))
    starts = F.array_compact(F.transform("_s", lambda t, i: F.when((i == 0) | (t != F.get("_s", i - 1)), i)))
    marked = split.select(key, "_s", starts.alias("_i"))
    entries = F.transform("_i", lambda i, j: F.struct(F.get("_s", i).alias(name), (F.coalesce(F.get("_i", j + 1), F.size("_s")) - i).cast("long").alias("tf")))
    out = marked.select(key, F.size("_s").alias("dl"), F.explode(entries).alias("x")).select(key, "dl", f"x.{name}", "x.tf")
    if docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return out
    return out.groupBy(key, "dl", name).agg(F.sum("tf").alias("tf"))


def with_term(posting: DataFrame, terms: DataFrame, on: str | list[str] = "term", head: int = HEAD) -> DataFrame:
    """Postings with the columns of ``terms`` (on, df, ...), a written table.

    The most frequent terms, at most ``head``, are broadcast; only postings of the others, which no task has many of,
    are shuffled.
    """
    on = [on] if isinstance(on, str) else on
    bits = terms.groupBy(F.length(F.bin("df")).alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("b")).collect()  # 64 rows at most
    taken, cut = 0, None
    for row in bits:
        if taken + row.n > head:
            break
        taken, cut = taken + row.n, 1 << (row.b - 1)
    if cut is None:
        return posting.join(terms, on)
    common = posting.join(F.broadcast(terms.where(F.col("df") >= cut)), on)
    if cut == 1 << (bits[-1].b - 1):
        return common
    rare = posting.join(F.broadcast(terms.where(F.col("df") >= cut).select(*on)), on, "left_anti").join(terms.where(F.col("df") < cut), on)
    return common.unionByName(rare)


def doc_stats(docs: DataFrame, tokens: Column | None = None) -> DataFrame:
    """(doc_id, dl): lengths in tokens, of empty documents too."""
    tokens = word_tokens(F.col("text")) if tokens is None else tokens
    return docs.select("doc_id", F.size(tokens).cast("long").alias("dl"))


def query_terms(queries: DataFrame, tokens: Column | None = None) -> DataFrame:
    """(query_id, term, qtf) of queries (query_id, text)."""
    tokens = word_tokens(F.col("text")) if tokens is None else tokens
    return queries.select("query_id", F.explode(tokens).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def top_k(scored: DataFrame, k: int | None, by: str = "query_id", score: str = "score", key: str = "doc_id") -> DataFrame:
    """Rank from 1 within ``by``, by falling score, ties by key; Catalyst limits groups before the shuffle. All rows if ``k`` is None."""
    order = Window.partitionBy(by).orderBy(F.desc(score), key)
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return (ranked if k is None else ranked.where(F.col("rank") <= k)).withColumn("rank", F.col("rank").cast("long"))


def bm25(docs: DataFrame, queries: list[tuple[int, str]], method: str = "lucene", idf_method: str | None = None, k: int | None = 10, k1: float = 1.5, b: float = 0.75, delta: float = 0.5, pad: bool = False, tokens: Column | None = None, query_tokens: Column | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score): the best k documents of each query, or all if k is None, all queries in one job.

    ``queries`` is a batch from the caller, so of bounded size; its terms become a literal filter on the
    token arrays. Texts are tokenised once: what leaves the scan, each document's length and its hits, is written,
    and statistics, document frequencies and scores are read from that. With ``pad``, and under the shifted methods, documents without a query
    term fill up to k by smallest doc_id, with the score that the lack of all terms has.
    """
    spark = docs.sparkSession
    idf_method = idf_method or method
    asked = query_terms(spark.createDataFrame(queries, "query_id int, text string"), query_tokens).collect()
    terms = sorted({r.term for r in asked})
    wanted = F.broadcast(spark.createDataFrame([(r.query_id, r.term, float(r.qtf)) for r in asked], "query_id int, term string, qtf double"))
    tokens = word_tokens(F.col("text")) if tokens is None else tokens
    split = docs.select("doc_id", tokens.alias("tokens"))
    hits = materialise(split.select("doc_id", F.size("tokens").cast("double").alias("dl"), F.filter("tokens", lambda t: t.isin(terms)).alias("hits")), "hits")
    stats = hits.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("avgdl"))
    tf = hits.select("doc_id", "dl", F.explode("hits").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    # One row per query term, and one row of statistics: bounded by the batch.
    weights = F.broadcast(wanted.join(df, "term").crossJoin(F.broadcast(stats)).withColumn("idf", idf(idf_method, F.col("n"), F.col("df"))))
    lack = absent(method, k1, delta)
    gain = F.col("qtf") * F.col("idf") * (saturation(method, F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b, delta) - lack)
    shift = weights.groupBy("query_id").agg(F.sum(F.col("qtf") * F.col("idf") * lack).alias("shift"))
    matched = tf.join(weights, "term").groupBy("query_id", "doc_id").agg(F.sum(gain).alias("gain"))
    scored = matched.join(F.broadcast(shift), "query_id").select("query_id", "doc_id", F.round(F.col("gain") + F.col("shift"), 6).alias("score"))
    if pad or method in SHIFTED:
        # Among the first k documents, at least as many lack all terms as places can be open.
        asked_ids = spark.createDataFrame([(q,) for q, _ in queries], "query_id int")
        first = hits.select("doc_id") if k is None else hits.select("doc_id").orderBy("doc_id").limit(k)
        rest = first.crossJoin(F.broadcast(asked_ids)).join(matched, ["query_id", "doc_id"], "left_anti").join(F.broadcast(shift), "query_id", "left")
        scored = scored.unionByName(rest.select("query_id", "doc_id", F.round(F.coalesce("shift", F.lit(0.0)), 6).alias("score")))
    return top_k(scored, k).select("query_id", "rank", "doc_id", "score")


def impacts(docs: DataFrame, method: str, k1: float = 1.5, b: float = 0.75, delta: float = 0.5, places: int | None = 6, tokens: Column | None = None) -> DataFrame:
    """(term, doc_id, impact): every posting's score, less what the lack of the term scores; rounded to ``places``."""
    # Texts are split once; a posting carries its document's length.
    posting = materialise(counted(docs, word_tokens(F.col("text")) if tokens is None else tokens), "postings")
    return weighed(posting, materialise(term_stats(posting), "terms"), docs.count(), method, k1, b, delta, places)


def weighed(posting: DataFrame, terms: DataFrame, n: int, method: str, k1: float, b: float, delta: float, places: int | None, on: str = "term") -> DataFrame:
    """(term, doc_id, impact) of postings (on, doc_id, dl, tf) and the written table of their terms (on, term, df, cf)."""
    average = float(terms.agg(F.sum("cf").alias("c")).first().c or 0) / n if n else 0.0
    d = lambda c: F.col(c).cast("double")
    part = saturation(method, d("tf"), d("dl"), F.lit(average), k1, b, delta) - absent(method, k1, delta)
    impact = idf(method, F.lit(float(n)), d("df")) * part
    return with_term(posting, terms, on).select("term", "doc_id", (impact if places is None else F.round(impact, places)).alias("impact"))


class Bm25Index:
    """A persisted index: scored postings by term, and what queries need of the corpus."""

    def __init__(self, postings_: DataFrame, terms: DataFrame, params: dict):
        self.postings, self.terms, self.params = postings_, terms, params
        self.corpus: DataFrame | None = None

    @classmethod
    def build(cls, docs: DataFrame, method: str = "lucene", k1: float = 1.5, b: float = 0.75, delta: float = 0.5, tokens: Column | None = None) -> Bm25Index:
        """``tokens`` may be a column of words, or of numbers, whose digits are then the terms; by default texts are split."""
        tokens = word_tokens(F.col("text")) if tokens is None else tokens.cast("array<string>")
        posting = materialise(counted(docs, tokens), "postings")
        return cls._of(posting, materialise(term_stats(posting), "terms"), docs.count(), method, k1, b, delta)

    @classmethod
    def _of(cls, posting: DataFrame, terms: DataFrame, n: int, method: str = "lucene", k1: float = 1.5, b: float = 0.75, delta: float = 0.5, on: str = "term") -> Bm25Index:
        """Of written postings and statistics of their terms: texts are split once for both."""
        shift = idf(method, F.lit(float(n)), F.col("df").cast("double")) * absent(method, k1, delta)
        scored = weighed(posting, terms, n, method, k1, b, delta, None, on)
        return cls(scored, terms.select("term", "df", "cf", shift.alias("shift")), {"method": method, "k1": k1, "b": b, "delta": delta, "n": n})

    @classmethod
    def from_numbers(cls, docs: DataFrame, vocabulary: DataFrame, ids: str = "ids", **settings) -> Bm25Index:
        """Of documents as arrays of word numbers, with the vocabulary (number, term) that they are numbers of.

        Numbers are counted as they are, and named by term, not by posting. Where the vocabulary gives a number or a
        term twice or lacks a number, the arrays are turned into words first.
        """
        vocabulary = materialise(vocabulary.select("number", "term"), "vocabulary")
        sizes = vocabulary.agg(F.count(F.lit(1)), F.count_distinct("number"), F.count_distinct("term")).first()
        if sizes[0] == sizes[1] == sizes[2]:
            posting = materialise(counted(docs, F.col(ids), name="number"), "postings")
            found = posting.groupBy("number").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
            named = materialise(found.join(vocabulary, "number", "left"), "terms")
            if named.where("term IS NULL").isEmpty():
                return cls._of(posting, named, docs.count(), on="number", **settings)
        flat = docs.select("doc_id", F.explode(ids).alias("number")).join(vocabulary, "number").groupBy("doc_id").agg(F.collect_list("term").alias("_words"))
        named = docs.select("doc_id").join(flat, "doc_id", "left").select("doc_id", F.coalesce("_words", F.array().cast("array<string>")).alias("words"))
        return cls.build(materialise(named, "words"), tokens=F.col("words"), **settings)

    def vocabulary(self) -> DataFrame:
        """(number, term): terms numbered in order, without gaps within a task's range."""
        return self.terms.select("term").orderBy("term").select(F.monotonically_increasing_id().alias("number"), "term")

    def save(self, path: str, corpus: DataFrame | None = None) -> None:
        """Parquet per component; postings are laid out by term, so that a scan for few terms skips row groups.

        With ``corpus`` its rows are kept beside the index, for ``load(..., corpus=True)``.
        """
        if corpus is not None:
            corpus.write.mode("overwrite").parquet(f"{path}/corpus")
        self.postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        spark = self.postings.sparkSession
        spark.createDataFrame([(json.dumps(self.params),)], "params string").coalesce(1).write.mode("overwrite").text(f"{path}/params")

    @classmethod
    def load(cls, spark: SparkSession, path: str, corpus: bool = False) -> Bm25Index:
        """The saved index. What a document scores for terms that it lacks is part of ``terms``; without it, this fails."""
        params = json.loads(spark.read.text(f"{path}/params").first()[0])
        out = cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"), params)
        if "shift" not in out.terms.columns:
            raise ValueError("the index lacks the scores of absent terms")
        out.corpus = spark.read.parquet(f"{path}/corpus") if corpus else None
        return out

    def documents(self, queries: list[tuple[int, str]], k: int = 10) -> DataFrame:
        """The best k of each query with the rows of the corpus that was loaded with the index."""
        return self.topk(queries, k).join(self.corpus, "doc_id")

    def topk(self, queries: list[tuple[int, str]], k: int = 10) -> DataFrame:
        """(query_id, rank, doc_id, score)."""
        spark = self.postings.sparkSession
        asked = query_terms(spark.createDataFrame(queries, "query_id int, text string")).collect()
        wanted = F.broadcast(spark.createDataFrame([(r.query_id, r.term, float(r.qtf)) for r in asked], "query_id int, term string, qtf double"))
        terms = sorted({r.term for r in asked})
        found = self.postings.where(F.col("term").isin(terms)).join(wanted, "term")
        shift = self.terms.where(F.col("term").isin(terms)).join(wanted, "term").groupBy("query_id").agg(F.sum(F.col("qtf") * F.col("shift")).alias("shift"))
        scored = found.groupBy("query_id", "doc_id").agg(F.sum(F.col("qtf") * F.col("impact")).alias("gain")).join(F.broadcast(shift), "query_id")
        return top_k(scored.select("query_id", "doc_id", F.round(F.col("gain") + F.col("shift"), 6).alias("score")), k).select("query_id", "rank", "doc_id", "score")


class VectorSpace:
    """Cosine of tf-idf vectors: tf over length, log10(N / df).

    Fitted once: frequencies and norms are written, so that a query reads its own terms' postings and the norms.
    """

    def __init__(self, weights: DataFrame, norms: DataFrame, idfs: DataFrame):
        self.weights, self.norms, self.idfs = weights, norms, idfs

    @classmethod
    def fit(cls, docs: DataFrame, tokens: Column | None = None) -> VectorSpace:
        tokens = word_tokens(F.col("text")) if tokens is None else tokens
        tf = materialise(counted(docs, tokens), "tf")
        n = docs.agg(F.count(F.lit(1)).cast("double").alias("n"))
        idfs = materialise(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("term", "df", F.log10(F.col("n") / F.col("df")).alias("idf")), "idfs")
        # A document's postings lie together, so its norm is added up before the shuffle.
        weights = with_term(tf, idfs).select("doc_id", "term", (F.col("tf") / F.col("dl") * F.col("idf")).alias("w"))
        norms = materialise(weights.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")), "norms")
        return cls(weights, norms, idfs)

    def query(self, text: str, tokens: Column | None = None) -> DataFrame:
        """(doc_id, score) of the documents that share a known term with the query. Unknown terms count for the query's length only."""
        spark = self.weights.sparkSession
        tokens = word_tokens(F.col("text")) if tokens is None else tokens
        asked = spark.createDataFrame([(text,)], "text string").select(tokens.alias("t")).first().t
        counts = {t: asked.count(t) / max(1, len(asked)) for t in asked}
        # The query's distinct terms.
        q = F.broadcast(spark.createDataFrame([*counts.items()] or [("", 0.0)], "term string, qtf double"))
        qw = F.broadcast(self.idfs.join(q, "term").select("term", (F.col("qtf") * F.col("idf")).alias("qw")))
        qn = qw.agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
        dots = self.weights.where(F.col("term").isin(list(counts))).join(qw, "term").groupBy("doc_id").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
        scored = dots.join(self.norms, "doc_id").crossJoin(F.broadcast(qn))
        return scored.select("doc_id", F.round(F.coalesce(F.try_divide(F.col("dot"), F.col("norm") * F.col("qnorm")), F.lit(0.0)), 6).alias("score"))


def parametric(scores: DataFrame, docs: DataFrame, equals: dict | None = None, ranges: dict[str, tuple[float, float]] | None = None, grid: bool = False) -> DataFrame:
    """Scores of the documents that meet all equalities and ranges. A ``grid`` range holds whole numbers only."""
    kept = docs
    for column, value in (equals or {}).items():
        kept = kept.where(F.col(column) == value)
    for column, (low, high) in (ranges or {}).items():
        c = F.col(column)
        kept = kept.where(c.between(F.floor(F.lit(low)), F.ceil(F.lit(high))) & (c == F.floor(c)) if grid else c.between(low, high))
    return scores.join(kept.select("doc_id"), "doc_id", "left_semi")


def combsum(ranked: DataFrame, k: int = 100) -> DataFrame:
    """Fusion of variants (query_id, variant_id, doc_id, score), each cut already: sums, best k."""
    return top_k(ranked.groupBy("query_id", "doc_id").agg(F.round(F.sum("score"), 6).alias("score")), k).select("query_id", "rank", "doc_id", "score")


def domain_share(results: DataFrame) -> DataFrame:
    """(query_id, host, n, share) of results (query_id, host)."""
    counts = results.groupBy("query_id", "host").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("query_id")), 6))


def domain_cap(results: DataFrame, pool: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Results (query_id, doc_id, host, score); if a host has ``threshold`` of them or more, the lower half of
    its documents gives way to the pool's first documents of other hosts (doc_id, host), with score 0."""
    shares = domain_share(results)
    top = shares.where(F.col("share") >= threshold).select("query_id", "host", "n")
    order = Window.partitionBy("query_id", "host").orderBy("score", F.desc("doc_id"))
    lowest = results.withColumn("_low", F.row_number().over(order)).join(top, ["query_id", "host"]).where(F.col("_low") <= F.floor(F.col("n") / 2))
    kept = results.join(lowest.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    open_places = top.select("query_id", "host", F.floor(F.col("n") / 2).alias("open"))
    # A query's places are filled from the first documents of other hosts, of which its results take some: so many
    # documents of the pool's start serve all queries with the same host. Queries and so hosts are a batch.
    most = results.groupBy("query_id").agg((F.count(F.lit(1)) * 2).alias("m")).agg(F.max("m")).first()[0] or 0
    others = None
    for row in top.select("host").distinct().collect():
        first = pool.where(F.col("host") != row.host).orderBy("doc_id").limit(int(most)).withColumn("_top", F.lit(row.host))
        others = first if others is None else others.unionByName(first)
    kept = kept.select("query_id", "doc_id", "host", "score")
    if others is None:
        return kept
    met = others.join(open_places.withColumnRenamed("host", "_top"), "_top").join(results.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    filled = met.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))).where(F.col("_n") <= F.col("open"))
    return kept.unionByName(filled.select("query_id", "doc_id", "host", F.lit(0.0).alias("score")))
