"""Ranking features, labels, learned ranking and evaluation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import cosine, grade_weight, graded_label, hashed_embedding, min_max
from ..functions.text import simple_tokens
from ..functions.web import count_of, url_terms
from ..storage import materialise
from .retrieval import counted, with_term

PARTS = ("body", "title", "url")


def part_terms(candidates: DataFrame) -> DataFrame:
    """(query_id, doc_id, part, term, tf, stream_length) of split candidates (query_id, doc_id, t_body, t_title, t_url).

    Counted within the row, so that nothing is shuffled; where a query has a candidate twice, its terms add up.
    """
    long = candidates.select("query_id", "doc_id", F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(f"t_{p}").alias("tokens")) for p in PARTS])).alias("x"))
    keyed = long.select(F.struct("query_id", "doc_id", "x.part").alias("_key"), F.col("x.tokens").alias("tokens"))
    flat = counted(keyed, F.col("tokens"), "_key")
    return flat.select("_key.*", "term", "tf", F.col("dl").alias("stream_length"))


FEATURES = [f"{p}_{f}" for p in PARTS for f in ("sum_tf", "sum_tfidf", "stream_length", "cosine", "synonym_count", "embedding")] + ["url_slashes", "url_chars"]


def part_texts() -> dict[str, Column]:
    return {"body": simple_tokens(F.col("body")), "title": simple_tokens(F.col("title")), "url": url_terms(F.col("url"))}


def lexical_features(candidates: DataFrame, queries: DataFrame, synonyms: DataFrame | None = None, embed: Callable[[Column], Column] = hashed_embedding, wanted: list[str] = FEATURES) -> DataFrame:
    """Per candidate and part: sum_tf, sum_tfidf, stream_length, cosine, synonym_count and the cosine of embeddings;
    slashes and length of the URL: 20 features, or those ``wanted``.

    The corpus of the inverse document frequencies, ln(N / df), is the query's candidate set. ``embed`` makes a
    vector of an array of tokens; a model may stand behind it. Queries are a batch of the caller and are broadcast.
    """
    # Pages are split into tokens once; all that follows reads those, and their counts.
    candidates = materialise(candidates.select("query_id", "doc_id", "url", *[t.alias(f"t_{p}") for p, t in part_texts().items()]), "parts")
    # Rows alone: the URL's counts, and the parts' embeddings against the query's.
    asked_vectors = F.broadcast(queries.select("query_id", embed(simple_tokens(F.col("text"))).alias("asked")))
    alike = {f"{p}_embedding": F.round(cosine(embed(F.col(f"t_{p}")), F.col("asked")), 6) for p in PARTS}
    own = candidates.join(asked_vectors, "query_id").select("query_id", "doc_id", *[v.alias(k) for k, v in alike.items()], count_of(F.col("url"), "/").cast("double").alias("url_slashes"), F.length("url").cast("double").alias("url_chars"))
    if set(wanted) <= set(own.columns):
        return own.select("query_id", "doc_id", *wanted)
    terms = materialise(part_terms(candidates), "terms")
    n = F.broadcast(candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")))
    df = terms.groupBy("query_id", "part", "term").agg(F.count(F.lit(1)).alias("df"))
    idf = materialise(df.join(n, "query_id").select("query_id", "part", "term", "df", F.log(F.col("n") / F.col("df")).alias("idf")), "idfs")
    asked = queries.select("query_id", F.explode(simple_tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    parts = F.explode(F.array(*map(F.lit, PARTS))).alias("part")
    # A query's term that no candidate has weighs ln N.
    weights = asked.join(n, "query_id").select("query_id", "term", "qtf", "n", parts).join(idf, ["query_id", "part", "term"], "left").select("query_id", "part", "term", (F.col("qtf") * F.coalesce("idf", F.log("n"))).alias("qw"))
    weights = materialise(weights, "weights")
    # All of a candidate's sums in one step; its terms lie together, so they are added up before the shuffle.
    found = with_term(terms, idf, ["query_id", "part", "term"]).join(F.broadcast(weights), ["query_id", "part", "term"], "left")
    if synonyms is not None:
        also = asked.join(synonyms, "term").select("query_id", F.col("synonym").alias("term"), F.lit(True).alias("also")).distinct()
        found = found.join(F.broadcast(also), ["query_id", "term"], "left")
    else:
        found = found.withColumn("also", F.lit(None).cast("boolean"))
    hit, w = F.col("qw").isNotNull(), F.col("tf") * F.col("idf")
    sums = {"sum_tf": F.when(hit, F.col("tf")), "sum_tfidf": F.when(hit, w), "dot": w * F.col("qw"), "synonyms": F.when(F.col("also"), F.col("tf")), "squares": F.pow(w, 2)}
    wide = found.groupBy("query_id", "doc_id").agg(*[F.max(F.when(F.col("part") == p, F.col("stream_length"))).alias(f"{p}_length") for p in PARTS], *[F.sum(F.when(F.col("part") == p, v)).alias(f"{p}_{k}") for p in PARTS for k, v in sums.items()])
    qnorm = weights.groupBy("query_id").agg(*[F.sqrt(F.sum(F.when(F.col("part") == p, F.pow("qw", 2)))).alias(f"{p}_qnorm") for p in PARTS])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    of = {
        "sum_tf": lambda p: zero(f"{p}_sum_tf"),
        "sum_tfidf": lambda p: F.round(zero(f"{p}_sum_tfidf"), 6),
        "stream_length": lambda p: zero(f"{p}_length"),
        "cosine": lambda p: F.round(F.coalesce(F.try_divide(F.col(f"{p}_dot"), F.sqrt(f"{p}_squares") * F.col(f"{p}_qnorm")), F.lit(0.0)), 6),
        "synonym_count": lambda p: zero(f"{p}_synonyms"),
    }
    both = wide.join(F.broadcast(qnorm), "query_id", "left").select("query_id", "doc_id", *[make(p).alias(f"{p}_{k}") for p in PARTS for k, make in of.items()])
    return both.join(own, ["query_id", "doc_id"]).select("query_id", "doc_id", *wanted)


def normalized(features: DataFrame, columns: list[str], by: str = "query_id", written: bool = False) -> DataFrame:
    """Each column between its least and greatest in the query's group; 0 where they are equal.

    Of a ``written`` table with large groups the extremes are found first and joined, so that no task gets a group.
    """
    others = [c for c in features.columns if c not in columns]
    if written:
        limits = features.groupBy(F.col(by).alias("_by")).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max))])
        met = features.join(F.broadcast(limits), F.col(by).eqNullSafe(F.col("_by")))
        return met.select(*others, *[F.round(min_max(F.col(c), F.col(f"_low_{c}"), F.col(f"_high_{c}")), 6).alias(c) for c in columns])
    whole = Window.partitionBy(by)
    return features.select(*others, *[F.round(min_max(F.col(c), F.min(c).over(whole), F.max(c).over(whole)), 6).alias(c) for c in columns])


def term_statistics(values: Column) -> Column:
    """sum, min, max, mean and population variance of an array, 0 for an empty one, rounded to six places."""
    n = F.size(values)
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    mean = F.coalesce(F.try_divide(total, n), F.lit(0.0))
    var = F.coalesce(F.try_divide(F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)), n), F.lit(0.0))
    named = {"sum": total, "min": F.coalesce(F.array_min(values), F.lit(0.0)), "max": F.coalesce(F.array_max(values), F.lit(0.0)), "mean": mean, "variance": var}
    return F.struct(*[F.round(v, 6).alias(k) for k, v in named.items()])


def labels(judged: DataFrame) -> DataFrame:
    """``judged`` (grade, score) with label 1 to 5: weight plus score, scaled over all rows."""
    low_high = judged.agg(F.min(grade_weight(F.col("grade")) + F.col("score")).alias("_low"), F.max(grade_weight(F.col("grade")) + F.col("score")).alias("_high"))
    return judged.crossJoin(F.broadcast(low_high)).withColumn("label", graded_label(F.col("grade"), F.col("score"), F.col("_low"), F.col("_high"))).drop("_low", "_high")


def split_by_query(rows: DataFrame, train: int, by: str = "query_id") -> DataFrame:
    """``rows`` with ``part``: train for the first ``train`` queries by id, else test.

    Only the first ids leave their tasks.
    """
    ids = rows.select(by).distinct()
    first = ids.orderBy(by).limit(train).select(by, F.lit("train").alias("part"))
    return rows.join(first, by, "left").withColumn("part", F.coalesce("part", F.lit("test")))


class Ranker:
    """Boosted regression trees on graded labels; a document's prediction is its rank score."""

    def __init__(self, columns: list[str], rounds: int = 20, depth: int = 5, rate: float = 0.1, seed: int = 42):
        self.columns, self.settings = columns, {"maxIter": rounds, "maxDepth": depth, "stepSize": rate, "seed": seed}
        self.assembler = VectorAssembler(inputCols=columns, outputCol="features")
        self.model = None

    def fit(self, rows: DataFrame) -> Ranker:
        self.model = GBTRegressor(labelCol="label", featuresCol="features", **self.settings).fit(self.assembler.transform(rows))
        return self

    def rerank(self, rows: DataFrame, k: int = 100) -> DataFrame:
        """(query_id, rank, doc_id, prediction)."""
        scored = self.model.transform(self.assembler.transform(rows)).withColumn("prediction", F.round("prediction", 6))
        order = Window.partitionBy("query_id").orderBy(F.desc("prediction"), "doc_id")
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long")).select("query_id", "rank", "doc_id", "prediction")

    def importance(self) -> dict[str, float]:
        return dict(zip(self.columns, self.model.featureImportances.toArray().tolist()))


def ndcg(run: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg) of a run (query_id, rank, doc_id) against (query_id, doc_id, relevance)."""
    gain = lambda rel, rank: (F.pow(F.lit(2.0), rel) - 1) / F.log2(rank + 1)
    found = run.where(F.col("rank") <= k).join(judged, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.sum(gain(F.coalesce("relevance", F.lit(0)), F.col("rank"))).alias("dcg"))
    best = judged.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "doc_id"))).where(F.col("r") <= k)
    ideal = best.groupBy("query_id").agg(F.sum(gain(F.col("relevance"), F.col("r"))).alias("idcg"))
    return found.join(ideal, "query_id", "left").select("query_id", F.round(F.coalesce(F.try_divide("dcg", "idcg"), F.lit(0.0)), 6).alias("ndcg"))


def average_precision(run: DataFrame, judged: DataFrame) -> DataFrame:
    """(query_id, ap): precision at each relevant document of the run, over all relevant ones."""
    relevant = judged.where("relevance > 0")
    totals = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    hits = run.join(relevant, ["query_id", "doc_id"]).withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    sums = hits.groupBy("query_id").agg(F.sum(F.col("n") / F.col("rank")).alias("s"))
    return totals.join(sums, "query_id", "left").select("query_id", F.round(F.coalesce("s", F.lit(0.0)) / F.col("total"), 6).alias("ap"))


def reciprocal_rank(run: DataFrame, judged: DataFrame) -> DataFrame:
    """(query_id, rr): one over the rank of the first relevant document; 0 without one."""
    hits = run.join(judged.where("relevance > 0"), ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    return run.select("query_id").distinct().join(hits, "query_id", "left").select("query_id", F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"))


def total_of(columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, map(F.col, columns))
