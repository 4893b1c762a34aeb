"""The numbered features of the older ranking data sets: 14 statistics of four parts, four of the page, BM25+ of each part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import space_tokens, trimmed
from ..functions.web import count_of
from ..storage import materialise
from . import retrieval

#: A part's base number, and the number of its BM25 column.
PARTS = {"content": 1, "title": 3, "url": 4, "whole": 5}
BM25_COLUMNS = {"content": 106, "title": 108, "url": 109, "whole": 110}
#: What is added to the base for each statistic.
STATISTICS = {"covered": 0, "covered_ratio": 5, "stream_length": 10, "idf": 15, "tf_sum": 20, "tf_min": 25, "tf_max": 30, "tf_mean": 35, "tf_variance": 40, "tfidf_sum": 70, "tfidf_min": 75, "tfidf_max": 80, "tfidf_mean": 85, "tfidf_variance": 90}
PAGE_COLUMNS = {"slashes": 126, "chars": 127, "outlinks": 129, "pagerank": 130}
PAGERANK_SCALE = 100_000


def slashed(text: Column) -> Column:
    """Tokens of a lower-cased text with slashes and dots as spaces."""
    return space_tokens(F.translate(F.coalesce(text, F.lit("")), "/.", "  "))


def part_tokens() -> dict[str, Column]:
    content = space_tokens(F.col("content"))
    return {"content": trimmed(content), "title": space_tokens(F.col("title")), "url": slashed(F.col("url")), "whole": F.concat(content, slashed(F.col("url")), slashed(F.col("outgoing_links")))}


def inverse_frequency(df: Column) -> Column:
    """One over the documents with a term and one more; a half for a term that none has."""
    return F.coalesce(F.lit(1.0) / (df + 1), F.lit(0.5))


def idf_table(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(term, idf) of the given terms, counted in content, URL and links as they are written."""
    words = space_tokens(F.concat_ws(" ", F.coalesce("content", F.lit("")), F.coalesce("url", F.lit("")), F.coalesce("outgoing_links", F.lit(""))))
    held = F.filter(F.array_distinct(words), lambda t: t.isin(terms))
    counts = docs.select(F.explode(held).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    asked = docs.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    return asked.join(counts, "term", "left").select("term", inverse_frequency(F.col("df")).alias("idf"))


def found_terms(tokens: Column) -> Column:
    """(tf, idf) of those of the row's query terms that the tokens hold."""
    count = lambda t: F.struct(F.size(F.filter(tokens, lambda x: x == t["term"])).cast("double").alias("tf"), t["idf"].alias("idf"))
    return F.filter(F.transform("terms", count), lambda x: x["tf"] > 0)


def described(values: str, mean: str, prefix: str) -> dict[str, Column]:
    """Sum, least, greatest, mean and variance about the rounded mean, to six places; 0 of nothing."""
    zero, n = F.lit(0.0), F.size(values)
    spread = F.aggregate(values, zero, lambda s, x: s + (x - F.col(mean)) * (x - F.col(mean)))
    found = {"sum": F.aggregate(values, zero, lambda s, x: s + x), "min": F.coalesce(F.array_min(values), zero), "max": F.coalesce(F.array_max(values), zero), "mean": F.col(mean), "variance": F.coalesce(F.try_divide(spread, n), zero)}
    return {f"{prefix}_{k}": F.round(v, 6) for k, v in found.items()}


def mean_of(values: str) -> Column:
    return F.round(F.coalesce(F.try_divide(F.aggregate(values, F.lit(0.0), lambda s, x: s + x), F.size(values)), F.lit(0.0)), 6)


def numbered_features(docs: DataFrame, queries: list[tuple[int, str]], bm25: bool = True) -> DataFrame:
    """(query_id, doc_id, f1 ... f130): every document for every query of the batch.

    ``docs``: doc_id, content, title, url, outgoing_links (joined by commas), pagerank. The statistics of a
    query's terms come from the arrays of a row, so nothing but the frequencies of the batch's terms and the
    BM25+ scores is shuffled.
    """
    spark = docs.sparkSession
    split = {q: text.lower().split() for q, text in queries}
    terms = sorted({t for words in split.values() for t in words})
    idfs = {r.term: r.idf for r in idf_table(docs, terms).collect()}  # the batch's terms
    rows = F.array(*[F.struct(F.lit(q).alias("query_id"), F.array(*[F.struct(F.lit(t).alias("term"), F.lit(float(idfs[t])).alias("idf")) for t in words]).alias("terms")) for q, words in split.items()])
    # Texts are split once; features and scores of all parts are read from that.
    split_docs = materialise(docs.select("doc_id", "url", "outgoing_links", "pagerank", *[t.alias(f"t_{p}") for p, t in part_tokens().items()]), "parts")
    wide = split_docs.withColumn("q", F.explode(rows)).select("*", "q.query_id", "q.terms").drop("q")
    # One step after another, so that no expression is computed twice.
    wide = wide.withColumns({f"c_{p}": found_terms(F.col(f"t_{p}")) for p in PARTS})
    wide = wide.withColumns({f"{n}_{p}": F.transform(f"c_{p}", of) for p in PARTS for n, of in (("tf", lambda x: x["tf"]), ("ws", lambda x: x["tf"] * x["idf"]))})
    wide = wide.withColumns({f"mean_{n}_{p}": mean_of(f"{n}_{p}") for p in PARTS for n in ("tf", "ws")})
    out: dict[str, Column] = {}
    asked = F.size("terms")
    for part, base in PARTS.items():
        tokens = F.col(f"t_{part}")
        # Of a URL, the letters of its host's first name count.
        length = F.length(F.coalesce(F.get(tokens, F.lit(2)), F.lit(""))) if part == "url" else F.size(tokens)
        found = {
            "covered": F.size(f"c_{part}").cast("double"),
            "covered_ratio": F.round(F.size(f"c_{part}") / asked, 6),
            "stream_length": length.cast("double"),
            "idf": F.round(F.aggregate("terms", F.lit(0.0), lambda s, t: s + t["idf"]) / asked, 6),
            **described(f"tf_{part}", f"mean_tf_{part}", "tf"),
            **described(f"ws_{part}", f"mean_ws_{part}", "tfidf"),
        }
        out |= {f"f{base + STATISTICS[k]}": v for k, v in found.items()}
    url = F.lower(F.coalesce("url", F.lit("")))
    page = {"slashes": count_of(url, "/").cast("double"), "chars": F.length(url).cast("double"), "outlinks": F.size(F.split(F.coalesce("outgoing_links", F.lit("")), ",")).cast("double"), "pagerank": F.round(F.col("pagerank") * PAGERANK_SCALE, 6)}
    out |= {f"f{PAGE_COLUMNS[k]}": v for k, v in page.items()}
    features = wide.select("query_id", "doc_id", *[v.alias(k) for k, v in sorted(out.items(), key=lambda x: int(x[0][1:]))])
    if bm25:
        for part in PARTS:
            named = split_docs.select("doc_id", F.col(f"t_{part}").alias("tokens"))
            scores = retrieval.bm25(named, queries, method="bm25+", k=None, tokens=F.col("tokens"), query_tokens=space_tokens(F.col("text")))
            features = features.join(scores.select("query_id", "doc_id", F.col("score").alias(f"f{BM25_COLUMNS[part]}")), ["query_id", "doc_id"], "left")
        features = features.fillna(0.0, [f"f{n}" for n in BM25_COLUMNS.values()])
    return features
