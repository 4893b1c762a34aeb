"""Corpus operators: exact and soft deduplication, the cleaning pipeline, keywords, topics, geography."""

from __future__ import annotations

import ctypes
import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import IDF, CountVectorizer, Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.scoring import geodesic_km, haversine
from ..functions.text import STOP_WORDS, lemma, pipeline_tokens, word_tokens
from ..functions.web import encyclopedia_noise, main_text, title
from ..storage import materialise

SOFT_SIMILARITY, SOFT_DISTANCE = 0.95, 2
#: Blocks of a 64-bit SimHash, one of which is equal in two that differ in SOFT_DISTANCE bits.
SOFT_BLOCKS = (22, 21, 21)
#: Hashes under one block from which on their pairs are not made.
SOFT_CROWD = 256


#: Rows and characters that a Python worker turns into objects at once; a longer row comes alone.
BATCH_ROWS, BATCH_BYTES = 500, 2 << 20


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of BATCH_ROWS and about BATCH_BYTES at most."""
    for batch in batches:
        step = max(1, min(BATCH_ROWS, int(batch.num_rows * BATCH_BYTES / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _in_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """``mapInArrow`` whose memory follows neither the partition's rows nor the session's batches: Spark sends no more
    than BATCH_ROWS and BATCH_BYTES at once, unless the session asks for less, and free memory goes back."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(re.sub("[^0-9-]", "", conf.get(key))) <= most:
            conf.set(key, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(_slices(batches))
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return df.mapInArrow(run, schema)


def exact_dedup(docs: DataFrame, content: str = "text", key: str = "doc_id") -> DataFrame:
    """The first document of each content. Only digests and keys are shuffled; partial aggregation takes hot contents."""
    first = docs.groupBy(F.sha2(F.coalesce(F.col(content), F.lit("")), 256).alias("_digest")).agg(F.min(key).alias(key))
    return docs.join(first.select(key), key, "left_semi")


def simhashes(docs: DataFrame, tokens: Column | None = None) -> DataFrame:
    """(doc_id, simhash, bag) of documents with tokens: 64 bits weighted by counts, and a hash of the counted tokens.

    A term's bits are the first 64 of its md5. A document is hashed where it is read; nothing is shuffled.
    """
    tokens = word_tokens(F.col("text")) if tokens is None else tokens
    fields = StructType([docs.schema["doc_id"], StructField("simhash", LongType()), StructField("bag", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            ids, hashes, bags = [], [], []
            for doc, words in zip(batch.column("doc_id").to_pylist(), batch.column("tokens").to_pylist()):
                if not words:
                    continue
                counts = Counter(words)
                if len(known) > 50_000:
                    known.clear()
                for w in counts:
                    if w not in known:
                        known[w] = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")
                terms = np.array([known[w] for w in counts], ">u8")
                n = np.fromiter(counts.values(), np.int64, len(counts))
                ones = np.zeros(64)
                for at in range(0, len(terms), 4096):  # 64 numbers a term
                    ones += n[at : at + 4096] @ np.unpackbits(terms[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1).astype(np.float64)
                ids.append(doc)
                hashes.append(int.from_bytes(np.packbits(2 * ones > n.sum()).tobytes(), "big", signed=True))
                # A sum over the counted terms, each multiplied by an odd number of its count's.
                odd = n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) << np.uint64(1) | np.uint64(1)
                bags.append(int((terms.astype(np.uint64) * odd).sum(dtype=np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("doc_id").type), pa.array(hashes, pa.int64()), pa.array(bags, pa.int64())], ["doc_id", "simhash", "bag"])

    return _in_arrow(docs.select("doc_id", tokens.alias("tokens")), run, fields)


def simhash_links(hashes: DataFrame) -> DataFrame:
    """(u, v), u < v: pairs of distinct hashes within SOFT_DISTANCE bits. One of three blocks must be equal.

    Hashes that share a block with over SOFT_CROWD others meet in another way, without pairs of the block: two
    differ in at most 2 bits exactly if flipping at most one bit of each gives one value, which no more than
    65 hashes give.
    """
    parts, at = [], 0
    for i, width in enumerate(SOFT_BLOCKS):
        parts.append(F.struct(F.lit(i).alias("k"), F.shiftrightunsigned("simhash", at).bitwiseAND(F.lit((1 << width) - 1)).alias("v")))
        at += width
    distinct = hashes.select("simhash").distinct()
    keyed = distinct.select("simhash", F.explode(F.array(*parts)).alias("x")).select("simhash", "x.k", "x.v")
    sizes = keyed.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = materialise(keyed.join(sizes, ["k", "v"]), "blocks")
    a, b = dealt.where(F.col("n") <= SOFT_CROWD).alias("a"), dealt.where(F.col("n") <= SOFT_CROWD).alias("b")
    near = F.bit_count(F.col("a.simhash").bitwiseXOR(F.col("b.simhash"))) <= SOFT_DISTANCE
    few = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.v") == F.col("b.v")) & (F.col("a.simhash") < F.col("b.simhash")) & near).select(F.col("a.simhash").alias("u"), F.col("b.simhash").alias("v"))
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - ((1 << 64) if i == 63 else 0)).cast("long") for i in range(64)])
    crowd = dealt.where(F.col("n") > SOFT_CROWD).select("simhash").distinct()
    met = crowd.select("simhash", F.explode(flips).alias("f")).groupBy(F.col("simhash").bitwiseXOR(F.col("f")).alias("value")).agg(F.collect_set("simhash").alias("s")).where(F.size("s") > 1)
    many = met.select(F.explode("s").alias("u"), "s").select("u", F.explode("s").alias("v")).where("u < v")
    return few.unionByName(many).distinct()


def simhash_pairs(hashes: DataFrame) -> DataFrame:
    """(early, late): pairs of documents within SOFT_DISTANCE bits."""
    equal = hashes.alias("a").join(hashes.alias("b"), (F.col("a.simhash") == F.col("b.simhash")) & (F.col("a.doc_id") < F.col("b.doc_id"))).select(F.col("a.doc_id").alias("early"), F.col("b.doc_id").alias("late"))
    one, two = hashes.select(F.col("doc_id").alias("p"), F.col("simhash").alias("u")), hashes.select(F.col("doc_id").alias("q"), F.col("simhash").alias("v"))
    near = simhash_links(hashes).join(one, "u").join(two, "v").select(F.least("p", "q").alias("early"), F.greatest("p", "q").alias("late"))
    return equal.unionByName(near.where("early < late"))


def tfidf(docs: DataFrame, tokens: Column | None = None) -> DataFrame:
    """(doc_id, term, w) with tf * ln(N / df)."""
    tokens = word_tokens(F.col("text")) if tokens is None else tokens
    tf = docs.select("doc_id", F.explode(tokens).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    n = docs.agg(F.count(F.lit(1)).cast("double").alias("n"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return tf.join(df, "term").crossJoin(F.broadcast(n)).select("doc_id", "term", (F.col("tf") * F.log(F.col("n") / F.col("df"))).alias("w"))


def soft_duplicates(docs: DataFrame, tokens: Column | None = None, similarity: float = SOFT_SIMILARITY) -> DataFrame:
    """doc_id of the documents that some earlier one, dropped or not, is close to by SimHash and by cosine.

    Documents of equal tokens stand for each other: only the first of each such class is hashed and paired, and
    the others are close to it, unless their vector is zero. Vectors are made for paired documents only; all
    documents count for the frequencies of terms.
    """
    tokens = word_tokens(F.col("text")) if tokens is None else tokens
    hashes = materialise(simhashes(docs, tokens), "simhashes")
    classes = hashes.groupBy("simhash", "bag").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("members"))
    firsts = materialise(classes.select(F.col("first").alias("doc_id"), "simhash", "bag", "members"), "firsts")
    pairs = materialise(simhash_pairs(firsts.select("doc_id", "simhash")), "pairs")
    wanted = pairs.select(F.col("early").alias("doc_id")).unionByName(pairs.select(F.col("late").alias("doc_id"))).unionByName(firsts.where("members > 1").select("doc_id")).distinct()
    n = docs.agg(F.count(F.lit(1)).cast("double").alias("n"))
    # Tokens of paired documents, and how many of all documents hold each of their terms.
    tf = materialise(docs.join(wanted, "doc_id", "left_semi").select("doc_id", F.explode(tokens).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf")), "tf")
    held = docs.select(F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = held.join(tf.select("term").distinct(), "term", "left_semi")
    w = materialise(tf.join(df, "term").crossJoin(F.broadcast(n)).select("doc_id", "term", (F.col("tf") * F.log(F.col("n") / F.col("df"))).alias("w")), "weights")
    norms = materialise(w.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")), "norms")
    a, b = w.select(F.col("doc_id").alias("early"), "term", F.col("w").alias("wa")), w.select(F.col("doc_id").alias("late"), "term", F.col("w").alias("wb"))
    dots = pairs.join(a, "early").join(b, ["late", "term"]).groupBy("early", "late").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    na, nb = norms.select(F.col("doc_id").alias("early"), F.col("norm").alias("na")), norms.select(F.col("doc_id").alias("late"), F.col("norm").alias("nb"))
    close = dots.join(na, "early").join(nb, "late").where(F.round(F.coalesce(F.try_divide(F.col("dot"), F.col("na") * F.col("nb")), F.lit(0.0)), 6) >= similarity)
    found = materialise(close.select(F.col("late").alias("doc_id")).distinct(), "close")
    # A class's later members are close to its first; the first itself if it is close to an earlier document.
    crowded = firsts.where("members > 1").join(norms.where("norm > 0").select("doc_id"), "doc_id", "left_semi").select("simhash", "bag", F.col("doc_id").alias("first"))
    later = hashes.join(crowded, ["simhash", "bag"]).where("doc_id > first").select("doc_id")
    return found.unionByName(later).distinct()


def soft_dedup(docs: DataFrame, **settings) -> tuple[DataFrame, DataFrame]:
    """(kept, duplicates)."""
    gone = soft_duplicates(docs, **settings)
    return docs.join(gone, "doc_id", "left_anti"), docs.join(gone, "doc_id", "left_semi")


def base_forms(terms: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """(term, base) of the terms whose base form differs and is a word: one of ``vocabulary``, or of the terms."""
    distinct = terms.select("term").distinct()
    changed = distinct.select("term", lemma(F.col("term")).alias("base")).where("base <> term")
    known = (distinct if vocabulary is None else vocabulary.select("term").distinct()).withColumnRenamed("term", "base")
    return changed.join(known, "base", "left_semi").select("term", "base")


def lemmatised(docs: DataFrame, key: str, tokens: str = "tokens", vocabulary: DataFrame | None = None) -> DataFrame:
    """``docs`` with tokens replaced by their base forms, in order."""
    flat = docs.select(key, F.posexplode(tokens).alias("at", "term"))
    found = flat.join(base_forms(flat, vocabulary), "term", "left").select(key, "at", F.coalesce("base", "term").alias("term"))
    again = found.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "term"))), lambda x: x["term"]).alias("_base"))
    return docs.join(again, key, "left").withColumn(tokens, F.coalesce("_base", F.array().cast("array<string>"))).drop("_base").select(*docs.columns)


def clean_pages(pages: DataFrame, lemmas: bool = False, soft: bool = False) -> DataFrame:
    """(page_id, url, title, tokens): exact dedup, then the URL filter, then text, tokens and stop words; with
    ``lemmas`` base forms, which must themselves be words of the pages; with ``soft`` no near copies.

    The filter comes after deduplication, as a copy's first page may be one that the filter drops.
    """
    first = exact_dedup(pages, "html", "page_id").where(~encyclopedia_noise(F.coalesce("url", F.lit(""))))
    tokens = pipeline_tokens(main_text(F.col("html")))
    out = first.select("page_id", "url", title(F.col("html")).alias("title"), tokens.alias("tokens"))
    if lemmas:
        out = lemmatised(materialise(out, "clean"), "page_id")
    if soft:
        keyed = out.withColumnRenamed("page_id", "doc_id")
        out = soft_dedup(keyed, tokens=F.col("tokens"))[0].withColumnRenamed("doc_id", "page_id")
    return out


def rake(docs: DataFrame, k: int | None = None) -> DataFrame:
    """(doc_id, phrase, score): runs of words between stop words and marks, scored by degree over frequency.

    A phrase scores the sum, over its words, of (words in the phrases that hold it) / (phrases that hold it).
    """
    marked = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), rf"[ \t\r\n\f]+", " ")
    words = F.filter(F.split(F.regexp_replace(marked, r"([.,;:!?()|])", " . "), " "), lambda w: w != "")
    # Stop words and marks become one mark; the phrases are what stands between.
    joined = F.array_join(F.transform(words, lambda w: F.when(w.isin([*STOP_WORDS, "."]), "\x01").otherwise(w)), " ")
    phrases = F.filter(F.transform(F.split(joined, "\x01"), lambda p: F.trim(p)), lambda p: p != "")
    fields = StructType([docs.schema["doc_id"], *StructType.fromDDL("phrase string, score double").fields])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found, scores = [], [], []
            for doc, own in zip(batch.column("doc_id").to_pylist(), batch.column("phrases").to_pylist()):
                split = [p.split(" ") for p in own or []]
                degree: dict[str, int] = {}
                held: dict[str, int] = {}
                for words in split:
                    for w in words:
                        degree[w] = degree.get(w, 0) + len(words)
                        held[w] = held.get(w, 0) + 1
                for p, words in {p: w for p, w in zip(own or [], split)}.items():
                    ids.append(doc)
                    found.append(p)
                    scores.append(sum(degree[w] / held[w] for w in words))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("doc_id").type), pa.array(found, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "phrase", "score"])

    # All of it lies within a document: one narrow stage, and a shuffle for the rank alone.
    scored = _in_arrow(docs.select("doc_id", phrases.alias("phrases")), score, fields).withColumn("score", F.round("score", 9))
    if k is None:
        return scored
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "phrase")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


#: Places of the demonstration gazetteer; their names are words of the test corpus.
GAZETTEER = [
    ("rean", 48.52, 9.05, "DE", "P"),
    ("onsh", 52.52, 13.40, "DE", "P"),
    ("ingti", 48.14, 11.58, "DE", "P"),
    ("erth", 50.94, 6.96, "DE", "P"),
    ("anst", 53.55, 10.0, "DE", "P"),
    ("enhe", 48.85, 2.35, "FR", "P"),
    ("ndor", 49.01, 8.4, "DE", "H"),
    ("atin", 51.34, 12.37, "DE", "P"),
]


def gazetteer(spark, rows=GAZETTEER, country: str = "DE", feature: str = "P") -> DataFrame:
    """Populated places of a country: (name, latitude, longitude)."""
    df = spark.createDataFrame(rows, "name string, latitude double, longitude double, country_code string, feature_class string")
    return df.where((F.col("country_code") == country) & (F.col("feature_class") == feature)).select("name", "latitude", "longitude")


def place_matches(docs: DataFrame, places: DataFrame, limit: int = 100_000) -> DataFrame:
    """(doc_id, name, latitude, longitude) of the names that are words of a text.

    Names are matched to words by an equi-join, not as substrings of every text, so the work follows the
    text. The gazetteer is broadcast up to ``limit`` rows and joined by shuffle beyond.
    """
    words = docs.select("doc_id", F.explode(F.array_distinct(word_tokens(F.col("text"), stop=False))).alias("name"))
    named = places.withColumn("name", F.lower("name"))
    small = named.limit(limit + 1).count() <= limit
    return words.join(F.broadcast(named) if small else named, "name").select("doc_id", "name", "latitude", "longitude")


def place_substrings(docs: DataFrame, names: list[tuple[str, float, float]]) -> DataFrame:
    """The same for names as substrings; ``names`` is a short list from the caller, put into the scan as a literal."""
    items = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).alias("latitude"), F.lit(o).alias("longitude")) for n, a, o in names])
    found = F.filter(items, lambda x: F.contains(F.coalesce(F.col("text"), F.lit("")), x["name"]))
    return docs.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.*")


def mean_distance(docs: DataFrame, matches: DataFrame, exact: bool = False) -> DataFrame:
    """(doc_id, avg_km), null for documents without a place. ``exact`` takes the ellipsoid, else the sphere."""

    if exact:
        # Places are few against their mentions: each is measured once.
        @F.pandas_udf("double")
        def ellipsoid(lat: pd.Series, lon: pd.Series) -> pd.Series:
            return pd.Series([geodesic_km(a, o) for a, o in zip(lat, lon)], dtype="float64")

        places = materialise(matches.select("latitude", "longitude").distinct().withColumn("km", ellipsoid("latitude", "longitude")), "places")
        measured = matches.join(places, ["latitude", "longitude"])
    else:
        measured = matches.withColumn("km", haversine(F.col("latitude"), F.col("longitude")))
    means = measured.groupBy("doc_id").agg(F.round(F.avg("km"), 3).alias("avg_km"))
    return docs.select("doc_id").join(means, "doc_id", "left")


class Topics:
    """Latent Dirichlet allocation over tf-idf of tokens; fitted once on the union of all queries' candidates."""

    def __init__(self, k: int = 5, rounds: int = 10, vocabulary: int = 10_000, seed: int = 42):
        self.k, self.rounds, self.vocabulary, self.seed = k, rounds, vocabulary, seed

    def fit(self, docs: DataFrame, tokens: Column | None = None) -> Topics:
        tokens = word_tokens(F.col("text")) if tokens is None else tokens
        self.tokens = tokens
        split = docs.withColumn("_tokens", tokens)
        self.counter = CountVectorizer(inputCol="_tokens", outputCol="_tf", vocabSize=self.vocabulary).fit(split)
        counted = self.counter.transform(split)
        self.idf = IDF(inputCol="_tf", outputCol="features").fit(counted)
        self.model = LDA(k=self.k, maxIter=self.rounds, seed=self.seed, featuresCol="features").fit(self.idf.transform(counted))
        return self

    def transform(self, docs: DataFrame) -> DataFrame:
        """``docs`` with topic_0 ... of each document."""
        out = self.model.transform(self.idf.transform(self.counter.transform(docs.withColumn("_tokens", self.tokens))))
        shares = vector_to_array("topicDistribution")
        return out.select(*docs.columns, *[F.round(shares[i], 6).alias(f"topic_{i}") for i in range(self.k)])

    def terms(self, n: int = 10) -> DataFrame:
        """(topic, position, term)."""
        words = self.counter.vocabulary
        rows = [(r.topic, i, words[t]) for r in self.model.describeTopics(n).collect() for i, t in enumerate(r.termIndices)]
        return self.model.describeTopics(1).sparkSession.createDataFrame(rows, "topic int, position int, term string")


def diversified(weighted: DataFrame, topics: list[str], alpha: float = 0.3, by: str = "query_id", score: str = "score") -> DataFrame:
    """With diversity_score, the sum over topics of share / (the topic's mass in the result + 1), and combined_score."""
    whole = Window.partitionBy(by)
    diversity = sum((F.col(t) / (F.sum(t).over(whole) + 1) for t in topics), F.lit(0.0))
    out = weighted.withColumn("diversity_score", F.round(diversity, 6))
    return out.withColumn("combined_score", F.round((1 - alpha) * F.col(score) + alpha * F.col("diversity_score"), 7))


def topic_arrays(weighted: DataFrame, topics: list[str], n: int = 5, by: str = "query_id") -> DataFrame:
    """(query_id, topic, rank, doc_id): per topic in turn, its n best documents that no earlier topic took."""
    left, out = weighted, None
    for i, t in enumerate(topics):
        order = Window.partitionBy(by).orderBy(F.desc(t), "doc_id")
        picked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select(by, F.lit(i).alias("topic"), F.col("rank").cast("long").alias("rank"), "doc_id")
        left = left.join(picked.select(by, "doc_id"), [by, "doc_id"], "left_anti")
        out = picked if out is None else out.unionByName(picked)
    return out


#: The colours in which a client shows the five topics.
TOPIC_COLOURS = ["#f8d7da", "#d4edda", "#d1ecf1", "#fff3cd", "#e8b3f5"]


def completed_by_topics(combined: DataFrame, topics: int, k: int, by: str = "query_id") -> DataFrame:
    """(query_id, rank, doc_id, topic): the best k by combined_score, with topic -1, and after them one more for
    each topic in turn, the best of the rest by combined_score. Topics find nothing where k takes all."""
    order = Window.partitionBy(by).orderBy(F.desc("combined_score"), "doc_id")
    ranked = combined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + topics)
    return ranked.select(by, F.col("rank").cast("long").alias("rank"), "doc_id", F.when(F.col("rank") > k, F.col("rank") - k - 1).otherwise(-1).cast("int").alias("topic"))


def topic_links(arrays: DataFrame, by: str = "query_id") -> DataFrame:
    """(query_id, payload): topics with their pages and colours as JSON, of rows (query_id, topic, rank, title, url)."""
    pages = F.transform(F.sort_array(F.collect_list(F.struct("rank", "title", "url"))), lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url")))
    each = arrays.groupBy(by, "topic").agg(pages.alias("urls"))
    colour = F.element_at(F.array(*map(F.lit, TOPIC_COLOURS)), F.col("topic") % len(TOPIC_COLOURS) + 1)
    named = each.select(by, "topic", F.struct(F.concat(F.lit("Topic "), (F.col("topic") + 1).cast("string")).alias("name"), "urls", colour.alias("color")).alias("t"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("topic", "t"))), lambda x: x["t"])
    return named.groupBy(by).agg(F.to_json(ordered).alias("payload"))


def word_neighbours(docs: DataFrame, words: list[str], n: int = 5, size: int = 32) -> DataFrame:
    """(word, neighbour, similarity) by word vectors trained on the corpus."""
    model = Word2Vec(vectorSize=size, minCount=5, seed=42, inputCol="tokens", outputCol="v").fit(docs.select(word_tokens(F.col("text")).alias("tokens")))
    known = {r.word for r in model.getVectors().where(F.col("word").isin(words)).select("word").collect()}
    rows = [(w, x, float(s)) for w in words if w in known for x, s in model.findSynonymsArray(w, n)]
    return docs.sparkSession.createDataFrame(rows, "word string, neighbour string, similarity double")
