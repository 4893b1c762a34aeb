"""Readers of the file formats that search corpora and runs come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, names: list[str] = TABLES) -> None:
    """All tables as temporary views, for SQL."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)


def projected(df: DataFrame, columns: list[str], limit: int | None = None, order: str | None = None) -> DataFrame:
    """Columns of a table, and the first ``limit`` rows by ``order``."""
    out = df.select(*columns)
    if order:
        out = out.orderBy(order)
    return out if limit is None else out.limit(limit)


def json_rows(spark: SparkSession, path: str, schema: str = "title string, content string, url string") -> DataFrame:
    """A JSON array of rows; broken files give rows of nulls, which are left out."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path).dropna("all")


def jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def by_ids(df: DataFrame, ids: list, key: str = "doc_id") -> DataFrame:
    """Point lookups; the list comes from the caller and is pushed to the scan."""
    return df.where(F.col(key).isin(list(ids)))


def token_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(title, url, tokens) of blocks ``Title: ...``, ``URL: ...``, ``Tokens: ...`` that a blank line ends."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).where(F.trim("value") != "")
    field = lambda name: F.regexp_extract("value", rf"(?m)^{name}: ?(.*)$", 1)
    # What follows the tokens' line belongs to them.
    tokens = F.regexp_replace(F.regexp_extract("value", r"(?s)(?:^|\n)Tokens: ?(.*)$", 1), r"[ \t\r\n\f]+", " ")
    return blocks.select(field("Title").alias("title"), field("URL").alias("url"), F.filter(F.split(F.trim(tokens), " "), lambda t: t != "").alias("tokens"))


def block_column(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One of tokens, title or url of the blocks."""
    return token_blocks(spark, path).select(column.lower())


def batch_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_number, query) of tab-separated lines; split at the first tab, lines without one are skipped."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).select(parts.alias("p")).where(F.size("p") == 2).select(F.trim(F.col("p")[0]).alias("query_number"), F.trim(F.col("p")[1]).alias("query"))


def ranked_results(spark: SparkSession, path: str) -> DataFrame:
    """(index, title, url, tokens, score) of pipe-separated rows; rows that do not fit are skipped."""
    raw = spark.read.schema("index int, title string, url string, content string, score double").option("sep", "|").option("mode", "DROPMALFORMED").csv(path)
    return raw.where("index IS NOT NULL AND score IS NOT NULL").select("index", "title", "url", F.regexp_extract_all("content", F.lit(r"'([^']*)'"), F.lit(1)).alias("tokens"), "score")


def ranking_features(spark: SparkSession, folder: str) -> DataFrame:
    """The feature columns of a ranking data set, as numbers, under the names in the file's header."""
    path = f"{folder}/X.csv"
    names = spark.read.option("header", True).csv(path).columns
    return spark.read.option("header", True).schema(", ".join(f"`{n}` double" for n in names)).csv(path)


def ranking_csv(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(labels, groups) of a ranking data set; CSV with headers."""
    y = spark.read.option("header", True).schema("target1 int, target2 double").csv(f"{folder}/y.csv")
    groups = spark.read.option("header", True).schema("`group` int").csv(f"{folder}/groups.csv")
    return y, groups


def svm_rank(spark: SparkSession, path: str, columns: int = 64) -> DataFrame:
    """(label, qid, f1 ...) of lines ``label qid:q 1:v 2:v ...``, up to ``columns`` features."""
    parts = F.split(F.trim("value"), " +")
    found = F.map_from_entries(F.transform(F.filter(F.slice(parts, 3, 10_000), lambda x: x.contains(":")), lambda x: F.struct(F.split(x, ":")[0].cast("int").alias("k"), F.split(x, ":")[1].cast("double").alias("v"))))
    rows = spark.read.text(path).where(F.trim("value") != "").select(parts[0].cast("int").alias("label"), F.split(parts[1], ":")[1].cast("long").alias("qid"), found.alias("m"))
    return rows.select("label", "qid", *[F.try_element_at("m", F.lit(i)).alias(f"f{i}") for i in range(1, columns + 1)])


def filled_columns(rows: DataFrame, prefix: str = "f") -> DataFrame:
    """``rows`` without the feature columns that hold no number in any row."""
    names = [c for c in rows.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()]
    held = rows.agg(*[F.count(F.when(~F.isnan(c), F.col(c))).alias(c) for c in names]).first() if names else {}
    return rows.drop(*[c for c in names if not held[c]])


def query_groups(rows: DataFrame, by: str = "qid") -> DataFrame:
    """(qid, n): rows of each query, in order."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(by)


def gazetteer_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").schema("name string, latitude double, longitude double, country_code string, feature_class string").csv(path)


def merged_subcorpora(parts: dict[str, DataFrame], key: str = "_id") -> DataFrame:
    """The parts in one table, each key with its part's name in front."""
    out = None
    for name, df in parts.items():
        named = df.withColumn(key, F.concat_ws("_", F.lit(name), F.col(key)))
        out = named if out is None else out.unionByName(named)
    return out


def merged_judgements(parts: dict[str, DataFrame], keys: tuple[str, ...] = ("query-id", "corpus-id")) -> DataFrame:
    """The parts' judgements in one table, with their part's name in front of both the query's and the document's key."""
    out = None
    for name, df in parts.items():
        named = df.withColumns({k: F.concat_ws("_", F.lit(name), F.col(f"`{k}`")) for k in keys})
        out = named if out is None else out.unionByName(named)
    return out


def judged_rows(scored: DataFrame, queries: DataFrame, judged: DataFrame, docs: DataFrame, top: int | None = None) -> DataFrame:
    """First-stage scores with their query, judgement and document, where all are known."""
    kept = scored.join(judged, ["query_id", "doc_id"]).join(queries, "query_id").join(docs, "doc_id")
    return kept if top is None else kept.orderBy("query_id", "doc_id").limit(top)


def size_capped(df: DataFrame, column: Column, limit: int = 10 * 1024 * 1024) -> DataFrame:
    return df.where(F.octet_length(column) <= limit)
