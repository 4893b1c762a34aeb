"""Frontier and document store: inserts, replacements, upserts, unsent rows, next batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def insert_or_ignore(existing: DataFrame, new: DataFrame, key: str = "url", order: str | None = None) -> DataFrame:
    """``existing`` and those of ``new`` whose key it lacks; among equal new keys the first by ``order`` stays."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order or key))).where("_n = 1").drop("_n")
    return existing.unionByName(first.join(existing.select(key), key, "left_anti").select(*existing.columns))


def replace_latest(existing: DataFrame, new: DataFrame, key: str = "url", order: str = "ts") -> DataFrame:
    """All rows, the latest of each key."""
    latest = Window.partitionBy(key).orderBy(F.desc(order))
    return existing.unionByName(new.select(*existing.columns)).withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")


def upsert(existing: DataFrame, changes: DataFrame, key: str = "url") -> DataFrame:
    """``changes``, and those of ``existing`` whose key is not among them."""
    return existing.join(changes.select(key), key, "left_anti").select(*existing.columns).unionByName(changes.select(*existing.columns))


def unsent(docs: DataFrame, sent: DataFrame, key: str = "url") -> DataFrame:
    return docs.join(sent.select(key), key, "left_anti")


def next_batch(frontier: DataFrame, n: int, excluded: list[str] = ()) -> DataFrame:
    """The first n URLs that are neither crawled nor faulty and match none of the LIKE patterns."""
    left = frontier.where(~F.col("crawled") & ~F.col("error"))
    for pattern in excluded:
        left = left.where(~F.col("url").ilike(pattern))
    return left.orderBy("url").limit(n)


def new_links(links: DataFrame, frontier: DataFrame, documents: DataFrame) -> DataFrame:
    """Distinct links that are in neither table."""
    known = frontier.select("url").unionByName(documents.select("url")).distinct()
    return links.select("url").distinct().join(known, "url", "left_anti")


def mark(frontier: DataFrame, done: DataFrame, column: str = "crawled") -> DataFrame:
    """``frontier`` with a flag set for the URLs in ``done``."""
    hit = done.select("url", F.lit(True).alias("_hit")).distinct()
    return frontier.join(hit, "url", "left").withColumn(column, F.coalesce("_hit", column)).drop("_hit").select(*frontier.columns)
