"""Micro-batch crawl ingest, sync and deduplication with Structured Streaming."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from ..functions.web import any_keyword, links, main_text, title, without_fragment

PAGES = "page_id long, url string, html string"


def page_stream(spark: SparkSession, folder: str, pattern: str = "*", files: int = 5) -> DataFrame:
    """Pages as they arrive in a folder, ``files`` at a time: the crawl's batches."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files).option("pathGlobFilter", pattern).parquet(folder)


def documents_of(pages: DataFrame, keywords: list[str] | None = None) -> DataFrame:
    """(page_id, url, title, content) of fetched pages; with keywords, of the relevant ones."""
    out = pages.where("url IS NOT NULL").select("page_id", without_fragment(F.col("url")).alias("url"), title(F.col("html")).alias("title"), main_text(F.col("html")).alias("content"))
    return out.where(any_keyword(F.col("content"), keywords)) if keywords else out


def distinct_urls(stream: DataFrame, watermark: str | None = None, time: str = "ts") -> DataFrame:
    """First row of each URL across batches. With a watermark the state is bounded."""
    if watermark:
        return stream.withWatermark(time, watermark).dropDuplicatesWithinWatermark(["url"])
    return stream.dropDuplicates(["url"])


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what is there and stop; a later call goes on from the checkpoint. Returns the table written."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def _batches(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """All batches written to a folder, with their number ``batch``."""
    return spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(folder)


def _begin(spark: SparkSession, folder: str, schema: StructType) -> None:
    """An empty first batch, so that the folder can be read."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/batch=-1")


def sync(stream: DataFrame, store: str, checkpoint: str, order: str = "page_id") -> DataFrame:
    """Upsert the documents of a stream into a store by URL: a known URL takes the new row.

    A batch is written to a folder of its own, so that a batch that is tried again overwrites what it wrote
    before and nothing is sent twice. The store's row of a URL is the last by ``order``, however files were dealt to
    batches, and of equal ones that of the last batch.
    """
    spark, schema = stream.sparkSession, stream.schema

    def send(batch: DataFrame, number: int) -> None:
        # As a struct, a row counts even if its place in the order is unknown.
        last = batch.groupBy("url").agg(F.max_by(F.struct(*batch.columns), F.struct(order)).alias("r")).select("r.*")
        last.write.mode("overwrite").parquet(f"{store}/batch={number}")

    _begin(spark, store, schema)
    stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return synced(spark, store, schema, order)


def synced(spark: SparkSession, store: str, schema: StructType, order: str = "page_id") -> DataFrame:
    """The rows of a store, one a URL: the last by ``order``."""
    names = schema.fieldNames()
    return _batches(spark, store, schema).groupBy("url").agg(F.max_by(F.struct(*names), F.struct(order, "batch")).alias("r")).select("r.*")


FOUND = StructType([StructField("url", StringType()), StructField("crawled", BooleanType()), StructField("error", BooleanType())])
DOCUMENT = StructType([StructField("page_id", LongType()), *(StructField(n, StringType()) for n in ("url", "title", "content"))])


def crawl(pages: DataFrame, folder: str, checkpoint: str, keywords: list[str] | None = None, trigger: dict | None = None):
    """Take in fetched pages batch by batch: store the relevant ones as documents, add their links to the frontier,
    and mark all of the batch as crawled, those without content as faulty, so that none is taken twice.

    Documents and the frontier's changes are written to a folder for each batch, which a second try overwrites;
    ``frontier`` and ``crawled_documents`` add them up. The call ends once all that is there is done; with
    a ``trigger`` such as ``{"processingTime": "30 minutes"}`` it returns the running query.
    """
    spark = pages.sparkSession

    def take(batch: DataFrame, number: int) -> None:
        batch.persist()
        docs = documents_of(batch.where("html IS NOT NULL"), keywords)
        docs.write.mode("overwrite").parquet(f"{folder}/documents/batch={number}")
        own = batch.where("url IS NOT NULL").select(without_fragment(F.col("url")).alias("url"), F.lit(True).alias("crawled"), F.col("html").isNull().alias("error"))
        relevant = batch.join(docs.select("page_id"), "page_id", "left_semi")
        linked = relevant.select(F.explode(links(F.col("html"), F.col("url"))).alias("url")).distinct().select("url", F.lit(False).alias("crawled"), F.lit(False).alias("error"))
        own.unionByName(linked).write.mode("overwrite").parquet(f"{folder}/frontier/batch={number}")
        batch.unpersist()

    _begin(spark, f"{folder}/documents", DOCUMENT)
    _begin(spark, f"{folder}/frontier", FOUND)
    writer = pages.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    query = writer.start()
    if trigger:
        return query
    query.awaitTermination()
    return None


def frontier(spark: SparkSession, folder: str) -> DataFrame:
    """(url, crawled, error) of all URLs that were crawled or linked to; what is left to crawl has neither flag."""
    return _batches(spark, f"{folder}/frontier", FOUND).groupBy("url").agg(F.max("crawled").alias("crawled"), F.max("error").alias("error"))


def crawled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The document of each URL with the least page_id, however files were dealt to batches; of equal ones the first batch's."""
    first = F.min_by(F.struct(*DOCUMENT.fieldNames()), F.struct(F.isnull("page_id"), "page_id", "batch"))
    return _batches(spark, f"{folder}/documents", DOCUMENT).groupBy("url").agg(first.alias("r")).select("r.*")


def alternate(work: Callable[[], object], send: Callable[[], object], seconds: float, rounds: int | None = None, pause: float = 1.0) -> int:
    """Work for ``seconds``, call after call, then send, and so on for ``rounds`` (None: for ever). Returns the calls of ``work``."""
    calls, done = 0, 0
    while rounds is None or done < rounds:
        until = time.monotonic() + seconds
        while True:
            work()
            calls += 1
            if time.monotonic() + pause >= until:
                break
            time.sleep(pause)
        send()
        done += 1
    return calls


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events per window and type; rows that come later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
