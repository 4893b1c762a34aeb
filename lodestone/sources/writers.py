"""Writers of runs, token blocks, keyword lists and payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values are written as they are, with the spaces at their ends.
WHOLE = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def run_rows(results: DataFrame) -> DataFrame:
    """(query_number, rank, url, score) in order; rows whose score is no number are left out."""
    return results.where(F.expr("try_cast(score AS double)").isNotNull()).select("query_number", "rank", "url", F.expr("try_cast(score AS double)").alias("score")).orderBy("query_number", "rank")


def write_run(results: DataFrame, path: str) -> None:
    """A run: tab-separated, no header, in order across the files' names. A batch's run is of queries times k rows."""
    run_rows(results).write.mode("overwrite").options(sep="\t", **WHOLE).csv(path)


def write_token_blocks(rows: DataFrame, path: str) -> None:
    """Blocks of title, URL and tokens, with a blank line after each."""
    text = F.concat(F.lit("Title: "), "title", F.lit("\nURL: "), "url", F.lit("\nTokens: "), F.array_join("tokens", " "), F.lit("\n"))
    rows.select(text.alias("value")).write.mode("overwrite").text(path)


def write_ranked_results(rows: DataFrame, path: str) -> None:
    """Pipe-separated (index, title, url, tokens as a list literal, score)."""
    literal = F.concat(F.lit("["), F.array_join(F.transform("tokens", lambda t: F.concat(F.lit("'"), F.replace(t, F.lit("'"), F.lit("")), F.lit("'"))), ", "), F.lit("]"))
    rows.select("index", "title", "url", literal.alias("content"), "score").write.mode("overwrite").options(sep="|", **WHOLE).csv(path)


def write_keyword_counts(counts: DataFrame, path: str) -> None:
    """Lines ``word: count`` by falling count."""
    counts.orderBy(F.desc("n"), "term").select(F.format_string("%s: %d", "term", "n").alias("value")).write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").options(header=True, **WHOLE).csv(path)


def write_readable(results: DataFrame, path: str, k: int = 10) -> None:
    """The best k results as text for people."""
    line = F.format_string("%d. %s (%s) %.4f", "rank", "title", "url", "score")
    results.where(F.col("rank") <= k).orderBy("rank").select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def payload(*columns: str) -> Column:
    """A JSON object of columns, as a service would answer."""
    return F.to_json(F.struct(*columns))
