"""Quality rules whose limits follow the data.

Each document gets counts (words, symbols, repeated lines, repeated three-word windows, capitals) and, from
them, five smoothed rates. Per language and source, the rates go into quantile sketches: histograms over
logarithmic bins, 128 to a power of two, so that a quantile is known to within a hundredth of itself and a
sketch has a few thousand bins at most, whatever the rows. Sketches of any two sets of rows merge by adding
their counts; partial aggregation builds them, and those of a language, and of all documents, are merged from
those of its sources. A rate beyond its group's fences,

    upper quartile + SPREAD * (upper - lower quartile)    and, for the rates in ``LOWER``,
    lower quartile - SPREAD * (upper - lower quartile),

both counted in bins, that is in powers, rejects a document. Nothing but the quartiles decides where a fence
stands. A group's fences are drawn towards its language's, and these towards all documents', as if PRIOR rows
of them were in the group: alike for any number of rows.

Bins are whole numbers and add up exactly, so results are repeatable in any order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, encoded, materialise, rows_again, table, whole_rows

SYMBOLS = b"#*$%&|<>"
#: Each rate is (count + 1) / (whole + SMOOTH), in millionths.
RATES = {"symbol_rate": ("n_symbols", "n_words"), "line_rate": ("n_dup_lines", "n_lines"), "repeat_rate": ("n_repeat_words", "n_words"), "capital_rate": ("n_capitals", "n_letters"), "word_length": ("word_chars", "n_words")}
#: Rates of which too little is a fault as well.
LOWER = ("capital_rate", "word_length")
SMOOTH, UNIT = 8, 1_000_000
#: Bins to a power of two, as a power of two.
BIN_BITS = 7
#: Fences stand as many quartile distances beyond the quartiles as those for far outliers do.
SPREAD = 3
PRIOR = 100
METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_letters long, n_capitals long"
NAMES = [x.split()[0] for x in METRICS.split(", ")]
NOT_SYMBOLS = bytes(set(range(256)) - set(SYMBOLS))
NOT_CAPITALS = bytes(set(range(256)) - set(range(65, 91)))
NOT_SMALL = bytes(set(range(256)) - set(range(97, 123)))
CONTINUED = bytes(range(0x80, 0xC0))


def measure(data: bytes) -> tuple[int, ...]:
    """Counts of a whole text in UTF-8, in the order of ``METRICS``."""
    words = data.split()
    joined = b"".join(words)
    chars = len(joined) - (0 if joined.isascii() else len(joined) - len(joined.translate(None, CONTINUED)))
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeated = 0
    if len(words) > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            first: dict[tuple, int] = {}
            twice = {w for i, w in enumerate(windows) if first.setdefault(w, i) != i}
            end = 0
            for i, w in enumerate(windows):
                if w in twice:
                    repeated += i + 3 - max(i, end)
                    end = i + 3
    capitals = len(joined.translate(None, NOT_CAPITALS))
    return (len(words), chars, len(joined.translate(None, NOT_SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines), capitals + len(joined.translate(None, NOT_SMALL)), capitals)


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs``, of columns doc_id, lang, source and ``text`` or of one struct ``row``, with the counts of its texts."""
    kept = [c for c in docs.columns if c != text]
    schema = T.StructType([*(docs.schema[c] for c in kept), *T._parse_datatype_string(METRICS).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [*zip(*map(measure, encoded(batch, text)))] or [[]] * len(NAMES)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(x, pa.int64()) for x in counts)], [*kept, *NAMES])

    return arrow_map(docs, run, schema)


def bin_of(count: str, whole: str) -> Column:
    """The bin of a rate: linear within each power of two, and ascending."""
    x = F.expr(f"({count} + 1) * {UNIT} DIV ({whole} + {SMOOTH})")
    shift = F.greatest(F.length(F.bin(x)) - (BIN_BITS + 1), F.lit(0))
    return shift.cast("long") * F.lit(1 << BIN_BITS) + F.call_function("shiftright", x, shift)


def bins() -> dict[str, Column]:
    return {name: bin_of(*of) for name, of in RATES.items()}


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, rate, bin, n): a sketch of each rate for each language and source."""
    entries = F.explode(F.array(*[F.struct(F.lit(name).alias("rate"), b.alias("bin")) for name, b in bins().items()]))
    long = counted.select("lang", "source", entries.alias("x")).select("lang", "source", "x.rate", "x.bin")
    return long.groupBy("lang", "source", "rate", "bin").agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Sketches added up over all groups that agree in ``by``."""
    return sketch.groupBy(*by, "rate", "bin").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, by: list[str], prefix: str) -> DataFrame:
    """(by, rate, <prefix>_rows, <prefix>_low, <prefix>_high), in bins. A sketch's bins are few, so a list holds them."""
    entries = F.sort_array(F.collect_list(F.struct("bin", "n")))
    held = sketch.groupBy(*by, "rate").agg(F.sum("n").alias("rows"), entries.alias("bins"))

    def quartile(percent: int) -> Column:
        # The first bin at which the running count reaches the share.
        need = F.ceil(F.col("rows") * F.lit(percent) / F.lit(100))
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).cast("long").alias("bin"))
        step = lambda a, x: F.when(a["seen"] >= need, a).otherwise(F.struct((a["seen"] + x["n"]).alias("seen"), x["bin"].alias("bin")))
        return F.aggregate("bins", start, step)["bin"]

    found = held.select(*by, "rate", "rows", quartile(25).alias("q1"), quartile(75).alias("q3"))
    return found.select(*by, "rate", F.col("rows").alias(f"{prefix}_rows"), (F.col("q1") - SPREAD * (F.col("q3") - F.col("q1"))).alias(f"{prefix}_low"), (F.col("q3") + SPREAD * (F.col("q3") - F.col("q1"))).alias(f"{prefix}_high"))


def limits(counted: DataFrame) -> DataFrame:
    """(lang, source, low_<rate>..., high_<rate>...): one row per language and source, few against the documents.

    Null languages and sources are groups of their own.
    """
    sketch = materialise(sketches(counted), "sketch", narrow=True)
    own = fences(sketch, ["lang", "source"], "own").alias("o")
    lang = fences(merged(sketch, ["lang"]), ["lang"], "lang").alias("l")
    every = fences(merged(sketch, []), [], "every").alias("e")
    joined = own.join(lang, F.col("o.rate").eqNullSafe(F.col("l.rate")) & F.col("o.lang").eqNullSafe(F.col("l.lang"))).join(every, F.col("o.rate") == F.col("e.rate"))

    def drawn(side: str) -> Column:
        prior = F.lit(float(PRIOR))
        wider = (F.col("lang_rows") * F.col(f"lang_{side}") + prior * F.col(f"every_{side}")) / (F.col("lang_rows") + prior)
        return (F.col("own_rows") * F.col(f"own_{side}") + prior * wider) / (F.col("own_rows") + prior)

    both = joined.select("o.lang", "o.source", "o.rate", drawn("low").alias("low"), drawn("high").alias("high"))
    return both.groupBy("lang", "source").agg(*[F.max(F.when(F.col("rate") == name, F.col(side))).alias(f"{side}_{name}") for name in RATES for side in ("low", "high")])


def judge(counted: DataFrame, limit: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``counted`` with base_failed and kept. ``limit`` is a materialised table, so the planner knows its size:
    it is broadcast below Spark's threshold and sort-merge joined beyond, where AQE splits a hot source."""
    base = (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    fence = limit.withColumnsRenamed({"lang": "limit_lang", "source": "limit_source"})
    joined = counted.join(fence, F.col(lang).eqNullSafe(F.col("limit_lang")) & F.col(source).eqNullSafe(F.col("limit_source")), "left")
    beyond = F.lit(False)
    for name, b in bins().items():
        beyond = beyond | (b > F.col(f"high_{name}"))
        if name in LOWER:
            beyond = beyond | (b < F.col(f"low_{name}"))
    out = joined.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & ~F.coalesce(beyond, F.lit(False)))
    return out.drop(*fence.columns)


def quality_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts and verdict per document: doc_id, lang, source, the counts, base_failed, kept.

    A null or empty text has no words and fails. Null doc_ids, languages and sources are ordinary values;
    repeated rows each get a row and count each time. An empty table gives an empty result. Other columns are
    not read. Texts are read once.
    """
    counted = materialise(with_counts(docs.select("doc_id", "lang", "source", text), text), "counts")
    return judge(counted, materialise(limits(counted), "limits", narrow=True))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with its own columns, whatever their names; a null text goes.

    The counts are made twice, for the limits and for the verdict, rather than stored beside whole texts.
    """
    limit = materialise(limits(with_counts(docs.select("doc_id", "lang", "source", "text"))), "limits", narrow=True)
    return rows_again(judge(with_counts(whole_rows(docs)), limit, "row.lang", "row.source").where("kept"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive quality rules over all ``documents``."""
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _fences_sql(name: str, keys: str) -> str:
    """Fences of merged sketches, by running counts over the bins."""
    part = f"{keys}, rate" if keys else "rate"
    quartile = lambda q: f"min(bin) FILTER (WHERE seen >= ceil(total * {q} / 100.0))"
    return f"""{name}_m AS (SELECT {part}, bin, sum(n) AS n FROM sketch GROUP BY {part}, bin),
{name}_c AS (SELECT *, sum(n) OVER (PARTITION BY {part} ORDER BY bin) AS seen, sum(n) OVER (PARTITION BY {part}) AS total FROM {name}_m),
{name}_q AS (SELECT {part}, max(total)::BIGINT AS total_rows, {quartile(25)} AS q1, {quartile(75)} AS q3 FROM {name}_c GROUP BY {part}),
{name} AS (SELECT {part}, total_rows, q1 - 3 * (q3 - q1) AS low, q3 + 3 * (q3 - q1) AS high FROM {name}_q)"""


def counts_sql(source: str = "documents") -> str:
    """The counts in DuckDB SQL, as CTEs ending in ``counted``."""
    word = r"[^\x20\x09-\x0D]+"
    return rf"""docs AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM {source}),
words AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT rid, regexp_extract_all(text, '{word}') AS ws FROM docs)),
wins AS (SELECT *, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w, w2, w3) > 1 AND w3 IS NOT NULL AS t FROM wins),
reps AS (SELECT rid, count(*) AS n_repeat_words FROM (SELECT DISTINCT rid, i + unnest([0, 1, 2]) AS i FROM twice WHERE t) GROUP BY rid),
wordsum AS (SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars FROM words GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs),
linesum AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '{word}') GROUP BY rid),
counted AS (SELECT d.*, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals
  FROM docs d LEFT JOIN wordsum USING (rid) LEFT JOIN linesum USING (rid) LEFT JOIN reps USING (rid))"""


def verdict_sql(source: str = "documents") -> str:
    """CTEs ending in ``judged``: the counts with base_failed and kept, by row."""
    pairs = {"symbol_rate": ("n_symbols", "n_words"), "line_rate": ("n_dup_lines", "n_lines"), "repeat_rate": ("n_repeat_words", "n_words"), "capital_rate": ("n_capitals", "n_letters"), "word_length": ("word_chars", "n_words")}
    values = " UNION ALL ".join(f"SELECT rid, lang, source, '{k}' AS rate, ({a} + 1) * 1000000 // ({b} + 8) AS x FROM counted" for k, (a, b) in pairs.items())
    drawn = lambda side: f"(o.total_rows * o.{side} + 100.0::DOUBLE * ((l.total_rows * l.{side} + 100.0::DOUBLE * e.{side}) / (l.total_rows + 100.0::DOUBLE))) / (o.total_rows + 100.0::DOUBLE) AS {side}"
    return f"""{counts_sql(source)},
vals AS ({values}),
bins AS (SELECT rid, lang, source, rate, greatest(length(bin(x)) - 8, 0) * 128 + (x >> greatest(length(bin(x)) - 8, 0)) AS bin FROM vals),
sketch AS (SELECT lang, source, rate, bin, count(*) AS n FROM bins GROUP BY ALL),
{_fences_sql("own", "lang, source")},
{_fences_sql("bylang", "lang")},
{_fences_sql("allrows", "")},
lims AS (SELECT o.lang, o.source, o.rate, {drawn("low")}, {drawn("high")}
  FROM own o JOIN bylang l ON o.rate = l.rate AND o.lang IS NOT DISTINCT FROM l.lang JOIN allrows e ON o.rate = e.rate),
beyond AS (SELECT rid, bool_or(bin > high OR bin < low AND bins.rate IN ('capital_rate', 'word_length')) AS b FROM bins JOIN lims ON bins.rate = lims.rate AND bins.lang IS NOT DISTINCT FROM lims.lang AND bins.source IS NOT DISTINCT FROM lims.source GROUP BY rid),
judged AS (SELECT c.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT b AS kept FROM counted c JOIN beyond USING (rid))"""


QUERIES = {"op4_quality_rules": op4_quality_rules}
SQL = {"op4_quality_rules": f"WITH {verdict_sql()} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"}
