"""URL filters: prefix rules by host and path, and boosted trees for URLs that no rule fits.

All of it is DataFrame expressions: parsing, rules, lexical features and suffix statistics; the trees are
trained and applied by Spark's ML library inside the JVM. URLs that a rule fits are the labelled ones. The
trees see how a URL is written, and how its host's suffix and first path part fared among labelled URLs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

#: (name, verdict, host, path prefix)
RULES = [
    ("org/", "allow", "org", "/"),
    ("example.org/es/", "block", "example.org", "/es/"),
    ("example.org/en/1", "block", "example.org", "/en/1"),
    ("com/fr/", "allow", "com", "/fr/"),
    ("com/de/", "block", "com", "/de/"),
]
#: Labelled URLs that train the trees, at most.
SAMPLE = 20_000
TREES, DEPTH = 8, 4
PRIOR = 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["url_length", "host_length", "path_length", "host_depth", "path_depth", "digit_ratio", "entropy", "parameters", "values_length", "has_fragment", "dashes", "longest_digits", "suffix_block", "domain_block", "first_block", "ending_length"]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Then up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """(name, verdict) of the longest rule whose host is the URL's or above it and whose path begins the URL's."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, verdict, rule_host, prefix in sorted(rules, key=lambda r: (len(r[2]) + len(r[3]), r[0])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(prefix)
        found = F.when(fits, F.struct(F.lit(name).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def entropy(text: Column) -> Column:
    """Bits a character, over letters, digits and common marks."""
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    shares = [(F.length(text) - F.length(F.replace(text, F.lit(c)))) / size for c in "abcdefghijklmnopqrstuvwxyz0123456789/.-_=?&%"]
    return reduce(lambda a, b: a + b, [F.when(p > 0, -p * F.log2(p)).otherwise(0.0) for p in shares])


def with_features(pages: DataFrame) -> DataFrame:
    """``pages`` (url, host, path) with lexical features and the keys of the statistics."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    count = lambda text, c: F.length(text) - F.length(F.replace(text, F.lit(c)))
    digits = F.length(F.regexp_replace(url, "[^0-9]", ""))
    labels = F.split("host", r"\.")
    return pages.withColumns(
        {
            "url_length": F.length(url),
            "host_length": F.length("host"),
            "path_length": F.length("path"),
            "host_depth": count(F.col("host"), "."),
            "path_depth": count(F.col("path"), "/"),
            "digit_ratio": digits / F.greatest(F.length(url), F.lit(1)),
            "entropy": entropy(F.lower(url)),
            "parameters": F.when(query == "", 0).otherwise(count(query, "&") + 1),
            "values_length": F.length(query),
            "has_fragment": url.contains("#").cast("int"),
            "dashes": count(url, "-") + count(url, "_"),
            "longest_digits": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(url, F.lit(r"([0-9]+)"), F.lit(1)), F.length)), F.lit(0)),
            "ending_length": F.length(F.regexp_extract("path", r"\.([A-Za-z0-9]{1,8})$", 1)),
            "_suffix": F.element_at(labels, -1),
            "_domain": F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(2)), 2), "."),
            "_first": F.coalesce(F.get(F.split("path", "/"), F.lit(1)), F.lit("")),
        }
    )


def statistics(labelled: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): the share of blocked URLs under a key, drawn towards one half where there are few."""
    return labelled.groupBy(key).agg(((F.sum("label") + PRIOR / 2) / (F.count(F.lit(1)) + PRIOR)).alias(name))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every URL.

    Rules decide where one fits; else the trees, trained on up to SAMPLE URLs that a rule fits (the first by
    a hash of the URL). Their statistics cover all labelled URLs. If the labelled URLs have one verdict
    only, that is the verdict of the rest, and without any it is allow. A null URL, or one without ://, has
    empty host and path. Repeated rows each give a row.
    """
    split = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = split.withColumn("_rule", fitting_rule(F.col("host"), F.col("path"), rules))
    featured = with_features(ruled)
    labelled = featured.where("_rule IS NOT NULL").withColumn("label", (F.col("_rule.verdict") == "block").cast("double"))
    stats = [materialise(statistics(labelled, k, n), n) for k, n in (("_suffix", "suffix_block"), ("_domain", "domain_block"), ("_first", "first_block"))]

    def joined(df: DataFrame) -> DataFrame:
        # Small tables, written, so of known size; Spark broadcasts those below its threshold only.
        for s in stats:
            df = df.join(s, s.columns[0], "left")
        return df.fillna(0.5, ["suffix_block", "domain_block", "first_block"])

    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
    seen = {r.label for r in labelled.select("label").distinct().collect()}
    if len(seen) < 2:
        verdict = F.lit("block" if seen == {1.0} else "allow")
        return ruled.select("page_id", "host", "path", "_rule.rule", F.coalesce("_rule.verdict", verdict).alias("verdict"))
    sample = labelled.orderBy(F.xxhash64("url"), "url").limit(SAMPLE)
    train = materialise(joined(sample).select(*FEATURES, "label"), "urls")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, seed=1, featuresCol="features").fit(assembler.transform(train.coalesce(2)))
    rest = model.transform(assembler.transform(joined(featured)))
    predicted = F.when(F.col("prediction") == 1.0, "block").otherwise("allow")
    return rest.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", predicted).alias("verdict"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` judged by their url."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))


QUERIES = {"op8_urls": op8_urls}
SQL: dict[str, str] = {}
