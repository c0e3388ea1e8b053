"""URL verdicts: rules first, gradient-boosted trees on lexical features for the rest.

A URL that a rule fits has that rule's verdict, and these URLs are the labelled ones. Features are lengths, depth,
digit ratio, character entropy, parameter counts and, for the host's last label and the file suffix, the smoothed
share of blocked URLs among all labelled ones. The trees are fitted on at most ``sample`` labelled rows, drawn by hash;
the statistics cover all of them. Everything is DataFrame expressions and Spark's own trees.

Cases: a null URL, or one without ``://``, has empty host and path, no rule, and the method's verdict on its other
features; a null id keeps its row; repeated rows repeat; an empty table gives no rows; other columns are ignored. With
no labelled rows, or labels of one kind only, the method says that kind, or allow.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowfind.session import scratch

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
         ("block", "net/fr/"))
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Rows of suffix statistics that may be broadcast; a row is a short string and two numbers.
SMALL_ROWS = 20_000
FEATURES = ["n_url", "n_host", "n_path", "depth", "labels", "digit_ratio", "entropy", "n_parameters", "n_hyphens",
            "n_escapes", "longest_label", "has_fragment", "secure", "host_suffix_rate", "file_suffix_rate"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    known = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return (F.translate(F.regexp_extract(known, pattern, 1), UPPER, UPPER.lower()),
            F.regexp_extract(known, pattern, 2))


def fitting_rule(host: Column, path: Column, rules) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    best = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        of, slash, below = rule.partition("/")
        fits = ((host == of) | F.endswith(host, F.lit(f".{of}"))) & F.startswith(path, F.lit(slash + below))
        best = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def occurrences(text: Column, what: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, what, ""))).cast("double")


def entropy(text: Column) -> Column:
    """Bits for each character of a text."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    letters = F.array_distinct(F.split(text, ""))
    shares = F.transform(letters, lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.coalesce(F.aggregate(shares, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0)),
                      F.lit(0.0))


def lexical(pages: DataFrame) -> DataFrame:
    """Adds the features that a URL has by itself, and the keys of the suffix statistics."""
    url, host, path = (F.col(c) for c in ("__url", "host", "path"))
    n = F.length(url).cast("double")
    return pages.withColumns({
        "n_url": n, "n_host": F.length(host).cast("double"), "n_path": F.length(path).cast("double"),
        "depth": occurrences(path, "/"), "labels": occurrences(host, "."),
        "digit_ratio": F.coalesce(occurrences(url, "0123456789") / F.nullif(n, F.lit(0.0)), F.lit(0.0)),
        "entropy": entropy(url), "n_parameters": occurrences(url, "="), "n_hyphens": occurrences(host, "-"),
        "n_escapes": occurrences(url, "%"),
        "longest_label": F.array_max(F.transform(F.split(host, r"\."), F.length)).cast("double"),
        "has_fragment": F.contains(url, F.lit("#")).cast("double"),
        "secure": F.startswith(F.lower(url), F.lit("https:")).cast("double"),
        "host_suffix": F.regexp_extract(host, r"([^.]*)$", 1),
        "file_suffix": F.lower(F.regexp_extract(path, r"\.([^./]{1,8})$", 1))})


def with_rate(rows: DataFrame, key: str, overall: float, weight: float = 20.0) -> DataFrame:
    """Adds the smoothed share of blocked rows among the labelled rows of each ``key``."""
    label = F.when(F.col("verdict") == "block", 1.0).otherwise(0.0)
    stats = scratch(rows.where("verdict is not null").groupBy(F.col(key).alias("__key"))
                    .agg(((F.sum(label) + weight * overall) / (F.count("*") + weight)).alias("__rate")), key)
    if stats.count() <= SMALL_ROWS:
        stats = F.broadcast(stats)
    return (rows.join(stats, rows[key] == stats["__key"], "left")
            .withColumn(f"{key}_rate", F.coalesce("__rate", F.lit(overall))).drop("__key", "__rate"))


def url_verdicts(pages: DataFrame, rules=RULES, sample: int = 20_000, trees: int = 10, depth: int = 4,
                 threshold: float = 0.5, id_column: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each row; score is the method's chance of block."""
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.coalesce(url, F.lit("")).alias("__url"))
    host, path = host_and_path(F.col("__url"))
    rows = rows.withColumns({"host": host, "path": path})
    rows = rows.withColumn("__fit", fitting_rule(F.col("host"), F.col("path"), rules))
    rows = lexical(rows.select("page_id", "__url", "host", "path", "__fit.rule", "__fit.verdict"))
    labels = {r["verdict"]: r["count"] for r in rows.where("verdict is not null").groupBy("verdict").count().collect()}
    n_block, n_allow = labels.get("block", 0), labels.get("allow", 0)
    overall = n_block / max(1, n_block + n_allow)
    if not n_block or not n_allow:
        scored = rows.withColumn("score", F.lit(overall))
    else:
        rows = with_rate(with_rate(rows, "host_suffix", overall), "file_suffix", overall)
        rows = VectorAssembler(inputCols=FEATURES, outputCol="__features").transform(rows)
        drawn = (rows.where("verdict is not null").orderBy(F.xxhash64("__url"), "page_id").limit(sample)
                 .select("__features", F.when(F.col("verdict") == "block", 1.0).otherwise(0.0).alias("__label")))
        model = GBTClassifier(featuresCol="__features", labelCol="__label", maxIter=trees, maxDepth=depth,
                              seed=7).fit(scratch(drawn, "labelled-urls"))
        scored = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    said = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", said).alias("verdict"), "score")
