"""URL filter: curated rules, else logistic regression on hashed character n-grams.

All on DataFrame functions and Spark's own ML pipeline. A rule names a host, which
stands for its subdomains too, and the start of a path; the longest rule that fits
decides. What no rule decides goes to a model of the character n-grams of host and
path that was trained on a small table of labelled URLs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of the labelled table that a fit reads at most.
MAX_LABELLED = 4000
FEATURES = 1 << 14
GRAMS = (3, 4)

#: Fixed values of the contract: host, start of path, verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host(url: Column) -> Column:
    """After the first ``://``; null or none: empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host_col: Column, path_col: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest fitting rule, ties to the larger text; null if none fits.

    The rules are an argument, so their number is bounded by who writes them.
    """
    fits = [
        F.when(
            ((host_col == h) | host_col.endswith(f".{h}")) & path_col.startswith(p),
            F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for h, p, v in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")


def grams(host_col: Column, path_col: Column, sizes: Sequence[int] = GRAMS) -> Column:
    """Character n-grams of ``^host$`` and of ``^path$``, each marked with its part."""

    def of(mark: str, text: Column, n: int) -> Column:
        framed = F.concat(F.lit("^"), text, F.lit("$"))
        starts = F.when(F.length(framed) >= n, F.sequence(F.lit(1), F.length(framed) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(F.lit(mark), F.substr(framed, i, F.lit(n))))

    return F.concat(*(of(mark, c, n) for mark, c in (("h", host_col), ("p", path_col)) for n in sizes))


def fit(labelled: DataFrame, max_rows: int = MAX_LABELLED):
    """A model from url, label (1 block, 0 allow), or a constant where there is one label or none.

    Reads ``max_rows`` rows at most, those first by a hash of the URL. Null labels
    and null URLs teach nothing.
    """
    rows = labelled.filter(F.col("url").isNotNull() & F.col("label").isNotNull()).select("url", F.col("label").cast("double").alias("label"))
    rows = rows.orderBy(F.xxhash64("url"), "url", "label").limit(max_rows)
    seen = rows.agg(F.min("label").alias("low"), F.max("label").alias("high")).first()
    if seen["low"] is None or seen["low"] == seen["high"]:
        return float(seen["low"] or 0.0)
    rows = rows.select(grams(host(F.col("url")), path(F.col("url"))).alias("url_grams"), "label")
    hashed = HashingTF(numFeatures=FEATURES, inputCol="url_grams", outputCol="url_features").transform(rows)
    return LogisticRegression(featuresCol="url_features", labelCol="label", regParam=0.01, maxIter=40, standardization=False).fit(hashed)


def block_score(urls: DataFrame, model, score: str = "block_score") -> DataFrame:
    """``urls`` (with url_host, url_path) and the model's probability of block."""
    if isinstance(model, float):
        return urls.withColumn(score, F.lit(model))
    hashed = HashingTF(numFeatures=FEATURES, inputCol="url_grams", outputCol="url_features").transform(urls.withColumn("url_grams", grams(F.col("url_host"), F.col("url_path"))))
    model = model.copy().setRawPredictionCol("").setPredictionCol("").setProbabilityCol("url_probability")
    out = model.transform(hashed).withColumn(score, vector_to_array("url_probability")[1])
    return out.drop("url_grams", "url_features", "url_probability")


def judge(urls: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = 0.5) -> DataFrame:
    """``urls`` (key, url) with url_host, url_path, url_rule, block_score and verdict.

    A null URL has empty host and path, fits no rule, and gets the model's verdict
    on an empty URL. Repeated rows get equal verdicts. Other columns stay.
    """
    model = fit(labelled)
    rows = urls.withColumns({"url_host": host(F.col("url")), "url_path": path(F.col("url"))})
    rows = block_score(rows, model)
    best = longest_rule(F.col("url_host"), F.col("url_path"), rules)
    learned = F.when(F.col("block_score") >= threshold, "block").otherwise("allow")
    return rows.withColumns({"url_rule": best["rule"], "verdict": F.coalesce(best["verdict"], learned)})


def labelled_by_rules(urls: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """The labelled URL table the rules imply: the URLs they decide, each once."""
    best = longest_rule(host(F.col("url")), path(F.col("url")), rules)
    rows = urls.select("url", best["verdict"].alias("by_rule")).filter(F.col("by_rule").isNotNull())
    return rows.distinct().select("url", (F.col("by_rule") == "block").cast("int").alias("label"))


def op8(spark, sf_dir):
    from .common import table

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rows = judge(pages, labelled_by_rules(pages))
    return rows.select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule").alias("rule"), "verdict", "block_score")
