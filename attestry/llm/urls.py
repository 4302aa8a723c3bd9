"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest.

The trees learn from labelled URLs. Where a rule list is all there is, the URLs that a rule decides are the
labelled ones. Only DataFrame operations are used; the trees are Spark's own.

Defined results: a null URL or one without ``://`` has an empty host and path, and features of an empty text;
repeated URLs are judged alike; without labelled URLs, or with one kind of label only, the verdict of all others
is ``allow``, or that kind; columns of any name besides those asked for are kept by ``judge`` and not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import LOWER, UPPER, table, unit
from attestry.operators.keyed import cut_lineage, salted_join

#: Most labelled URLs that the trees are fitted on, give or take what hashing to a fraction does.
TRAIN_ROWS = 20_000
#: How many URLs' worth of the overall rate a suffix's own rate is mixed with.
PRIOR = 20.0
FEATURES = ["f_length", "f_host_length", "f_depth", "f_labels", "f_digits", "f_entropy", "f_params", "f_query_length", "f_hyphens", "f_suffix_rate", "f_suffix_log"]


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, with A to Z in small letters."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule ``(verdict, host, path)`` that fits, as a struct of rule and verdict; null if none does.

    A rule list is written by people and is part of the expression, so that no row is moved for it.
    """
    fits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in rules
    ]
    best = F.array_max(F.array_compact(F.array(*fits))) if fits else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    return best


def suffix_of(host: Column) -> Column:
    """The last label of a host."""
    return F.regexp_extract(host, r"([^.]*)$", 1)


def lexical(rows: DataFrame, url: str, host: str, path: str) -> DataFrame:
    """Adds the features that the text alone gives: lengths, depth, digit ratio, entropy, parameter counts."""
    text = F.coalesce(F.col(url), F.lit(""))
    n = F.length(text)
    query = F.regexp_extract(text, r"(?s)^[^?#]*\?([^#]*)", 1)
    letters = F.array_distinct(F.split(text, ""))
    # -sum(p log p) over the distinct characters; an empty text has none
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    entropy = F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0.0), lambda total, c: total - share(c) * F.log(share(c)))
    return rows.withColumns({
        "f_length": n.cast("double"),
        "f_host_length": F.length(host).cast("double"),
        "f_depth": F.size(F.filter(F.split(F.col(path), "/"), lambda part: part != "")).cast("double"),
        "f_labels": F.size(F.split(F.col(host), r"\.")).cast("double"),
        "f_digits": F.when(n > 0, F.regexp_count(text, F.lit("[0-9]")) / n).otherwise(0.0),
        "f_entropy": F.coalesce(entropy, F.lit(0.0)),
        "f_params": F.size(F.filter(F.split(query, "&"), lambda part: part != "")).cast("double"),
        "f_query_length": F.length(query).cast("double"),
        "f_hyphens": F.regexp_count(text, F.lit("-")).cast("double"),
    })


def with_suffix(rows: DataFrame, suffixes: DataFrame, overall: float) -> DataFrame:
    """Adds the rate of blocked URLs and the count of a suffix; a suffix not seen before has the overall rate."""
    joined = salted_join(rows, suffixes, ["_suffix"], "left")
    return joined.withColumns({
        "f_suffix_rate": (F.coalesce("_blocked", F.lit(0)) + PRIOR * overall) / (F.coalesce("_seen", F.lit(0)) + PRIOR),
        "f_suffix_log": F.log1p(F.coalesce("_seen", F.lit(0)).cast("double")),
    }).drop("_blocked", "_seen")


class UrlModel:
    """Trees over lexical features and suffix statistics of labelled URLs."""

    def __init__(self, trees, suffixes: DataFrame, overall: float):
        self.trees, self.suffixes, self.overall = trees, suffixes, overall

    @classmethod
    def fit(cls, labelled: DataFrame, rounds: int = 20, depth: int = 4, train_rows: int = TRAIN_ROWS) -> UrlModel:
        """``labelled`` has ``_url, _host, _path`` and ``_label`` (1 to block). Statistics are those of all rows."""
        suffixes = cut_lineage(labelled.groupBy(suffix_of(F.col("_host")).alias("_suffix")).agg(F.count("*").alias("_seen"), F.sum("_label").alias("_blocked")))
        seen, blocked = suffixes.agg(F.sum("_seen"), F.sum("_blocked")).first()
        overall = (blocked or 0) / seen if seen else 0.0
        if not seen or blocked in (0, seen):
            return cls(None, suffixes, overall)
        sample = labelled.filter(unit(F.col("_url"), F.lit(7)) < train_rows / seen) if seen > train_rows else labelled
        rows = with_suffix(lexical(sample, "_url", "_host", "_path").withColumn("_suffix", suffix_of(F.col("_host"))), suffixes, overall)
        data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("features", F.col("_label").cast("double").alias("label"))
        trees = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.2, maxBins=32, seed=11).fit(cut_lineage(data))
        return cls(trees, suffixes, overall)

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds ``score``, the probability that the URL is one to block."""
        if self.trees is None:
            return rows.withColumn("score", F.lit(float(self.overall)))
        ready = with_suffix(lexical(rows, "_url", "_host", "_path").withColumn("_suffix", suffix_of(F.col("_host"))), self.suffixes, self.overall)
        scored = self.trees.transform(VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(ready).withColumnRenamed("_features", "features"))
        return scored.select(*rows.columns, vector_to_array("probability")[1].alias("score"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """Adds ``host, path, rule, verdict, score`` to ``pages``, in place of columns of these names; ``score`` is null where a rule decides."""
    kept = pages.drop("host", "path", "rule", "verdict", "score").columns
    parsed = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col(url).cast("string").alias("_url"))
    parsed = parsed.withColumns({"_host": host_of(F.col("_url")), "_path": path_of(F.col("_url"))}).withColumn("_rule", rule_for(F.col("_host"), F.col("_path"), rules))
    decided, rest = parsed.filter(F.col("_rule").isNotNull()), parsed.filter(F.col("_rule").isNull())
    labelled = decided.select("_url", "_host", "_path", (F.col("_rule.verdict") == "block").cast("int").alias("_label"))
    scored = UrlModel.fit(labelled).score(rest)
    out = decided.withColumn("score", F.lit(None).cast("double")).unionByName(scored)
    verdict = F.coalesce("_rule.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return out.select("_row.*", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "score")


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op7_url_filter(spark, folder: str) -> DataFrame:
    return judge(table(spark, folder, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict", "score")
