"""URL filtering by gradient-boosted trees on lexical features, with host and path rules before it.

Everything is DataFrame expressions and Spark's own boosted trees. The features of a URL are lengths,
depth, digit ratio, entropy of its characters, counts of parameters, hyphens and dots, and statistics
of its host's suffixes: how frequent they are, and how often they are blocked among labelled URLs.
Hosts are dealt to folds by hash, and a labelled URL gets the shares of the other folds, so neither its
own label nor its host's is in them; URLs without a label get those of all. The rarer class weighs as
much as the other when trees are grown.

A rule is a host with a path prefix; it fits the host and all subdomains where the URL's path starts
with the prefix, and the longest that fits decides. URLs that rules decide are the labelled ones when
no others are given. Null URLs, and those without "://", have empty host and path and fit no rule.
With no labelled URL of one of the two classes nothing can be learned, and every verdict is the class
there is ("allow" with none). Repeated rows get equal verdicts; columns besides the id and the URL
are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, plain

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LEXICAL = ["url_length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "dots", "longest_label"]
SUFFIXES = ["suffix_1", "suffix_2"]
FOLDS = 5


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, SPLIT, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, SPLIT, 2), F.lit(""))


def apply_rules(urls: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Append rule and ruled from (verdict, "host/path...") rules; both null where none fits."""
    rule = ruled = F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is tested first
        name, slash, rest = text.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(slash + rest)
        rule, ruled = F.when(fits, text).otherwise(rule), F.when(fits, verdict).otherwise(ruled)
    return urls.withColumn("rule", rule).withColumn("ruled", ruled)


def lexical(urls: DataFrame) -> DataFrame:
    """Append the lexical features and the host's suffixes."""
    url = F.coalesce(F.col("url"), F.lit(""))
    size = F.greatest(F.length(url), F.lit(1))
    without = lambda c: F.length(F.regexp_replace(url, c, ""))
    shares = F.transform(F.array_distinct(F.split(url, "")), lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / size)
    entropy = F.aggregate(shares, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    labels = F.split(F.col("host"), r"\.")
    return urls.withColumns(
        {
            "url_length": F.length(url).cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "depth": (F.length("path") - F.length(F.replace(F.col("path"), F.lit("/"), F.lit("")))).cast("double"),
            "digit_ratio": (F.length(url) - without("[0-9]")) / size,
            "entropy": entropy,
            "parameters": (F.length(url) - without("[?&;]")).cast("double"),
            "hyphens": (F.length(url) - without("-")).cast("double"),
            "dots": (F.length(url) - without(r"\.")).cast("double"),
            "longest_label": F.array_max(F.transform(labels, lambda x: F.length(x))).cast("double"),
            "suffix_1": F.element_at(labels, -1),
            "suffix_2": F.array_join(F.slice(labels, -F.least(F.lit(2), F.size(labels)), 2), "."),
        }
    )


def suffix_statistics(urls: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Append, for each suffix, the log of its rows and its smoothed share of blocks (column `label`).

    A labelled URL's share counts the hosts of other folds alone, so all labelled URLs of a fold and
    suffix have the same; a URL without a label has that of all hosts. All is counted by host first,
    which the suffixes' statistics are joined to, and only then by URL.
    """
    own = F.coalesce("label", F.lit(0.0))
    hosts = urls.groupBy("host", *SUFFIXES).agg(F.count("*").alias("rows"), F.count("label").alias("labelled"), F.sum(own).alias("blocked"))
    hosts = materialise(hosts.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "host"), F.lit(folds))), "hosts")
    for name in SUFFIXES:
        parts = hosts.groupBy(name, "fold").agg(*[F.sum(c).alias(f"{name}_{c}_fold") for c in ("labelled", "blocked")], F.sum("rows").alias(f"{name}_rows"))
        parts = materialise(parts, name)
        whole = parts.groupBy(name).agg(F.sum(f"{name}_rows").alias(f"{name}_rows"), *[F.sum(f"{name}_{c}_fold").alias(f"{name}_{c}") for c in ("labelled", "blocked")])
        hosts = hosts.join(parts.drop(f"{name}_rows"), [name, "fold"]).join(materialise(whole, name), name)
    hosts = hosts.select("host", *[f"{name}_{c}" for name in SUFFIXES for c in ("rows", "labelled", "blocked", "labelled_fold", "blocked_fold")])
    urls = urls.join(hosts, "host")
    for name in SUFFIXES:
        among = lambda c: F.col(f"{name}_{c}") - F.when(F.col("label").isNotNull(), F.col(f"{name}_{c}_fold")).otherwise(0)  # noqa: B023, E731
        urls = urls.withColumn(f"{name}_blocked", (among("blocked") + 1) / (among("labelled") + 2)).withColumn(f"{name}_rows", F.log1p(f"{name}_rows"))
    return urls


def judge(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None, trees: int = 12, depth: int = 4, sample: int = 200_000) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row; score is the learned chance of a block.

    `labelled` may give (url, label) with 1.0 for URLs to block; else the rules label the pages. Of the
    labelled URLs about `sample` are learned from at most, chosen by a hash.
    """
    rows = plain(pages, "page_id", "url").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    rows = apply_rules(rows.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url"))), rules)
    label = F.when(F.col("ruled") == "block", 1.0).when(F.col("ruled") == "allow", 0.0)
    rows = rows.withColumn("label", label if labelled is None else F.lit(None).cast("double"))
    rows = lexical(rows.withColumn("judged", F.lit(True)))
    if labelled is not None:
        more = labelled.select(F.lit(None).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("label").cast("double").alias("label"))
        more = more.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url"))).withColumn("judged", F.lit(False))
        rows = rows.unionByName(lexical(more), allowMissingColumns=True)
    names = LEXICAL + [f"{s}_{k}" for s in SUFFIXES for k in ("rows", "blocked")]
    rows = materialise(suffix_statistics(rows).select("page_id", "url", "host", "path", "rule", "ruled", "judged", "label", *names), "url-features")
    counts = {r["label"]: r["count"] for r in rows.where("label is not null").groupBy("label").count().collect()}
    total = sum(counts.values())
    judged = rows.where("judged")
    if len(counts) < 2:
        only = float(max(counts, default=0.0))
        scored = judged.withColumn("score", F.lit(only))
    else:
        part = F.pmod(F.xxhash64(F.lit("urls"), "url", "page_id"), F.lit(1 << 20)) < F.lit((sample << 20) / total)
        assemble = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")
        learner = GBTClassifier(labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=0.3, minInstancesPerNode=5, seed=1)
        weight = F.when(F.col("label") == 1, total / (2 * counts[1.0])).otherwise(total / (2 * counts[0.0]))
        model = learner.fit(assemble.transform(rows.where("label is not null").where(part)).select("features", "label", weight.alias("weight")))
        scored = model.transform(assemble.transform(judged)).withColumn("score", vector_to_array("probability")[1])
    learned = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), "score")
