"""URL filter: host and path rules first, gradient-boosted trees on lexical features for all other URLs.

The features are column expressions, and the trees, once fitted, are one too: all URLs are judged without leaving the
JVM. The trees are fitted on the driver to a bounded number of labelled URLs (``MAX_LABELLED``). Labels come from a
table; where none is given they are the verdicts of the rules on the URLs at hand, so that the trees carry what the rules
say of some URLs over to those that no rule fits.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled URLs at most (the first by hash); trees, their depth, step, bins of a feature.
MAX_LABELLED, TREES, DEPTH, STEP, BINS = 50_000, 40, 3, 0.3, 32
#: Labelled URLs that a suffix needs for a rate of its own, URLs of the mean rate that are added to each.
SEEN, SMOOTH = 3, 4

# fixed values: (verdict, host, path prefix); a rule fits its host and all subdomains
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def winning_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as struct(size, rule, verdict); null if none does. For rule lists the plan can hold."""
    fits = [
        F.when((F.endswith(F.concat(F.lit("."), host), F.lit("." + h))) & F.startswith(path, F.lit(p)), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


#: Names of the numeric features, and of the suffixes whose share of blocked URLs is a feature.
NUMBERS = ["length", "host_length", "path_length", "depth", "labels", "hyphens", "digit_ratio", "entropy", "parameters", "joined"]
SUFFIXES = ["top", "domain", "folder", "ending"]


def entropy(text: Column) -> Column:
    """Bits a character of a string by its own character frequencies; 0 if it is empty."""
    size = F.length(text)
    counts = F.transform(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")), lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size)
    return F.when(size > 0, F.aggregate(counts, F.lit(0.0), lambda t, p: t - p * F.log2(p))).otherwise(0.0)


def features(url: Column, host: Column, path: Column) -> list[Column]:
    """Numeric features and suffixes of a URL, as columns with the names ``NUMBERS`` and ``SUFFIXES``."""
    url = F.coalesce(url, F.lit(""))
    many = lambda text, c: F.length(text) - F.length(F.translate(text, c, ""))
    rest = F.substring_index(url, "?", -1)
    query = F.when(many(url, "?") > 0, rest).otherwise("")
    numbers = [
        F.length(url), F.length(host), F.length(path), many(path, "/"), many(host, "."), many(host, "-"),
        many(url, "0123456789") / F.greatest(F.length(url), F.lit(1)), entropy(url), many(query, "="), many(query, "&"),
    ]
    suffixes = [F.substring_index(host, ".", -1), F.substring_index(host, ".", -2), F.regexp_extract(path, "^/([^/]*)/", 1), F.regexp_extract(path, r"(\.[A-Za-z0-9]+|/)$", 1)]
    return [*(x.cast("double").alias(n) for x, n in zip(numbers, NUMBERS)), *(x.alias(n) for x, n in zip(suffixes, SUFFIXES))]


class BoostedTrees:
    """Logistic boosting of complete binary trees over binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, step: float = STEP) -> None:
        self.depth = depth
        p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.base, self.trees = math.log(p / (1 - p)), []
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        score = np.full(len(y), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
            for level in range(depth):
                first = 2**level - 1
                best = np.full(2**level, 1e-9)
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    at = node * (len(e) + 1) + binned[:, j]
                    g = np.bincount(at, grad, 2**level * (len(e) + 1)).reshape(2**level, -1)
                    h = np.bincount(at, hess, 2**level * (len(e) + 1)).reshape(2**level, -1)
                    gl, hl = g.cumsum(axis=1)[:, :-1], h.cumsum(axis=1)[:, :-1]
                    ga, ha = g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True)
                    gain = gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1)
                    k = gain.argmax(axis=1)
                    top = gain[np.arange(2**level), k]
                    for m in np.flatnonzero(top > best):
                        best[m], feature[first + m], cut[first + m] = top[m], j, e[k[m]]
                node = node * 2 + (x[np.arange(len(y)), feature[first + node]] > cut[first + node])
            value = step * np.bincount(node, grad, 2**depth) / (np.bincount(node, hess, 2**depth) + 1)
            self.trees.append((feature, cut, value))
            score += value[node]

    def probability(self, x: list[Column]) -> Column:
        """The probability of label 1 as an expression of the features."""

        def value(tree, node: int, level: int) -> Column:
            feature, cut, values = tree
            if level == self.depth:
                return F.lit(float(values[node]))
            at = 2**level - 1 + node
            left, right = (value(tree, 2 * node + side, level + 1) for side in (0, 1))
            return left if np.isinf(cut[at]) else F.when(x[feature[at]] > F.lit(float(cut[at])), right).otherwise(left)

        score = reduce(lambda t, v: t + v, (value(tree, 0, 0) for tree in self.trees), F.lit(self.base))
        return 1 / (1 + F.exp(-score))


class UrlModel:
    """Trees and suffix rates, fitted to rows of features with a label (block: 1)."""

    def __init__(self, rows: list) -> None:
        y = np.array([r.block for r in rows], float)
        self.mean = float(y.mean()) if len(y) else 0.0
        self.rates = {}
        for name in SUFFIXES:
            seen: dict[str, list] = {}
            for r, v in zip(rows, y):
                n = seen.setdefault(r[name], [0, 0.0])
                n[0] += 1
                n[1] += v
            self.rates[name] = {k: float(s + SMOOTH * self.mean) / (n + SMOOTH) for k, (n, s) in seen.items() if n >= SEEN}
        x = np.array([[r[n] for n in NUMBERS] + [self.rates[n].get(r[n], self.mean) for n in SUFFIXES] for r in rows], float).reshape(-1, len(NUMBERS) + len(SUFFIXES))
        # one label only, or none at all: nothing to tell apart
        self.trees = BoostedTrees(x, y) if 0 < self.mean < 1 else None

    def judged(self, rows: DataFrame) -> DataFrame:
        """Rows with ``p``, the probability of a block."""
        if self.trees is None:
            return rows.withColumn("p", F.lit(self.mean))
        for name, rates in self.rates.items():
            # as many rows as labelled URLs have suffixes: MAX_LABELLED / SEEN at most
            table = rows.sparkSession.createDataFrame(list(rates.items()), f"{name} string, rate_{name} double")
            rows = rows.join(F.broadcast(table), name, "left")
        x = [F.col(n) for n in NUMBERS] + [F.coalesce(f"rate_{n}", F.lit(self.mean)) for n in SUFFIXES]
        return rows.withColumn("p", self.trees.probability(x))


def labelled_rows(labelled: DataFrame, url_col: str, block_col: str) -> list:
    """Features and label of at most ``MAX_LABELLED`` rows of a labelled table, the first by hash of the URL."""
    url = F.col(url_col).cast("string")
    rows = labelled.filter(F.col(url_col).isNotNull() & F.col(block_col).isNotNull()).select(url.alias("url"), F.col(block_col).cast("int").alias("block"))
    rows = rows.orderBy(F.xxhash64("url"), "url", "block").limit(MAX_LABELLED)
    return rows.select("block", *features(F.col("url"), host_of(F.col("url")), path_of(F.col("url")))).collect()


def filter_urls(pages: DataFrame, url_col: str = "url", id_col: str = "page_id", rules=RULES, labelled: DataFrame | None = None, label_url: str = "url", label_block: str = "block") -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, block_probability.

    ``labelled`` is a table of URLs with a label, true or 1 to block; without one, the URLs of ``pages`` that a rule fits
    are learned from, with the rule's verdict as label (no labels, or all alike: every other URL gets their mean, which
    is an allow without labels). A null URL, or one without ``://``, has an empty host and path, fits no rule and is
    judged by the trees like any other. Of rules that fit the longest wins (equally long: the last by name). Repeated
    rows come out repeated and count each as a label; an empty table gives an empty result; URLs are taken whole, however
    long; other columns are ignored.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("won", winning_rule(F.col("host"), F.col("path"), rules)).select("id", "url", "host", "path", F.col("won.rule").alias("rule"), F.col("won.verdict").alias("verdict"))
    if labelled is None:
        labelled, label_url, label_block = rows.filter("verdict IS NOT NULL").withColumn("block", F.col("verdict") == "block"), "url", "block"
    model = UrlModel(labelled_rows(labelled, label_url, label_block))
    out = model.judged(rows.select("*", *features(F.col("url"), F.col("host"), F.col("path"))))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.when(F.col("p") >= 0.5, "block").otherwise("allow")).alias("verdict"), F.col("p").alias("block_probability"))


def op9_filter_urls(spark, sf_dir: str) -> DataFrame:
    """Verdicts on every url of ``pages``."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
