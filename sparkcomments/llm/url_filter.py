"""Judging URLs by host and path rules: expressions, short hash prefixes, full digests, precedence.

A rule has a host, a path and a verdict (``allow`` or ``block``). It fits its host and all subdomains, if the URL's path
starts with the rule's path. Each URL is expanded into expressions: a suffix of its host's labels, and a prefix of its
path that ends with a slash (or is empty). A rule has one expression: its host, and its path up to the last slash. The
two meet in an equi-join on the first hexadecimal digits of the expressions' SHA-256; then the full digests must agree,
and the path must start with the rule's whole path. Of the rules that fit, the longest (host and path, in code points)
wins, then that of the longer host, then ``block``.

Only those expressions are made whose number of labels and of slashes some rule has: these pairs are read from the rules
and stand in the plan. They depend on the rules alone, not on the URLs, and keep an URL of many labels and slashes from
being expanded into their product.

Distinct hosts and paths are judged, not rows: repeated URLs are put together before anything is expanded. Nothing is
broadcast by hint: Catalyst does so with rules under its threshold; above it, adaptive execution splits the prefix that
a third of all sites have, and the site that a third of all rows have.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case. Path: from there up to
``?``, ``#`` or the end. A null URL, or one without ``://``, has an empty host and path. An empty host fits only rules of
an empty host. A rule without host (null) fits nothing; a null path is an empty one; other verdicts than the two are an
error. Repeated rows each keep their row; an empty table gives none; without rules, all have the default verdict.
Columns ``host``, ``path``, ``rule`` and ``verdict`` of the table are replaced, all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table

#: Hexadecimal digits of the digest that rules and expressions are joined on.
PREFIX = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDED = ("host", "path", "rule", "verdict")

# The rules of the contract.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def _folded(host: Column) -> Column:
    return F.translate(host, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both texts of an URL; neither is null."""
    rest = F.when(url.contains("://"), F.substring_index(F.concat(F.lit("x"), url), "://", 1))
    after = F.coalesce(F.substr(url, F.char_length(rest) + F.lit(3)), F.lit(""))
    return _folded(F.regexp_extract(after, r"^[^/?#]*", 0)), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def _with_digest(df: DataFrame) -> DataFrame:
    hashed = df.withColumn("_digest", F.sha2(F.col("_expression"), 256))
    return hashed.withColumn("_prefix", F.substring("_digest", 1, PREFIX))


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules with their expression's shape, digest and prefix."""
    c = F.col
    known = rules.where(c("host").isNotNull()).select(
        _folded(c("host")).alias("_host"), F.coalesce("path", F.lit("")).alias("_path"),
        F.when(c("verdict").isin("allow", "block"), c("verdict")).otherwise(
            F.raise_error(F.concat(F.lit("a rule's verdict is allow or block, not "), F.coalesce("verdict", F.lit("null"))))).alias("_verdict"))
    slashes = F.regexp_count("_path", F.lit("/"))
    return _with_digest(known.distinct().withColumns({
        "_labels": F.regexp_count("_host", F.lit(r"\.")) + 1, "_slashes": slashes,
        "_expression": F.concat("_host", F.regexp_extract("_path", "(?s)^.*/", 0))}))


def expressions(sites: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """The expressions of each site that have one of the shapes: pairs of a number of labels and of slashes."""
    if not shapes:
        return sites.where("false").withColumn("_expression", F.lit(""))
    made = ", ".join(
        f"IF({labels} <= _n_labels AND {slashes} <= _n_slashes, concat(substring_index(host, '.', -{labels}), "
        + (f"substring_index(path, '/', {slashes}), '/'" if slashes else "''") + "), NULL)"
        for labels, slashes in shapes)
    counted = sites.withColumns({
        "_n_labels": F.regexp_count("host", F.lit(r"\.")) + 1, "_n_slashes": F.regexp_count("path", F.lit("/"))})
    return counted.select("host", "path", F.explode(F.expr(f"array_compact(array({made}))")).alias("_expression"))


def best_rules(sites: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path, rule, verdict`` of each site that a rule fits."""
    c = F.col
    known = rule_table(rules)
    shapes = sorted((r._labels, r._slashes) for r in known.select("_labels", "_slashes").distinct().collect())
    met = _with_digest(expressions(sites, shapes)).join(known.drop("_expression").withColumnRenamed("_digest", "_full"), "_prefix")
    fits = met.where((c("_digest") == c("_full")) & c("path").startswith(c("_path")))
    size = F.struct(F.char_length("_host") + F.char_length("_path"), F.char_length("_host"), c("_verdict"))
    return fits.groupBy("host", "path").agg(
        F.max_by(F.struct(F.concat("_host", "_path").alias("rule"), c("_verdict").alias("verdict")), size).alias("_best")
    ).select("host", "path", "_best.*")


def judged(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``."""
    host, path = host_and_path(F.col(f"`{url}`"))
    kept = [F.col(f"`{name}`") for name in pages.columns if name not in ADDED]
    split = pages.select(*kept, host.alias("host"), path.alias("path"))
    found = best_rules(split.select("host", "path").distinct(), rules)
    out = split.join(found, ["host", "path"], "left")
    return out.select(*kept, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def rules_of(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, rules_of(spark)).drop("url")
