"""URL filters: host-suffix and path-prefix expressions against hashed rules.

Each URL is expanded into (host suffix, path prefix) expressions, path prefixes ending at
every ``/``. Rules and expressions meet in an equi-join on the first four bytes of their
SHA-256; the full digests then have to agree and the URL's path has to start with the
rule's whole path (a rule path that does not end in ``/`` is keyed by its part up to the
last one). Of the rules that fit a URL the longest wins.

Defined cases: a null URL or one without ``://`` has an empty host and path and fits no
rule; a URL that fits no rule gets ``default``. Between rules of the same length the longer
host wins, then ``block``. Suffixes and prefixes deeper than any rule's are not formed, so a
URL's cost follows its length, whatever its depth. Rows with equal ids or URLs are judged one by one; an empty table
gives an empty result; further columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetra.llm.common import with_row_id

# Fixed values of the query: (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
SMALL_RULES = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def digest(host: Column, path: Column) -> Column:
    """Full digest of one expression; the zero byte keeps host and path apart."""
    return F.sha2(F.concat(host, F.lit("\u0000"), path), 256)


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Rules (host, path, verdict) as a DataFrame with their key digests; a list of at most
    ``SMALL_RULES`` is marked for broadcast, its size being known."""
    rules = list(rules)
    df = keyed_rules(spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string"))
    return F.broadcast(df) if len(rules) <= SMALL_RULES else df


def keyed_rules(df: DataFrame) -> DataFrame:
    """Add digest and hash prefix to rules of any number (``rule_host, rule_path, rule_verdict``)."""
    stem = F.regexp_extract("rule_path", r"(?s)^(.*/)", 1)
    full = digest(F.translate("rule_host", UPPER, LOWER), stem)
    return df.select("rule_host", "rule_path", "rule_verdict", full.alias("rule_digest"), full.substr(1, 8).alias("rule_prefix"))


def expressions(host: Column, path: Column, labels: int = -1, slashes: int = -1) -> Column:
    """Digests of all (host suffix, path prefix) pairs of one URL, of at most so many labels
    and slashes (-1: all)."""
    names = F.split(host, r"\.")
    first = F.greatest(F.lit(1), F.size(names) - F.lit(labels) + 1) if labels >= 0 else F.lit(1)
    suffixes = F.transform(
        F.sequence(first, F.greatest(first, F.size(names))),
        lambda i: F.array_join(F.slice(names, i, F.greatest(F.lit(0), F.size(names) - i + 1)), "."),
    )
    steps = F.split(path, "/", slashes + 1 if slashes >= 0 else -1)
    cut = F.transform(
        F.sequence(F.lit(1), F.size(steps)),
        lambda i: F.when(i < F.size(steps), F.concat(F.array_join(F.slice(steps, 1, i), "/"), F.lit("/"))),
    )
    prefixes = F.array_distinct(F.concat(F.array(F.lit("")), F.filter(cut, lambda p: p.isNotNull())))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: digest(h, p))))


def depths(rules: DataFrame) -> tuple[int, int]:
    """Labels of the longest rule host and slashes of the deepest rule path."""
    found = rules.agg(F.max(F.size(F.split("rule_host", r"\."))), F.max(F.size(F.split("rule_path", "/")) - 1)).first()
    return found[0] or 0, found[1] or 0


def judge(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: ``id, host, path, rule, verdict``.

    The expressions of a URL leave its task only as far as rules are joined by shuffle;
    with few rules Catalyst broadcasts them, and the closing aggregate, combined before its
    shuffle, moves one row per URL.
    """
    url = F.col("_url")
    urls = with_row_id(pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url")))
    parts = urls.select("_row", "_id", host_of(url).alias("host"), path_of(url).alias("path"))
    asked = parts.withColumn("digest", F.explode_outer(expressions(F.col("host"), F.col("path"), *depths(rules)))).withColumn("prefix", F.col("digest").substr(1, 8))
    met = asked.join(rules, F.col("prefix") == F.col("rule_prefix"), "left")
    fits = (F.col("digest") == F.col("rule_digest")) & F.startswith(F.col("path"), F.col("rule_path"))
    name = F.concat("rule_host", "rule_path")
    rank = F.struct(
        F.length(name).alias("size"),
        F.length("rule_host").alias("host_size"),
        (F.col("rule_verdict") == "block").alias("blocks"),
        name.alias("rule"),
        F.col("rule_verdict").alias("verdict"),
    )
    best = met.groupBy("_row", "_id", "host", "path").agg(F.max(F.when(fits, rank)).alias("best"))
    return best.select(
        F.col("_id").alias(id_col), "host", "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )
