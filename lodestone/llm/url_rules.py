"""URL filter: host-suffix and path-prefix expressions matched by short hash prefixes.

Every URL is expanded into the expressions `suffix-of-host + prefix-of-path`; the rule
list holds the same expressions. Short hash prefixes are equi-joined, full digests
confirm a match, and the longest expression decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import Scratch

RULE_SCHEMA = T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

#: Rule lists up to this many rows are broadcast; longer ones are joined by a shuffle.
BROADCAST_RULES = 100_000
#: Hexadecimal digits of the short hash that is joined on.
SHORT = 8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first `://` up to `/`, `?`, `#`, lower-cased A-Z;
    path from there up to `?` or `#`. Null or no `://`: both empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def parse_rules(rules: DataFrame) -> DataFrame:
    """rule, verdict -> host and path of each rule; rows with a null in either, and rules
    without a host, match nothing and go."""
    slash = F.instr("rule", "/")
    host = F.translate(F.when(slash > 0, F.expr("left(rule, instr(rule, '/') - 1)")).otherwise(F.col("rule")), UPPER, LOWER)
    path = F.when(slash > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise(F.lit(""))
    return (
        rules.select("rule", "verdict")
        .where(F.col("rule").isNotNull() & F.col("verdict").isNotNull())
        .select("rule", "verdict", host.alias("r_host"), path.alias("r_path"))
        .where(F.length("r_host") > 0)
        .distinct()
    )


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: id, host, path, rule (null if none fits), verdict.

    A rule fits its host and every subdomain if the path starts with the rule's path.
    The longest rule text wins; of equally long ones `block` comes first, then the
    later text. URLs that no rule fits get `default`.

    Null URLs and URLs without `://` have an empty host and path, fit no rule and get
    the default. Repeated rows are judged once and each is returned. Empty tables give
    an empty result; columns other than the two named are ignored.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    host, path = url_parts(F.col("url"))
    known = parse_rules(rules)
    # Path prefixes are taken at the lengths that rules have: a URL is at most a few
    # thousand characters long, so this set is small however long the rule list.
    lengths = sorted(r[0] for r in known.select(F.length("r_path")).distinct().collect())
    n_rules = known.limit(BROADCAST_RULES + 1).count()

    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    # Each distinct URL is expanded once, however many rows repeat it.
    expanded = (
        src.where(F.col("url").isNotNull()).select("url").distinct()
        .select("url", host.alias("host"), path.alias("path")).where(F.length("host") > 0)
        .select("url", F.explode(suffixes).alias("suffix"), F.array_compact(prefixes).alias("prefixes"))
        .select("url", F.explode("prefixes").alias("prefix"), "suffix")
        .select("url", F.sha2(F.concat("suffix", F.lit("\n"), "prefix").cast("binary"), 256).alias("digest"))
        .withColumn("short", F.substring("digest", 1, SHORT))
    )
    listed = known.select(
        F.sha2(F.concat("r_host", F.lit("\n"), "r_path").cast("binary"), 256).alias("r_digest"), "rule", "verdict",
        F.struct(F.length("rule"), F.col("verdict") == "block", F.col("rule")).alias("rank"),
    ).withColumn("short", F.substring("r_digest", 1, SHORT))
    if n_rules <= BROADCAST_RULES:
        listed = F.broadcast(listed)
    best = scratch.save(
        expanded.join(listed, "short").where(F.col("digest") == F.col("r_digest"))
        .groupBy("url").agg(F.max(F.struct("rank", "verdict")).alias("best"))
        .select("url", F.col("best.rank.rule").alias("rule"), F.col("best.verdict").alias("verdict")),
        "best",
    )  # written, so that the join below can split a URL that many rows have, or those without one
    out = src.join(best, "url", "left")
    return out.select(
        F.col("id").alias(id_col), host.alias("host"), path.alias("path"), "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"),
    )
