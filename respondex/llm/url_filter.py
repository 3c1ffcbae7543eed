"""URL filters: host-suffix and path-prefix expressions, looked up by short hash prefix.

A rule (host, path, verdict) fits its host and every subdomain if the url's path begins
with the rule's path. Only expressions of a shape that some rule has are made: so many host
labels and so many characters of path. They are joined on the first 32 bits of their
digest; equal full digests confirm a hit. The longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from respondex.llm.shared import lower_ascii

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

PREFIX_DIGITS = 8


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """A few rules as a table; a long list is read from files instead."""
    items = [
        F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict"))
        for h, p, v in rules
    ]
    return spark.range(1).select(F.inline(F.array(*items)))


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.when(
        F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + F.lit(3))
    ).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.translate(host, ".", "")) + 1


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    default: str = "allow",
) -> DataFrame:
    """page_id, url, host, path, rule, verdict: one row per input row.

    Other columns are not looked at. A null url, or one without ``://``, has an empty host
    and path, fits no rule and gets ``default``; so does every url without a fitting rule.
    Rows that repeat an id or a url are judged alike. Of equally long rules the longer host
    wins, then block over allow; rules with a null part are void. Without rules, or
    without pages, nothing is blocked. The rules may be of any number: their join is
    planned by Spark from their size, and only their shapes come to the driver, which are
    as many as pairs of a label count and a path length.
    """
    known = rules.select("host", "path", "verdict").where(
        "host is not null and path is not null and verdict is not null"
    )
    known = known.withColumn("host", lower_ascii(F.col("host")))
    shapes = known.select(_labels(F.col("host")).alias("n"), F.length("path").alias("m"))
    shapes = sorted(tuple(x) for x in shapes.distinct().collect())
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"))
    host, path = host_and_path(F.col("url"))
    # Equal urls are looked up once, so a hot url or host costs one row per task.
    urls = rows.select("url").distinct().select("url", host.alias("host"), path.alias("path"))
    made = [
        F.when(
            (_labels(F.col("host")) >= n) & (F.length("path") >= m),
            F.concat(
                F.substring_index("host", ".", -n), F.substr("path", F.lit(1), F.lit(m))
            ),
        )
        for n, m in shapes
    ]
    all_made = F.array(*made) if made else F.array().cast("array<string>")
    expressions = urls.select("url", F.explode(F.array_compact(all_made)).alias("expression"))
    digest = F.sha2("expression", 256)
    hashed = expressions.select("url", digest.alias("digest")).withColumn(
        "prefix", F.substring("digest", 1, PREFIX_DIGITS)
    )
    rule = F.concat("host", "path")
    listed = (
        known.select(
            F.sha2(rule, 256).alias("rule_digest"),
            F.struct(
                F.length(rule).alias("length"),
                F.length("host").alias("host_length"),
                F.col("verdict"),
                rule.alias("rule"),
            ).alias("hit"),
        )
        .groupBy("rule_digest")
        .agg(F.max("hit").alias("hit"))
        .withColumn("prefix", F.substring("rule_digest", 1, PREFIX_DIGITS))
    )
    hits = (
        hashed.join(listed, "prefix")
        .where(F.col("digest") == F.col("rule_digest"))
        .groupBy("url")
        .agg(F.max("hit").alias("hit"))
    )
    return rows.join(hits, "url", "left").select(
        "page_id",
        "url",
        host.alias("host"),
        path.alias("path"),
        F.col("hit.rule").alias("rule"),
        F.coalesce("hit.verdict", F.lit(default)).alias("verdict"),
    )
