"""URL rules by host suffix and path prefix, looked up by short digests.

Rules and urls meet in an equi-join: a url is expanded into the (host suffix,
path directory) pairs whose shape some rule has, a rule has one such pair, and
both are joined on the first 32 bits of the pair's SHA-256. The whole digest
and the rule's own path then confirm the hit; the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of the digest that the join compares.
_PREFIX = 8


def url_host(url: Column) -> Column:
    """From the first `://` to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; empty without `://`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def _slashes(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def _digest(host: Column, directory: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), directory).cast("binary"), 256)


def _rule_keys(rules: DataFrame) -> DataFrame:
    """One row a rule: its digest and what decides between rules. Rules without a host fit nothing."""
    host = F.translate(F.coalesce(F.col("host"), F.lit("")), _UPPER, _LOWER)
    path = F.coalesce(F.col("path"), F.lit(""))
    kept = rules.select(host.alias("r_host"), path.alias("r_path"), F.col("verdict").alias("r_verdict"))
    kept = kept.filter(F.col("r_host") != "").withColumn("r_depth", _slashes(F.col("r_path")))
    directory = F.regexp_extract("r_path", r"(?s)\A(.*/)?", 1)
    return kept.select(
        "*",
        F.size(F.split("r_host", r"\.", -1)).alias("r_labels"),
        _digest(F.col("r_host"), directory).alias("r_digest"),
    )


def filter_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """Every page with host, path, the winning rule (or null) and the verdict.

    `rules` has host, path, verdict (`allow` or `block`). A rule fits its host
    and all subdomains if the url's path starts with the rule's path; the
    longest rule wins, of equally long ones that with the longer host, then
    `block`. A url that no rule fits gets `default`. Null urls and urls without
    `://` have empty host and path and fit no rule. Pages repeat as given;
    an empty table gives an empty result, an empty rule table the default
    everywhere. Other columns of the pages are neither read nor returned.

    The join sees each distinct url once, so a url or host that fills a third
    of the table weighs no more than any other. Only the rules' shapes (labels
    and slashes, as pairs of numbers) come to the driver, never the rules.
    """
    rules = _rule_keys(rules)
    shapes = sorted((r[0], r[1]) for r in rules.select("r_labels", "r_depth").distinct().collect())
    listed = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("_url"))
    urls = listed.filter(F.col("_url").contains("://")).select("_url").distinct()
    parts = urls.select("_url", url_host(F.col("_url")).alias("_h"), url_path(F.col("_url")).alias("_p"))
    parts = parts.withColumns({"_labels": F.split("_h", r"\.", -1), "_depth": _slashes(F.col("_p"))})
    expressions = [
        F.when(
            (F.size("_labels") >= labels) & (F.col("_depth") >= depth),
            _digest(
                F.substring_index("_h", ".", -labels),
                F.concat(F.substring_index("_p", "/", depth), F.lit("/")) if depth else F.lit(""),
            ),
        )
        for labels, depth in shapes
    ]
    keys = F.array_compact(F.array(*expressions)) if expressions else F.array().cast("array<string>")
    expanded = parts.select("_url", "_p", F.explode(keys).alias("_digest"))
    fits = expanded.join(
        rules,
        (F.substring("_digest", 1, _PREFIX) == F.substring("r_digest", 1, _PREFIX))
        & (F.col("_digest") == F.col("r_digest"))
        & F.startswith(F.col("_p"), F.col("r_path")),
    )
    rank = F.struct(
        (F.length("r_host") + F.length("r_path")).alias("n"),
        F.length("r_host").alias("h"),
        (F.col("r_verdict") == "block").alias("b"),
        F.concat("r_host", "r_path").alias("rule"),
        F.col("r_verdict").alias("verdict"),
    )
    best = fits.groupBy("_url").agg(F.max(rank).alias("_best"))
    return listed.join(best.withColumnRenamed("_url", "_of"), F.col("_url") == F.col("_of"), "left").select(
        "page_id",
        url_host(F.col("_url")).alias("host"),
        url_path(F.col("_url")).alias("path"),
        F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
    )
