"""URL filters by hashed expressions.

A rule is a host, a path and an action. It fits a URL whose host is the rule's or a subdomain of it and whose path
starts with the rule's. Each URL expands into expressions: a suffix of its host, in whole labels, and a prefix of its
path, of the label counts and path lengths that rules have. Distinct expressions are joined to the rules on the first
PREFIX_BYTES of their SHA-256, where the rules of a prefix are one row; then the full digests are compared, and what
matched goes back to the URLs.

The longest fitting rule wins (host and path together, in characters; then the longer host; then block over allow).
A URL that no rule fits is allowed. Null URLs and those without `://` have an empty host and path. URLs of any length
are judged whole; what one expands to is bounded by the rules' label counts and path lengths. Rows are judged one by
one, so repeated page_ids are fine. Only the two named columns of pages are read, whatever the names of others. An empty
table gives an empty result; empty rules allow everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stash, ascii_lower, unhot_join

PREFIX_BYTES = 4


def prefix_of(digest: Column) -> Column:
    """The first bytes of a digest, as a number."""
    return F.conv(F.substring(F.hex(digest), 1, 2 * PREFIX_BYTES), 16, 10).cast("long")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("_url")))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict. rules: host, path, action."""
    parsed = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url"))
    host, path = host_and_path(F.col("_url"))
    rows = Stash(parsed.select("page_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("_row")), "url-parts").df
    rules = rules.select(ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), F.col("action").alias("r_action")).distinct()
    rules = rules.withColumn("rule", F.concat("r_host", "r_path"))
    shapes = rules.agg(F.collect_set(F.size(F.split("r_host", "\\."))), F.collect_set(F.char_length("r_path"))).first()
    labels = F.split("host", "\\.")
    hosts = F.filter(F.array(*(F.when(F.size(labels) >= n, F.array_join(F.slice(labels, -n, n), ".")) for n in sorted(shapes[0]))), lambda x: x.isNotNull())
    paths = F.filter(F.array(*(F.when(F.char_length("path") >= n, F.substring("path", 1, n)) for n in sorted(shapes[1]))), lambda x: x.isNotNull())
    if shapes[0]:
        expressions = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))
    else:
        expressions = F.array().cast("array<string>")
    digests = rows.select("_row", F.explode(expressions).alias("_expression")).select("_row", F.unhex(F.sha2("_expression", 256)).alias("_digest"))
    expanded = Stash(digests, "url-expressions").df
    counted = expanded.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n")).withColumn("_prefix", prefix_of(F.col("_digest")))
    rank = F.struct(F.char_length("rule").alias("length"), F.char_length("r_host").alias("host"), F.when(F.col("r_action") == "block", 1).otherwise(0).alias("block"), F.col("rule").alias("rule"), F.col("r_action").alias("action"))
    full = F.unhex(F.sha2("rule", 256))
    listed = rules.groupBy(prefix_of(full).alias("_prefix")).agg(F.collect_list(F.struct(full.alias("full"), rank.alias("rank"))).alias("_rules"))
    # All rules of a prefix come along, and only those of the same digest count.
    met = counted.join(listed, "_prefix").select("_digest", "_n", F.explode(F.filter("_rules", lambda r: r["full"] == F.col("_digest"))).alias("_hit"))
    best = Stash(met.groupBy("_digest").agg(F.max("_hit.rank").alias("_rank"), F.max("_n").alias("_n")), "url-hits").df
    total = best.agg(F.sum("_n")).first()[0] or 0
    won = unhot_join(expanded, best, "_digest", "_n", total).groupBy("_row").agg(F.max("_rank").alias("_rank"))
    return rows.join(won, "_row", "left").select("page_id", "host", "path", F.col("_rank.rule").alias("rule"), F.coalesce("_rank.action", F.lit(default)).alias("verdict"))
