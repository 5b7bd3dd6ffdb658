"""URL filters: the longest rule (host, path) that fits a URL decides; native DataFrame functions only.

Method: a URL is expanded into host-suffix and path-prefix expressions, as many as rules can have
(suffixes up to the most labels of a rule, prefixes of the lengths that rule paths have). They meet the rules on
the first four bytes of their SHA-256; the whole digest confirms. Of the rules that fit the longest
wins, then the one with the longer host, then block.

Rules are broadcast up to `broadcast_rules` of them. Beyond that both sides are shuffled on the short
hash and a salt of the page, so that an expression that a third of all URLs have (`com/`) is read by many tasks.

Cases: null URLs and those without :// have an empty host and path, fit no rule and get the
default; user info and ports belong to the host, as the text before / says; repeated rows each keep a row; repeated rules count once; no
rules: all get the default; other columns of the input stay out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_RULES, SALTS = 100_000, 64


def host_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(_after(url), r"\A([^/?#]*)", 1), UPPER, LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(_after(url), r"\A[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def _after(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def _expressions(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """Structs (host, path) of what a rule for this URL can be."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda i: F.array_join(F.slice(parts, F.size(parts) - i + 1, i), "."))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("h"), p.alias("p")))))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """One row per row of pages(page_id, url): page_id, host, path, rule, verdict. rules(host, path, verdict): paths begin with / or are empty."""
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    rules = rules.where("rule_host is not null and rule_verdict is not null").distinct().withColumn("rule", F.concat("rule_host", "rule_path"))
    rules = rules.withColumn("digest", F.sha2("rule", 256)).withColumn("short", F.substring("digest", 1, 8))
    # The lengths of rule paths are as few as the longest path has characters.
    shape = rules.agg(F.count("*").alias("n"), F.max(F.size(F.split("rule_host", r"\."))).alias("labels"), F.collect_set(F.length("rule_path")).alias("lengths")).first()
    seen = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not shape["n"]:
        return seen.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    each = seen.withColumn("e", F.explode_outer(_expressions(F.col("host"), F.col("path"), shape["labels"], sorted(shape["lengths"]))))
    each = each.withColumn("full", F.sha2(F.concat("e.h", "e.p"), 256)).withColumn("start", F.substring("full", 1, 8)).drop("e")
    fits = (F.col("start") == F.col("short")) & (F.col("full") == F.col("digest"))
    if shape["n"] <= broadcast_rules:
        met = each.join(F.broadcast(rules), fits, "left")
    else:
        salted = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = each.withColumn("page_salt", F.pmod("row", F.lit(SALTS))).join(salted, fits & (F.col("page_salt") == F.col("salt")), "left")
    rank = F.struct(F.length("rule").alias("long"), F.length("rule_host").alias("wide"), F.col("rule_verdict").alias("verdict"), F.col("rule").alias("rule"))
    best = met.groupBy("row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(F.when(F.col("rule").isNotNull(), rank)).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
