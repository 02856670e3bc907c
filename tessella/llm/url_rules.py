"""URL filters: written rules first, then association rules mined from labelled URLs.

Everything here is a DataFrame expression; FP-growth is Spark's own.  URL
tokens are all labels of the host, all segments of the path, the file
extension and all keys of the query.  Labels are given by the caller, or are
the verdicts of the written rules on the pages that they fit: what is mined
then carries these verdicts on to pages that share tokens with them.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.plans.store import Scratch

# The list of the contract, as (verdict, host/path).
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule whose host is the URL's or a parent of it and whose path begins the URL's, as struct(rule, verdict); else null.

    ``rules`` is a list in the program, so that its size is bounded by it; of
    equally long ones the first counts.
    """
    out = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of a URL, sorted: host labels by their place from the right, path segments by their place from the left, the extension, the keys of the query; runs of digits count as 0."""
    plain = lambda x: F.regexp_replace(x, r"[0-9]+", "0")
    named = lambda kind: lambda x, i: F.when(x != "", F.concat(F.lit(kind), i.cast("string"), F.lit("="), plain(x)))
    labels = F.transform(F.reverse(F.split(host, r"\.")), named("h"))
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), named("p"))
    ext = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.when(F.substring_index(x, "=", 1) != "", F.concat(F.lit("q="), plain(F.substring_index(x, "=", 1)))))
    single = F.array(F.when(ext != "", F.concat(F.lit("x="), ext)))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(labels, segments, single, keys))))


def representatives(labelled: DataFrame, least: int) -> DataFrame:
    """token, name: tokens of at least ``least`` labelled rows; of tokens that stand in the very same rows all have the name of the first.

    A rule that holds for one of them holds for all, so that FP-growth needs
    only one; else n of them, such as the parts of one long path, would make
    2**n itemsets.  Rows are told apart by sums of hashes.  As each token
    stands in the support's share of the rows, there are at most (tokens of a
    row) / support of them, whatever the number of rows.
    """
    sets = labelled.groupBy("items", "verdict").agg(F.count("*").alias("n"))
    each = sets.select(F.explode("items").alias("token"), "n", F.xxhash64("items", "verdict").cast("decimal(38,0)").alias("h"))
    seen = each.groupBy("token").agg(F.sum("n").alias("n"), F.sum("h").alias("h")).where(F.col("n") >= least)
    first = seen.groupBy("n", "h").agg(F.min("token").alias("name"))
    return seen.join(first, ["n", "h"]).select("token", "name")


def renamed(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows (items, ...) with items as names; tokens without one are left out.  The names, a bounded number, come in one broadcast row."""
    one = F.broadcast(names.agg(F.map_from_entries(F.collect_list(F.struct("token", "name"))).alias("names")))
    known = F.array_compact(F.transform("items", lambda x: F.try_element_at("names", x)))
    return rows.crossJoin(one).withColumn("items", F.array_sort(F.array_distinct(known))).drop("names")


def mine(labelled: DataFrame, scratch: Scratch, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame] | None:
    """labelled: items (tokens) and verdict -> names of tokens, and rules (antecedent, verdict, confidence, support).

    A rule's confidence is the part of the labelled rows with its tokens that
    have its verdict, its support the part of all labelled rows that have
    both.  Rows whose verdict is null are left out.  Without rows of two
    verdicts there is nothing to tell apart, and None is returned.
    """
    known = scratch.keep(labelled.where("verdict is not null"))
    n, verdicts = known.agg(F.count("*"), F.countDistinct("verdict")).first()
    if verdicts < 2:
        return None
    names = scratch.keep(representatives(known, max(1, math.ceil(n * min_support))))
    named = F.concat(F.lit("verdict="), "verdict")
    train = scratch.keep(renamed(known, names).select(F.array_append("items", named).alias("items")))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(train)
    head = F.element_at("consequent", 1)
    found = model.associationRules.where(F.startswith(head, F.lit("verdict=")))
    rules = found.select(F.array_sort("antecedent").alias("antecedent"), F.substring_index(head, "=", -1).alias("verdict"), "confidence", "support")
    return names, scratch.keep(rules)


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, labelled: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """page_id, url -> page_id, host, path, rule, verdict, confidence.

    A URL that a written rule fits has the rule's verdict.  For the others,
    association rules are mined from ``labelled`` (url, verdict or null), or
    from the pages that written rules fit.  They are found by an inverted
    index: each rule stands under its rarest token, a URL's tokens look up
    rules, and those whose tokens the URL has all count; the one of highest
    confidence (then support, then block) decides, else ``default``; confidence
    is null where no mined rule does.

    The lookup works on distinct sets of those tokens that rules have, so that
    a host with most of the pages costs few rows.  Null and malformed URLs have
    empty host and path and get ``default`` unless a rule fits; repeated rows
    stay; other columns are ignored; an empty table gives an empty table.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    host, path = host_and_path(F.col("url"))
    read = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    read = read.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    read = read.withColumn("items", tokens(F.col("host"), F.col("path"), F.coalesce("url", F.lit(""))))
    read = scratch.keep(read.select("page_id", "host", "path", "fit", "items"))
    if labelled is None:
        train = read.select("items", "fit.verdict")
    else:
        h, p = host_and_path(F.col("url"))
        train = labelled.select(tokens(h, p, F.coalesce("url", F.lit(""))).alias("items"), "verdict")
    mined = mine(train, scratch)
    if mined is None:
        return read.select("page_id", "host", "path", "fit.rule", F.coalesce("fit.verdict", F.lit(default)).alias("verdict"), F.lit(None).cast("double").alias("confidence"))
    names, found = mined
    used = found.select(F.explode("antecedent").alias("name")).distinct()
    read = renamed(read, names.join(F.broadcast(used), "name", "left_semi"))
    sets = scratch.keep(read.where("fit is null").select("items").distinct())
    frequency = found.select(F.explode("antecedent").alias("token")).groupBy("token").count()
    under = found.withColumn("id", F.monotonically_increasing_id()).select("*", F.explode("antecedent").alias("token")).join(frequency, "token")
    index = under.groupBy("id").agg(F.min_by("token", F.struct("count", "token")).alias("token"), *[F.first(c).alias(c) for c in ("antecedent", "verdict", "confidence", "support")])
    looked = sets.select("items", F.explode("items").alias("token")).join(index.drop("id"), "token").where(F.size(F.array_except("antecedent", "items")) == 0)
    order = F.struct("confidence", "support", F.col("verdict") == "block")
    best = scratch.keep(looked.groupBy("items").agg(F.max_by(F.struct("verdict", "confidence"), order).alias("mined")))
    out = read.join(best.withColumnRenamed("items", "key"), read["items"] == F.col("key"), "left")
    by_method = F.when(F.col("fit").isNull(), F.col("mined.confidence"))
    verdict = F.coalesce("fit.verdict", "mined.verdict", F.lit(default))
    return out.select("page_id", "host", "path", "fit.rule", verdict.alias("verdict"), by_method.alias("confidence"))
