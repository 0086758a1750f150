"""URL filter by association rules (DataFrame functions and Spark's FP-growth).

Labelled urls become transactions: their tokens and, for unwanted ones, the
item ``!block``.  FP-growth finds the frequent combinations; the rules
``tokens -> !block`` of enough confidence and lift stay, but not one that a
rule on fewer of its tokens matches at no less confidence.  An inverted index
(a rule's rarest token -> rule) finds the rules all of whose tokens a url holds.  Given rules
(host, path) come first: the longest that fits decides.

Defined results: a null url, or one without ``://``, has an empty host and path
and no tokens: the method allows it; without labelled urls nothing is blocked
by the method; labels that are null don't count; repeated rows each give a row;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

BLOCK = "!block"
MIN_URLS = 20  # unwanted urls that must hold a combination, whatever the number of labelled ones
MIN_CONFIDENCE = 0.5
MIN_LIFT = 1.5


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    empty = url.isNull() | (at == 0)
    return F.when(empty, "").otherwise(host), F.when(empty, "").otherwise(path)


def url_tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens: host labels (with the registered part as a whole),
    path words, keys of the query."""
    labels = F.split(host, r"\.")
    words = F.split(F.lower(path), r"[/._~-]+")
    keys = F.regexp_extract_all(url, F.lit(r"[?&]([^=&#]+)="), F.lit(1))
    named = [F.transform(F.filter(a, lambda x: x != ""), lambda x, p=p: F.concat(F.lit(p), x))
             for p, a in (("host:", labels), ("path:", words), ("key:", keys))]
    whole = F.array(F.concat(F.lit("site:"), host))
    tokens = F.array_distinct(F.concat(whole, *named))
    return F.when((host == "") | url.isNull(), F.array().cast("array<string>")).otherwise(tokens)


def mine(labelled: DataFrame, min_urls: int = MIN_URLS, min_confidence: float = MIN_CONFIDENCE,
         min_lift: float = MIN_LIFT) -> DataFrame:
    """``rule, items, confidence, support`` from ``tokens, unwanted``."""
    spark = labelled.sparkSession
    labelled = written(labelled.where(F.size("tokens") > 0).withColumn("row", F.monotonically_increasing_id()))
    n = labelled.count()
    schema = "rule long, items array<string>, confidence double, support double"
    if n < min_urls:
        return spark.createDataFrame([], schema)
    # all tokens of a rule are in min_urls unwanted urls: others need no mining
    tokens = labelled.select("row", "unwanted", F.explode("tokens").alias("token"))
    able = tokens.where("unwanted").groupBy("token").count().where(F.col("count") >= min_urls).select("token")
    held = tokens.join(able, "token").groupBy("row").agg(F.collect_list("token").alias("held"))
    items = F.coalesce("held", F.array().cast("array<string>"))
    rows = labelled.join(held, "row", "left").select(F.when(
        F.col("unwanted"), F.array_append(items, F.lit(BLOCK))).otherwise(items).alias("items"))
    # the half keeps the product with n, rounded up, at min_urls
    growth = FPGrowth(itemsCol="items", minSupport=(min_urls - 0.5) / n, minConfidence=min_confidence)
    found = growth.fit(rows).associationRules.where(
        (F.col("consequent")[0] == BLOCK) & (F.col("lift") >= min_lift))
    rules = found.select(F.array_sort("antecedent").alias("items"), "confidence", "support")
    rules = written(rules.withColumn("rule", F.xxhash64("items")).select("rule", "items", "confidence", "support"))
    # a rule is idle if one on a part of its items is as sure
    part = keyed(rules).select("key", F.col("items").alias("some"), F.col("confidence").alias("as_sure"))
    idle = (rules.select("rule", "items", "confidence", F.explode("items").alias("key")).join(part, "key")
            .where((F.size("some") < F.size("items")) & holds("items", "some") & (F.col("as_sure") >= F.col("confidence"))))
    return written(rules.join(idle.select("rule").distinct(), "rule", "left_anti"))


def holds(items: str, needs: str) -> Column:
    return F.size(F.array_except(needs, items)) == 0


def keyed(rules: DataFrame) -> DataFrame:
    """``rules`` with ``key``: of a rule's items the one that fewest rules hold.
    Thousands of rules under one common item are listed under their own."""
    item = rules.select("rule", F.explode("items").alias("item"))
    counts = item.groupBy("item").agg(F.count("*").alias("n"))
    key = item.join(counts, "item").groupBy("rule").agg(F.min(F.struct("n", "item")).alias("k"))
    return written(rules.join(key, "rule").withColumn("key", F.col("k.item")).drop("k"))


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``row, best`` for the rows whose tokens hold all items of a rule: the
    index finds the rules of a token, the other items are tested in the row."""
    index = keyed(rules).select("key", "rule", F.col("items").alias("needs"), "confidence", "support")
    hits = (urls.select("row", "tokens", F.explode("tokens").alias("key")).join(index, "key")
            .where(holds("tokens", "needs")))
    return hits.groupBy("row").agg(F.max(F.struct("confidence", "support", "rule")).alias("best"))


def given_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest (verdict, host, path) rule that fits."""
    text = verdict = F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = F.when(fits, rule_host + rule_path).otherwise(text)
        verdict = F.when(fits, what).otherwise(verdict)
    return text, verdict


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id",
                url_col: str = "url", label_id_col: str = "doc_id", **limits) -> DataFrame:
    """``page_id, host, path, rule, verdict`` per row; ``labels`` (id, quality,
    toxic) mark a page of that id as unwanted when its quality is 0 or it is
    toxic."""
    host, path = parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"),
                        url_tokens(host, path, F.col(url_col)).alias("tokens"))
    unwanted = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    marks = (labels.where(F.col("quality").isNotNull() | F.col("toxic").isNotNull())
             .groupBy(F.col(label_id_col).alias("page_id")).agg(F.max(unwanted).alias("unwanted")))
    found = mine(rows.join(marks, "page_id").select("tokens", "unwanted"), **limits)
    # the same tokens get the same verdict: match each set of them once
    rows = rows.withColumn("row", F.sha2(F.concat_ws("\n", F.array_sort("tokens")), 256))
    sites = rows.select("row", "tokens").where(F.size("tokens") > 0).dropDuplicates(["row"])
    best = matched(sites, found).select(F.col("row"), F.lit("block").alias("learned"))
    text, verdict = given_rule(F.col("host"), F.col("path"), rules)
    return rows.join(best, "row", "left").select(
        "page_id", "host", "path", text.alias("rule"),
        F.coalesce(verdict, F.col("learned"), F.lit("allow")).alias("verdict"))
