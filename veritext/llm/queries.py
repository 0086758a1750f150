"""Registered queries of this subpackage, with production parameters over
the whole tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, conversation_repair, embed_dedup, exact_dedup, html_extract, line_dedup, mixing, ngram_join,
               periodic_runs, quality, substring_dedup, suffix_dedup, url_filter)
from .common import table

BPE_FILE = "byte_bpe_multi_50k.tiktoken"


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
                      F.size("span_starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)


def op8_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embed_dedup(table(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE),
                                public_tokenizers.PATTERN)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.kept_texts(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with the faults of the contract, by crc32(`conv_id:turn`) % 20."""
    spaced = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(spaced["conv_id"], F.lit(":"), spaced["turn"])) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(spaced["text"], ".!?", "")).otherwise(spaced["text"])
    copies = F.when(kind == 3, 2).otherwise(1)
    return conversations.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(spaced["role"]).alias("role"), text.alias("text"),
        F.explode(F.sequence(F.lit(1), copies)).alias("copy")).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    repair = conversation_repair.Repair(damaged(conversations))
    every = conversations.select("conv_id").distinct()
    out = every.join(repair.summary(), F.col("conv_id").eqNullSafe(F.col("conv")), "left").drop("conv")
    out = out.join(repair.digests(), F.col("conv_id").eqNullSafe(F.col("conv")), "left").drop("conv")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("conv_id", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def planted_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: a tenth of the documents repeat from word ``a`` on
    with period ``p``, both derived from the id; the others are unchanged."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    # a generated column: the words are cut once a row, not once a word
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.explode(F.array(words)).alias("words"))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.expr("if(n > 0, g % n, 0)"))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    repeated = F.expr("array_join(transform(words, (w, i) -> if(i < a, w, get(words, cast(a + (i - a) % p as int)))), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.periodic_runs(planted_periods(table(spark, sf_dir, "documents")))
    # runs come by start, then period: the first of those with the largest length / period
    best = F.expr("aggregate(runs, get(runs, 0), (best, r) -> "
                  "if(r.length * best.period > best.length * r.period, r, best))")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    out = out.select(F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                     F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                      F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                      "runs_sha256", "collapsed_sha256")


SQL = {
    "op2_mixing": r"""
        WITH sizes AS (
          SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
          FROM documents),
        sources AS (
          SELECT source, source_size, 2.0::DOUBLE * source_size AS cap, CASE (row_number() OVER (
            ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
          FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source)),
        levels AS (
          SELECT *, cap / weight AS ratio,
            (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
          FROM sources),
        targets AS (
          SELECT source, source_size,
            least(cap, (SELECT arg_min(level, ratio) FROM levels WHERE level <= ratio) * weight) AS target
          FROM levels),
        due AS (
          SELECT s.*, source_size, target,
            CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS due,
            (('0x' || substr(md5('mix:' || doc_id), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE AS u
          FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
        parts AS (
          SELECT *, floor(due) AS certain, due - floor(due) AS f, target - floor(due) * source_size AS budget FROM due),
        odds AS (
          SELECT *, CASE WHEN f > 0 THEN u / (1 - u) / (f / (1 - f)) END AS odds FROM parts),
        upto AS (
          SELECT *, CASE WHEN f > 0 THEN sum(size) OVER (PARTITION BY source, f > 0 ORDER BY odds, doc_id) END AS upto
          FROM odds),
        missing AS (
          SELECT *, coalesce(upto <= budget, false) AS reached,
            budget - max(CASE WHEN upto <= budget THEN upto ELSE 0 END) OVER (PARTITION BY source) AS missing
          FROM upto),
        last AS (
          SELECT *, row_number() OVER (PARTITION BY source ORDER BY (f > 0 AND NOT reached) DESC,
            abs(size - missing), odds, doc_id) = 1 AND f > 0 AND NOT reached AND abs(size - missing) < missing AS last
          FROM missing)
        SELECT doc_id, size, source_size, target,
          ((certain + CASE WHEN reached OR last THEN 1 ELSE 0 END) * size)::BIGINT AS taken,
          (certain + CASE WHEN reached OR last THEN 1 ELSE 0 END)::INT AS copies
        FROM last""",
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op11_line_dedup": r"""
        WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        lines AS (
          SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split),
        keyed AS (
          SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
        common AS (
          SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
        judged AS (SELECT k.*, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY doc_id""",
}


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_mixing, op3_ngram_join, op4_exact_dedup, op5_substring_dedup,
                                   op6_html_extract, op7_url_filter, op8_embed_dedup, op9_quality, op10_bpe, op11_line_dedup,
                                   op12_conversation_repair, op13_periodic_runs)}


def all_sql() -> dict[str, str]:
    return SQL
