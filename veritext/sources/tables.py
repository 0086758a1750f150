"""Driver-table bindings: the parquet tables play the roles of the
original corpora (see FIXTURES.md section C)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import BINARY_NAMES, name_for_id


# Row keys of the tables whose per-row work is CPU-heavy (regex cleaning,
# tokenising, distance evaluation).
SPREAD_KEYS = {"documents": ["doc_id"], "pages": ["page_id"], "conversations": ["conv_id", "turn"],
               "benchmark": ["item_id"], "embeddings": ["vec_id"]}


def read_table(spark: SparkSession, sf_dir: str, name: str, most_bytes: int | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    keys = SPREAD_KEYS.get(name)
    return spread(df, keys, most_bytes=most_bytes) if keys else df


SPREAD_BYTES = 2 * 1024 * 1024  # stored (compressed) input per task for CPU-heavy text work
TERM_BYTES = 16 * 1024 * 1024  # stored text per task where a task holds the counts of its terms


def spread(df: DataFrame, keys: list[str], bytes_per_task: int = SPREAD_BYTES,
           most_bytes: int | None = None) -> DataFrame:
    """Give CPU-heavy per-row work enough tasks.  A scan with at least as
    many splits as the cluster has cores (any large table) is returned
    untouched: no extra shuffle, no file listing.  A thin scan (few files or
    row groups) is hash-partitioned by its row key (deterministic under task
    retries) into ``ceil(stored bytes / bytes_per_task)`` partitions, at most
    one per core, so a small table on a big cluster does not turn into
    thousands of empty tasks.  With ``most_bytes`` no task gets more stored
    input than that, at any size of the table."""
    from .fs import total_bytes
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    if splits >= cores and most_bytes is None:
        return df
    size = total_bytes(df.sparkSession, df.inputFiles())
    parts = min(cores, max(1, -(-size // bytes_per_task)))
    if most_bytes is not None:
        parts = max(parts, -(-size // most_bytes))
    return df.repartition(parts, *keys) if parts > splits else df


def labelled_corpus(spark: SparkSession, sf_dir: str, scheme: str = "binary") -> DataFrame:
    """Corpus contract ``doc_id, text, label, label_id, source, lang``.

    ``binary``: label_id = quality (0 fake, 1 true); ``quad``: quality*2+toxic.
    documents and labels both grow with the data, so this is a plain
    equi-join on doc_id (sort-merge / AQE-chosen), never a forced broadcast.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return (docs.join(label_rows(spark, sf_dir, scheme), "doc_id")
                .where(F.col("text").isNotNull()))


def label_rows(spark: SparkSession, sf_dir: str, scheme: str = "binary") -> DataFrame:
    """(doc_id, label_id, label) of the labelled documents."""
    labels = read_table(spark, sf_dir, "labels")
    if scheme == "binary":
        lid = F.col("quality")
        names = BINARY_NAMES
    elif scheme == "quad":
        lid = F.col("quality") * 2 + F.col("toxic")
        names = {0: "low", 1: "low_toxic", 2: "high", 3: "high_toxic"}
    else:
        raise ValueError(scheme)
    lab = labels.select("doc_id", lid.cast("int").alias("label_id")).where(F.col("label_id").isNotNull())
    return lab.withColumn("label", name_for_id("label_id", names))


# The prediction-table fixture on lineitem.
LINESTATUS_TO_FLAG = {"F": "A", "O": "N"}
RETURNFLAG_CLASSES = ["A", "N", "R"]


def prediction_table_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large prediction table: true = l_returnflag, pred = mapped l_linestatus.
    'R' is never predicted, which exercises zero division."""
    li = read_table(spark, sf_dir, "lineitem")
    m = F.create_map(*[x for k, v in LINESTATUS_TO_FLAG.items() for x in (F.lit(k), F.lit(v))])
    return li.select(
        F.col("l_orderkey"), F.col("l_linenumber"),
        F.col("l_returnflag").alias("true_label"),
        F.element_at(m, F.col("l_linestatus")).alias("pred_label"),
    )


def prediction_table_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text prediction table: true = quality, pred = toxic, over labelled docs.
    Length features are computed on the document side, before the join."""
    from ..functions.text import char_length, word_count
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", "text", char_length("text").alias("text_length"), word_count("text").alias("word_count"))
    labels = read_table(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").cast("int").alias("true_id"),
        F.col("toxic").cast("int").alias("pred_id"))
    return docs.join(labels, "doc_id")
