"""Incremental corpus ingestion.

New files landing in a directory are cleaned, labelled through the
credibility dimension (stream-static broadcast join: the dimension is a
fixed small table) and appended to a Parquet sink.  ``availableNow`` drains
whatever exists and stops, so the same job serves backfills and schedules.
The checkpoint lives under the session's ``spark.checkpoint.dir`` (shared
storage on a cluster), so a restarted job resumes exactly where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import NELA_3WAY, name_for_id
from ..functions.text import char_length, normalise_source_key, with_clean, word_count
from ..session import ensure_checkpoint_dir

ARTICLE_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()),
    T.StructField("text", T.StringType())])


def clean_stream(stream: DataFrame, dimension: DataFrame) -> DataFrame:
    keyed = stream.withColumn("source_key", normalise_source_key("source"))
    j = keyed.join(dimension, "source_key")
    out = with_clean(j.select("doc_id", "source", "label_id", name_for_id("label_id", NELA_3WAY).alias("label"),
                              "text", char_length("text").alias("text_length")))
    return out.drop("text").withColumn("word_count", word_count("clean_text"))


def start_clean_stream(spark: SparkSession, in_dir: str, out_dir: str, dimension: DataFrame,
                       fmt: str = "parquet", schema: T.StructType = ARTICLE_SCHEMA, name: str = "clean_stream"):
    base = ensure_checkpoint_dir(spark)
    src = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", 64).load(in_dir)
    q = (clean_stream(src, dimension).writeStream.format("parquet")
         .option("checkpointLocation", f"{base.rstrip('/')}/{name}")
         .option("path", out_dir).outputMode("append").trigger(availableNow=True).start())
    return q
