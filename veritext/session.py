"""Session helpers: a tuned local session for tests/bench and the
checkpoint-directory rule (read the cluster's setting, set our own only
where none is configured)."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def get_spark(master: str | None = None, partitions: int | None = None,
              app: str = "veritext") -> SparkSession:
    """Return the active session or build a local one tuned for small runs.

    On a cluster the launcher sets the master and the sizes; they are kept.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    if "PYSPARK_GATEWAY_PORT" in os.environ and master is None:  # set by spark-submit
        return SparkSession.builder.appName(app).getOrCreate()
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    master = master or f"local[{cpus}]"
    partitions = partitions or cpus
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("VERITEXT_DRIVER_MEM", "16g"))
        # broadcast only what is proven small: keep Spark's own size check
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only when it is unset
    under a local master (tests, bench) point it at a fresh scratch folder.
    Non-local masters without the setting fail instead of checkpointing to
    a machine-local disk."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        # a machine-local folder would vanish with its executor: on a cluster
        # the shared checkpoint folder must come from the session's config
        raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder (HDFS/S3/...)")
    path = tempfile.mkdtemp(prefix="veritext-ckpt-")
    sc.setCheckpointDir(path)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut_lineage(df):
    """Reliable checkpoint (survives executor loss), never localCheckpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """Write ``df`` once as Parquet below ``spark.checkpoint.dir`` and read it
    back: the lineage ends there, a lost executor re-reads files, consumers
    prune columns, and nothing stays in executor memory.  ``schema`` may name
    a user-defined type where ``df`` has the type's stored form (a vector is
    stored as a struct of size, indices and values)."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)
