import os

from pyspark.sql import functions as F


def _has_repartition(df):
    return "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()


def test_spread_only_thin_scans(spark, tmpdir_path):
    from veritext.sources.tables import spread
    cores = spark.sparkContext.defaultParallelism
    wide = os.path.join(tmpdir_path, "wide")
    spark.range(0, 4000, numPartitions=cores * 2).withColumn("text", F.lit("aa bb")).write.parquet(wide)
    thin = os.path.join(tmpdir_path, "thin")
    spark.range(0, 4000, numPartitions=1).withColumn("text", F.lit("aa bb")).write.parquet(thin)
    w = spread(spark.read.parquet(wide), ["id"], bytes_per_task=1)
    t = spread(spark.read.parquet(thin), ["id"], bytes_per_task=1)
    assert not _has_repartition(w)          # enough splits: no extra shuffle
    assert _has_repartition(t) and t.rdd.getNumPartitions() == cores   # capped at one per core
    assert sorted(r.id for r in t.select("id").collect()) == list(range(4000))
    # a small table is not blown up into one task per core
    assert not _has_repartition(spread(spark.read.parquet(thin), ["id"]))


def test_checkpoint_dir_is_read_from_session(spark):
    from veritext.session import ensure_checkpoint_dir
    configured = spark.conf.get("spark.checkpoint.dir")
    assert ensure_checkpoint_dir(spark) == configured


def test_checkpoint_dir_required_on_a_cluster():
    """A non-local master without spark.checkpoint.dir must fail rather than
    checkpoint to a machine-local folder."""
    import pytest

    from veritext.session import ensure_checkpoint_dir

    class _Conf:
        def get(self, key, default=None):
            return default

    class _Sc:
        master = "yarn"

        def getConf(self):
            return _Conf()

        def setCheckpointDir(self, path):
            raise AssertionError("must not set a folder")

    class _Spark:
        sparkContext = _Sc()
        conf = _Conf()

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(_Spark())
