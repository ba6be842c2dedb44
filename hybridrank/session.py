"""Session helpers: a local session for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "hybridrank") -> SparkSession:
    """A local session configured the way the library expects (AQE on, UI off)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("HYBRIDRANK_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder; set a scratch one only when none is configured.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS/S3/...). We never replace it;
    only in local runs without any setting do we fall back to a fresh temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="hybridrank-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def materialize(df):
    """Write ``df`` once as Parquet to the shared checkpoint folder and return a DataFrame reading it back.

    The data survive the loss of executors and the lineage is cut, so later stages do not recompute
    the inputs; columnar files, so later reads prune columns.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_bucketed(df, path: str, key: str, buckets: int) -> None:
    """Write ``df`` as Parquet at ``path``, a file per bucket of ``key`` when it is partitioned by it.

    The bucketing goes through a table name of its own, which is dropped again; the files stay.
    """
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", path).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")


def read_bucketed(spark: SparkSession, path: str, columns: str, key: str, buckets: int):
    """Files of :func:`write_bucketed` as a DataFrame that needs no shuffle to group by ``key``."""
    name = f"bucketed_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the DataFrame keeps the files and their bucketing
    return table
