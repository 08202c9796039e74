"""Spark session and lineage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def get_spark(master: str | None = None, app: str = "curata", shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume.

    AQE is on so that joins against tables of unknown size (memory, store) become broadcast
    joins only after the runtime size is measured below ``autoBroadcastJoinThreshold``,
    and skewed shuffle partitions are split.
    """
    master = master or os.environ.get("CURATA_MASTER", "local[*]")
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CURATA_DRIVER_MEMORY", "16g"))
    )
    if shuffle_partitions is not None:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set (a shared file system such as HDFS or an object store); only a
    single-process local master falls back to a fresh scratch folder, which is what tests use.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")
        conf = tempfile.mkdtemp(prefix="curata-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared checkpoint folder and read it back.

    One job per cut (a reliable ``checkpoint()`` computes the plan twice unless cached), and the
    files live on the shared file system, so a lost executor never forces recomputation of earlier
    rounds. Never ``localCheckpoint``.
    """
    path = new_path(df.sparkSession)
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.parquet(path)


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """:func:`cut_lineage`, and the number of rows, observed in the pass that writes them."""
    seen = Observation()
    out = cut_lineage(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


def new_path(spark: SparkSession) -> str:
    """A path in the shared checkpoint folder that nothing uses yet."""
    return f"{checkpoint_dir(spark).rstrip('/')}/curata-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that :func:`new_path` named, once no DataFrame in use reads it."""
    if not path.rstrip("/").rsplit("/", 1)[-1].startswith("curata-"):
        raise ValueError(f"not one of this library's tables: {path}")
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
