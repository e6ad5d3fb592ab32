"""Session helpers: tuned local sessions and fault-tolerant lineage cuts."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "histomesh", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benches; clusters bring their own session."""
    n = os.cpu_count() if cpus == "*" else int(cpus)
    settings = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.driver.host": "127.0.0.1",
    }
    settings.update(conf)
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, setting one only when the cluster named none.

    The folder comes from ``spark.checkpoint.dir`` (a shared path on a cluster). A private
    temporary folder is used under a ``local[...]`` master only; elsewhere (also ``local-cluster``) an unset folder is an error, since
    a machine-local path would be lost with its executor.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="histomesh-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and continue from the written table.

    Cuts the lineage there: a lost executor re-reads files instead of recomputing earlier rounds.
    The table is columnar, so later steps read only the columns they use. It is removed when the
    application ends, or by ``release`` once nothing reads it any more.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the tables that ``durable`` wrote for ``frames``.

    Only for frames whose successors are written: whatever is still to be computed from them fails.
    Frames that ``durable`` did not return are left alone. The driver's garbage is collected then, by
    which Spark drops the shuffle files of plans that nothing refers to any more.
    """
    for df in frames:
        path = getattr(df, "_stored_at", None)
        if path:
            spark = df.sparkSession
            hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
    gc.collect()
    for df in frames[:1]:
        df.sparkSession._jvm.System.gc()


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash-partition by ``keys`` with the session's full shuffle width.

    For steps that do much work per byte (each row meets a hundred others): adaptive execution
    would merge their small partitions by size, an explicit width keeps it from doing that.
    """
    spark = df.sparkSession
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(width, *keys)
