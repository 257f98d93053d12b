"""Session helpers: a local session for tests and a shared scratch location.

On a cluster the session is built by the caller; the library only reads
``spark.checkpoint.dir`` from it.  Where it is unset, a folder under the
session's warehouse is used if that is shared, never over a value the cluster
provides.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "aspectra", warehouse: str | None = None) -> SparkSession:
    """A ``local[cores]`` session configured the way the tests and bench expect."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("ASPECTRA_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if warehouse:
        builder = builder.config("spark.sql.warehouse.dir", warehouse)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the session's ``spark.checkpoint.dir``, else one under the warehouse.

    A warehouse on a store that all machines reach serves on any master.  One on a local file system is
    the driver's own on a cluster, so there a session without ``spark.checkpoint.dir`` is refused.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not conf_dir:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if is_machine_local(warehouse, sc.master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines share: the warehouse {warehouse} is local")
        conf_dir = f"{warehouse}/_checkpoints"
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def is_machine_local(path: str, master: str) -> bool:
    """Whether a path without a shared store's scheme is used on a master with machines of its own."""
    return not master.startswith("local") and (path.startswith("file:") or "://" not in path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a written intermediate table through the Hadoop file system it lives on."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/aspectra-{name}-{uuid.uuid4().hex}"
