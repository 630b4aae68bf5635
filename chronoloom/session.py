"""Session settings and lineage cutting shared by jobs, tests and the benchmark."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that are safe on one machine and on a large cluster.  Partition counts are left
#: to adaptive execution: it starts from an upper bound and merges small partitions.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str | int = "*", app: str = "chronoloom") -> SparkSession:
    """A session for tests and the benchmark; a cluster job brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("CHRONOLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", "8")
        # Small inputs are dense in work per byte: keep all local cores busy.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tuned(spark: SparkSession) -> SparkSession:
    """The same settings on a session that is already there, as on a cluster."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


_LOCAL: dict[str, str | None] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all machines share.

    Where none is set, a local master gets a scratch folder; on a cluster that would be another
    disk on every machine, so it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        # The setting cannot be changed on a running session.
        folder = _LOCAL.setdefault("folder", None) or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        _LOCAL["folder"] = folder
    return folder


def spread(df: DataFrame, pieces: int = 1) -> DataFrame:
    """Use all cores on an input that comes in fewer pieces than there are cores.

    A large input has many pieces and passes unchanged; only a small one is dealt out.  Where a
    piece as Spark reads it means much work, it is cut into so many ``pieces``.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df.rdd.getNumPartitions()
    wanted = max(cores, parts * pieces)
    return df.repartition(wanted) if parts < wanted else df


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the table.

    Used where a result is read several times and costs much to make, or where a loop would
    let the plan grow.  The copy is columnar and on shared storage: later steps read only the
    columns they need, and the loss of an executor costs nothing.  It is written by zstd, which
    takes a third less disk than the default for little more time.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
