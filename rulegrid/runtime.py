"""Table access, lineage cuts and the session used by tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session(app: str = "rulegrid", cores: int | str = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("RULEGRID_DRIVER_MEMORY", "8g"))
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Only where it is unset and the session is local (tests,
    a laptop) a folder of this machine is used; on a cluster that is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named
    if not (sc.master.startswith("local") and not sc.master.startswith("local-cluster")):
        raise RuntimeError("spark.checkpoint.dir is not set; name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="rulegrid-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a table written to the shared folder.

    It is computed once (an eager checkpoint() runs the last stage twice), its columns can be pruned, and its size is
    known to the planner. `sweep` removes a session's tables.
    """
    path = f"{_tables(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _tables(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/rulegrid-{spark.sparkContext.applicationId}"


def sweep(spark: SparkSession) -> None:
    """Removes the tables that `checkpointed` wrote in this session; frames built on them can no longer be read."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fan_out(df: DataFrame, salts: int, name: str = "salt") -> DataFrame:
    """Repeats each row once per salt value, for the small side of a salted join."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def spread(df: DataFrame, key: str, per_core: int = 3) -> DataFrame:
    """At least `per_core` partitions a core ahead of work that costs far more than moving the rows.

    Few large input files would otherwise leave most of a cluster idle; an input of enough splits is left as it lies.
    """
    wanted = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted, key)
