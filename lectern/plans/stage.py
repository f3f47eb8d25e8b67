"""Cutting lineage: a stage's result is written once to the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables written by this driver and not yet deleted.
_tables: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, in local mode a temporary one of its own; on a cluster
    that is an error, since executors would write to disks that others cannot read."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a parquet table in the shared folder: it outlives a lost executor and is computed once.

    The table is deleted by ``clear``, or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lectern-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    _tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Deletes the tables written so far, once the results made from them have been saved; returns how many."""
    n = 0
    while _tables:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_tables.pop())
        n += target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    return n


def partitions(spark: SparkSession) -> int:
    """The shuffle width the session is set to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, those with the smallest hashes of ``key``. Rows beyond a hash bound a little above the wanted share are dropped where they are read, so what travels is near ``rows`` however many tasks there are."""
    total = df.count()
    h = F.xxhash64(F.col(key))
    if total > rows:
        share = min(1.0, (rows + 4 * rows**0.5) / total)
        df = df.filter(h <= F.lit(int(-(2**63) + share * (2**64 - 1))))
    return df.orderBy(h, *df.columns).limit(rows)
