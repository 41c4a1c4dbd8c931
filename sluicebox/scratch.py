"""Shared scratch space: where a job writes the tables it reads again.

Everything two executors must agree on goes to the folder that the cluster names in ``spark.checkpoint.dir``, or,
where none is named, to a folder inside the warehouse, which driver and executors share as well.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, list[str]] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of this session."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return (configured or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch").rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else uses."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result no longer depends on how ``df`` was computed, so a lost executor cannot change values that were
    derived from task or partition numbers. Parquet keeps column pruning and filter pushdown for later reads.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> int:
    """Delete what this application wrote to the shared folder, once its results are saved; gives the number of paths."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    settings = spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = hadoop.Path(name)
        path.getFileSystem(settings).delete(path, True)
    return len(paths)
