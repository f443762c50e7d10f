"""Tables between the steps of one job, in the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``. Where none is set, a local folder does for
    a local master; a cluster needs the setting, because executors do not share local folders."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="runweave-"))
    return f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder when the application ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` there and read it back: lineage ends here, and no lost executor repeats the steps before."""
    path = shared_dir(df.sparkSession)
    forget_at_exit(df.sparkSession, path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
