"""The folder that driver and executors share, for tables between jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    Where that is unset a local session takes a temporary folder; on a cluster executors could not
    read one, so an unset folder is an error there.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="surveyloom-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one, so that what an ended application left can be told and removed."""
    return f"{shared_dir(spark)}/surveyloom-{spark.sparkContext.applicationId}"


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's folder."""
    return f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back, where a plan would otherwise compute it again and again.

    The table stays until ``clear_work``, as results that are not yet collected still read it.
    """
    path = work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_work(spark: SparkSession) -> None:
    """Delete the tables that this application's queries have written for themselves.

    Call it when their results have been collected or written; results that were not are lost. A folder of an
    application that has ended may be removed at any time.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
