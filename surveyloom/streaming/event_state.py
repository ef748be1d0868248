"""The event log's latest state, kept up by Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Versions of the state that stay: the newest, and the one a reader may still hold.
KEPT = 2


def follow(events: DataFrame, path: str, checkpoint: str, key: str, order: Sequence[str], fields: Sequence[str]) -> StreamingQuery:
    """Keep every id's latest state: each field's last value in ``order`` wins; lines without an id are left out.

    Spark's state store holds the ids, a row each, so a micro-batch costs what it brings and the log is never
    read again. Each batch writes the state as the version of its number; a batch that is run again after a
    failure starts from the state before it and writes the same version.
    """
    seq = F.struct(*order)
    rows = events.where(events[key].isNotNull())
    state = rows.groupBy(key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), seq)).alias(f) for f in fields], F.max(seq).alias("_last"))

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/v={number}")
        fs, root = _folder(batch.sparkSession, path)
        for old in sorted(_versions(fs, root))[:-KEPT]:
            fs.delete(root.suffix(f"/v={old}"), True)

    return state.writeStream.outputMode("complete").foreachBatch(one).option("checkpointLocation", checkpoint).start()


def _folder(spark: SparkSession, path: str) -> tuple[object, object]:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), root


def _versions(fs: object, root: object) -> list[int]:
    """Numbers of the versions that are whole."""
    return [int(x.getPath().getName()[2:]) for x in fs.listStatus(root) if x.getPath().getName().startswith("v=") and fs.exists(x.getPath().suffix("/_SUCCESS"))]


def current(spark: SparkSession, path: str, key: str, fields: Sequence[str], limit: int = 5000) -> DataFrame:
    """The newest version of the state, the ids last heard of first; a row an id is read, however long the log."""
    fs, root = _folder(spark, path)
    newest = spark.read.parquet(f"{path}/v={max(_versions(fs, root))}")
    return newest.orderBy(F.col("_last").desc(), key).limit(limit).select(key, *fields)
