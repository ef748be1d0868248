"""Where intermediate tables go: the folder all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.work import shared_dir


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other job uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, row_group: int | None = None, scratch: list[DataFrame] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    ``scratch`` gets the table, for ``discard`` when nothing reads it any more. ``row_group`` bounds the bytes that a reader takes at once, for tables with large rows.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.option("parquet.block.size", row_group) if row_group else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if scratch is not None:
        scratch.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Hash buckets of ids that are broadcast to tell which rows cannot meet a table: so many at most, whatever the table's size.
BUCKETS = 1 << 20


def _buckets(ids: DataFrame, column: str) -> DataFrame:
    return F.broadcast(ids.select(F.pmod(F.xxhash64(column), F.lit(BUCKETS)).alias("_bucket")).distinct())


def near(df: DataFrame, id_col: str, ids: DataFrame, column: str) -> DataFrame:
    """The rows of ``df`` whose id may stand in ``ids`` (a stored table): those that share a bucket with one there.

    An exact join may follow; it then shuffles few texts where ``ids`` is a small part of the rows.
    """
    b = _buckets(ids, column)
    return df.join(b, F.pmod(F.xxhash64(df[id_col]), F.lit(BUCKETS)) == b["_bucket"], "left_semi")


def without(df: DataFrame, id_col: str, ids: DataFrame, column: str, null_safe: bool = False) -> DataFrame:
    """The rows of ``df`` whose id does not stand in ``ids`` (a stored table). Rows that share no bucket pass by.

    Null ids stay, or with ``null_safe`` go where ``ids`` has a null.
    """
    b, gone = _buckets(ids, column), ids.select(F.col(column).alias("_gone"))
    far = df.join(b, F.pmod(F.xxhash64(df[id_col]), F.lit(BUCKETS)) == b["_bucket"], "left_anti")
    some = near(df, id_col, ids, column)
    same = some[id_col].eqNullSafe(gone["_gone"]) if null_safe else some[id_col] == gone["_gone"]
    return far.unionByName(some.join(gone, same, "left_anti"))
