"""Sharding by size-tiered compaction, in DataFrame functions only.

A table is a folder of immutable Parquet shards and numbered manifests. An arrival is one
run: a folder of the small shards its tasks write. Runs whose shards are of similar size
form a tier; when a tier holds ``fanout`` shards, compaction merges its runs into one run of
files of about the target size, without a shuffle. Merged shards move up a tier, and those of
half the target are never written again, so a row is rewritten at most once a tier. Every
change ends in the rename of a finished manifest folder to the next version, which fails if
that version exists: readers see a whole version or the one before, and a writer that comes
second applies its change to the newer version.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``run`` is the folder of a shard below the table, ``shard`` its file there.
MANIFEST = "version long, run string, shard string, bytes long, n_rows long"
#: Newer versions that a writer meets in a row before it gives up.
ATTEMPTS = 20


class Conflict(RuntimeError):
    """Another writer has committed this version."""


def _fs(spark: SparkSession, path: str):
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, place, jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), conf)


def _names(spark: SparkSession, folder: str) -> list[str]:
    _, place, files = _fs(spark, folder)
    return [x.getPath().getName() for x in files.util().listStatus(place)] if files.util().exists(place) else []


def versions(spark: SparkSession, table: str) -> list[int]:
    """Committed versions, oldest first."""
    return sorted(int(x[1:]) for x in _names(spark, f"{table}/manifests") if x[:1] == "v" and x[1:].isdigit())


def manifest(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """The shards of a version (the newest by default); none of a table without versions."""
    found = versions(spark, table)
    if not found:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{table}/manifests/v{found[-1] if version is None else version}")


def _runs(shards: DataFrame) -> list:
    """A row per run: run, shards, bytes. A run is an arrival or a merge, so these are few."""
    return shards.groupBy("run").agg(F.count("*").alias("shards"), F.sum("bytes").alias("bytes")).orderBy("run").collect()


def read(spark: SparkSession, table: str, version: int | None = None, schema: object = None) -> DataFrame:
    """The rows of a version; each row's file is in ``_metadata.file_path``."""
    folders = [f"{table}/shards/{r['run']}" for r in _runs(manifest(spark, table, version))]
    if not folders:
        raise ValueError(f"{table} holds no shards")
    return (spark.read.schema(schema) if schema else spark.read).parquet(*folders)


def _file(path: str = "_metadata.file_path"):
    return F.element_at(F.split(path, "/"), -1)


def _write(df: DataFrame, table: str, schema: object) -> tuple[str, DataFrame]:
    """Write ``df`` as a new run; its name and its manifest rows, which come from the files' footers alone."""
    spark, run = df.sparkSession, uuid.uuid4().hex
    folder = f"{table}/shards/{run}"
    df.write.option("compression", "zstd").parquet(folder)
    found = spark.read.schema(schema).parquet(folder).groupBy(_file().alias("shard"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("n_rows"))
    return run, found.select(F.lit(run).alias("run"), "shard", "bytes", "n_rows")


def commit(spark: SparkSession, table: str, rows: DataFrame, version: int) -> int:
    """Publish ``rows`` (run, shard, bytes, n_rows) as manifest ``version`` by one rename that never overwrites."""
    draft = f"{table}/drafts/{uuid.uuid4().hex}"
    rows.select(F.lit(version).cast("long").alias("version"), "run", "shard", "bytes", "n_rows").coalesce(1).write.parquet(draft)
    jvm, source, files = _fs(spark, draft)
    target = jvm.org.apache.hadoop.fs.Path(f"{table}/manifests/v{version}")
    files.mkdir(target.getParent(), jvm.org.apache.hadoop.fs.permission.FsPermission.getDirDefault(), True)
    try:
        if files.util().exists(target):
            raise Conflict(f"version {version} of {table} exists")
        try:
            files.rename(source, target, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            raise Conflict(f"version {version} of {table} could not be committed: {e}") from e
    except Conflict:
        files.delete(source, True)
        raise
    return version


def _change(spark: SparkSession, table: str, change: Callable[[DataFrame], DataFrame | None]) -> int:
    """Commit ``change`` of the newest manifest, again on the next one if another writer was first; None gives up."""
    for _ in range(ATTEMPTS):
        held = versions(spark, table)
        newest = held[-1] if held else 0
        rows = change(manifest(spark, table))
        if rows is None:
            return newest
        try:
            return commit(spark, table, rows, newest + 1)
        except Conflict:
            continue
    raise Conflict(f"{table}: {ATTEMPTS} newer versions in a row")


def append(df: DataFrame, table: str) -> int:
    """Write an arrival as small immutable shards and commit it; an arrival without rows adds no shard."""
    _, new = _write(df, table, df.schema)
    return _change(df.sparkSession, table, lambda now: now.select("run", "shard", "bytes", "n_rows").unionByName(new))


def due(runs: list, target: int, fanout: int) -> list[list[str]]:
    """Names of the runs that each merge takes: all of a tier with ``fanout`` shards or more.

    A run's tier is its mean shard size on a logarithmic scale of ``fanout`` below the target; runs
    whose shards reach half the target are in no tier.
    """
    tiers: dict[int, list] = {}
    for r in runs:
        mean = max(1, r["bytes"] // r["shards"])
        if 2 * mean < target:
            tiers.setdefault(math.floor(math.log(target / mean, fanout) + 1e-9), []).append(r)
    full = [x for _, x in sorted(tiers.items()) if sum(r["shards"] for r in x) >= fanout]
    # one shard alone has nothing to merge with
    return [[r["run"] for r in x] for x in full if sum(r["shards"] for r in x) > 1]


def compact(spark: SparkSession, table: str, *, target: int = 128 << 20, fanout: int = 4, schema: object = None) -> int:
    """Merge full tiers until none is left; every merge is a version of its own. Returns the newest version.

    A tier with fewer than ``fanout`` shards waits for more. A merge whose runs another writer has
    merged meanwhile is left to ``vacuum``. Old shards stay for readers of old versions.
    """
    while True:
        runs = _runs(manifest(spark, table))
        merges = due(runs, target, fanout)
        if not merges:
            return (versions(spark, table) or [0])[-1]
        names = merges[0]
        size = sum(r["bytes"] for r in runs if r["run"] in names)
        folders = [f"{table}/shards/{x}" for x in names]
        kind = schema or spark.read.parquet(*folders).schema
        rows = spark.read.schema(kind).parquet(*folders)
        _, new = _write(rows.coalesce(max(1, round(size / target))), table, kind)

        def replace(now: DataFrame, names: list[str] = names, new: DataFrame = new) -> DataFrame | None:
            old = now.where(F.col("run").isin(names))
            if old.select("run").distinct().count() < len(names):
                return None
            return now.where(~F.col("run").isin(names)).select("run", "shard", "bytes", "n_rows").unionByName(new)

        _change(spark, table, replace)


def vacuum(spark: SparkSession, table: str, keep: int = 1) -> int:
    """Delete all but the newest ``keep`` versions, the runs that none of those names, and drafts.

    Not while other writers are at work: their unfinished runs would go too. Returns the deleted runs.
    """
    held = versions(spark, table)
    stay: set[str] = set()
    for v in held[-keep:]:
        stay |= {r["run"] for r in _runs(manifest(spark, table, v))}
    gone = [x for x in _names(spark, f"{table}/shards") if x not in stay]
    for path in [f"shards/{x}" for x in gone] + [f"manifests/v{v}" for v in held[:-keep]] + ["drafts"]:
        _, place, files = _fs(spark, f"{table}/{path}")
        if files.util().exists(place):
            files.delete(place, True)
    return len(gone)


def shard_corpus(arrivals: list[DataFrame], table: str, **options: int) -> DataFrame:
    """Append every arrival, compact, and return the table's rows as the newest manifest has them.

    All rows come back with their own columns of any name, nulls and repeated rows included; with no
    rows at all the result is empty. One column more, ``shard`` (with underscores after it where the
    arrivals have that name), is a struct that tells where a row lies: version, run, file, rows, bytes.
    """
    spark, schema = arrivals[0].sparkSession, arrivals[0].schema
    for df in arrivals:
        append(df.select(*[F.col(f"`{c}`") for c in schema.names]), table)
    version = compact(spark, table, schema=schema, **options)
    shards = manifest(spark, table, version)
    own = F.struct(*[F.col(f"`{c}`") for c in schema.names]).alias("row")
    if shards.isEmpty():
        rows = arrivals[0].limit(0).select(own, F.lit("").alias("file"))
    else:
        rows = read(spark, table, version, schema).select(own, _file().alias("file"))
    named = shards.select("shard", F.struct(F.lit(version).cast("long").alias("version"), "run", F.col("shard").alias("file"), F.col("n_rows").alias("rows"), "bytes").alias("place"))
    name = "shard"
    while name in schema.names:
        name += "_"
    placed = rows.join(named, F.col("file") == named["shard"])
    return placed.select(*[F.col("row").getField(c).alias(c) for c in schema.names], F.col("place").alias(name))
