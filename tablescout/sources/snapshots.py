"""Versioned tables: a change is written as a new folder, then a commit names it.

A reader never sees a half-written version, and a version is never overwritten, so nothing
that was read needs to be invalidated. A table kept by parts (one per tenant) writes only the
parts that changed; the others stay in the folder of an earlier version.

Every writer writes into a folder of its own and then creates the commit file of the next number,
which the file system lets one writer do. So of two writers that started from one version exactly
one names the next; the other gets a ``Conflict``, and neither touches what the other wrote. Folders
without a commit, of losers and of failed runs, are never read.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_POINTER = "version long, rows long, part string, folder string, written_at timestamp"
_COMMIT = "version long, folder string"


class Conflict(RuntimeError):
    """Another writer named the version first; read again and write on top of it."""


def _files(spark: SparkSession, path: str):
    """``(file system, path)`` as the session's readers and writers see them."""
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return of.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), of


def create_exclusively(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file unless it is there; False when it is, whoever was faster.

    A store must create files atomically, as distributed file systems do. Where the path is
    the machine's own, the operating system's exclusive creation is used.
    """
    fs, at = _files(spark, path)
    at = fs.makeQualified(at)
    fs.mkdirs(at.getParent())
    if fs.getUri().getScheme() == "file":
        try:
            handle = os.open(at.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            return False
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
        return True
    try:
        out = fs.create(at, False)
    except Exception:
        if fs.exists(at):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, at = _files(spark, folder)
    if not fs.exists(at):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(at))


def _commits(spark: SparkSession, root: str) -> DataFrame:
    """The versions that are named, with their folder: one short line each."""
    if not _names(spark, f"{root}/commits"):
        return spark.createDataFrame([], _COMMIT)
    line = F.split("value", " ")
    return spark.read.text(f"{root}/commits").select(line[0].cast("long").alias("version"), line[1].alias("folder"))


def current_version(spark: SparkSession, root: str) -> int:
    """Newest named version, 0 when there is none."""
    return int(_commits(spark, root).agg(F.max("version")).first()[0] or 0)


def _next(spark: SparkSession, root: str, base: int | None) -> tuple[int, str]:
    """Number and folder of a version to write, the one after ``base`` if that is given.

    A commit file counts even while it is being written.
    """
    names = [n.split(".")[0] for n in _names(spark, f"{root}/commits")]
    n = max([int(x) for x in names if x.isdigit()], default=0) + 1
    if base is not None and base + 1 != n:
        raise Conflict(f"version {base + 1} of {root} was named by another writer")
    return n, f"v={n:08d}-{uuid.uuid4().hex}"


def _name(spark: SparkSession, root: str, version: int, folder: str) -> None:
    """Name a version, unless another writer named it meanwhile."""
    if not create_exclusively(spark, f"{root}/commits/{version:08d}.txt", f"{version} {folder}\n"):
        raise Conflict(f"version {version} of {root} was named by another writer")


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    commits = _commits(spark, root)
    if version is not None:
        commits = commits.where(F.col("version") == version)
    newest = commits.orderBy(F.col("version").desc()).limit(1).collect()
    if not newest:
        raise ValueError(f"no version in {root}")
    return spark.read.parquet(f"{root}/{newest[0]['folder']}")


def write_snapshot(df: DataFrame, root: str, partition_by: list[str] = (), base: int | None = None) -> int:
    """Write the next version and name it last; returns its number.

    ``base`` is the version that the rows were made from: any named since then is a ``Conflict``.
    """
    spark = df.sparkSession
    n, folder = _next(spark, root, base)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{root}/{folder}")
    _name(spark, root, n, folder)
    return n


def _part(value: Column) -> Column:
    """Folder name of a part: safe in a path and never read as a number."""
    return F.concat(F.lit("p"), F.md5(value))


def write_parts(df: DataFrame, root: str, by: str, changed: DataFrame, base: int | None = None) -> int:
    """Write the next version of the ``changed`` parts only (a frame with the column ``by``).

    ``df`` holds all rows of these parts; a part without rows is named as empty. ``base`` is the
    version that the rows were made from: any named since then is a ``Conflict``.
    """
    spark = df.sparkSession
    n, folder = _next(spark, root, base)
    path = f"{root}/{folder}"
    df.withColumn("part", _part(F.col(by))).write.partitionBy("part").parquet(path)
    written = spark.read.schema(df.schema.add("part", "string")).parquet(path)
    rows = written.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    parts = changed.select(_part(F.col(by)).alias("part")).distinct().join(rows, "part", "left")
    parts.select(
        F.lit(n).cast("long").alias("version"), F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), "part",
        F.lit(folder).alias("folder"), F.current_timestamp().alias("written_at"),
    ).coalesce(1).write.parquet(f"{root}/pointer/{folder.removeprefix('v=')}")
    _name(spark, root, n, folder)
    return n


def read_parts(spark: SparkSession, root: str, schema: str, by: str, wanted: DataFrame | None = None) -> DataFrame:
    """The newest version of every part, or of the ``wanted`` parts (a frame with ``by``).

    The pointer has one short row per change of a part, and only those of named versions count;
    only the chosen folders are listed.
    """
    commits = _commits(spark, root)
    if commits.isEmpty():
        return spark.createDataFrame([], schema)
    # Every writer has a folder of its own there too.
    pointer = spark.read.schema(_POINTER).option("recursiveFileLookup", "true").parquet(f"{root}/pointer").join(commits, ["version", "folder"], "left_semi")
    newest = pointer.groupBy("part").agg(
        F.max_by("folder", "version").alias("folder"), F.max_by("rows", "version").alias("rows")
    ).where("rows > 0")
    if wanted is not None:
        newest = newest.join(wanted.select(_part(F.col(by)).alias("part")).distinct(), "part", "left_semi")
    paths = [f"{root}/{r['folder']}/part={r['part']}" for r in newest.collect()]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def compact_parts(spark: SparkSession, root: str, schema: str, by: str) -> int:
    """Write all parts anew as one version with few files; returns its number, 0 without parts.

    Rows stay as they are. Every part becomes one file, unless the session's
    ``spark.sql.files.maxRecordsPerFile`` says otherwise, and a crowded part is spread over several. A
    version named meanwhile is a ``Conflict``, so nothing that it holds is lost.
    """
    base = current_version(spark, root)
    rows = read_parts(spark, root, schema, by)
    keys = rows.select(by).distinct()
    if keys.isEmpty():
        return 0
    # A rebalance brings a part together, splits a large one and joins small files.
    return write_parts(rows.hint("rebalance", by), root, by, keys, base)
