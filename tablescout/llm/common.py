"""Small helpers that the corpus operators share."""

from __future__ import annotations

import sys
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.sources.lineage import checkpoint_folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as Parquet in the shared folder, and read back.

    Later jobs read the table, so losing an executor never repeats the work before it. The
    tables stay until the owner of ``spark.checkpoint.dir`` clears that folder.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/tablescout-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names close to ``names`` that the frame does not use, in any letter case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def folds(n_rows: int, per_group: int) -> int:
    """How many groups hold ``n_rows`` with about ``per_group`` rows each."""
    return max(1, -(-int(n_rows) // int(per_group)))


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model learns from: crc32 of the id's text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def empty_frame(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def worker_memo(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, for things dear to build again."""
    module = sys.modules.setdefault("tablescout_worker_memo", types.ModuleType("tablescout_worker_memo"))
    return module.__dict__.setdefault(name, {})
