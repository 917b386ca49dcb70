"""Cutting lineage with a written table, or a reliable checkpoint, in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


_PLAIN = (
    T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType,
)


def _fits_a_file(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _fits_a_file(kind.elementType)
    if isinstance(kind, T.StructType):
        return bool(kind.fields) and all(_fits_a_file(f.dataType) for f in kind.fields)
    return isinstance(kind, _PLAIN)


def cut_lineage(df: DataFrame) -> DataFrame:
    """A written copy that survives the loss of executors.

    It is a Parquet table, which is computed once; a checkpoint, which computes rows twice, is kept for
    rows that such a file cannot hold, as with two columns of one name. Tables stay until the owner of
    ``spark.checkpoint.dir`` clears that folder.
    """
    spark, names = df.sparkSession, [c.lower() for c in df.columns]
    folder = checkpoint_folder(spark)
    if len(set(names)) < len(names) or not _fits_a_file(df.schema):
        return df.checkpoint(eager=True)
    path, schema = f"{folder.rstrip('/')}/written-{uuid.uuid4().hex}", df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
