"""Files to tables of the ``tmp`` database: cleaned names, inferred types, replaced table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.functions import constants as K


def clean_table_name(name: str) -> str:
    """Blank and ``-`` to ``_``; only letters, digits and ``_`` stay."""
    out = "".join(c for c in re.sub("[ -]", "_", name) if c.isalnum() or c == "_")
    if not out:
        raise ValueError("the table name has no letter, digit or underscore")
    return out


def clean_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[str(c).strip().replace(" ", "_") for c in df.columns])


def upload_types(df: DataFrame) -> DataFrame:
    """Whole numbers, doubles, booleans and timestamps keep a type, everything else is text."""
    out = []
    for f in df.schema.fields:
        target = K.UPLOAD_TYPES.get(f.dataType.simpleString())
        c = F.col(f"`{f.name}`")
        if target is None and f.dataType.simpleString().startswith(("array", "map", "struct")):
            c = F.to_json(c)
        out.append(c.cast(target or "string").alias(f.name))
    return df.select(*out)


def read_file(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    if fmt == "csv":
        return spark.read.csv(path, header=True, inferSchema=True)
    if fmt in ("json", "parquet", "orc"):
        return spark.read.format(fmt).load(path)
    if fmt in ("xlsx", "xls"):
        # A sheet holds at most 1,048,576 rows; needs an Excel reader beside pandas.
        import pyspark.pandas as ps

        return ps.read_excel(path).to_spark()
    raise ValueError(f"unknown file format: {fmt}")


def typed(df: DataFrame) -> DataFrame:
    return upload_types(clean_headers(df))


def ingest(spark: SparkSession, path: str, table: str, fmt: str = "csv") -> dict:
    """Replace ``tmp.<table>`` with the file; reports table, rows and columns."""
    name = f"tmp.{clean_table_name(table)}"
    df = typed(read_file(spark, path, fmt))
    if df.isEmpty():
        raise ValueError("the file is empty")
    spark.sql("CREATE DATABASE IF NOT EXISTS tmp")
    df.write.mode("overwrite").saveAsTable(name)
    return {"table_name": name, "row_count": spark.table(name).count(), "columns": df.columns}
