"""Parquet tables of one directory, as DataFrames or temporary views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register_views(spark: SparkSession, folder: str, sql: str | None = None) -> None:
    """Register the tables of the folder as temporary views, or only those a text names."""
    words = set(re.findall(r"\w+", sql.lower())) if sql is not None else set(TABLES)
    for name in TABLES:
        if name in words:
            read_table(spark, folder, name).createOrReplaceTempView(name)


def tenant_scan(df: DataFrame, tenant: str, columns: list[str], order: str = "id") -> DataFrame:
    """Rows of one tenant, ordered: the filter and the columns reach the scan."""
    return df.where(F.col("db_name") == tenant).select(*columns).orderBy(order)
