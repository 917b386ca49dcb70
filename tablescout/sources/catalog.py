"""Catalog column frames from the session catalog or from DataFrame schemas.

This is metadata: its size follows the number of tables, not their rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "db_name string, schema_name string, table_name string, table_comment string, "
    "column_order int, column_name string, data_type string, column_comment string"
)


def session_columns(spark: SparkSession, db_name: str, database: str) -> DataFrame:
    """Tables and views of a database with their comments and columns in order."""
    rows = []
    for t in spark.catalog.listTables(database):
        if t.isTemporary:
            continue
        for n, c in enumerate(spark.catalog.listColumns(f"{database}.{t.name}"), 1):
            rows.append((db_name, database, t.name, t.description or "", n, c.name, c.dataType, c.description or ""))
    return spark.createDataFrame(rows, SCHEMA)


def frame_columns(spark: SparkSession, db_name: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The comment-free form: names and types of DataFrames, without a schema name."""
    rows = [
        (db_name, "", name, "", n, f.name, f.dataType.simpleString(), "")
        for name, df in tables.items()
        for n, f in enumerate(df.schema.fields, 1)
    ]
    return spark.createDataFrame(rows, SCHEMA)
