"""Catalog columns from the footers of Parquet files, read in tasks.

A folder holds a folder per schema, and that holds the tables, each a Parquet file or a folder of
them. Only schemas are listed on the driver; each is one partition, whose task lists its tables
and reads one footer of each. Comments come from the schema that Spark keeps in its footers.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_type

from tablescout.sources.catalog import SCHEMA

_SPARK_KEY = b"org.apache.spark.sql.parquet.row.metadata"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _children(store: fs.FileSystem, path: str) -> list[fs.FileInfo]:
    """What a folder holds, by name, without hidden and marker files."""
    found = store.get_file_info(fs.FileSelector(path, recursive=False))
    return sorted((f for f in found if not f.base_name.startswith(("_", "."))), key=lambda f: f.base_name)


def _footer_of(store: fs.FileSystem, info: fs.FileInfo) -> pa.Schema | None:
    """Schema of a table's first file; None where the folder holds no Parquet file."""
    if info.type == fs.FileType.Directory:
        for child in _children(store, info.path):
            got = _footer_of(store, child)
            if got is not None:
                return got
        return None
    return pq.read_schema(info.path, filesystem=store) if info.base_name.endswith(".parquet") else None


def _comments(schema: pa.Schema) -> dict[str, str]:
    kept = (schema.metadata or {}).get(_SPARK_KEY)
    fields = json.loads(kept)["fields"] if kept else []
    return {f["name"]: f.get("metadata", {}).get("comment", "") for f in fields}


def _type_of(kind: pa.DataType) -> str:
    """Spark's name of a type; times without a zone are ``timestamp_ntz``."""
    return from_arrow_type(kind, prefer_timestamp_ntz=True).simpleString()


class _Schema(InputPartition):
    def __init__(self, path: str, name: str):
        super().__init__(path)
        self.name = name


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.db = options["path"], options.get("db_name", "")

    def partitions(self) -> list[InputPartition]:
        store, path = _store(self.path)
        return [
            _Schema(f"{self.path.rstrip('/')}/{f.base_name}", f.base_name)
            for f in _children(store, path) if f.type == fs.FileType.Directory
        ]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        store, path = _store(partition.value)
        for info in _children(store, path):
            schema = _footer_of(store, info)
            if schema is None:
                continue
            table, comments = info.base_name.removesuffix(".parquet"), _comments(schema)
            for n, field in enumerate(schema, 1):
                yield (
                    self.db, partition.name, table, "", n, field.name, _type_of(field.type), comments.get(field.name, "")
                )


class FooterSource(DataSource):
    """Option ``path`` names the folder, ``db_name`` the tenant its tables belong to."""

    @classmethod
    def name(cls) -> str:
        return "parquet_footers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def footer_columns(spark: SparkSession, db_name: str, folder: str) -> DataFrame:
    """Columns of all tables below ``folder/<schema>/<table>``, in the catalog's form.

    Tables have no comment of their own; an empty folder gives no rows. The folder must be in a store
    that ``pyarrow.fs`` reads from every machine.
    """
    spark.dataSource.register(FooterSource)
    return spark.read.format("parquet_footers").option("db_name", db_name).load(folder)
