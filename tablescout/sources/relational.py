"""Relational sources by id: JDBC read options for PostgreSQL and SQLite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_URLS = {
    "postgresql": "jdbc:postgresql://{host}:{port}/{name}?sslmode={sslmode}",
    "sqlite": "jdbc:sqlite:{file_path}",
}
_DRIVERS = {"postgresql": "org.postgresql.Driver", "sqlite": "org.sqlite.JDBC"}


class Registry:
    """Named database settings; entries without a usable host are not offered."""

    def __init__(self, entries: dict[str, dict], excluded: set[str] | None = None):
        self._entries = dict(entries)
        self._excluded = set(excluded or ())

    def get(self, db_name: str) -> dict:
        if db_name not in self._entries:
            raise ValueError(f"no settings for database {db_name}")
        return self._entries[db_name]

    def available(self) -> list[str]:
        return [n for n, e in self._entries.items() if n not in self._excluded and _complete(e)]


def _complete(entry: dict) -> bool:
    if entry.get("type") == "sqlite":
        return bool(entry.get("file_path"))
    return entry.get("host") not in (None, "", "None")


def jdbc_options(entry: dict, table: str) -> dict[str, str]:
    kind = entry["type"]
    if kind not in _URLS:
        raise ValueError(f"unknown database type: {kind}")
    filled = {"port": "5432", "sslmode": "prefer", **entry}
    options = {"url": _URLS[kind].format(**filled), "dbtable": table, "driver": _DRIVERS[kind]}
    for key in ("user", "password"):
        if entry.get(key) is not None:
            options[key] = str(entry[key])
    return options


def read_relational(
    spark: SparkSession,
    registry: Registry,
    db_name: str,
    table: str,
    column: str | None = None,
    lower: int | None = None,
    upper: int | None = None,
    partitions: int = 32,
) -> DataFrame:
    """JDBC scan; with a numeric column it is read in parallel ranges. Spark pushes filters down."""
    reader = spark.read.format("jdbc").options(**jdbc_options(registry.get(db_name), table))
    if column is not None:
        reader = reader.options(
            partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=partitions
        )
    return reader.load()
