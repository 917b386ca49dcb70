"""Row filters, clean-up and existence tests."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.functions import constants as K
from tablescout.functions import text


def in_list(col: Column, listed: str | None, ignore_case: bool = False) -> Column:
    """Comma-list filter; a missing or blank list lets every row pass.

    ``ignore_case=False`` is the exact form, ``True`` the lower-cased one.
    """
    names = [s.strip() for s in (listed or "").split(",") if s.strip()]
    if not names:
        return F.lit(True)
    if ignore_case:
        return F.lower(F.coalesce(col, F.lit(""))).isin([n.lower() for n in names])
    return F.coalesce(col.isin(names), F.lit(False))


def in_list_column(col: Column, listed: Column, ignore_case: bool = False) -> Column:
    """The same filter when every row brings its own list."""
    names = text.split_list(F.coalesce(listed, F.lit("")))
    if ignore_case:
        names = F.transform(names, F.lower)
        col = F.lower(F.coalesce(col, F.lit("")))
    return (F.size(names) == 0) | F.coalesce(F.array_contains(names, col), F.lit(False))


def visible_items(
    schema: Column,
    table: Column,
    kind: Column | None = None,
    allowed: Column | None = None,
    excluded: Iterable[str] = K.EXCLUDED_SCHEMAS,
    schema_like: Iterable[str] = K.EXCLUDED_SCHEMA_LIKE,
    table_like: Iterable[str] = K.EXCLUDED_TABLE_LIKE,
    kinds: Iterable[str] = K.TABLE_KINDS,
) -> Column:
    """The one exclusion set used by extraction and polling alike."""
    tests = [~schema.isin(list(excluded))]
    tests += [~schema.like(p) for p in schema_like]
    tests += [~table.like(p) for p in table_like]
    if kind is not None:
        tests.append(kind.isin(list(kinds)))
    if allowed is not None:
        tests.append(F.coalesce(allowed, F.lit(False)))
    return reduce(lambda a, b: a & b, tests)


def usable_tenants(tenants: DataFrame, excluded: Iterable[str] = ()) -> DataFrame:
    """Tenants that are not excluded and have a host."""
    host_ok = F.col("host").isNotNull() & ~F.col("host").isin("", "None")
    return tenants.where(host_ok & ~F.col("db_name").isin(list(excluded)))


def finite_or_null(df: DataFrame, time_format: str | None = None) -> DataFrame:
    """NaN and infinities become null, dates and times become text.

    Without a format, a time is written to the second, with its fraction where it has one.
    """
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            bad = F.isnan(c) | (F.abs(c) == float("inf"))
            c = F.when(~bad, c)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, time_format) if time_format else c.cast("string")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(f.name))
    return df.select(*out)


def preview(df: DataFrame, order: list[str], rows: int = K.PREVIEW_ROWS) -> DataFrame:
    """The first rows, each with the full row count.

    The count and the top rows are two passes over the source; nothing is held in memory.
    """
    total = df.agg(F.count(F.lit(1)).alias("total_rows"))
    return df.orderBy(*order).limit(rows).withColumn("total_rows", total.scalar())


def groups_with_rows(groups: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Existence per group: a semi-join style flag, no full count."""
    present = rows.select(key).distinct().withColumn("has_rows", F.lit(True))
    return groups.join(present, key, "left").withColumn(
        "has_rows", F.coalesce("has_rows", F.lit(False))
    )


def any_row(df: DataFrame) -> bool:
    """Existence test that stops at the first row."""
    return bool(df.limit(1).count())
