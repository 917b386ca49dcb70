"""Row changes as transformations from one table version to the next.

Parquet tables have no UPDATE or DELETE, so each operator returns the next version; write it
with ``sources.snapshots``. Keys are unique on both sides, so joins spread evenly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def keyed_update(
    stored: DataFrame, updates: DataFrame, key: list[str], columns: list[str], now: Column
) -> DataFrame:
    """Set columns for matched keys and stamp ``updated_at``; other rows stay.

    Adds ``matched``; filter and count it for the number of rows hit.
    """
    new = updates.select(*key, *[F.col(c).alias("_new_" + c) for c in columns], F.lit(True).alias("_hit"))
    hit = F.coalesce("_hit", F.lit(False))
    out = []
    for f in stored.columns:
        c = F.col(f)
        if f in columns:
            c = F.when(hit, F.coalesce(F.col("_new_" + f), c)).otherwise(c)
        elif f == "updated_at":
            c = F.when(hit, now).otherwise(c)
        out.append(c.alias(f))
    return stored.join(new, key, "left").select(*out, hit.alias("matched"))


def delete_keys(stored: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not listed; null keys never match and stay."""
    return stored.join(keys.select(*key), key, "left_anti")


def delete_where(stored: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true (false or unknown rows stay)."""
    return stored.where(~F.coalesce(condition, F.lit(False)))


def bulk_upsert(
    stored: DataFrame, incoming: DataFrame, key: list[str], now: Column, keep: list[str] = ()
) -> DataFrame:
    """Update matched keys and insert the others, in one full outer join.

    ``keep`` lists columns whose stored value survives an update (creation time, id). A null in
    a key column is taken as ''. A column that the stored table lacks is an error; add it first with
    ``add_missing_columns``.
    """
    unknown = [c for c in incoming.columns if c not in stored.columns]
    if unknown:
        raise ValueError(f"the stored table has no column {', '.join(unknown)}")

    def clean(df: DataFrame) -> DataFrame:
        strings = [f.name for f in df.schema.fields if f.name in key and isinstance(f.dataType, T.StringType)]
        return df.withColumns({k: F.coalesce(k, F.lit("")) for k in strings}) if strings else df

    old = clean(stored).select(
        *key, *[F.col(c).alias("_old_" + c) for c in stored.columns if c not in key], F.lit(True).alias("_old")
    )
    new = clean(incoming).select(
        *key, *[F.col(c).alias("_new_" + c) for c in incoming.columns if c not in key], F.lit(True).alias("_new")
    )
    is_new = F.col("_new").isNotNull()
    out = []
    for c in stored.columns:
        if c in key:
            out.append(F.col(c))
        elif c == "updated_at":
            out.append(F.when(is_new, now).otherwise(F.col("_old_" + c)).alias(c))
        elif c in keep and c in incoming.columns:
            out.append(F.coalesce(F.col("_old_" + c), F.col("_new_" + c)).alias(c))
        elif c in incoming.columns:
            out.append(F.when(is_new, F.col("_new_" + c)).otherwise(F.col("_old_" + c)).alias(c))
        else:
            out.append(F.col("_old_" + c).alias(c))
    return old.join(new, key, "full").select(*out)


def pk_upsert(stored: DataFrame, incoming: DataFrame, key: list[str], order: str) -> DataFrame:
    """Union, newest row per key; of equally new rows the incoming one wins.

    The newest row is picked by an aggregate that combines before the shuffle, so many
    versions of one key never meet in one task.
    """
    both = stored.withColumn("_side", F.lit(0)).unionByName(
        incoming.select(*stored.columns).withColumn("_side", F.lit(1))
    )
    rest = [c for c in stored.columns if c not in key]
    newest = F.max(F.struct(F.col(order), F.col("_side"), *[c for c in rest if c != order])).alias("_row")
    return both.groupBy(*key).agg(newest).select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def clear_for_keys(
    stored: DataFrame, keys: DataFrame, key: list[str], column: str, now: Column
) -> DataFrame:
    """Null one column for the listed keys (soft removal)."""
    listed = keys.select(*key).distinct().withColumn("_hit", F.lit(True))
    hit = F.col("_hit").isNotNull()
    changed = {column: F.when(~hit, F.col(column))}
    if "updated_at" in stored.columns:
        changed["updated_at"] = F.when(hit, now).otherwise(F.col("updated_at"))
    return stored.join(listed, key, "left").withColumns(changed).select(*stored.columns)


def add_missing_columns(df: DataFrame, wanted: T.StructType) -> DataFrame:
    """Add absent columns as typed nulls; present ones stay untouched."""
    have = set(df.columns)
    new = {f.name: F.lit(None).cast(f.dataType) for f in wanted.fields if f.name not in have}
    return df.withColumns(new) if new else df
