"""Snapshot differences, incremental classes and content fingerprints.

A snapshot is keyed by ``db_name, schema_name, table_name`` (a null schema is the empty
schema) and carries a content hash. Keys are unique. Keys and hashes of both sides are written
once; digests of key ranges then tell which ranges changed, and only the rows of these are brought
together, spread evenly whatever the size of a tenant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.functions import constants as K
from tablescout.operators import digests
from tablescout.sources.lineage import cut_lineage

KEY = ["db_name", "schema_name", "table_name"]


def with_key(df: DataFrame) -> DataFrame:
    """Null schema becomes the empty schema."""
    return df.withColumn("schema_name", F.coalesce("schema_name", F.lit("")))


def item_key(schema: Column, table: Column) -> Column:
    return F.concat_ws(".", schema, table)


def _sides(current: DataFrame, stored: DataFrame, key: list[str], names: list[str]) -> DataFrame:
    """Rows of both sides, written once, with their side and the leaf of their key."""
    columns = [*key, *names]
    both = current.select(*columns, F.lit(1).cast("long").alias("_side")).unionByName(
        stored.select(*columns, F.lit(-1).cast("long").alias("_side"))
    )
    return cut_lineage(both.withColumn("_leaf", digests.leaf_of(key[:2], key[2:])))


def _of(side: int, column: str) -> Column:
    """The value that a key has on a side; keys are unique on each."""
    return F.max(F.when(F.col("_side") == side, F.col(column)))


def _has(side: int) -> Column:
    return F.count_if(F.col("_side") == side) > 0


def snapshot_diff(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Class of every key: added, deleted, modified or same. A null stored hash is ''."""
    old = with_key(stored).withColumn("hash", F.coalesce("hash", F.lit("")))
    rows = _sides(with_key(current), old, KEY, ["hash"])
    touched, alike = digests.split_by_change(rows, [*KEY, "hash"])
    both = touched.groupBy(*KEY).agg(
        _of(1, "hash").alias("cur_hash"), _of(-1, "hash").alias("old_hash"),
        _has(1).alias("in_cur"), _has(-1).alias("in_old"),
    )
    change = (
        F.when(~F.col("in_old"), "added").when(~F.col("in_cur"), "deleted")
        .when(~F.col("cur_hash").eqNullSafe(F.col("old_hash")), "modified").otherwise("same")
    )
    same = alike.select(*KEY, F.col("hash").alias("cur_hash"), F.col("hash").alias("old_hash"), F.lit("same").alias("change"))
    return both.select(*KEY, "cur_hash", "old_hash", change.alias("change")).unionByName(same)


def _compared(current: DataFrame, stored: DataFrame, provider: str | None) -> tuple[DataFrame, DataFrame]:
    """``(touched, alike)`` per (item, provider); a stored row without a vector is like no current one."""
    wanted = [provider] if provider else list(K.PROVIDERS)
    cur = with_key(current).withColumn("provider", F.explode(F.array(*[F.lit(p) for p in wanted])))
    old = with_key(stored).where(F.col("provider").isin(wanted))
    key = [*KEY, "provider"]
    cur = cur.withColumn("has_vector", F.lit(True))
    old = old.withColumn("has_vector", F.coalesce("has_vector", F.lit(False)))
    return digests.split_by_change(_sides(cur, old, key, ["text_hash", "has_vector"]), [*key, "text_hash", "has_vector"])


def _statuses(touched: DataFrame) -> DataFrame:
    key = [*KEY, "provider"]
    both = touched.groupBy(*key).agg(
        _of(1, "text_hash").alias("cur_text_hash"), _of(-1, "text_hash").alias("old_text_hash"),
        _of(-1, "has_vector").alias("_vector"), _has(1).alias("_cur"), _has(-1).alias("_old"),
    )
    status = (
        F.when(~F.col("_old"), "new")
        .when(~F.col("_cur"), F.when(F.col("_vector"), "removed").otherwise("gone"))
        .when(~F.col("cur_text_hash").eqNullSafe(F.col("old_text_hash")) | ~F.col("_vector"), "changed")
        .otherwise("unchanged")
    )
    return both.select(*key, "cur_text_hash", "old_text_hash", status.alias("status"))


def classify(current: DataFrame, stored: DataFrame, provider: str | None = None) -> DataFrame:
    """Incremental classes per (item, provider): new, changed, unchanged, removed, gone.

    ``current`` has ``text_hash``; ``stored`` has ``provider, text_hash, has_vector``. An equal
    hash with a missing vector is changed. A stored item that is absent now is removed while it
    still has a vector and gone afterwards, so a second pass finds nothing to do.
    """
    touched, alike = _compared(current, stored, provider)
    same = alike.select(
        *KEY, "provider", F.col("text_hash").alias("cur_text_hash"), F.col("text_hash").alias("old_text_hash"),
        F.lit("unchanged").alias("status"),
    )
    return _statuses(touched).unionByName(same)


def moved(current: DataFrame, stored: DataFrame, provider: str | None = None) -> DataFrame:
    """The rows of ``classify`` that are not unchanged; work grows with them, not with the tables."""
    return _statuses(_compared(current, stored, provider)[0]).where("status <> 'unchanged'")


def sync_stats(classes: DataFrame, by: list[str]) -> DataFrame:
    """Counts of each class and an up-to-date flag."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("new", "changed", "unchanged", "removed")]
    return classes.groupBy(*by).agg(*counts).withColumn(
        "up_to_date", (F.col("new") + F.col("changed") + F.col("removed")) == 0
    )


def removed_keys(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored keys without a current row."""
    return with_key(stored).select(*KEY).join(with_key(current).select(*KEY), KEY, "left_anti")


def keys_except(a: DataFrame, b: DataFrame) -> DataFrame:
    return with_key(a).select(*KEY).subtract(with_key(b).select(*KEY))


def keys_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return with_key(a).select(*KEY).intersect(with_key(b).select(*KEY))


def _word(digest: Column, n: int) -> Column:
    return F.conv(F.substring(digest, 8 * n + 1, 8), 16, 10).cast("decimal(20,0)")


def fingerprint(items: DataFrame, by: list[str], content: str = "vector_text") -> DataFrame:
    """One digest per group over the set of (key, content).

    Each item gives an MD5; its four words are summed per group. Sums combine before the
    shuffle and hold five numbers whatever the size of the group, so no text or hash list is
    ever put together. Any added, removed or edited item changes the digest.
    """
    body = F.concat_ws("\x1f", F.coalesce("schema_name", F.lit("")), "table_name", F.md5(F.col(content)))
    hashed = items.select(*by, F.md5(body).alias("_h"))
    sums = [F.sum(_word(F.col("_h"), n)).alias(f"_w{n}") for n in range(4)]
    parts = [F.col("_n").cast("string")] + [F.col(f"_w{n}").cast("string") for n in range(4)]
    return (
        hashed.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("_n"), *sums)
        .select(*by, F.md5(F.concat_ws(",", *parts)).alias("fingerprint"))
    )


def fingerprint_gate(current: DataFrame, stored: DataFrame, missing: DataFrame) -> DataFrame:
    """What each tenant needs: a full incremental pass, a null-only pass, or nothing.

    ``current`` and ``stored`` have ``db_name, fingerprint``; ``missing`` has ``db_name`` once
    per row that lacks a vector.
    """
    gaps = missing.groupBy("db_name").agg(F.count(F.lit(1)).alias("missing_vectors"))
    old = stored.select("db_name", F.col("fingerprint").alias("_old"))
    out = current.join(old, "db_name", "left").join(gaps, "db_name", "left")
    changed = F.col("_old").isNull() | (F.col("_old") != F.col("fingerprint"))
    return out.select(
        "db_name",
        "fingerprint",
        F.coalesce("missing_vectors", F.lit(0)).alias("missing_vectors"),
        F.when(changed, "full")
        .when(F.coalesce("missing_vectors", F.lit(0)) > 0, "fill")
        .otherwise("none")
        .alias("action"),
    )


def missing_vectors(items: DataFrame, vectors: DataFrame, key: list[str]) -> DataFrame:
    """(item, provider) pairs that have no vector yet, for the fixed list of providers."""
    wanted = items.withColumn("provider", F.explode(F.array(*[F.lit(p) for p in K.PROVIDERS])))
    have = vectors.where(F.col("embedding").isNotNull()).select(*key, "provider")
    return wanted.join(have, [*key, "provider"], "left_anti")


def coverage_counts(vectors: DataFrame, by: list[str]) -> DataFrame:
    """Rows, filled and empty vectors per provider, in one pass."""
    aggs = [F.count(F.lit(1)).alias("total_rows")]
    for p in K.PROVIDERS:
        mine = F.col("provider") == p
        aggs.append(F.count_if(mine & F.col("embedding").isNotNull()).alias(f"{p}_filled"))
        aggs.append(F.count_if(mine & F.col("embedding").isNull()).alias(f"{p}_empty"))
    return vectors.groupBy(*by).agg(*aggs)
