"""Dense numbering and id allocation without a single-task window."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dense_numbers(
    df: DataFrame, order: str, name: str = "n", pieces: int | None = None
) -> DataFrame:
    """Number the rows 1..n in the order of a unique numeric column.

    Rows are cut into ranges at approximate quantiles of the order column. Each range is
    counted by a map-side aggregate, the running count over the ranges (as many rows as
    there are ranges) gives each its offset, and the rows are numbered inside their range.
    No task sees more than one range.
    """
    spark = df.sparkSession
    if pieces is None:
        pieces = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = F.col(order).cast("double")
    # The quantiles are `pieces` numbers, whatever the size of the table.
    cuts = df.select(key.alias("k")).approxQuantile(
        "k", [i / pieces for i in range(1, pieces)], 0.5 / pieces
    )
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    if len(splits) < 3:
        splits = [float("-inf"), 0.0, float("inf")]
    tagged = Bucketizer(splits=splits, inputCol="_k", outputCol="_piece").transform(
        df.withColumn("_k", key)
    )
    counts = tagged.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("_piece").orderBy(order)
    return (
        tagged.withColumn("_at", F.row_number().over(inside))
        .join(offsets, "_piece")
        .withColumn(name, (F.col("_before") + F.col("_at")).cast("long"))
        .drop("_k", "_piece", "_before", "_at")
    )


def insert_with_ids(
    stored: DataFrame, incoming: DataFrame, order: str, id_col: str = "id"
) -> DataFrame:
    """Append a batch whose ids follow the largest stored id (1 for an empty table)."""
    last = stored.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("last_id")).scalar()
    numbered = dense_numbers(incoming, order, "_n")
    fresh = numbered.withColumn(id_col, last + F.col("_n"))
    return stored.unionByName(fresh.select(*stored.columns))


def first_n_per_group(df: DataFrame, keys: list[str], order: list, n: int, rank: str) -> DataFrame:
    """First n rows of each group; Spark limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


