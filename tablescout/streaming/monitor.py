"""Polling for changed catalogs as a stream of announced snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablescout.operators.sized import broadcast_if_small
from tablescout.plans import sync
from tablescout.sources import snapshots
from tablescout.sources.lineage import cut_lineage

MARKERS = "snapshot_at timestamp_ntz, path string, tenants array<string>"


def apply_snapshot(
    items: DataFrame, root: str, encoders: dict[str, Callable] | None = None, tenants: list[str] | None = None
) -> dict:
    """Bring the stored vectors of the snapshot's tenants up to date: deletes, then upserts.

    ``tenants`` names what the snapshot covers, so that a tenant without any item is cleared; without
    it the tenants are those that have items.
    Only the folders of these tenants are read, only tenants with a change are written, and
    nothing is written when nothing changed.
    """
    spark = items.sparkSession
    covered = items.select("db_name")
    if tenants:
        covered = covered.unionByName(spark.createDataFrame([(t,) for t in tenants], "db_name string"))
    base = snapshots.current_version(spark, root)
    stored = snapshots.read_parts(spark, root, sync.STORED, "db_name", covered.distinct())
    # Hashes first: texts are encoded only when some hash differs.
    classes = sync.sync_classes(items, stored, unchanged=True)
    counts = classes.agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("new", "changed", "unchanged", "removed", "gone")]
    ).first().asDict()
    moved = classes.where(F.col("status") != "unchanged").select("db_name").distinct()
    if counts["new"] + counts["changed"] + counts["removed"] + counts["gone"] == 0:
        return counts
    busy = broadcast_if_small(cut_lineage(moved))
    synced = sync.apply_sync(
        classes.join(busy, "db_name", "left_semi"),
        items.join(busy, "db_name", "left_semi"),
        stored.join(busy, "db_name", "left_semi"),
        F.current_timestamp().cast("timestamp_ntz"),
        encoders,
    )
    kept = sync.store(synced.where(~F.col("status").isin("removed", "gone")))
    snapshots.write_parts(kept, root, "db_name", busy, base)
    return counts


def watch(
    spark: SparkSession,
    markers: str,
    root: str,
    checkpoint: str,
    seconds: int = 60,
    once: bool = False,
    encoders: dict[str, Callable] | None = None,
) -> StreamingQuery:
    """Apply every newly announced snapshot. ``once`` handles what is there and stops (daily pass).

    The stream reads marker rows (``snapshot_at``, ``path``), one small JSON file per finished
    snapshot; the snapshot itself may have any number of files and is read as a table. It
    holds all items of its tenants, which ``tenants`` of the marker may name.
    """
    rows = spark.readStream.schema(MARKERS).option("maxFilesPerTrigger", 16).json(markers)

    def each(batch: DataFrame, _: int) -> None:
        for marker in batch.orderBy("snapshot_at").collect():
            apply_snapshot(spark.read.parquet(marker["path"]), root, encoders, marker["tenants"])

    writer = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if once else {"processingTime": f"{seconds} seconds"}
    return writer.trigger(**trigger).start()
