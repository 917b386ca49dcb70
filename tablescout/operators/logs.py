"""Query-log rows and reports.

The log has ``db_name, nl_query, schema_filter, search_mode, selected_table, top_k,
matched_tables, generated_sql, execute_status, error_message, result_rows,
search_duration_ms, llm_duration_ms, sql_exec_duration_ms, total_duration_ms, prompt_tokens,
completion_tokens, total_tokens, llm_calls, created_at`` and is partitioned by ``log_date``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescout.functions import constants as K
from tablescout.functions import text
from tablescout.functions.times import epoch_micros, from_micros
from tablescout.operators import ordered
from tablescout.sources.lineage import cut_lineage

STAGES = ("search_duration_ms", "llm_duration_ms", "sql_exec_duration_ms", "total_duration_ms")


def log_rows(runs: DataFrame) -> DataFrame:
    """Runs as log rows: derived mode, JSON list of tables, cut error text, log date."""
    mode = F.coalesce(
        F.col("search_mode"), text.search_mode(F.col("selected_table"), F.col("use_vectors"))
    )
    return runs.withColumns(
        {
            "search_mode": mode,
            "top_k": F.when(mode == "vector", F.col("top_k")),
            "matched_tables": F.to_json("matched_tables"),
            "error_message": F.left("error_message", F.lit(K.ERROR_CHARS)),
            "log_date": F.to_date("created_at"),
        }
    ).drop("use_vectors")


def history_filter(
    db_name: str,
    start_time: str | None = None,
    end_date: str | None = None,
    search_mode: str | None = None,
) -> Column:
    """Start inclusive; the end date counts as a whole day; the mode is optional."""
    tests = [F.col("db_name") == db_name]
    if start_time:
        tests.append(F.col("created_at") >= F.lit(start_time).cast("timestamp_ntz"))
    if end_date:
        after = F.date_add(F.to_date(F.lit(end_date), "yyyy-MM-dd"), 1)
        tests.append(F.col("created_at") < after.cast("timestamp_ntz"))
    if search_mode:
        tests.append(F.col("search_mode") == search_mode)
    return reduce(lambda a, b: a & b, tests)


def history(
    log: DataFrame,
    db_name: str,
    limit: int = K.HISTORY_LIMIT,
    start_time: str | None = None,
    end_date: str | None = None,
    search_mode: str | None = None,
    tie: str | None = None,
) -> DataFrame:
    """Latest runs of one tenant, newest first; the limit is kept between 1 and 200."""
    n = max(1, min(int(limit), K.HISTORY_LIMIT_MAX))
    order = [F.col("created_at").desc()] + ([F.col(tie).desc()] if tie else [])
    if "log_date" in log.columns:
        # The partition column repeats the time bounds, so other days are not listed or read.
        if start_time:
            log = log.where(F.col("log_date") >= F.to_date(F.lit(start_time)))
        if end_date:
            log = log.where(F.col("log_date") <= F.to_date(F.lit(end_date)))
    return log.where(history_filter(db_name, start_time, end_date, search_mode)).orderBy(*order).limit(n)


def latest_per_tenant(log: DataFrame, n: int, tie: str) -> DataFrame:
    """The history page of every tenant at once; each group is cut before the shuffle."""
    w = Window.partitionBy("db_name").orderBy(F.col("created_at").desc(), F.col(tie).desc())
    return log.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def status_share(log: DataFrame) -> DataFrame:
    """Runs per status with the percentage of all runs, two decimals."""
    counts = log.groupBy("execute_status").agg(F.count(F.lit(1)).alias("runs"))
    # The window runs over one row per status.
    total = F.sum("runs").over(Window.partitionBy())
    share = F.round(F.col("runs").cast("double") * 100.0 / total, 2)
    return counts.withColumn("percentage", share)


def latency_stats(log: DataFrame, by: list[str] = ()) -> DataFrame:
    """Mean, largest and smallest duration of successful runs."""
    d = "total_duration_ms"
    return (
        log.where(F.col("execute_status") == "success")
        .groupBy(*by)
        .agg(
            F.avg(d).alias("avg_ms"),
            F.max(d).alias("max_ms"),
            F.min(d).alias("min_ms"),
            F.count(F.lit(1)).alias("runs"),
        )
    )


def stage_durations(log: DataFrame) -> DataFrame:
    """Mean and largest time of each stage by mode and status."""
    aggs = []
    for c in STAGES:
        aggs += [F.avg(c).alias("avg_" + c), F.max(c).alias("max_" + c)]
    return log.groupBy("search_mode", "execute_status").agg(*aggs)


def usage_totals(calls: DataFrame, by: list[str]) -> DataFrame:
    """Token sums and call count per request."""
    sums = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")]
    return calls.groupBy(*by).agg(*sums, F.count(F.lit(1)).alias("llm_calls"))


def retrieval_quality(
    hits: DataFrame, by: list[str], within: float, percentiles: tuple[float, ...] = (0.5, 0.95), latency: str | None = None
) -> DataFrame:
    """Score spread, percentiles and the share of hits at or under a distance.

    Percentile ``p`` is column ``score_p50`` and so on; ``latency`` names a column of durations whose
    mean and percentiles are added as ``latency_avg``, ``latency_p50`` and so on. Percentiles
    lie between two rows where they must; values are counted, not listed. A group keeps a counter for
    each different value, so use ``score_sketches`` where these are many.
    """
    good = F.count_if(F.col("score") <= within).cast("double")

    def spread(column: str, prefix: str) -> list[Column]:
        return [F.percentile(column, p).alias(f"{prefix}_p{round(100 * p)}") for p in percentiles]

    more = [F.avg(latency).alias("latency_avg"), *spread(latency, "latency")] if latency else []
    return hits.groupBy(*by).agg(
        F.count(F.lit(1)).alias("hits"),
        F.avg("score").alias("avg_score"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
        (good / F.count(F.lit(1))).alias("hit_share"),
        *spread("score", "score"), *more,
    )


def score_sketches(hits: DataFrame, by: list[str], column: str = "score", k: int = 800) -> DataFrame:
    """A quantile sketch of each group's values: ``by, sketch``.

    A sketch is a few kilobytes whatever the group's size, combines before the shuffle, and can be stored:
    those of days or regions merge to that of the whole. ``k`` sets its accuracy; at 800 a quantile's rank
    is off by about half a percent. Null values are left out; a group without any has a null sketch.
    """
    value = F.col(column).cast("double")
    return hits.groupBy(*by).agg(F.kll_sketch_agg_double(value, k).alias("sketch"))


def merged_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of coarser groups out of stored ones."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(sketches: DataFrame, percentiles: tuple[float, ...] = (0.5, 0.95), prefix: str = "score") -> DataFrame:
    """The sketches with ``n``, the number of values, and the value at each percentile."""
    out = sketches.withColumn("n", F.kll_sketch_get_n_double("sketch"))
    for p in percentiles:
        out = out.withColumn(f"{prefix}_p{round(100 * p)}", F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))))
    return out


_COUNTED = f"k string, us long, n long, trailing long, piece int, {ordered.EDGE}"


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream of sorted rows (k, us, kind, n) to the running sum of each arrival, and the partition's edge."""
    piece = ordered.this_piece()
    first, key, at, total = None, None, None, 0
    for b in batches:
        if not b.num_rows:
            continue
        n, sums = b.column(3).to_numpy(), np.zeros(b.num_rows, dtype=np.int64)
        for k, lo, hi in ordered.segments(b.column(0)):
            if first is None:
                first, at = k, b.column(1)[lo].as_py()
            if k != key:
                key, total = k, 0
            sums[lo:hi] = total + np.cumsum(n[lo:hi])
            total = int(sums[hi - 1])
        came = np.flatnonzero(b.column(2).to_numpy() == 1)
        mine = b.take(pa.array(came))
        yield ordered.batch_of(
            [None] * len(came), k=mine.column(0), us=mine.column(1), n=mine.column(3), trailing=pa.array(sums[came]),
            piece=pa.array(np.full(len(came), piece, dtype=np.int32)),
        )
    if first is not None:
        none = pa.nulls(1, pa.int64())
        yield ordered.batch_of(
            [ordered.Edge(piece, first, key, at, [total])], k=pa.nulls(1, pa.string()), us=none, n=none, trailing=none,
            piece=pa.nulls(1, pa.int32()),
        )


def trailing_counts(events: DataFrame, key: str, time: str, seconds: int, pieces: int | None = None) -> DataFrame:
    """Number of events of the key in the last ``seconds`` (strict), itself included.

    Equal times of a key are counted before the shuffle. Each count comes once when it enters the
    window and once, negative, when it leaves; the running sum over both is the count in the window.
    Sums run in range partitions by key and time, so a hot key is cut by its rows however they
    crowd, and the sum at the end of a partition is added to its key's rows in the next. ``pieces`` is
    the number of these, by default the session's.

    The result has one row per (key, time) with ``n`` events at that time and ``trailing`` in the
    window. A null time lies in no window, so its row has a null ``trailing``; null keys are one key.
    """
    spark, window = events.sparkSession, seconds * 1_000_000
    ktype, ttype = events.schema[key].dataType, events.schema[time].dataType
    # Written once, as the borders are sampled from it before it is dealt out.
    at = cut_lineage(events.groupBy(key, time).agg(F.count(F.lit(1)).alias("n")))
    timeless = at.where(F.col(time).isNull()).select(key, time, "n", F.lit(None).cast("long").alias("trailing"))
    # Expiries first, as an event is out when the window has passed in full.
    moves = F.array(
        F.struct(F.lit(0).cast("long").alias("by"), F.lit(1).alias("kind"), F.lit(1).alias("sign")),
        F.struct(F.lit(window).cast("long").alias("by"), F.lit(0).alias("kind"), F.lit(-1).alias("sign")),
    )
    timed = at.where(F.col(time).isNotNull()).select(
        # A mark before the value keeps null apart from any text.
        F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("k"),
        epoch_micros(F.col(time), ttype).alias("us"), "n", F.inline(moves),
    )
    rows = timed.select("k", (F.col("us") + F.col("by")).alias("us"), "kind", (F.col("n") * F.col("sign")).alias("n"))
    summed = cut_lineage(ordered.ranged(rows, "k", "us", "kind", pieces=pieces).mapInArrow(_running, _COUNTED))
    carry: dict[int, int] = {}
    heads = []
    for before, after in ordered.crossings(ordered.edges_of(summed)):
        over = carry.get(before.piece, 0) if before.first == before.last else 0
        carry[after.piece] = before.state[0] + over
        heads.append((after.piece, after.first, carry[after.piece]))
    counted = summed.where("edge IS NULL")
    if heads:
        # At most one small row for each partition.
        heads = F.broadcast(spark.createDataFrame(heads, "piece int, k string, carry long"))
        counted = counted.join(heads, ["piece", "k"], "left").withColumn(
            "trailing", F.col("trailing") + F.coalesce("carry", F.lit(0))
        )
    return counted.select(
        F.when(F.col("k") != "", F.substring("k", 2, 2**31 - 1)).cast(ktype).alias(key),
        from_micros(F.col("us"), ttype).alias(time), "n", "trailing",
    ).unionByName(timeless)
