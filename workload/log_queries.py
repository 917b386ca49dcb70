"""Query-log rows, reports and admission."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescout.operators import admission, logs
from workload.inputs import frame, table, with_inputs

Q: dict = {}


def add(name, fn, sql=None):
    Q[name] = (fn, sql)


def rounded(df, names, digits=6):
    """Sums of doubles differ in the last places between engines."""
    return df.withColumns({n: F.round(n, digits) for n in names})


_PAGE = ["event_id", "nl_query", "search_mode", "execute_status", "total_duration_ms", "created_at"]
add(
    "log_history",
    lambda s, d: logs.history(frame(s, d, "runs"), "42", 500, "2024-01-05", "2024-01-20", "click", tie="event_id").select(*_PAGE),
    with_inputs("runs", """SELECT event_id, nl_query, search_mode, execute_status, total_duration_ms, created_at FROM runs WHERE db_name = '42'
        AND created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-21' AND search_mode = 'click' ORDER BY created_at DESC, event_id DESC LIMIT 200"""),
)
add(
    "log_latest",
    lambda s, d: logs.latest_per_tenant(frame(s, d, "runs"), 50, "event_id").select("db_name", "position", "event_id", "created_at"),
    with_inputs("runs", """SELECT db_name, position, event_id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY db_name ORDER BY created_at DESC, event_id DESC) AS position FROM runs) WHERE position <= 50"""),
)


def _log_rows(s, d):
    runs = frame(s, d, "runs").select(
        "event_id", "db_name", "created_at", "execute_status",
        F.when(F.col("search_mode") == "signup", "orders").when(F.col("search_mode") == "view", "").alias("selected_table"),
        F.when(F.col("search_mode") == "purchase", "manual_sql").alias("search_mode"),
        (F.col("search_mode") != "click").alias("use_vectors"),
        F.lit(10).alias("top_k"),
        F.array(F.concat(F.lit("a."), "db_name"), F.lit("b.表")).alias("matched_tables"),
        F.repeat("nl_query", 200).alias("error_message"),
    )
    return logs.log_rows(runs).withColumns({"top_k": F.coalesce("top_k", F.lit(0)), "log_date": F.col("log_date").cast("string")})


add(
    "log_rows",
    _log_rows,
    with_inputs("runs", """, r AS (SELECT *, CASE search_mode WHEN 'signup' THEN 'orders' WHEN 'view' THEN '' END AS selected_table,
         CASE WHEN search_mode = 'purchase' THEN 'manual_sql' WHEN search_mode = 'signup' THEN 'selected_table' WHEN search_mode <> 'click' THEN 'vector' ELSE 'all' END AS mode FROM runs)
       SELECT event_id, db_name, created_at, execute_status, selected_table, mode AS search_mode, CASE WHEN mode = 'vector' THEN 10 ELSE 0 END AS top_k,
         '["a.' || db_name || '","b.表"]' AS matched_tables, substr(repeat(nl_query, 200), 1, 1000) AS error_message, CAST(CAST(created_at AS DATE) AS VARCHAR) AS log_date FROM r"""),
)
add(
    "status_share",
    lambda s, d: logs.status_share(frame(s, d, "runs")),
    with_inputs("runs", """SELECT execute_status, count(*) AS runs, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM runs), 2) AS percentage FROM runs GROUP BY 1"""),
)
add(
    "latency_stats",
    lambda s, d: rounded(logs.latency_stats(frame(s, d, "runs")), ["avg_ms"]),
    with_inputs("runs", """SELECT round(avg(total_duration_ms), 6) AS avg_ms, max(total_duration_ms) AS max_ms, min(total_duration_ms) AS min_ms, count(*) AS runs
        FROM runs WHERE execute_status = 'success'"""),
)
add(
    "latency_by_mode",
    lambda s, d: rounded(logs.latency_stats(frame(s, d, "runs"), ["db_name", "search_mode"]), ["avg_ms"]),
    with_inputs("runs", """SELECT db_name, search_mode, round(avg(total_duration_ms), 6) AS avg_ms, max(total_duration_ms) AS max_ms, min(total_duration_ms) AS min_ms, count(*) AS runs
        FROM runs WHERE execute_status = 'success' GROUP BY ALL"""),
)
_STAGE_SQL = ", ".join(f"round(avg({c}), 6) AS avg_{c}, max({c}) AS max_{c}" for c in logs.STAGES)
add(
    "stage_durations",
    lambda s, d: rounded(logs.stage_durations(frame(s, d, "runs")), ["avg_" + c for c in logs.STAGES]),
    with_inputs("runs", f"SELECT search_mode, execute_status, {_STAGE_SQL} FROM runs GROUP BY ALL"),
)
add(
    "usage_totals",
    lambda s, d: logs.usage_totals(frame(s, d, "runs"), ["db_name", "search_mode"]),
    with_inputs("runs", """SELECT db_name, search_mode, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens,
        sum(total_tokens)::BIGINT AS total_tokens, count(*) AS llm_calls FROM runs GROUP BY ALL"""),
)
add(
    "retrieval_quality",
    lambda s, d: rounded(
        logs.retrieval_quality(frame(s, d, "hits").withColumn("ms", F.col("score") * 10 + F.col("rank")), ["schema_name"], 1.0, latency="ms"),
        ["avg_score", "min_score", "max_score", "hit_share", "score_p50", "score_p95", "latency_avg", "latency_p50", "latency_p95"],
    ),
    with_inputs("hits", """SELECT schema_name, count(*) AS hits, round(avg(score), 6) AS avg_score, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score,
        round(count(*) FILTER (score <= 1.0) / count(*), 6) AS hit_share, round(quantile_cont(score, 0.5), 6) AS score_p50, round(quantile_cont(score, 0.95), 6) AS score_p95,
        round(avg(score * 10 + rank), 6) AS latency_avg, round(quantile_cont(score * 10 + rank, 0.5), 6) AS latency_p50, round(quantile_cont(score * 10 + rank, 0.95), 6) AS latency_p95
        FROM hits GROUP BY ALL"""),
)


def _sketched(s, d, error=0.02):
    """Percentiles out of merged sketches, and whether their exact ranks are within the error."""
    hits = frame(s, d, "hits")
    parts = logs.score_sketches(hits, ["schema_name", "rank"])
    found = logs.sketch_quantiles(logs.merged_sketches(parts, ["schema_name"]))
    joined = hits.join(found.select("schema_name", "n", "score_p50", "score_p95"), "schema_name")
    share = lambda of: F.count_if(of) / F.count(F.lit(1))
    out = joined.groupBy("schema_name").agg(
        F.max("n").alias("hits"),
        *[x for p in ("p50", "p95") for x in (
            share(F.col("score") < F.col(f"score_{p}")).alias(f"{p}_below"), share(F.col("score") <= F.col(f"score_{p}")).alias(f"{p}_upto"),
        )],
    )
    near = lambda p, q: (F.col(f"{p}_below") <= q + error) & (F.col(f"{p}_upto") >= q - error)
    return out.select("schema_name", "hits", near("p50", 0.5).alias("p50_near"), near("p95", 0.95).alias("p95_near"))


add(
    "retrieval_sketch",
    _sketched,
    with_inputs("hits", "SELECT schema_name, count(score) AS hits, true AS p50_near, true AS p95_near FROM hits GROUP BY ALL"),
)
add(
    "trailing_count",
    lambda s, d: logs.trailing_counts(table(s, d, "events"), "user_id", "ts", 86400),
    """SELECT DISTINCT user_id, ts, count(*) OVER (PARTITION BY user_id, ts) AS n,
       count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS trailing FROM events""",
)


def _odd_events(s, d):
    ev = table(s, d, "events")
    return ev.select(
        F.when(F.col("event_type") != "error", F.col("user_id")).alias("user_id"),
        F.when(F.col("event_type") != "signup", F.col("ts")).alias("ts"), "event_id",
    )


add(
    "admit_null_keys",
    lambda s, d: admission.admit_events(_odd_events(s, d), "user_id", "ts", "event_id", limit=2, seconds=86400),
    """WITH e AS (SELECT CASE WHEN event_type <> 'error' THEN user_id END AS user_id, CASE WHEN event_type <> 'signup' THEN ts END AS ts, event_id FROM events)
       , l AS (SELECT user_id, list({'t': epoch_us(ts), 'e': event_id} ORDER BY ts, event_id) AS ev FROM e WHERE ts IS NOT NULL GROUP BY 1)
       , f AS (SELECT list_reduce(ev, lambda acc, x: CASE WHEN len(list_filter(acc.h, lambda t: x.t - t < 86400000000)) < 2
              THEN {'h': list_append(list_filter(acc.h, lambda t: x.t - t < 86400000000), x.t), 'a': list_append(acc.a, x.e)} ELSE acc END,
              {'h': CAST([] AS BIGINT[]), 'a': CAST([] AS BIGINT[])}) AS r FROM l)
       , ok AS (SELECT unnest(r.a) AS event_id FROM f)
       SELECT user_id, ts, event_id, event_id IN (SELECT event_id FROM ok) AS admitted FROM e""",
)
add(
    "trailing_null_times",
    lambda s, d: logs.trailing_counts(_odd_events(s, d), "user_id", "ts", 86400),
    """WITH e AS (SELECT CASE WHEN event_type <> 'error' THEN user_id END AS user_id, CASE WHEN event_type <> 'signup' THEN ts END AS ts FROM events)
       SELECT DISTINCT user_id, ts, count(*) OVER (PARTITION BY user_id, ts) AS n,
       CASE WHEN ts IS NOT NULL THEN count(*) OVER (PARTITION BY user_id, ts IS NULL ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) END AS trailing FROM e""",
)
add(
    "admit_events",
    lambda s, d: admission.admit_events(table(s, d, "events"), "user_id", "ts", "event_id", limit=2, seconds=86400),
    """WITH l AS (SELECT user_id, list({'t': epoch_us(ts), 'e': event_id} ORDER BY ts, event_id) AS ev FROM events GROUP BY 1)
       , f AS (SELECT user_id, list_reduce(ev, lambda acc, x: CASE WHEN len(list_filter(acc.h, lambda t: x.t - t < 86400000000)) < 2
              THEN {'h': list_append(list_filter(acc.h, lambda t: x.t - t < 86400000000), x.t), 'a': list_append(acc.a, x.e)} ELSE acc END,
              {'h': CAST([] AS BIGINT[]), 'a': CAST([] AS BIGINT[])}) AS r FROM l)
       , ok AS (SELECT unnest(r.a) AS event_id FROM f)
       SELECT user_id, ts, event_id, event_id IN (SELECT event_id FROM ok) AS admitted FROM events""",
)
