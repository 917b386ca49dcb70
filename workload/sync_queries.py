"""Diffs, table versions and vector sync."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.functions import vectors as V
from tablescout.operators import diff, encode, numbering, upsert
from tablescout.plans import search, sync
from tablescout.sources import ingest
from workload.catalog_queries import fingerprint_sql
from workload.inputs import frame, table, with_inputs

Q: dict = {}
NOW = "2024-02-01 00:00:00"
KEY = "db_name, schema_name, table_name"


def add(name, fn, sql=None):
    Q[name] = (fn, sql)


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _hashed(df, name):
    return df.select(*diff.KEY, F.md5("vector_text").alias(name))


def _cur(s, d, name="hash"):
    return _hashed(frame(s, d, "items"), name)


def _old(s, d, name="hash"):
    return _hashed(frame(s, d, "stored_items"), name)


_KEYED = """, cur AS (SELECT db_name, coalesce(schema_name, '') AS schema_name, table_name, md5(vector_text) AS hash, length(vector_text) AS n_chars FROM items)
  , old AS (SELECT db_name, coalesce(schema_name, '') AS schema_name, table_name, md5(vector_text) AS hash FROM stored_items)
  , vec AS (SELECT db_name, coalesce(schema_name, '') AS schema_name, table_name, provider, text_hash, embedding, updated_at FROM stored_vectors)
  , cls AS (SELECT db_name, schema_name, table_name, provider, c.hash AS new_hash, c.n_chars, v.text_hash AS old_hash, v.embedding,
       CASE WHEN v.text_hash IS NULL THEN 'new' WHEN c.hash IS NULL THEN CASE WHEN v.embedding IS NOT NULL THEN 'removed' ELSE 'gone' END
            WHEN c.hash <> v.text_hash OR v.embedding IS NULL THEN 'changed' ELSE 'unchanged' END AS status
     FROM (SELECT * FROM cur CROSS JOIN (VALUES ('local'), ('api')) p(provider)) c FULL JOIN vec v USING (db_name, schema_name, table_name, provider))
  """
_ALL = "items stored_items stored_vectors"
add(
    "snapshot_diff",
    lambda s, d: diff.snapshot_diff(_cur(s, d), _old(s, d)),
    with_inputs(_ALL, _KEYED + f"""SELECT {KEY}, c.hash AS cur_hash, o.hash AS old_hash, CASE WHEN o.hash IS NULL THEN 'added' WHEN c.hash IS NULL THEN 'deleted'
        WHEN c.hash <> o.hash THEN 'modified' ELSE 'same' END AS change FROM cur c FULL JOIN old o USING ({KEY})"""),
)


def _classes(s, d):
    stored = frame(s, d, "stored_vectors").withColumn("has_vector", F.col("embedding").isNotNull())
    return diff.classify(_cur(s, d, "text_hash"), stored)


add(
    "incremental_classify",
    lambda s, d: _classes(s, d).select(*diff.KEY, "provider", "status"),
    with_inputs(_ALL, _KEYED + f"SELECT {KEY}, provider, status FROM cls"),
)
add(
    "sync_stats",
    lambda s, d: diff.sync_stats(_classes(s, d), ["db_name", "provider"]),
    with_inputs(_ALL, _KEYED + """SELECT db_name, provider, count(*) FILTER (status = 'new') AS new, count(*) FILTER (status = 'changed') AS changed,
        count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'removed') AS removed,
        count(*) FILTER (status IN ('new', 'changed', 'removed')) = 0 AS up_to_date FROM cls GROUP BY ALL"""),
)
add(
    "removed_keys",
    lambda s, d: diff.removed_keys(_cur(s, d), _old(s, d)),
    with_inputs(_ALL, _KEYED + f"SELECT {KEY} FROM old EXCEPT SELECT {KEY} FROM cur"),
)
add(
    "keys_except",
    lambda s, d: diff.keys_except(_cur(s, d), _old(s, d)),
    with_inputs(_ALL, _KEYED + f"SELECT {KEY} FROM cur EXCEPT SELECT {KEY} FROM old"),
)
add(
    "keys_intersect",
    lambda s, d: diff.keys_intersect(_cur(s, d), _old(s, d)),
    with_inputs(_ALL, _KEYED + f"SELECT {KEY} FROM cur INTERSECT SELECT {KEY} FROM old"),
)
add(
    "missing_vectors",
    lambda s, d: diff.missing_vectors(
        diff.with_key(frame(s, d, "items")).select(*diff.KEY), diff.with_key(frame(s, d, "stored_vectors")), diff.KEY
    ),
    with_inputs(_ALL, _KEYED + f"""SELECT {KEY}, provider FROM cur CROSS JOIN (VALUES ('local'), ('api')) p(provider)
        EXCEPT SELECT {KEY}, provider FROM vec WHERE embedding IS NOT NULL"""),
)
add(
    "coverage_counts",
    lambda s, d: diff.coverage_counts(frame(s, d, "stored_vectors"), ["db_name"]),
    with_inputs("stored_vectors", """SELECT db_name, count(*) AS total_rows,
        count(*) FILTER (provider = 'local' AND embedding IS NOT NULL) AS local_filled, count(*) FILTER (provider = 'local' AND embedding IS NULL) AS local_empty,
        count(*) FILTER (provider = 'api' AND embedding IS NOT NULL) AS api_filled, count(*) FILTER (provider = 'api' AND embedding IS NULL) AS api_empty
        FROM stored_vectors GROUP BY ALL"""),
)
add(
    "vector_scan",
    lambda s, d: search.vector_scan(frame(s, d, "stored_vectors"), "api").select(*diff.KEY, F.size("embedding").alias("dim")),
    with_inputs("stored_vectors", f"SELECT {KEY}, len(embedding) AS dim FROM stored_vectors WHERE provider = 'api' AND embedding IS NOT NULL"),
)
add(
    "vector_dims",
    lambda s, d: encode.vector_rejects(frame(s, d, "stored_vectors"), {"local": 64, "api": 2048}).select(*diff.KEY, "provider"),
    with_inputs("stored_vectors", f"SELECT {KEY}, provider FROM stored_vectors WHERE provider = 'api' AND embedding IS NOT NULL"),
)


def _synced(s, d):
    out = sync.incremental_sync(frame(s, d, "items").drop("ref"), frame(s, d, "stored_vectors"), _now())
    return out.select(
        *sync.ITEM, "text_hash", "status", "updated_at", F.col("embedding").isNotNull().alias("has_vector"),
        F.round(V.l2_norm(F.col("embedding")), 4).alias("norm"),
    )


add(
    "incremental_sync",
    _synced,
    with_inputs(_ALL, _KEYED + f"""SELECT {KEY}, provider, coalesce(new_hash, old_hash) AS text_hash, status,
        CASE WHEN status IN ('unchanged', 'gone') THEN TIMESTAMP '2024-01-01 00:00:00' ELSE TIMESTAMP '{NOW}' END AS updated_at,
        status IN ('new', 'changed', 'unchanged') AS has_vector,
        CASE WHEN status IN ('new', 'changed') AND n_chars < 3 THEN 0.0::DOUBLE WHEN status IN ('new', 'changed', 'unchanged') THEN 1.0::DOUBLE END AS norm FROM cls"""),
)


def _gate(s, d):
    items, old = frame(s, d, "items"), frame(s, d, "stored_items")
    same = F.col("db_name").isin("fr", "de")
    before = diff.fingerprint(items.where(same).unionByName(old.where(~same)), ["db_name"])
    return sync.check_tenants(items, frame(s, d, "stored_vectors"), before)


add(
    "fingerprint_gate",
    _gate,
    with_inputs(_ALL, _KEYED + f""", before AS (SELECT * FROM items WHERE db_name IN ('fr', 'de') UNION ALL SELECT * FROM stored_items WHERE db_name NOT IN ('fr', 'de'))
      , a AS (SELECT * FROM {fingerprint_sql('items')}), b AS (SELECT * FROM {fingerprint_sql('before')})
      , m AS (SELECT db_name, count(*) AS n FROM (SELECT {KEY}, provider FROM cur CROSS JOIN (VALUES ('local'), ('api')) p(provider)
             EXCEPT SELECT {KEY}, provider FROM vec WHERE embedding IS NOT NULL) GROUP BY 1)
      SELECT a.db_name, a.fingerprint, coalesce(m.n, 0) AS missing_vectors, CASE WHEN b.fingerprint IS NULL OR b.fingerprint <> a.fingerprint THEN 'full'
        WHEN coalesce(m.n, 0) > 0 THEN 'fill' ELSE 'none' END AS action FROM a LEFT JOIN b USING (db_name) LEFT JOIN m USING (db_name)"""),
)


def _checked(s, d):
    items = frame(s, d, "items")
    out = sync.check_and_sync(items, frame(s, d, "stored_vectors"), diff.fingerprint(items, ["db_name"]), _now())
    return out.select(*sync.ITEM, "text_hash", F.col("embedding").isNotNull().alias("has_vector"))


add(
    "check_and_sync",
    _checked,
    with_inputs(_ALL, _KEYED + f""", m AS (SELECT DISTINCT db_name FROM (SELECT {KEY}, provider FROM cur CROSS JOIN (VALUES ('local'), ('api')) p(provider)
             EXCEPT SELECT {KEY}, provider FROM vec WHERE embedding IS NOT NULL))
      , done AS (SELECT {KEY}, provider, coalesce(new_hash, old_hash) AS text_hash, status IN ('new', 'changed', 'unchanged') AS has_vector
             FROM cls WHERE db_name IN (SELECT db_name FROM m)
             UNION ALL SELECT {KEY}, provider, text_hash, embedding IS NOT NULL FROM vec WHERE db_name NOT IN (SELECT db_name FROM m))
      SELECT * FROM done WHERE schema_name NOT IN ('information_schema', 'pg_catalog', 'knowledge', 'hg_recyclebin')
        AND schema_name NOT LIKE 'pg_%' AND table_name NOT LIKE '%_middle%'"""),
)


def _upserted(s, d):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    stored = _old(s, d, "text_hash").withColumns({"created_at": start, "updated_at": start})
    return upsert.bulk_upsert(stored, _cur(s, d, "text_hash").withColumn("created_at", _now()), diff.KEY, _now(), keep=["created_at"])


add(
    "bulk_upsert",
    _upserted,
    with_inputs(_ALL, _KEYED + f"""SELECT {KEY}, coalesce(c.hash, o.hash) AS text_hash,
       CASE WHEN o.hash IS NOT NULL THEN TIMESTAMP '2024-01-01 00:00:00' ELSE TIMESTAMP '{NOW}' END AS created_at,
       CASE WHEN c.hash IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS updated_at FROM cur c FULL JOIN old o USING ({KEY})"""),
)


def _one_item(s, d):
    """The latest item alone, for every provider."""
    one = frame(s, d, "items").orderBy(F.col("ref").desc()).limit(1).drop("ref")
    out = sync.upsert_items(one, frame(s, d, "stored_vectors"), _now())
    return out.select(*sync.ITEM, "text_hash", "updated_at", F.col("embedding").isNotNull().alias("has_vector"))


add(
    "upsert_item",
    _one_item,
    with_inputs(_ALL, _KEYED + f""", one AS (SELECT db_name, coalesce(schema_name, '') AS schema_name, table_name, provider, md5(vector_text) AS hash
         FROM (SELECT * FROM items ORDER BY ref DESC LIMIT 1) CROSS JOIN (VALUES ('local'), ('api')) p(provider))
       SELECT {KEY}, provider, coalesce(o.hash, v.text_hash) AS text_hash, CASE WHEN o.hash IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE v.updated_at END AS updated_at,
         o.hash IS NOT NULL OR v.embedding IS NOT NULL AS has_vector FROM vec v FULL JOIN one o USING ({KEY}, provider)"""),
)


def _newest(s, d):
    ev = table(s, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return upsert.pk_upsert(ev.where("event_type <> 'error'"), ev.where("event_type = 'error'"), ["user_id"], "ts")


add(
    "pk_upsert",
    _newest,
    """SELECT user_id, ts, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type = 'error' DESC, event_id DESC) AS n FROM events) WHERE n = 1""",
)
add(
    "keyed_update",
    lambda s, d: upsert.keyed_update(
        table(s, d, "documents").select("doc_id", "lang", "source", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("updated_at")),
        table(s, d, "labels").select("doc_id", F.when(F.col("toxic") == 0, F.concat(F.lit("q"), "quality")).alias("source")),
        ["doc_id"], ["source"], _now(),
    ),
    f"""SELECT d.doc_id, lang, coalesce(CASE WHEN toxic = 0 THEN 'q' || quality END, source) AS source,
        CASE WHEN l.doc_id IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS updated_at, l.doc_id IS NOT NULL AS matched
        FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
add(
    "keyed_delete",
    lambda s, d: upsert.delete_where(
        upsert.delete_keys(table(s, d, "documents").select("doc_id", "lang", "source"), table(s, d, "labels").where("toxic = 1"), ["doc_id"]),
        F.nullif(F.col("lang"), F.lit("fr")) == "de",
    ),
    "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND lang <> 'de'",
)
add(
    "insert_with_ids",
    lambda s, d: numbering.insert_with_ids(
        table(s, d, "pages").select(F.col("page_id").alias("id"), F.col("page_id").alias("ref"), F.lit("page").alias("kind")),
        table(s, d, "orders").select(F.col("o_orderkey").alias("ref"), F.lit("order").alias("kind")),
        "ref",
    ),
    """SELECT page_id AS id, page_id AS ref, 'page' AS kind FROM pages UNION ALL
       SELECT (SELECT max(page_id) FROM pages) + row_number() OVER (ORDER BY o_orderkey), o_orderkey, 'order' FROM orders""",
)


def _cleared(s, d):
    stored = diff.with_key(frame(s, d, "stored_vectors"))
    out = upsert.clear_for_keys(stored, diff.removed_keys(_cur(s, d), _old(s, d)), diff.KEY, "embedding", _now())
    return out.select(*diff.KEY, "provider", F.col("embedding").isNotNull().alias("has_vector"), "updated_at")


add(
    "clear_for_keys",
    _cleared,
    with_inputs(_ALL, _KEYED + f""", gone AS (SELECT {KEY}, true AS hit FROM old WHERE ({KEY}) NOT IN (SELECT ({KEY}) FROM cur))
        SELECT {KEY}, provider, embedding IS NOT NULL AND hit IS NULL AS has_vector,
        CASE WHEN hit THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at FROM vec LEFT JOIN gone USING ({KEY})"""),
)
add(
    "add_missing_columns",
    lambda s, d: upsert.add_missing_columns(
        table(s, d, "documents").select("doc_id", "lang", "n_chars"),
        T.StructType([T.StructField("lang", T.StringType()), T.StructField("schema_hash", T.StringType()), T.StructField("owner", T.StringType())]),
    ).withColumn("has_hash", F.col("schema_hash").isNotNull()),
    "SELECT doc_id, lang, n_chars, CAST(NULL AS VARCHAR) AS schema_hash, CAST(NULL AS VARCHAR) AS owner, false AS has_hash FROM documents",
)


def _text_vectors(s, d):
    knowledge = frame(s, d, "knowledge").withColumn("sql", F.coalesce("sql", F.lit("")))
    out = sync.text_vectors(knowledge, frame(s, d, "glossary"))
    return out.select("kind", "db_name", "id", "provider", F.md5("vector_text").alias("text_hash"), F.round(V.l2_norm(F.col("embedding")), 4).alias("norm"))


add(
    "text_vectors",
    _text_vectors,
    with_inputs("knowledge glossary", """, t AS (SELECT 'knowledge' AS kind, db_name, id, '问题: ' || question || chr(10) || 'SQL: ' || coalesce(sql, '') AS x FROM knowledge
        UNION ALL SELECT 'glossary', db_name, id, term || ': ' || definition FROM glossary)
      SELECT kind, db_name, id, provider, md5(x) AS text_hash, 1.0::DOUBLE AS norm FROM t CROSS JOIN (VALUES ('local'), ('api')) p(provider)"""),
)


def _backfilled(s, d):
    knowledge = frame(s, d, "knowledge").withColumn("sql", F.coalesce("sql", F.lit("")))
    glossary = frame(s, d, "glossary")
    now = sync.text_vectors(knowledge, glossary).withColumn("text_hash", F.md5("vector_text"))
    # One kind has no vector of one provider, and the texts of one tenant have changed since.
    stale = F.when(F.col("db_name") == "tenant_1", F.lit("old")).otherwise(F.col("text_hash"))
    stored = now.where("kind = 'glossary' OR provider = 'local'").withColumns({
        "text_hash": stale, "embedding": F.when(F.col("db_name") != "tenant_2", F.col("embedding")),
    })
    out = sync.backfilled_text_vectors(knowledge, glossary, stored)
    return out.select(*sync.TEXT_KEY, "text_hash", "encoded", F.round(V.l2_norm(F.col("embedding")), 4).alias("norm"))


add(
    "backfilled_vectors",
    _backfilled,
    with_inputs("knowledge glossary", """, t AS (SELECT 'knowledge' AS kind, db_name, id, '问题: ' || question || chr(10) || 'SQL: ' || coalesce(sql, '') AS x FROM knowledge
        UNION ALL SELECT 'glossary', db_name, id, term || ': ' || definition FROM glossary)
      SELECT kind, db_name, id, provider, md5(x) AS text_hash, (kind = 'knowledge' AND provider = 'api') OR db_name IN ('tenant_1', 'tenant_2') AS encoded, 1.0::DOUBLE AS norm
      FROM t CROSS JOIN (VALUES ('local'), ('api')) p(provider)"""),
)


def _ingested(s, d):
    raw = ingest.read_file(s, f"{d}/lineitem.parquet", "parquet").select(
        F.col("l_orderkey").alias(" order key"), F.col("l_linenumber").alias("line number "), F.col("l_quantity").alias("qty"),
        (F.col("l_returnflag") == "R").alias("is returned"), F.col("l_shipdate").alias("ship date"),
        F.to_date("l_shipdate").alias("day"), F.col("l_discount").cast("decimal(4,2)").alias("disc"), F.col("l_tax").cast("float").alias("tax"),
    )
    return ingest.typed(raw).withColumn("tax", F.col("tax").cast("double"))


add(
    "ingest_typed",
    _ingested,
    """SELECT l_orderkey AS order_key, l_linenumber::BIGINT AS line_number, l_quantity AS qty, l_returnflag = 'R' AS is_returned, l_shipdate AS ship_date,
       CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, CAST(CAST(l_discount AS DECIMAL(4, 2)) AS VARCHAR) AS disc, CAST(l_tax AS FLOAT)::VARCHAR::DOUBLE AS tax FROM lineitem""",
)
