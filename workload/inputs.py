"""Operator inputs derived from the given tables.

Each input is one SELECT that Spark and DuckDB read alike, over whole tables: line items act
as catalog columns, orders as catalog tables, nations as schemas; documents and pages are
items with a stored earlier version; events are the query log; orders carry SQL texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.sources.tables import register_views

# name -> (inputs it reads, SELECT)
INPUTS: dict[str, tuple[list[str], str]] = {
    # Catalog: attribute, class, namespace.
    "attributes": ([], """
        SELECT a.class_id, CAST(a.ord AS BIGINT) * 10000000 + a.l_partkey AS column_order,
               CASE WHEN a.ls = 'O' AND a.rf = 'N' THEN '列_' ELSE 'part_' END || CAST(a.l_partkey AS VARCHAR(20)) AS column_name,
               CASE a.rf WHEN 'A' THEN 'bigint' WHEN 'R' THEN 'numeric(12,2)' ELSE 'text' END AS data_type,
               CASE WHEN a.ls = 'F' THEN p.p_name ELSE '' END AS column_comment,
               a.l_partkey AS part_key, a.ord AS line_no, a.rf AS return_flag
        FROM (SELECT l_orderkey AS class_id, l_partkey, min(l_linenumber) AS ord, min(l_returnflag) AS rf, min(l_linestatus) AS ls
              FROM lineitem GROUP BY l_orderkey, l_partkey) a
        JOIN part p ON p.p_partkey = a.l_partkey"""),
    "classes": ([], """
        SELECT o.o_orderkey AS class_id, c.c_nationkey AS namespace_id, lower(c.c_mktsegment) AS db_name,
               'order_' || CAST(o.o_orderkey AS VARCHAR(20)) || CASE WHEN o.o_orderpriority = '5-LOW' AND o.o_orderstatus = 'P' THEN '_middle' ELSE '' END AS table_name,
               CASE o.o_orderstatus WHEN 'O' THEN 'r' WHEN 'F' THEN 'v' ELSE 'm' END AS kind,
               CASE WHEN o.o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED') THEN '' ELSE o.o_orderpriority END AS table_comment,
               o.o_orderpriority AS priority, o.o_orderstatus AS status
        FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey"""),
    "namespaces": ([], """
        SELECT n_nationkey AS namespace_id,
               CASE n_nationkey WHEN 3 THEN 'hg_recyclebin' WHEN 7 THEN 'pg_temp' ELSE lower(n_name) END AS schema_name,
               n_regionkey <> 4 AS has_usage
        FROM nation"""),
    "catalog": (["attributes", "classes", "namespaces"], """
        SELECT c.db_name, n.schema_name, c.table_name, c.table_comment, a.column_order, a.column_name, a.data_type, a.column_comment
        FROM attributes a JOIN classes c ON c.class_id = a.class_id JOIN namespaces n ON n.namespace_id = c.namespace_id
        WHERE n.has_usage AND n.schema_name NOT IN ('information_schema', 'pg_catalog', 'knowledge', 'hg_recyclebin')
          AND substring(n.schema_name, 1, 3) <> 'pg_' AND c.table_name NOT LIKE '%!_middle%' ESCAPE '!'"""),
    "catalog_tables": (["classes", "namespaces"], """
        SELECT c.db_name, n.schema_name, c.table_name, c.table_comment
        FROM classes c JOIN namespaces n ON n.namespace_id = c.namespace_id
        WHERE n.has_usage AND n.schema_name NOT IN ('information_schema', 'pg_catalog', 'knowledge', 'hg_recyclebin')
          AND substring(n.schema_name, 1, 3) <> 'pg_' AND c.table_name NOT LIKE '%!_middle%' ESCAPE '!'"""),
    # Items and their stored earlier version.
    "items": ([], """
        SELECT lang AS db_name, NULLIF(source, 'src0') AS schema_name, 'doc_' || CAST(doc_id AS VARCHAR(20)) AS table_name,
               text AS vector_text, doc_id AS ref
        FROM documents"""),
    "stored_items": ([], """
        SELECT d.lang AS db_name, NULLIF(d.source, 'src0') AS schema_name, 'doc_' || CAST(d.doc_id AS VARCHAR(20)) AS table_name,
               CASE WHEN l.quality = 0 THEN d.text || 'x' ELSE d.text END AS vector_text, d.doc_id AS ref
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE d.lang <> 'es'
        UNION ALL
        SELECT 'en' AS db_name, 'web' AS schema_name, 'page_' || CAST(page_id AS VARCHAR(20)) AS table_name, html AS vector_text, page_id AS ref
        FROM pages"""),
    "stored_vectors": (["stored_items"], """
        SELECT s.db_name, s.schema_name, s.table_name, 'local' AS provider, md5(s.vector_text) AS text_hash, e.embedding,
               CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS updated_at
        FROM stored_items s LEFT JOIN embeddings e ON e.vec_id = s.ref
        UNION ALL
        SELECT s.db_name, s.schema_name, s.table_name, 'api' AS provider, md5(s.vector_text) AS text_hash, e.embedding,
               CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS updated_at
        FROM stored_items s LEFT JOIN embeddings e ON e.vec_id = s.ref WHERE s.db_name = 'en'"""),
    # Query log.
    "runs": ([], """
        SELECT event_id, CAST(user_id AS VARCHAR(20)) AS db_name, event_type AS search_mode,
               CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS execute_status,
               value * 0.25 AS search_duration_ms, value * 0.5 AS llm_duration_ms, value * 0.125 AS sql_exec_duration_ms,
               value AS total_duration_ms, length(props) AS prompt_tokens, length(event_type) AS completion_tokens,
               length(props) + length(event_type) AS total_tokens, ts AS created_at, props AS nl_query
        FROM events"""),
    # SQL texts, one per order.
    "sql_texts": (["classes", "namespaces"], """
        SELECT c.db_name, c.class_id AS query_id, c.priority, c.status,
               CASE c.priority
                 WHEN '1-URGENT' THEN '```sql' || chr(10) || 'SELECT o.' || t.col || ', o.' || t.last_col || ' FROM ' || t.ref || ' o -- tail' || chr(10) || chr(10) || '  WHERE o.' || t.last_col || ' > 5' || chr(10) || '```'
                 WHEN '2-HIGH' THEN 'WITH x AS (SELECT ' || t.col || ' AS amount FROM ' || t.ref || ') SELECT x.amount, x.missing_' || c.status || ' FROM x WHERE note = ''a--b'''
                 WHEN '3-MEDIUM' THEN 'SELECT a.' || t.col || ', b.wrong_col, year, A.Odd_Col FROM ' || t.ref || ' AS a JOIN nation_1.absent b ON a.id = b.id /* join */'
                 WHEN '4-NOT SPECIFIED' THEN CASE c.status
                    WHEN 'O' THEN 'DELETE FROM ' || t.ref
                    WHEN 'F' THEN 'select ' || t.col || ' from ' || t.ref || ' where x = ''it''''s''; drop table ' || t.ref
                    ELSE 'hello' || chr(10) || 'select ' || t.col || ' from ' || t.ref END
                 ELSE 'plan' || chr(10) || '## 最终 SQL' || chr(10) || chr(10) || 'SELECT ' || t.ref || '.' || t.col || ' FROM ' || t.ref || ' -- end' END AS sql
        FROM classes c
        JOIN (SELECT k.class_id, 'part_' || CAST(p.lo AS VARCHAR(20)) AS col, 'part_' || CAST(p.hi AS VARCHAR(20)) AS last_col,
                     n.schema_name || '.' || k.table_name AS ref
              FROM (SELECT l_orderkey, min(l_partkey) AS lo, max(l_partkey) AS hi FROM lineitem GROUP BY l_orderkey) p
              JOIN classes k ON k.class_id = p.l_orderkey JOIN namespaces n ON n.namespace_id = k.namespace_id) t ON t.class_id = c.class_id"""),
    # The catalog of the SQL texts has plain names only.
    "lint_catalog": (["classes", "namespaces"], """
        SELECT c.db_name, n.schema_name, c.table_name, 'part_' || CAST(l.l_partkey AS VARCHAR(20)) AS column_name
        FROM lineitem l JOIN classes c ON c.class_id = l.l_orderkey JOIN namespaces n ON n.namespace_id = c.namespace_id
        WHERE n.has_usage AND n.schema_name NOT IN ('information_schema', 'pg_catalog', 'knowledge', 'hg_recyclebin')
          AND substring(n.schema_name, 1, 3) <> 'pg_' AND c.table_name NOT LIKE '%!_middle%' ESCAPE '!'"""),
    # Requests, hits, candidates and raw answers.
    "requests": (["classes"], """
        SELECT class_id AS request_id, db_name, 'Show ' || priority || ' part 订单 of ' || db_name || ' select' AS question FROM classes"""),
    "hits": (["attributes"], """
        SELECT a.class_id AS request_id,
               row_number() OVER (PARTITION BY a.class_id ORDER BY a.column_order) AS rank,
               p.p_brand AS schema_name, 'Part_' || CAST(a.part_key AS VARCHAR(20)) AS table_name, p.p_size / 25.0e0 AS score
        FROM attributes a JOIN part p ON p.p_partkey = a.part_key"""),
    "candidates": (["attributes"], """
        SELECT a.class_id AS request_id, a.line_no AS batch,
               'SELECT x FROM ' || lower(p.p_brand) || '.part_' || CAST(a.part_key AS VARCHAR(20)) || ' WHERE note = ''urgent ' || p.p_type || '''' AS sql
        FROM attributes a JOIN part p ON p.p_partkey = a.part_key"""),
    "answers": (["attributes"], """
        SELECT class_id AS request_id, part_key,
               CASE return_flag WHEN 'N' THEN '-- 本批无相关表'
                 WHEN 'A' THEN '```sql' || chr(10) || 'select ' || column_name || ' from t -- x' || chr(10) || '```'
                 ELSE '## 思考过程' || chr(10) || data_type || chr(10) || '## 最终SQL' || chr(10) || column_comment || 'SELECT ' || column_name || chr(10) || 'FROM t' END AS content
        FROM attributes"""),
    # Knowledge and glossary.
    "knowledge": ([], """
        SELECT 'tenant_' || substring(md5(CAST(u.conv_id AS VARCHAR(20))), 1, 1) AS db_name, u.conv_id * 1000 + u.turn AS id,
               u.text AS question, a.text AS sql
        FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
        WHERE u.role = 'user'"""),
    "glossary": ([], """
        SELECT p_type AS db_name, p_partkey AS id, ' ' || p_name AS term, p_brand || ' ' || p_type AS definition FROM part"""),
    # Names to resolve against tables that occur in many schemas.
    "named_tables": ([], """
        SELECT DISTINCT lower(c.c_mktsegment) AS db_name, lower(n.n_name) AS schema_name,
               lower(o.o_orderstatus) || '_' || substring(o.o_orderpriority, 1, 1) AS table_name
        FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey"""),
    "wanted_names": ([], """
        SELECT o.o_orderkey AS request_id, 0 AS pos, lower(c.c_mktsegment) AS db_name,
               CASE WHEN o.o_orderstatus = 'O' THEN lower(n.n_name) || '.o_' || substring(o.o_orderpriority, 1, 1)
                    WHEN o.o_orderstatus = 'F' AND o.o_orderpriority = '1-URGENT' THEN lower(n.n_name) || '.absent'
                    WHEN o.o_orderstatus = 'F' AND o.o_orderpriority = '2-HIGH' THEN lower(n.n_name) || '.z_1'
                    WHEN o.o_orderstatus = 'F' THEN 'elsewhere.f_' || substring(o.o_orderpriority, 1, 1)
                    WHEN o.o_orderpriority = '5-LOW' THEN 'nothing_here'
                    ELSE 'p_' || substring(o.o_orderpriority, 1, 1) END AS name
        FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey"""),
}


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        for d in INPUTS[n][0]:
            visit(d)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


def with_inputs(names: str, body: str) -> str:
    """A DuckDB query over the named inputs; ``body`` may go on with more CTEs after a comma."""
    ctes = ",\n".join(f"{n} AS ({INPUTS[n][1]})" for n in _closure(names.split()))
    return f"WITH {ctes}{'' if body.lstrip().startswith(',') else chr(10)}{body}"


def _stored_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """``stored_vectors`` as its SELECT gives it, with texts hashed before the joins and one join for both providers.

    Only hashes and keys meet labels and embeddings, so no text is shuffled however large these are.
    """
    docs, labels, pages, embeddings = (table(spark, folder, n) for n in ("documents", "labels", "pages", "embeddings"))
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string")).alias("table_name")
    plain = docs.where("lang <> 'es'").select(
        F.col("lang").alias("db_name"), F.nullif("source", F.lit("src0")).alias("schema_name"), key("doc_", "doc_id"),
        F.md5("text").alias("_plain"), F.md5(F.concat("text", F.lit("x"))).alias("_edited"), F.col("doc_id").alias("ref"),
    )
    marks = labels.select(F.col("doc_id").alias("_doc"), "quality")
    texts = plain.join(marks, plain["ref"] == marks["_doc"], "left").select(
        "db_name", "schema_name", "table_name", F.when(F.col("quality") == 0, F.col("_edited")).otherwise(F.col("_plain")).alias("text_hash"), "ref",
    )
    # Always 'en', but not as a literal: a join on the tenant that Spark moves down to the pages keeps its key.
    english = F.coalesce(F.nullif(F.lit("en"), F.col("page_id").cast("string")), F.lit("en"))
    web = pages.select(
        english.alias("db_name"), F.lit("web").alias("schema_name"), key("page_", "page_id"),
        F.md5("html").alias("text_hash"), F.col("page_id").alias("ref"),
    )
    items = texts.unionByName(web)
    vectors = embeddings.select("vec_id", "embedding")
    providers = F.when(F.col("db_name") == "en", F.array(F.lit("local"), F.lit("api"))).otherwise(F.array(F.lit("local")))
    return items.join(vectors, items["ref"] == vectors["vec_id"], "left").select(
        "db_name", "schema_name", "table_name", F.explode(providers).alias("provider"), "text_hash", "embedding",
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("updated_at"),
    )


# Inputs that Spark builds in another order of steps than their SELECT is written; the rows are the same.
BUILT = {"stored_vectors": _stored_vectors}


def frame(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """An input as a Spark DataFrame."""
    return BUILT[name](spark, folder) if name in BUILT else selected(spark, folder, name)


def selected(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """An input as its SELECT is written."""
    ctes = ",\n".join(f"{n} AS ({INPUTS[n][1]})" for n in _closure([name]))
    sql = f"WITH {ctes} SELECT * FROM {name}"
    register_views(spark, folder, sql)
    df = spark.sql(sql)
    # A cast to TIMESTAMP has a zone in Spark and none in DuckDB.
    for f in df.schema.fields:
        if f.dataType.simpleString() == "timestamp":
            df = df.withColumn(f.name, df[f.name].cast("timestamp_ntz"))
    return df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
