"""Catalog texts, lists, signatures, filters and name resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescout.functions import text
from tablescout.operators import catalog_text as C
from tablescout.operators import diff, filters
from tablescout.sources.tables import tenant_scan
from workload.inputs import frame, table, with_inputs

Q: dict = {}


def add(name, fn, sql=None):
    Q[name] = (fn, sql)


def _extracted(s, d):
    return C.extract_columns(frame(s, d, "attributes"), frame(s, d, "classes"), frame(s, d, "namespaces"))


add(
    "scan_ordered",
    lambda s, d: tenant_scan(frame(s, d, "knowledge"), "tenant_c", ["id", "question", "sql"]),
    with_inputs("knowledge", "SELECT id, question, sql FROM knowledge WHERE db_name = 'tenant_c' ORDER BY id"),
)
add("catalog_columns", _extracted, with_inputs("catalog", "SELECT * FROM catalog"))
add(
    "join_three_way",
    lambda s, d: _extracted(s, d).groupBy("db_name", "schema_name", "data_type").agg(
        F.count(F.lit(1)).alias("columns"), F.count_distinct("table_name").alias("tables")
    ),
    with_inputs("catalog", "SELECT db_name, schema_name, data_type, count(*) AS columns, count(DISTINCT table_name) AS tables FROM catalog GROUP BY ALL"),
)
add(
    "table_list",
    lambda s, d: C.table_list(frame(s, d, "catalog")).withColumn("columns", F.array_join("columns", ",")),
    with_inputs("catalog", """SELECT db_name, schema_name, table_name, max(table_comment) AS table_comment, count(*) AS column_count,
        string_agg(column_name, ',' ORDER BY column_order) AS columns FROM catalog GROUP BY ALL"""),
)
_INLINE = "column_name || '[' || data_type || ']' || CASE WHEN column_comment <> '' THEN '(' || column_comment || ')' ELSE '' END"
_LINE = "'    ' || column_name || ' [' || data_type || ']' || CASE WHEN column_comment <> '' THEN ' (' || column_comment || ')' ELSE '' END"
_PART = "CASE WHEN column_comment <> '' THEN column_comment WHEN regexp_matches(column_name, '[一-龥]') THEN column_name END"
_TEXTS = f""", texts AS (SELECT db_name, schema_name, table_name, max(table_comment) AS table_comment, count(*) AS column_count,
        string_agg({_INLINE}, ', ' ORDER BY column_order) AS columns_text,
        string_agg({_LINE}, chr(10) ORDER BY column_order) AS columns_card,
        string_agg({_PART}, '、' ORDER BY column_order) AS columns_vector FROM catalog GROUP BY ALL)
    , vtexts AS (SELECT *, trim(concat(schema_name, '.', table_name, CASE WHEN table_comment <> '' THEN ' ' || table_comment ELSE '' END,
        CASE WHEN columns_vector <> '' THEN ' 字段: ' || columns_vector ELSE '' END)) AS vector_text FROM texts)
    , cards AS (SELECT *, '表名: ' || schema_name || '.' || table_name || CASE WHEN table_comment <> '' THEN ' 表注释: ' || table_comment ELSE '' END
        || chr(10) || '列:' || chr(10) || columns_card AS card FROM texts)
    """
add(
    "column_text",
    lambda s, d: C.column_texts(frame(s, d, "catalog")).drop("columns_card"),
    with_inputs("catalog", _TEXTS + "SELECT db_name, schema_name, table_name, table_comment, column_count, columns_text, columns_vector FROM texts"),
)
add(
    "column_json",
    lambda s, d: C.column_json(frame(s, d, "catalog")),
    with_inputs("catalog", """SELECT db_name, schema_name, table_name, CAST(to_json(list({'name': column_name, 'comment': column_comment, 'type': data_type}
        ORDER BY column_order)) AS VARCHAR) AS columns_json FROM catalog GROUP BY ALL"""),
)
add(
    "vector_texts",
    lambda s, d: C.vector_texts(frame(s, d, "catalog_tables"), frame(s, d, "catalog")).orderBy("schema_name", "table_name"),
    with_inputs("catalog", _TEXTS + "SELECT db_name, schema_name, table_name, table_comment, column_count, vector_text FROM vtexts ORDER BY schema_name, table_name"),
)
add(
    "signatures",
    lambda s, d: C.signatures(frame(s, d, "catalog")),
    with_inputs("catalog", _TEXTS + "SELECT db_name, schema_name, table_name, md5(vector_text) AS signature FROM vtexts"),
)
add(
    "schema_cards",
    lambda s, d: C.schema_cards(frame(s, d, "catalog")),
    with_inputs("catalog", _TEXTS + "SELECT db_name, schema_name, table_name, card FROM cards"),
)
add(
    "card_columns",
    lambda s, d: C.parse_cards(C.schema_cards(frame(s, d, "catalog")), ["db_name"]).drop("block_no"),
    with_inputs("catalog", "SELECT db_name, lower(schema_name) AS schema_name, lower(table_name) AS table_name, lower(column_name) AS column_name FROM catalog"),
)
add(
    "single_cards",
    lambda s, d: C.single_card(frame(s, d, "catalog")),
    with_inputs("catalog", _TEXTS + """SELECT db_name, schema_name, table_name, '表: ' || schema_name || '.' || table_name
        || CASE WHEN table_comment <> '' THEN ' (注释: ' || table_comment || ')' ELSE '' END || chr(10) || '列:' || chr(10) || columns_card AS card FROM texts"""),
)
add(
    "field_sets",
    lambda s, d: C.field_sets(frame(s, d, "catalog")).withColumn("fields", F.array_join("fields", ",")),
    with_inputs("catalog", "SELECT db_name, schema_name, table_name, string_agg(DISTINCT lower(column_name), ',' ORDER BY lower(column_name)) AS fields FROM catalog GROUP BY ALL"),
)


def _named_cards(s, d):
    wanted = frame(s, d, "classes").join(frame(s, d, "namespaces"), "namespace_id").select(
        F.col("class_id").alias("request_id"), F.lit(0).alias("pos"), "db_name", F.concat_ws(".", "schema_name", "table_name").alias("name")
    )
    columns = frame(s, d, "catalog")
    return C.named_cards(C.resolve_names(wanted, columns.select(*C.KEY).distinct()), columns).drop("pos")


add(
    "named_cards",
    _named_cards,
    with_inputs("catalog classes namespaces", _TEXTS + """, one AS (SELECT db_name, schema_name || '.' || table_name AS name, '表: ' || schema_name || '.' || table_name
        || CASE WHEN table_comment <> '' THEN ' (注释: ' || table_comment || ')' ELSE '' END || chr(10) || '列:' || chr(10) || columns_card AS card FROM texts)
      SELECT c.class_id AS request_id, c.db_name, n.schema_name || '.' || c.table_name AS name, coalesce(one.card, '未找到表: ' || n.schema_name || '.' || c.table_name) AS card
      FROM classes c JOIN namespaces n USING (namespace_id) LEFT JOIN one ON one.db_name = c.db_name AND one.name = n.schema_name || '.' || c.table_name"""),
)
_RESOLVE = """, f AS (SELECT db_name, table_name, min(schema_name) AS first_schema FROM named_tables GROUP BY ALL)
  , k AS (SELECT DISTINCT db_name, schema_name FROM named_tables)
  , p AS (SELECT *, CASE WHEN contains(name, '.') THEN split_part(name, '.', 1) END AS qs,
            CASE WHEN contains(name, '.') THEN substr(name, strpos(name, '.') + 1) ELSE name END AS qt FROM wanted_names)
  , r AS (SELECT p.request_id, p.pos, p.db_name, p.name, p.qt, e.schema_name AS es, f.first_schema AS fs, k.schema_name AS ks
      FROM p LEFT JOIN named_tables e ON e.db_name = p.db_name AND e.schema_name = p.qs AND e.table_name = p.qt
      LEFT JOIN f ON f.db_name = p.db_name AND f.table_name = p.qt
      LEFT JOIN k ON k.db_name = p.db_name AND k.schema_name = p.qs)
  """
_RESOLVED = """SELECT request_id, pos, db_name, name, sch AS schema_name, CASE WHEN sch IS NOT NULL THEN qt END AS table_name,
   CASE WHEN es IS NOT NULL THEN 'exact' WHEN sch IS NOT NULL THEN 'fallback' ELSE 'missing' END AS match FROM x"""
add(
    "resolve_names",
    lambda s, d: C.resolve_names(frame(s, d, "wanted_names"), frame(s, d, "named_tables")),
    with_inputs("wanted_names named_tables", _RESOLVE + ", x AS (SELECT *, coalesce(es, fs) AS sch FROM r) " + _RESOLVED),
)
add(
    "resolve_names_listed",
    lambda s, d: C.resolve_names(frame(s, d, "wanted_names"), frame(s, d, "named_tables"), strict_schema=True),
    with_inputs("wanted_names named_tables", _RESOLVE + ", x AS (SELECT *, coalesce(es, CASE WHEN ks IS NULL THEN fs END) AS sch FROM r) " + _RESOLVED),
)
add(
    "filter_list",
    lambda s, d: frame(s, d, "catalog_tables").where(filters.in_list(F.col("schema_name"), " nation_1, ,Nation_2,nation_11")),
    with_inputs("catalog_tables", "SELECT * FROM catalog_tables WHERE schema_name IN ('nation_1', 'Nation_2', 'nation_11')"),
)
add(
    "filter_list_ci",
    lambda s, d: frame(s, d, "catalog_tables").where(filters.in_list(F.col("schema_name"), " NATION_1, ,Nation_2", ignore_case=True)),
    with_inputs("catalog_tables", "SELECT * FROM catalog_tables WHERE lower(schema_name) IN ('nation_1', 'nation_2')"),
)
add(
    "filter_list_column",
    lambda s, d: frame(s, d, "items").select("db_name", "table_name").join(
        table(s, d, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("table_name"), F.concat_ws(" , ", "source", "lang").alias("listed")), "table_name"
    ).where(filters.in_list_column(F.col("db_name"), F.col("listed"))),
    "SELECT lang AS db_name, 'doc_' || doc_id AS table_name, source || ' , ' || lang AS listed FROM documents",
)
add(
    "exclude_items",
    lambda s, d: frame(s, d, "classes").join(frame(s, d, "namespaces"), "namespace_id").where(
        filters.visible_items(F.col("schema_name"), F.col("table_name"), F.col("kind"), F.col("has_usage"))
    ).select("db_name", "schema_name", "table_name", "table_comment"),
    with_inputs("catalog_tables", "SELECT db_name, schema_name, table_name, table_comment FROM catalog_tables"),
)
add(
    "usable_tenants",
    lambda s, d: filters.usable_tenants(
        table(s, d, "customer").select(
            F.col("c_name").alias("db_name"),
            F.expr("CASE c_mktsegment WHEN 'BUILDING' THEN '' WHEN 'MACHINERY' THEN 'None' WHEN 'FURNITURE' THEN NULL ELSE 'host' END").alias("host"),
        ),
        ["Customer#000000000", "Customer#000000007"],
    ),
    """SELECT c_name AS db_name, 'host' AS host FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE')
       AND c_name NOT IN ('Customer#000000000', 'Customer#000000007')""",
)
add(
    "script_match",
    lambda s, d: frame(s, d, "attributes").where(text.has_cjk(F.col("column_name"))).select("class_id", "column_name"),
    with_inputs("attributes", "SELECT class_id, column_name FROM attributes WHERE column_name LIKE '列%'"),
)
add(
    "exists_by_group",
    lambda s, d: filters.groups_with_rows(
        table(s, d, "customer").select(F.col("c_custkey").alias("key"), "c_name"),
        table(s, d, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("key")),
        "key",
    ),
    """SELECT c_custkey AS key, c_name, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000) AS has_rows FROM customer""",
)
add(
    "distinct_sorted",
    lambda s, d: frame(s, d, "catalog_tables").select("db_name", "schema_name").distinct().orderBy("db_name", "schema_name"),
    with_inputs("catalog_tables", "SELECT DISTINCT db_name, schema_name FROM catalog_tables ORDER BY 1, 2"),
)
add(
    "finite_or_null",
    lambda s, d: filters.finite_or_null(
        table(s, d, "lineitem").select(
            "l_orderkey", "l_partkey", "l_linenumber",
            F.when(F.col("l_discount") == 0, float("inf")).when(F.col("l_tax") == 0, float("nan"))
            .when(F.col("l_quantity") == 1, float("-inf")).otherwise(F.col("l_extendedprice")).alias("price"),
            "l_shipdate",
        )
    ),
    """SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_discount = 0 OR l_tax = 0 OR l_quantity = 1 THEN NULL ELSE l_extendedprice END AS price,
       strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate FROM lineitem""",
)
add(
    "preview_capped",
    lambda s, d: filters.preview(table(s, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), ["o_orderdate", "o_orderkey"]),
    """SELECT o_orderkey, o_orderdate, o_totalprice, (SELECT count(*) FROM orders) AS total_rows FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 500""",
)
add(
    "clean_names",
    lambda s, d: table(s, d, "pages").select(
        "page_id", text.clean_name(F.concat(F.lit("my table-"), "url")).alias("name"),
        text.clean_header(F.concat(F.lit(" a b"), "url", F.lit("\t "))).alias("header"),
    ),
    r"""SELECT page_id, regexp_replace(replace(replace('my table-' || url, ' ', '_'), '-', '_'), '[^\p{L}\p{N}_]', '', 'g') AS name,
        'a_b' || replace(url, ' ', '_') AS header FROM pages""",
)
_FP = """md5(concat_ws(',', count(*), sum(CAST('0x' || substr(h, 1, 8) AS BIGINT)), sum(CAST('0x' || substr(h, 9, 8) AS BIGINT)),
   sum(CAST('0x' || substr(h, 17, 8) AS BIGINT)), sum(CAST('0x' || substr(h, 25, 8) AS BIGINT))))"""


def fingerprint_sql(source: str) -> str:
    return f"""(SELECT db_name, {_FP} AS fingerprint FROM (SELECT db_name,
        md5(concat_ws(chr(31), coalesce(schema_name, ''), table_name, md5(vector_text))) AS h FROM {source}) GROUP BY db_name)"""


add(
    "fingerprint",
    lambda s, d: diff.fingerprint(frame(s, d, "items"), ["db_name"]),
    with_inputs("items", f"SELECT * FROM {fingerprint_sql('items')}"),
)
