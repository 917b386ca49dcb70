"""SQL-text jobs: cleaning, screening, lint, scoring, examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescout.functions import constants as K
from tablescout.functions import text
from tablescout.operators import scoring, sql_text
from tablescout.operators.catalog_text import resolve_names, schema_cards
from tablescout.plans import context
from workload.catalog_queries import _TEXTS
from workload.inputs import frame, with_inputs

Q: dict = {}


def add(name, fn, sql=None):
    Q[name] = (fn, sql)


def clean_sql_text(c: str) -> str:
    """The cleaning rule as a DuckDB expression."""
    body = rf"trim(coalesce({c}, ''), chr(32) || chr(9) || chr(10) || chr(13))"
    for p in (r"(?i)^```sql\s*\n?", r"^```\s*\n?", r"\n?```$"):
        body = f"regexp_replace({body}, '{p}', '')"
    joined = (
        f"array_to_string(list_filter(list_transform(string_split({body}, chr(10)), "
        "lambda ln: trim(split_part(ln, '--', 1), chr(32) || chr(9) || chr(13))), lambda ln: ln <> ''), ' ')"
    )
    return f"(CASE WHEN regexp_matches({joined}, '(?i)^(select|with)') THEN {joined} ELSE '' END)"


_FINAL = clean_sql_text(
    r"CASE WHEN regexp_matches({c}, '(?is)##\s*最终\s*SQL\s*\n') THEN regexp_extract({c}, '(?is)##\s*最终\s*SQL\s*\n+(.*)', 1) ELSE {c} END"
)


def final_sql_text(c: str) -> str:
    return _FINAL.replace("{c}", c)


add(
    "sql_clean",
    lambda s, d: frame(s, d, "sql_texts").select("query_id", text.clean_sql(F.col("sql")).alias("cleaned")),
    with_inputs("sql_texts", f"SELECT query_id, {clean_sql_text('sql')} AS cleaned FROM sql_texts"),
)
add(
    "sql_final",
    lambda s, d: frame(s, d, "sql_texts").select("query_id", text.final_sql(F.col("sql")).alias("final"), text.answer_sql(F.col("sql")).alias("answer")),
    with_inputs("sql_texts", f"SELECT query_id, {final_sql_text('sql')} AS final, {final_sql_text('sql')} AS answer FROM sql_texts"),
)
_FIRST = " ".join(f"WHEN regexp_matches(cleaned, '(?i){p}') THEN '{p}'" for p in K.WRITE_PATTERNS)
add(
    "sql_screen",
    lambda s, d: sql_text.screen(
        frame(s, d, "sql_texts").withColumn("sql", F.when(F.col("sql").startswith("DELETE"), F.concat(F.lit("with q as (select 1) "), "sql")).otherwise(F.col("sql"))), ["query_id"]
    ),
    with_inputs("sql_texts", f""", c AS (SELECT query_id, {clean_sql_text("CASE WHEN sql LIKE 'DELETE%' THEN 'with q as (select 1) ' || sql ELSE sql END")} AS cleaned FROM sql_texts)
        SELECT query_id, cleaned, regexp_matches(cleaned, '(?i)^(select|with)\\b') AS is_read, CASE {_FIRST} END AS write_pattern FROM c"""),
)
add(
    "valid_candidates",
    lambda s, d: frame(s, d, "answers").where(text.usable_answer(F.col("content"))).select("request_id", "part_key", text.final_sql(F.col("content")).alias("sql")),
    with_inputs("answers", f""", c AS (SELECT request_id, part_key, content, {final_sql_text('content')} AS sql FROM answers)
        SELECT request_id, part_key, sql FROM c WHERE sql <> '' AND NOT contains(substr(content, 1, 50), '本批无相关表')"""),
)
add(
    "keywords",
    lambda s, d: frame(s, d, "requests").select("request_id", F.array_join(F.array_sort(text.keywords(F.col("question"))), ",").alias("words")),
    with_inputs("requests", """SELECT request_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(question), '[一-龥a-zA-Z]+')), lambda w: length(w) > 1)), ',') AS words FROM requests"""),
)
# Texts without literals and comments, their FROM / JOIN pairs and the catalog facts.
_STRIP = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(sql, '''(?:[^'']|'''')*''', '', 'g'), '"[^"]*"', '', 'g'), '--[^\n]*', '', 'g'), '(?s)/\*.*?\*/', '', 'g')"""
_NONALIAS = ", ".join(f"'{w}'" for w in ["", *K.NON_ALIAS_WORDS])
_RESERVED = ", ".join(f"'{w}'" for w in K.RESERVED_WORDS)
_LINT = rf""", q AS (SELECT db_name, query_id, sql, {_STRIP} AS c FROM sql_texts)
 , fld AS (SELECT DISTINCT db_name, lower(table_name) AS t, lower(column_name) AS f FROM lint_catalog)
 , tab AS (SELECT DISTINCT db_name, lower(schema_name) AS s, lower(table_name) AS t FROM lint_catalog)
 , m AS (SELECT db_name, query_id, unnest(regexp_extract_all(c, '(?i)\b(?:FROM|JOIN)\s+([\w.]+)(?:\s+(?:AS\s+)?(\w+))?')) AS hit,
        generate_subscripts(regexp_extract_all(c, '(?i)\b(?:FROM|JOIN)\s+([\w.]+)(?:\s+(?:AS\s+)?(\w+))?'), 1) AS n FROM q)
 , r AS (SELECT db_name, query_id, n, lower(regexp_extract(hit, '(?i)\b(?:FROM|JOIN)\s+([\w.]+)', 1)) AS ref,
        lower(regexp_extract(hit, '(?i)\b(?:FROM|JOIN)\s+[\w.]+\s+(?:AS\s+)?(\w+)', 1)) AS al FROM m)
 , p AS (SELECT db_name, query_id, 2 * n AS seq, string_split(ref, '.')[-1] AS prefix, string_split(ref, '.')[-1] AS target FROM r
         WHERE (db_name, string_split(ref, '.')[-1]) IN (SELECT (db_name, t) FROM tab)
         UNION ALL SELECT db_name, query_id, 2 * n + 1, al, string_split(ref, '.')[-1] FROM r WHERE al NOT IN ({_NONALIAS}))
 , alias AS (SELECT db_name, query_id, prefix, arg_max(target, seq) AS target FROM p GROUP BY ALL)
 """
add(
    "sql_aliases",
    lambda s, d: sql_text.sql_aliases(frame(s, d, "sql_texts"), frame(s, d, "lint_catalog"), ["query_id"]),
    with_inputs("sql_texts lint_catalog", _LINT + "SELECT db_name, query_id, prefix, target FROM alias"),
)
add(
    "sql_lint",
    lambda s, d: sql_text.sql_lint(frame(s, d, "sql_texts"), frame(s, d, "lint_catalog")).withColumn("unknown_names", F.array_join("unknown_names", ",")),
    with_inputs("sql_texts lint_catalog", _LINT + rf""", x AS (SELECT db_name, query_id, list_transform(regexp_extract_all(c, '(?i)\b(\w+)\s+AS\s*\(', 1), lambda v: lower(v)) AS ctes,
        list_transform(regexp_extract_all(c, '(?i)\bAS\s+(\w+)', 1), lambda v: lower(v)) AS as_names,
        list_transform(regexp_extract_all(c, '\b(\w+)\.\w+\b', 1), lambda v: lower(v)) AS lefts,
        regexp_extract_all(c, '\b\w+\.\w+\b') AS dotted, regexp_extract_all(c, '\b([a-zA-Z_][a-zA-Z_0-9]*)\b', 1) AS bare FROM q)
     , dot AS (SELECT db_name, query_id, ctes, as_names, split_part(d, '.', 2) AS orig, lower(split_part(d, '.', 1)) AS l, lower(split_part(d, '.', 2)) AS r
               FROM (SELECT *, unnest(dotted) AS d FROM x))
     , baddot AS (SELECT dot.db_name, dot.query_id, orig FROM dot LEFT JOIN alias a ON a.db_name = dot.db_name AND a.query_id = dot.query_id AND a.prefix = dot.l
          WHERE NOT EXISTS (SELECT 1 FROM tab WHERE tab.db_name = dot.db_name AND tab.s = dot.l) AND NOT list_contains(as_names, r) AND NOT list_contains(ctes, r)
            AND CASE WHEN EXISTS (SELECT 1 FROM tab WHERE tab.db_name = dot.db_name AND tab.t = a.target)
                     THEN NOT EXISTS (SELECT 1 FROM fld WHERE fld.db_name = dot.db_name AND fld.t = a.target AND fld.f = r)
                     ELSE NOT list_contains(ctes, l) AND NOT EXISTS (SELECT 1 FROM fld WHERE fld.db_name = dot.db_name AND fld.f = r) END
          UNION ALL
          SELECT dot.db_name, dot.query_id, orig FROM dot
          WHERE EXISTS (SELECT 1 FROM tab WHERE tab.db_name = dot.db_name AND tab.s = dot.l) AND NOT EXISTS (SELECT 1 FROM tab WHERE tab.db_name = dot.db_name AND tab.t = dot.r)
            AND NOT list_contains(as_names, r) AND NOT list_contains(ctes, r) AND NOT list_contains(ctes, l) AND NOT EXISTS (SELECT 1 FROM fld WHERE fld.db_name = dot.db_name AND fld.f = r))
     , b AS (SELECT db_name, query_id, ctes, as_names, lefts, unnest(bare) AS orig FROM x)
     , badbare AS (SELECT db_name, query_id, orig FROM b WHERE lower(orig) NOT IN ({_RESERVED}) AND NOT list_contains(ctes, lower(orig)) AND NOT list_contains(as_names, lower(orig))
          AND NOT list_contains(lefts, lower(orig)) AND NOT EXISTS (SELECT 1 FROM fld WHERE fld.db_name = b.db_name AND fld.f = lower(orig))
          AND NOT EXISTS (SELECT 1 FROM tab WHERE tab.db_name = b.db_name AND tab.t = lower(orig)) AND NOT EXISTS (SELECT 1 FROM tab WHERE tab.db_name = b.db_name AND tab.s = lower(orig)))
     , bad AS (SELECT db_name, query_id, string_agg(DISTINCT orig, ',' ORDER BY orig) AS names FROM (SELECT * FROM baddot UNION ALL SELECT * FROM badbare) GROUP BY ALL)
     SELECT q.db_name, q.query_id, coalesce(names, '') AS unknown_names FROM q LEFT JOIN bad USING (db_name, query_id)"""),
)
_REFS = r""", rq AS (SELECT db_name, query_id, list_transform(regexp_extract_all(regexp_replace(regexp_replace(sql, '''(?:[^'']|'''')*''', '', 'g'), '--[^\n]*', '', 'g'),
        '(?i)\b(?:FROM|JOIN)\s+([\w.]+)', 1), lambda v: lower(v)) AS refs FROM sql_texts)
 , re AS (SELECT db_name, query_id, unnest(refs) AS ref, generate_subscripts(refs, 1) AS n FROM rq)
 """
add(
    "relevant_blocks",
    lambda s, d: sql_text.relevant_blocks(frame(s, d, "sql_texts"), frame(s, d, "catalog_tables")),
    with_inputs("sql_texts catalog_tables", _REFS + """, h AS (SELECT DISTINCT re.db_name, re.query_id, 'referenced' AS scope, t.schema_name, t.table_name FROM re JOIN catalog_tables t
        ON t.db_name = re.db_name AND (lower(t.table_name) IN (re.ref, string_split(re.ref, '.')[-1]) OR lower(t.schema_name || '.' || t.table_name) IN (re.ref, string_split(re.ref, '.')[-1])))
      SELECT * FROM h UNION ALL SELECT db_name, query_id, 'all', NULL, NULL FROM rq WHERE (db_name, query_id) NOT IN (SELECT (db_name, query_id) FROM h)"""),
)
add(
    "field_hint",
    lambda s, d: sql_text.field_hint(frame(s, d, "sql_texts"), frame(s, d, "lint_catalog")),
    with_inputs("sql_texts lint_catalog", _REFS + """, fs AS (SELECT db_name, t, string_agg(f, ', ' ORDER BY f) AS fields FROM (SELECT DISTINCT db_name, lower(table_name) AS t, lower(column_name) AS f FROM lint_catalog) GROUP BY ALL)
      , first AS (SELECT db_name, query_id, string_split(ref, '.')[-1] AS t, arg_min(ref, n) AS ref, min(n) AS n FROM re GROUP BY ALL)
      , hint AS (SELECT f.db_name, f.query_id, string_agg('- ' || f.ref || ' 的真实字段（仅这些可用）: ' || fs.fields, chr(10) ORDER BY f.n) AS hint FROM first f JOIN fs ON fs.db_name = f.db_name AND fs.t = f.t GROUP BY ALL)
      SELECT rq.db_name, rq.query_id, coalesce(hint, '') AS hint FROM rq LEFT JOIN hint USING (db_name, query_id)"""),
)
_WEIGHTS = """, w AS (SELECT request_id, rank, lower(schema_name) AS schema_name, lower(table_name) AS table_name,
   0.6::DOUBLE * ((count(*) OVER (PARTITION BY request_id) - rank + 1)::DOUBLE / count(*) OVER (PARTITION BY request_id)) + 0.4::DOUBLE * greatest(0.0::DOUBLE, 1.0::DOUBLE - score / 2.0) AS weight FROM hits)
 """
add(
    "hit_weights",
    lambda s, d: scoring.hit_weights(frame(s, d, "hits")).withColumn("weight", F.round("weight", 6)),
    with_inputs("hits", _WEIGHTS + "SELECT request_id, rank, schema_name, table_name, round(weight, 6) AS weight FROM w"),
)
_SCORES = _WEIGHTS + """, k AS (SELECT request_id, key, arg_max(weight, rank) AS weight FROM (SELECT request_id, rank, weight, schema_name || '.' || table_name AS key FROM w
      UNION ALL SELECT request_id, rank, weight, table_name FROM w) GROUP BY ALL)
  , words AS (SELECT request_id, unnest(list_filter(list_distinct(regexp_extract_all(lower(question), '[一-龥a-zA-Z]+')), lambda x: length(x) > 1)) AS word FROM requests)
  , c AS (SELECT *, row_number() OVER () AS cid FROM candidates)
  , t AS (SELECT c.cid, sum(k.weight) AS ts, count(*) AS used FROM c JOIN k ON k.request_id = c.request_id AND contains(lower(c.sql), k.key) GROUP BY 1)
  , kw AS (SELECT c.cid, count(*) AS n FROM c JOIN words ON words.request_id = c.request_id AND contains(lower(c.sql), word) GROUP BY 1)
  , scored AS (SELECT request_id, batch, sql, round(coalesce(ts, 0), 6) AS table_score, coalesce(n, 0) AS keyword_hits, coalesce(used, 0) AS tables_used,
       round(5.0::DOUBLE * coalesce(ts, 0) + coalesce(n, 0) + (10 - batch) * 0.1::DOUBLE, 4) AS score FROM c LEFT JOIN t USING (cid) LEFT JOIN kw USING (cid))
  """


def _scored(s, d):
    scored = scoring.candidate_scores(frame(s, d, "candidates"), frame(s, d, "requests"), frame(s, d, "hits"))
    # Sums of doubles differ in the last places between engines.
    return scored.withColumns({"table_score": F.round("table_score", 6), "score": F.round("score", 4)})


add("candidate_scores", _scored, with_inputs("candidates requests hits", _SCORES + "SELECT * FROM scored"))
add(
    "best_candidate",
    lambda s, d: scoring.best_candidate(_scored(s, d)),
    with_inputs("candidates requests hits", _SCORES + """SELECT request_id, batch, sql, score, candidates FROM (SELECT *, count(*) OVER (PARTITION BY request_id) AS candidates,
        row_number() OVER (PARTITION BY request_id ORDER BY score DESC, batch, sql DESC) AS n FROM scored) WHERE n = 1"""),
)
add(
    "few_shot",
    lambda s, d: scoring.few_shot(frame(s, d, "knowledge")),
    with_inputs("knowledge", """, f AS (SELECT *, row_number() OVER (PARTITION BY db_name ORDER BY id) AS n FROM knowledge)
       SELECT db_name, coalesce(string_agg('问题: ' || question || chr(10) || 'SQL: ' || sql, chr(10) || chr(10) ORDER BY id) FILTER (question <> '' AND sql <> ''), '无可用示例') AS examples FROM f WHERE n <= 5 GROUP BY 1"""),
)
add(
    "glossary_text",
    lambda s, d: scoring.glossary_text(frame(s, d, "glossary")),
    with_inputs("glossary", """SELECT db_name, id // 256 AS part, string_agg('- **' || trim(term) || '**：' || definition, chr(10) ORDER BY id) AS glossary FROM glossary GROUP BY ALL"""),
)


def _choice(s, d):
    classes, spaces = frame(s, d, "classes"), frame(s, d, "namespaces")
    named = classes.where("priority = '1-URGENT'").join(spaces.where("has_usage"), "namespace_id").select(
        F.col("class_id").alias("request_id"), "schema_name", "table_name"
    )
    return scoring.context_choice(frame(s, d, "requests"), named, frame(s, d, "hits").where("score < 1.5"))


def _cards_by_order(s, d):
    """Cards with the order number in the table's name as their place."""
    return schema_cards(frame(s, d, "catalog")).withColumn("pos", F.substring("table_name", 7, 20).cast("long"))


add(
    "question_context",
    lambda s, d: context.question_context(_choice(s, d), frame(s, d, "requests"), _cards_by_order(s, d)).select(
        "request_id", "db_name", "scope", F.md5(F.coalesce("context", F.lit(""))).alias("context")
    ),
    with_inputs("catalog classes namespaces requests hits", _TEXTS + """, nm AS (SELECT c.class_id AS request_id, c.db_name, n.schema_name, c.table_name FROM classes c JOIN namespaces n USING (namespace_id) WHERE c.priority = '1-URGENT' AND n.has_usage)
      , named AS (SELECT request_id, 'named' AS scope, card AS context FROM nm JOIN cards USING (db_name, schema_name, table_name))
      , near AS (SELECT request_id, 'nearest' AS scope, '未找到指定的表: ' || string_agg(schema_name || '.' || table_name, ', ' ORDER BY rank) AS context
          FROM hits WHERE score < 1.5 AND request_id NOT IN (SELECT request_id FROM nm) GROUP BY 1)
      , own AS (SELECT * FROM named UNION ALL SELECT * FROM near)
      SELECT request_id, db_name, coalesce(scope, 'all') AS scope, md5(coalesce(context, '')) AS context FROM requests LEFT JOIN own USING (request_id)"""),
)


def _selected(s, d):
    columns = frame(s, d, "catalog")
    wanted = frame(s, d, "requests").select("request_id", "db_name").join(
        frame(s, d, "classes").select(F.col("class_id").alias("request_id"), "table_name", "namespace_id", "status"), "request_id"
    ).join(frame(s, d, "namespaces"), "namespace_id")
    qualified = F.concat("schema_name", F.lit("."), "table_name")
    names = F.array(F.when(F.col("status") == "F", F.col("table_name")).otherwise(qualified), F.lit("no.where"))
    asked = wanted.select("request_id", "db_name", F.posexplode(names).alias("pos", "name"))
    tables = columns.select("db_name", "schema_name", "table_name").distinct()
    return context.cards_selected(resolve_names(asked, tables, strict_schema=True), schema_cards(columns))


add(
    "cards_selected",
    lambda s, d: _selected(s, d).withColumn("context", F.md5("context")),
    with_inputs("catalog classes namespaces requests", _TEXTS + """, w AS (SELECT c.class_id AS request_id, c.db_name, n.schema_name, c.table_name,
           CASE WHEN c.status = 'F' THEN c.table_name ELSE n.schema_name || '.' || c.table_name END AS name FROM classes c JOIN namespaces n USING (namespace_id))
      SELECT w.request_id, md5(coalesce(cards.card, '未找到指定的表: ' || name || ', no.where')) AS context FROM w
      LEFT JOIN cards ON cards.db_name = w.db_name AND cards.schema_name = w.schema_name AND cards.table_name = w.table_name"""),
)
add(
    "few_shot_tenants",
    lambda s, d: scoring.few_shot(frame(s, d, "knowledge").where("db_name <> 'tenant_1'"), tenants=frame(s, d, "knowledge")).withColumn("examples", F.md5("examples")),
    with_inputs("knowledge", """, f AS (SELECT *, row_number() OVER (PARTITION BY db_name ORDER BY id) AS n FROM knowledge)
       SELECT db_name, md5(CASE WHEN db_name = 'tenant_1' THEN '无可用知识库示例' ELSE coalesce(string_agg('问题: ' || question || chr(10) || 'SQL: ' || sql, chr(10) || chr(10) ORDER BY id)
         FILTER (question <> '' AND sql <> ''), '无可用示例') END) AS examples FROM f WHERE n <= 5 GROUP BY db_name"""),
)
add(
    "context_choice",
    lambda s, d: _choice(s, d).withColumn("rank", F.coalesce("rank", F.lit(0))),
    with_inputs("classes namespaces requests hits", """, nm AS (SELECT c.class_id AS request_id, n.schema_name, c.table_name FROM classes c JOIN namespaces n USING (namespace_id) WHERE c.priority = '1-URGENT' AND n.has_usage)
      SELECT request_id, 'named' AS scope, 1 AS rank, schema_name, table_name FROM nm
      UNION ALL SELECT request_id, 'nearest', rank, schema_name, table_name FROM hits WHERE score < 1.5 AND request_id NOT IN (SELECT request_id FROM nm)
      UNION ALL SELECT request_id, 'all', 0, NULL, NULL FROM requests WHERE request_id NOT IN (SELECT request_id FROM nm) AND request_id NOT IN (SELECT request_id FROM hits WHERE score < 1.5)"""),
)
