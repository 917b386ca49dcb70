"""One guarded query per name group, over the star schema."""

from __future__ import annotations

from tablescout.plans.guarded_sql import run_sql
from tablescout.sources.tables import register_views

Q: dict = {}


def add(name: str, sql: str, oracle: str | None = None, compat: bool = False) -> None:
    def run(spark, folder):
        register_views(spark, folder, sql)
        return run_sql(spark, sql, compat=compat)

    Q[name] = (run, oracle or sql)


add("sql_joins", """
```sql
SELECT n.n_name, r_name, count(*) AS orders, round(sum(o.o_totalprice), 2) AS total -- per nation
FROM orders o
JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey
INNER JOIN region ON r_regionkey = n.n_regionkey
GROUP BY n.n_name, r_name
```""", """SELECT n.n_name, r_name, count(*) AS orders, round(sum(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region ON r_regionkey = n.n_regionkey GROUP BY n.n_name, r_name""")
add("sql_outer_joins", """SELECT o.o_orderkey, coalesce(l.n, 0) AS lines, coalesce(b.best, 0.0) AS best FROM orders o
LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
LEFT JOIN LATERAL (SELECT max(l_extendedprice) AS best FROM lineitem x WHERE x.l_orderkey = o.o_orderkey) b ON true""")
add("sql_full_joins", """SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS docs, coalesce(b.n, 0) AS labelled
FROM (SELECT doc_id AS k, n_chars AS n FROM documents WHERE lang = 'en') a
FULL OUTER JOIN (SELECT doc_id AS k, 1 AS n FROM labels WHERE quality = 1) b ON a.k = b.k""")
add("sql_using_right", """SELECT doc_id, d.lang, l.quality FROM documents d RIGHT JOIN labels l USING (doc_id)""")
add("sql_predicates", """SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 300000 AND o_orderstatus IN ('O', 'F')
AND o_orderpriority LIKE '%-%' AND o_orderpriority ILIKE '%high%' AND NOT o_custkey IS NULL
AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40)""")
add("sql_any_all", """SELECT p_partkey, p_retailprice FROM part WHERE p_type LIKE ANY ('S%', 'P%') AND p_name NOT LIKE ALL ('%ring', '%gadget')""",
    """SELECT p_partkey, p_retailprice FROM part WHERE (p_type LIKE 'S%' OR p_type LIKE 'P%') AND p_name NOT LIKE '%ring' AND p_name NOT LIKE '%gadget'""")
add("sql_patterns", """SELECT p_partkey, p_brand, p_name SIMILAR TO '%(ring|nut)!%' ESCAPE '!' AS s FROM part WHERE p_brand SIMILAR TO 'Brand!#(1|2)_' ESCAPE '!'""",
    """SELECT p_partkey, p_brand, regexp_full_match(p_name, '.*(ring|nut)%') AS s FROM part WHERE p_brand SIMILAR TO 'Brand#(1|2).'""", compat=True)
add("sql_grouping", """SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, round(sum(l_quantity), 2) AS qty,
round(avg(l_discount), 6) AS disc, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10""")
add("sql_distinct", """SELECT DISTINCT lang, source FROM documents""")
add("sql_set_ops", """SELECT c_custkey AS k FROM customer UNION SELECT s_suppkey FROM supplier UNION ALL SELECT o_custkey FROM orders
EXCEPT SELECT l_suppkey FROM lineitem WHERE l_quantity < 2""")
add("sql_intersect", """SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT p_partkey FROM part WHERE p_size > 25""")
add("sql_order_limit", """SELECT o_orderkey, o_totalprice, nullif(o_orderstatus, 'P') AS st FROM orders ORDER BY nullif(o_orderstatus, 'P') COLLATE "C" DESC NULLS FIRST, o_totalprice ASC, o_orderkey LIMIT 100 OFFSET 20""",
    """SELECT o_orderkey, o_totalprice, nullif(o_orderstatus, 'P') AS st FROM orders ORDER BY nullif(o_orderstatus, 'P') DESC NULLS FIRST, o_totalprice ASC, o_orderkey LIMIT 100 OFFSET 20""", compat=True)
add("sql_conditional", """SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS size,
coalesce(nullif(o_orderstatus, 'P'), 'pending') AS st, greatest(o_custkey, o_orderkey) AS g, least(o_custkey, o_orderkey) AS l FROM orders""")
add("sql_math", """SELECT p_partkey, round(p_retailprice, 1) AS r, floor(p_retailprice) AS f, ceil(p_retailprice) AS c, ceiling(p_retailprice / 2) AS c2, abs(p_size - 25) AS a,
mod(p_size, 7) AS m, round(power(p_size, 2), 4) AS p, round(sqrt(p_size), 6) AS s, sign(p_size - 25) AS sg FROM part""",
    """SELECT p_partkey, round(p_retailprice, 1) AS r, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS c, CAST(ceiling(p_retailprice / 2) AS BIGINT) AS c2, abs(p_size - 25) AS a,
mod(p_size, 7) AS m, round(power(p_size, 2), 4) AS p, round(sqrt(p_size), 6) AS s, CAST(sign(p_size - 25) AS DOUBLE) AS sg FROM part""")
add("sql_string", """SELECT p_partkey, length(p_name) AS n, char_length(p_brand) AS cl, octet_length(p_brand) AS ol, lower(p_brand) AS lo, upper(p_name) AS up, initcap(p_name) AS ic,
substring(p_name, 2, 4) AS s1, substr(p_name, 3) AS s2, concat(p_brand, '/', p_type) AS c1, concat_ws('-', p_brand, p_type, p_name) AS c2, trim(concat('  ', p_name, ' ')) AS t1,
ltrim(concat('  ', p_name)) AS t2, rtrim(concat(p_name, '  ')) AS t3, replace(p_name, 'e', 'E') AS rp, translate(p_name, 'abc', 'xyz') AS tr,
split_part(p_brand, '#', 2) AS sp, position('i' IN p_name) AS po FROM part""",
    """SELECT p_partkey, length(p_name) AS n, length(p_brand) AS cl, octet_length(encode(p_brand)) AS ol, lower(p_brand) AS lo, upper(p_name) AS up,
array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS ic,
substring(p_name, 2, 4) AS s1, substr(p_name, 3) AS s2, concat(p_brand, '/', p_type) AS c1, concat_ws('-', p_brand, p_type, p_name) AS c2, trim(concat('  ', p_name, ' ')) AS t1,
ltrim(concat('  ', p_name)) AS t2, rtrim(concat(p_name, '  ')) AS t3, replace(p_name, 'e', 'E') AS rp, translate(p_name, 'abc', 'xyz') AS tr,
split_part(p_brand, '#', 2) AS sp, position('i' IN p_name) AS po FROM part""")
add("sql_regex", """SELECT page_id, regexp_replace(url, '[0-9]+', '#') AS masked, regexp_extract(url, '^([a-z]+)://', 1) AS scheme,
(regexp_match(url, '^([a-z]+)://([^/]+)'))[2] AS host, regexp_match(url, 'no such host') IS NULL AS none FROM pages WHERE url <> 'please call merge into'""",
    """SELECT page_id, regexp_replace(url, '[0-9]+', '#', 'g') AS masked, regexp_extract(url, '^([a-z]+)://', 1) AS scheme,
nullif(regexp_extract(url, '^([a-z]+)://([^/]+)', 2), '') AS host, true AS none FROM pages""", compat=True)
add("sql_dates", """SELECT cast(date_trunc('month', o_orderdate) AS date) AS month, extract(year FROM o_orderdate) AS y, date_part('quarter', o_orderdate) AS q,
count(*) AS n, min(o_orderdate + INTERVAL '3' DAY) AS due FROM orders WHERE o_orderdate < current_timestamp AND localtime >= TIME '00:00:00' GROUP BY 1, 2, 3""",
    """SELECT cast(date_trunc('month', o_orderdate) AS date) AS month, extract(year FROM o_orderdate) AS y, date_part('quarter', o_orderdate) AS q,
count(*) AS n, min(o_orderdate + INTERVAL 3 DAY) AS due FROM orders WHERE o_orderdate < now()::TIMESTAMP GROUP BY 1, 2, 3""", compat=True)
add("sql_dates_compat", """SELECT event_id, to_char(ts, 'YYYY-MM-DD HH24:MI:SS') AS day, to_date('2024/01/05', 'YYYY/MM/DD') AS d, extract(epoch FROM ts) AS sec,
extract(day FROM age(ts, to_timestamp('2024-01-01 00:00', 'YYYY-MM-DD HH24:MI'))) AS days FROM events""",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS day, DATE '2024-01-05' AS d, CAST(floor(epoch(ts)) AS BIGINT) AS sec,
CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 86400) AS INTEGER) AS days FROM events""", compat=True)
add("sql_date_names", """SELECT o_orderkey, to_char(o_orderdate, 'DD Mon YYYY "at" HH24') AS d, to_char(o_orderdate, 'Month') AS m, to_char(o_orderdate, 'Dy') AS w,
to_char(o_orderdate, 'Q') AS q, extract(year FROM age(o_orderdate)) > 0 AS old, extract(year FROM age(TIMESTAMP '1999-03-01 12:00:00', o_orderdate)) AS years,
extract(month FROM age(TIMESTAMP '1999-03-01 12:00:00', o_orderdate)) AS months, extract(day FROM age(o_orderdate, TIMESTAMP '1995-02-28 06:00:00')) AS days, now() > o_orderdate AS n, current_date > cast(o_orderdate AS date) AS c, localtimestamp > o_orderdate AS l FROM orders""",
    """SELECT o_orderkey, strftime(o_orderdate, '%d %b %Y at %H') AS d, strftime(o_orderdate, '%B') AS m, strftime(o_orderdate, '%a') AS w,
CAST(quarter(o_orderdate) AS VARCHAR) AS q, true AS old, extract(year FROM age(TIMESTAMP '1999-03-01 12:00:00', o_orderdate)) AS years,
extract(month FROM age(TIMESTAMP '1999-03-01 12:00:00', o_orderdate)) AS months, extract(day FROM age(o_orderdate, TIMESTAMP '1995-02-28 06:00:00')) AS days, true AS n, true AS c, true AS l FROM orders""", compat=True)
add("sql_subquery_any", """SELECT p_partkey FROM part WHERE p_size = ANY (SELECT p_size FROM part WHERE p_type LIKE 'S%') AND p_size + 1 > ALL (SELECT r_regionkey FROM region)
AND p_retailprice <= SOME (SELECT max(p_retailprice) - 1 FROM part) AND p_partkey <> ALL (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) AND 'a.b::text' NOT SIMILAR TO 'a.b' AND p_brand SIMILAR TO 'Brand#[1-3]%|.+4_'""",
    """SELECT p_partkey FROM part WHERE p_size = ANY (SELECT p_size FROM part WHERE p_type LIKE 'S%') AND p_size + 1 > ALL (SELECT r_regionkey FROM region)
AND p_retailprice <= ANY (SELECT max(p_retailprice) - 1 FROM part) AND p_partkey <> ALL (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) AND regexp_full_match(p_brand, 'Brand#[1-3].*|\\.+4.')""", compat=True)
add("sql_type_names", """SELECT event_id, props::json AS j, props::jsonb AS b, cast(event_type AS character varying(30)) AS v, event_type::character varying AS w, 'x::int8'::text AS t FROM events""",
    """SELECT event_id, props AS j, props AS b, event_type AS v, event_type AS w, 'x::int8' AS t FROM events""", compat=True)
add("sql_casts", """SELECT o_orderkey::text AS k, o_totalprice::bigint AS p, cast(o_custkey AS int4) AS c, o_orderdate::date AS d, (o_totalprice::numeric(12, 2))::double precision AS n,
cast(o_orderkey AS varchar(20)) AS v, '12'::int8 AS i, 'true'::bool AS b, cast('1.5' AS real) AS r FROM orders""",
    """SELECT CAST(o_orderkey AS VARCHAR) AS k, CAST(trunc(o_totalprice) AS BIGINT) AS p, CAST(o_custkey AS INTEGER) AS c, CAST(o_orderdate AS DATE) AS d,
CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS DOUBLE) AS n, CAST(o_orderkey AS VARCHAR) AS v, CAST(12 AS BIGINT) AS i, true AS b, CAST(1.5 AS FLOAT) AS r FROM orders""", compat=True)
add("sql_json", """SELECT get_json_object(props, '$.k') AS k, count(*) AS n, max(cast(parse_json(props):k AS int)) AS m,
max((props::jsonb ->> 'k')::int4) AS t, min(props -> 'k') AS j, count(props ->> 'absent') AS a FROM events GROUP BY 1""",
    """SELECT json_extract_string(props, '$.k') AS k, count(*) AS n, max(CAST(json_extract(props, '$.k') AS INTEGER)) AS m,
max(CAST(props ->> '$.k' AS INTEGER)) AS t, min(CAST(props -> '$.k' AS VARCHAR)) AS j, count(props ->> '$.absent') AS a FROM events GROUP BY 1""", compat=True)
add("sql_arrays", """SELECT doc_id, w AS word, (array[lang, source])[2] AS second, cardinality(array[1, 2, n_chars]) AS c FROM (SELECT doc_id, lang, source, n_chars, unnest(split(text, ' ')) AS w FROM documents)""",
    """SELECT doc_id, unnest(string_split(text, ' ')) AS word, source AS second, 3 AS c FROM documents""", compat=True)
add("sql_array_agg", """SELECT c_nationkey, concat_ws(',', sort_array(array_agg(DISTINCT c_mktsegment))) AS segs, array_join(array_agg(c_name ORDER BY c_acctbal DESC, c_custkey), ',') AS names,
(array_agg(c_custkey ORDER BY c_acctbal NULLS FIRST, c_custkey))[1] AS poorest FROM customer GROUP BY c_nationkey""",
    """SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segs, string_agg(c_name, ',' ORDER BY c_acctbal DESC, c_custkey) AS names,
first(c_custkey ORDER BY c_acctbal NULLS FIRST, c_custkey) AS poorest FROM customer GROUP BY c_nationkey""", compat=True)
add("sql_string_agg", """SELECT l_orderkey, string_agg(concat(l_partkey, ':', l_linenumber), ',' ORDER BY l_linenumber, l_partkey) AS items,
string_agg(l_returnflag, '') WITHIN GROUP (ORDER BY l_linenumber DESC, l_partkey, l_returnflag) AS flags FROM lineitem GROUP BY l_orderkey""",
    """SELECT l_orderkey, string_agg(concat(l_partkey, ':', l_linenumber), ',' ORDER BY l_linenumber, l_partkey) AS items,
string_agg(l_returnflag, '' ORDER BY l_linenumber DESC, l_partkey, l_returnflag) AS flags FROM lineitem GROUP BY l_orderkey""", compat=True)
add("sql_ranking", """SELECT o_custkey, o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS nt,
round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd, coalesce(lag(o_orderkey) OVER w, -1) AS prev, coalesce(lead(o_orderkey, 2) OVER w, -1) AS nxt
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
add("sql_frames", """SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS s4,
first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f,
last_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS l,
count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS day_n FROM events""",
    """SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS s4,
first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f,
last_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS l,
count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS day_n FROM events""")
add("sql_cte", """WITH big AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY o_custkey), top AS (SELECT max(n) AS m FROM big)
SELECT c_name, n, m FROM big JOIN customer ON c_custkey = o_custkey JOIN top ON n = m""")
add("sql_quoted", """SELECT c_mktsegment AS "26客户分组", count(*) AS "count rows" FROM customer GROUP BY c_mktsegment""")
add("sql_ratio", """SELECT l_suppkey, case when sum(l_tax) > 0 then round(sum(case when l_returnflag = 'R' then l_tax else 0.0 end) * 1.0 / sum(l_tax), 6) else 0 end AS share FROM lineitem GROUP BY l_suppkey""",
    """SELECT l_suppkey, CAST(case when sum(l_tax) > 0 then round(sum(case when l_returnflag = 'R' then l_tax else 0.0 end) * 1.0 / sum(l_tax), 6) else 0 end AS DOUBLE) AS share FROM lineitem GROUP BY l_suppkey""")
