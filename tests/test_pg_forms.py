"""PostgreSQL forms that are rewritten: values as that database gives them."""

import pytest

from tablescout.plans import guarded_sql

CASES = [
    ("SELECT 3 = ANY (SELECT * FROM VALUES (1), (3))", True),
    ("SELECT 3 <> ALL (SELECT * FROM VALUES (1), (3))", False),
    ("SELECT 3 > ALL (SELECT * FROM VALUES (1), (2))", True),
    ("SELECT 3 > ALL (SELECT * FROM VALUES (1), (null))", None),
    ("SELECT 0 > ALL (SELECT * FROM VALUES (1), (null))", False),
    ("SELECT 3 > ALL (SELECT v FROM VALUES (1) t(v) WHERE v > 5)", True),
    ("SELECT 3 < SOME (SELECT v FROM VALUES (1) t(v) WHERE v > 5)", False),
    ("SELECT 1 + 1 >= ANY (SELECT * FROM VALUES (2), (9))", True),
    ("SELECT 3 = ALL (SELECT * FROM VALUES (3), (3))", True),
    ("SELECT 3 <> ANY (SELECT * FROM VALUES (3), (4))", True),
    ("SELECT 1 < ANY (SELECT * FROM VALUES (0), (null))", None),
    ("SELECT CASE WHEN NOT 2 < ALL (SELECT * FROM VALUES (1)) AND 1 = 1 THEN 'y' ELSE 'n' END", "y"),
    ("SELECT string_agg(x, ',' ORDER BY x DESC) FROM VALUES ('a'), ('c'), ('b') t(x)", "c,b,a"),
    ("SELECT array_agg(x ORDER BY y DESC, x) FROM VALUES ('a', 1), ('b', null), ('d', 3), ('c', 3) t(x, y)", ["b", "c", "d", "a"]),
    ("SELECT array_agg(x ORDER BY y) FROM VALUES ('a', 1), ('b', null), ('c', 0) t(x, y)", ["c", "a", "b"]),
    ("SELECT array_agg(x ORDER BY y NULLS FIRST) FROM VALUES ('a', 1), ('b', null), (null, 0) t(x, y)", ["b", None, "a"]),
    ("SELECT array_agg(DISTINCT x ORDER BY x DESC) FROM VALUES (1), (2), (1) t(x)", [2, 1]),
    ("SELECT (array[10, 20, 30])[2]", 20),
    ("SELECT (array[10])[5]", None),
    ("SELECT (array[10, 20, 30])[2:3]", [20, 30]),
    ("SELECT array[[1, 2], [3]]", [[1, 2], [3]]),
    ("SELECT j -> 'a' FROM VALUES ('{\"a\": \"t\"}') t(j)", '"t"'),
    ("SELECT t.j ->> 'a' FROM VALUES ('{\"a\": \"t\"}') t(j)", "t"),
    ("SELECT j::jsonb -> 'o' ->> 'k' FROM VALUES ('{\"o\": {\"k\": [1]}}') t(j)", "[1]"),
    ("SELECT (j -> 'l') ->> 1 FROM VALUES ('{\"l\": [1, 2]}') t(j)", "2"),
    ("SELECT j ->> 'none' FROM VALUES ('{\"l\": null}') t(j)", None),
    ("SELECT j ->> 'x y' FROM VALUES ('{\"x y\": true}') t(j)", "true"),
    (r"SELECT regexp_match('foobar12', '([a-z]+)([0-9]+)')", ["foobar", "12"]),
    (r"SELECT regexp_match('a(b', 'a[(](?:b)')", ["a(b"]),
    ("SELECT regexp_match('abc', 'x')", None),
    ("SELECT 'a%b' SIMILAR TO 'a#%b' ESCAPE '#'", True),
    ("SELECT 'axb' SIMILAR TO 'a#%b' ESCAPE '#'", False),
    ("SELECT 'a' COLLATE \"C\" > 'B' COLLATE \"POSIX\"", True),
    ("SELECT localtime >= TIME '00:00:00'", True),
    ("SELECT cast(age(TIMESTAMP '2024-03-01', TIMESTAMP '2023-01-01') AS string)", "1 years 2 months"),
    ("SELECT cast(age(TIMESTAMP '2024-03-01', TIMESTAMP '2023-01-31') AS string)", "1 years 1 months 1 days"),
    ("SELECT cast(age(TIMESTAMP '2023-01-31 10:00:00', TIMESTAMP '2024-03-01 09:00:00') AS string)", "-1 years -1 months -23 hours"),
    ("SELECT age(TIMESTAMP '2024-03-01', NULL) IS NULL", False),
    # What looks like a form and is none.
    ("SELECT transform(array(1, 2), x -> x + 1)", [2, 3]),
    ("SELECT 'j -> ''k'' = ANY (SELECT 1)' AS t", "j -> 'k' = ANY (SELECT 1)"),
    ("SELECT 'please call me; merge into x' WHERE 'drop table' <> 'update a set'", "please call me; merge into x"),
    ("SELECT 'abc' LIKE ANY ('a%', 'x%')", True),
]


@pytest.mark.parametrize(("sql", "want"), CASES)
def test_forms_have_their_values(spark, sql, want):
    assert guarded_sql.run_sql(spark, sql, compat=True).collect()[0][0] == want


def test_a_refused_text_names_the_operation(spark):
    with pytest.raises(ValueError, match="forbidden operation"):
        guarded_sql.run_sql(spark, "with a as (select 1) insert into t select 1")


def test_a_word_is_no_operation(spark):
    assert guarded_sql.run_sql(spark, "select 1 as call where 'please call me' <> 'drop table'").first()[0] == 1
