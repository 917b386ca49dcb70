"""Read-only SQL: clean, screen, parse and inspect the plan, then Spark SQL.

What decides is the plan that the session's own parser makes of the text; the word screen names what was
wrong, and refuses nothing by itself, as its words may stand in literals. Anything but a query is refused wherever it stands: commands, inserts, merges, updates,
deletes, scripts, and functions that call into the JVM. Paths cannot be read as tables. The plan is
reached through the classic session's JVM handle.
"""

from __future__ import annotations

import re
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.functions import text
from tablescout.operators.filters import finite_or_null
from tablescout.plans import pg_forms
from tablescout.sources.lineage import cut_lineage
from tablescout.sources.log_sink import append_runs

_QUOTED = "spark.sql.ansi.doubleQuotedIdentifiers"

# PostgreSQL type names and their Spark names.
TYPE_NAMES = {
    "text": "string", "int8": "bigint", "int4": "int", "int2": "smallint",
    "timestamptz": "timestamp", "double precision": "double", "float8": "double",
    "float4": "float", "bool": "boolean", "varchar": "string", "character varying": "string",
    "json": "string", "jsonb": "string", "uuid": "string",
}
# PostgreSQL date pattern parts and their Java letters.
DATE_PARTS = (
    ("YYYY", "yyyy"), ("YY", "yy"), ("MONTH", "MMMM"), ("MON", "MMM"), ("MM", "MM"), ("DAY", "EEEE"), ("DY", "EEE"), ("DD", "dd"), ("HH24", "HH"), ("HH12", "hh"),
    ("HH", "hh"), ("MI", "mm"), ("SS", "ss"), ("MS", "SSS"), ("US", "SSSSSS"), ("AM", "a"), ("PM", "a"), ("Q", "Q"),
)
# The fields of the earlier time are taken from those of the later one; a day that is lacking is borrowed from
# the earlier one's month. With one argument the age is counted to the start of today.
_FIELDS = (
    "(year(hi) * 12 + month(hi) - year(lo) * 12 - month(lo)) AS m, day(hi) - day(lo) AS d, "
    "unix_micros(hi) - unix_micros(date_trunc('DAY', hi)) - unix_micros(lo) + unix_micros(date_trunc('DAY', lo)) AS t"
)
_COMPAT_FUNCTIONS = (
    "CREATE OR REPLACE TEMPORARY FUNCTION _age_of(hi TIMESTAMP, lo TIMESTAMP, sign INT) RETURNS INTERVAL RETURN "
    f"(SELECT make_interval(sign * ((m - IF(c < 0, 1, 0)) div 12), sign * ((m - IF(c < 0, 1, 0)) % 12), 0, "
    "sign * (c + IF(c < 0, day(last_day(lo)), 0)), 0, 0, sign * CAST((t + IF(t < 0, 86400000000, 0)) / 1000000 AS DECIMAL(18, 6))) "
    f"FROM (SELECT *, d - IF(t < 0, 1, 0) AS c FROM (SELECT {_FIELDS})))",
    "CREATE OR REPLACE TEMPORARY FUNCTION age(a TIMESTAMP, b TIMESTAMP DEFAULT NULL) RETURNS INTERVAL RETURN "
    "CASE WHEN coalesce(b, a) IS NULL THEN NULL WHEN b IS NULL THEN CASE WHEN a <= current_date() "
    "THEN _age_of(CAST(current_date() AS TIMESTAMP), a, 1) ELSE _age_of(a, CAST(current_date() AS TIMESTAMP), -1) END "
    "WHEN a >= b THEN _age_of(a, b, 1) ELSE _age_of(b, a, -1) END",
)


def date_pattern(pattern: str) -> str:
    """A PostgreSQL date pattern in Java letters, as it stands between quotes in a SQL text."""
    table = {k.lower(): v for k, v in DATE_PARTS}
    names = "|".join(k for k, _ in DATE_PARTS)

    def part(m: re.Match) -> str:
        found = m.group(0)
        return "''" + found[1:-1] + "''" if found[0] == '"' else table[found.lower()]

    return re.sub('"[^"]*"|' + names, part, pattern, flags=re.IGNORECASE)


_APART = re.compile(
    r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/""", re.S
)
_HELD = r"\x00\d+\x00"


def spark_names(sql: str) -> str:
    """Names and forms that differ between the two dialects; see also ``pg_forms``.

    Literals, quoted names and comments are set aside first; only the patterns of date functions and
    of SIMILAR TO are changed in them.
    """
    held: list[str] = []

    def hold(m: re.Match) -> str:
        held.append(m.group(0))
        return f"\0{len(held) - 1}\0"

    def change(m: re.Match, fn) -> None:
        at = int(m.group("at"))
        held[at] = "'" + fn(held[at][1:-1]) + "'"

    def dated(m: re.Match) -> str:
        change(m, date_pattern)
        return m.group(0)

    def similar(m: re.Match) -> str:
        escape = held[int(m.group("escape"))][1:-1] if m.group("escape") else "\\"
        change(m, lambda p: _similar(p, escape.replace("\\\\", "\\")).replace("\\", "\\\\"))
        return f"rlike \0{m.group('at')}\0"

    sql = _APART.sub(hold, sql)
    types = "|".join(re.escape(t).replace(r"\ ", r"\s+") for t in sorted(TYPE_NAMES, key=len, reverse=True))
    named = lambda m: m.group(1) + TYPE_NAMES[re.sub(r"\s+", " ", m.group(2).lower())]
    sql = re.sub(rf"(::\s*)({types})\b(?!\s*\()", named, sql, flags=re.I)
    sql = re.sub(rf"(\bas\s+)({types})\b(?=\s*\))", named, sql, flags=re.I)
    sql = re.sub(r"\bcharacter\s+varying\b(?=\s*\()", "varchar", sql, flags=re.I)
    sql = re.sub(r"(\bto_(?:char|date|timestamp)\s*\((?:[^()]|\([^()]*\))*,\s*)\x00(?P<at>\d+)\x00(?=\s*\))", dated, sql, flags=re.I)
    sql = re.sub(r"\bunnest\s*\(", "explode(", sql, flags=re.I)
    sql = re.sub(r"\bextract\s*\(\s*epoch\s+from\s+((?:[^()]|\([^()]*\))+)\)", r"unix_timestamp(\1)", sql, flags=re.I)
    sql = re.sub(r"\bsimilar\s+to\s+\x00(?P<at>\d+)\x00(?:\s+escape\s+\x00(?P<escape>\d+)\x00)?", similar, sql, flags=re.I)
    sql = re.sub(r"\blocaltimestamp\b(?!\s*\()", "localtimestamp()", sql, flags=re.I)
    sql = pg_forms.rewritten(sql, held)
    return re.sub(_HELD, lambda m: held[int(m.group(0)[1:-1])], sql)


def _similar(pattern: str, escape: str = "\\") -> str:
    """A SIMILAR TO pattern as a regular expression over the whole text; an empty escape means none."""
    out, bracket, at = [], False, 0
    while at < len(pattern):
        c = pattern[at]
        if escape and c == escape and at + 1 < len(pattern):
            at += 1
            out.append(re.escape(pattern[at]))
        elif bracket:
            bracket = c != "]"
            out.append(c)
        elif c == "%":
            out.append(".*")
        elif c == "_":
            out.append(".")
        elif c in ".^$\\":
            out.append("\\" + c)
        else:
            bracket = c == "["
            out.append(c)
        at += 1
    return "^(?:" + "".join(out) + ")$"


_LOGICAL = "org.apache.spark.sql.catalyst.plans.logical."
#: Functions that run methods of the JVM.
_CALLS = {"reflect", "java_method", "try_reflect"}


def _each(seq):
    return (seq.apply(i) for i in range(seq.size()))


def plan_fault(spark: SparkSession, sql: str) -> str | None:
    """What makes a text more than a query, or null; a text that cannot be parsed is a fault too."""
    from py4j.java_gateway import is_instance_of

    gateway = spark.sparkContext._gateway
    try:
        root = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        return "it cannot be parsed: " + str(e).split("\n")[0]
    todo = [root]
    while todo:
        plan = todo.pop()
        name = plan.getClass().getSimpleName()
        if "ScriptTransformation" in name or any(
            is_instance_of(gateway, plan, _LOGICAL + k) for k in ("Command", "ParsedStatement")
        ):
            return f"{name} is not a query"
        expressions = list(_each(plan.expressions()))
        while expressions:
            e = expressions.pop()
            if e.getClass().getSimpleName() == "UnresolvedFunction":
                called = e.nameParts().last().lower()
                if called in _CALLS:
                    return f"{called} calls into the JVM"
            expressions.extend(_each(e.children()))
        # Tables of a WITH clause are inner children, queries in expressions are subqueries.
        for some in (plan.children(), plan.subqueries(), plan.innerChildren()):
            todo.extend(x for x in _each(some) if is_instance_of(gateway, x, _LOGICAL + "LogicalPlan"))
    return None


def checked_sql(spark: SparkSession, raw: str) -> tuple[str, str | None]:
    """The cleaned text and the write pattern that it holds, if any; ValueError when it is empty."""
    one = spark.sql("SELECT :q AS sql", args={"q": raw or ""})
    row = (
        one.select(text.clean_sql(F.col("sql")).alias("s"))
        .select("s", text.is_read_query(F.col("s")).alias("ok"), text.first_write_pattern(F.col("s")).alias("bad"))
        .first()
    )
    if not row["s"]:
        raise ValueError("the SQL text is empty")
    if not row["ok"]:
        raise ValueError(f"only SELECT queries are allowed{_named(row['bad'])}")
    return row["s"], row["bad"]


def _named(pattern: str | None) -> str:
    return f"; the text holds a forbidden operation: {pattern}" if pattern else ""


@contextmanager
def _guarded(spark: SparkSession):
    """Double quotes name identifiers, and a path is never a table, while a query is analysed."""
    wanted = {_QUOTED: "true", "spark.sql.runSQLOnFiles": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def run_sql(spark: SparkSession, raw: str, compat: bool = False) -> DataFrame:
    """Run one guarded query; ``"name"`` quotes an identifier.

    ``compat`` also maps the names that differ from PostgreSQL.
    """
    sql, bad = checked_sql(spark, raw)
    if compat:
        sql = spark_names(sql)
        for statement in _COMPAT_FUNCTIONS:
            spark.sql(statement)
    with _guarded(spark):
        fault = plan_fault(spark, sql)
        if fault:
            raise ValueError(f"only SELECT queries are allowed: {fault}{_named(bad)}")
        return spark.sql(sql)


_RUN = (
    "db_name string, nl_query string, schema_filter string, search_mode string, selected_table string, "
    "use_vectors boolean, top_k int, matched_tables array<string>, generated_sql string, execute_status string, "
    "error_message string, result_rows long, search_duration_ms double, llm_duration_ms double, "
    "sql_exec_duration_ms double, total_duration_ms double, prompt_tokens long, completion_tokens long, "
    "total_tokens long, llm_calls long"
)


def run_logged(spark: SparkSession, raw: str, db_name: str, log_path: str, compat: bool = False) -> DataFrame:
    """Run one guarded query and append its log row, also when it fails.

    The result is written once to the shared folder, so counting and reading it do not run the
    query again; NaN and infinities become null and times become text.
    """
    start = time.perf_counter()

    def log(status: str, rows: int, error: str | None) -> None:
        ms = (time.perf_counter() - start) * 1000
        run = (
            db_name, raw, None, "manual_sql", None, False, None, None, raw, status, error, rows,
            0.0, 0.0, ms, ms, 0, 0, 0, 0,
        )
        one = spark.createDataFrame([run], _RUN)
        append_runs(one.withColumn("created_at", F.current_timestamp().cast("timestamp_ntz")), log_path)

    try:
        result = cut_lineage(finite_or_null(run_sql(spark, raw, compat)))
        rows = result.count()
    except Exception as e:
        log("failed", 0, str(e))
        raise
    log("success", rows, None)
    return result
