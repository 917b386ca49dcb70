"""Column expressions over text: cleaning, screening, names, keywords, truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablescout.functions import constants as K

# Python's \w and \b follow Unicode; Java's do so only under (?U).
UNI = "(?U)"
# str.strip() also removes tabs, newlines and the like.
_EDGE_SPACE = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(c, _EDGE_SPACE, "")


def clean_sql(raw: Column) -> Column:
    """SQL text without fences, ``--`` tails and blank lines, on one line.

    The result is empty unless it starts with SELECT or WITH. A ``--`` inside a string
    literal is cut too; the cleaned text is the contract.
    """
    body = strip(F.coalesce(raw, F.lit("")))
    body = F.regexp_replace(body, r"(?i)^```sql\s*\n?", "")
    body = F.regexp_replace(body, r"^```\s*\n?", "")
    body = F.regexp_replace(body, r"\n?```\z", "")
    lines = F.transform(F.split(body, "\n"), lambda s: strip(F.substring_index(s, "--", 1)))
    joined = F.array_join(F.filter(lines, lambda s: s != ""), " ")
    return F.when(joined.rlike(r"(?i)^(select|with)"), joined).otherwise(F.lit(""))


def final_sql(raw: Column) -> Column:
    """The SQL after the final-SQL heading, or the whole text when there is none, cleaned."""
    tail = F.regexp_extract(
        raw, rf"(?is)##\s*{K.FINAL_SQL_HEADING}\s*SQL\s*\n+(.*)", 1
    )
    has_heading = raw.rlike(rf"(?is)##\s*{K.FINAL_SQL_HEADING}\s*SQL\s*\n")
    return clean_sql(F.when(has_heading, tail).otherwise(raw))


def answer_sql(raw: Column) -> Column:
    """``final_sql``, or the stripped text itself when that is empty but starts as a query."""
    found = F.when(F.length(raw) > 3, final_sql(raw)).otherwise(F.lit(""))
    bare = strip(F.coalesce(raw, F.lit("")))
    return F.when(found != "", found).otherwise(
        F.when(bare.rlike(r"(?i)^(select|with)"), bare).otherwise(F.lit(""))
    )


def first_write_pattern(sql: Column) -> Column:
    """The first write pattern found in the text, null when it is clean."""
    return F.coalesce(
        *[F.when(sql.rlike("(?i)" + UNI + p), F.lit(p)) for p in K.WRITE_PATTERNS]
    )


def is_read_query(sql: Column) -> Column:
    """Gate: the first word is SELECT or WITH (a word, so ``selection`` does not pass)."""
    return F.coalesce(sql.rlike(r"(?i)^(select|with)\b"), F.lit(False))


# Statements that Spark accepts after a WITH clause besides queries.
_WRITES_AFTER_WITH = (
    r"(?i)\b(INSERT\s+(INTO|OVERWRITE)|MERGE\s+(WITH\s+SCHEMA\s+EVOLUTION\s+)?INTO|DELETE\s+FROM"
    r"|UPDATE\s+[^\s()]+(\s+(AS\s+)?\w+)?\s+SET)\b"
)


def has_write_statement(sql: Column) -> Column:
    """A write hidden behind a WITH clause; literals, quoted names and comments are not read."""
    return F.coalesce(without_literals(sql).rlike(_WRITES_AFTER_WITH), F.lit(False))


def usable_answer(content: Column) -> Column:
    """Answers that do not decline and yield a query."""
    declined = content.startswith("-- " + K.REFUSAL) | F.left(content, F.lit(50)).contains(
        K.REFUSAL
    )
    return F.coalesce(
        (content != "") & ~declined & (final_sql(content) != ""), F.lit(False)
    )


def without_literals(sql: Column, quoted_names: bool = True) -> Column:
    """Text without string literals and comments (and, if asked, double-quoted names)."""
    out = F.regexp_replace(sql, r"'(?:[^']|'')*'", "")
    if quoted_names:
        out = F.regexp_replace(out, r'"[^"]*"', "")
    out = F.regexp_replace(out, r"--[^\n]*", "")
    if quoted_names:
        out = F.regexp_replace(out, r"(?s)/\*.*?\*/", "")
    return out


def split_list(text: Column) -> Column:
    """Trimmed, non-blank parts of a comma list."""
    return F.filter(F.transform(F.split(text, ","), strip), lambda s: s != "")


def clean_name(name: Column) -> Column:
    """A table name: blank and ``-`` become ``_``; letters, digits and ``_`` stay."""
    return F.regexp_replace(F.regexp_replace(name, "[ -]", "_"), r"[^\p{L}\p{N}_]", "")


def clean_header(name: Column) -> Column:
    """A column header: stripped, blanks become ``_``."""
    return F.regexp_replace(strip(name), " ", "_")


def keywords(question: Column) -> Column:
    """Distinct lower-case runs of CJK or Latin letters that are longer than one character."""
    runs = F.regexp_extract_all(F.lower(question), F.lit("([一-龥a-zA-Z]+)"), F.lit(1))
    return F.filter(F.array_distinct(runs), lambda w: F.length(w) > 1)


def has_cjk(text: Column) -> Column:
    return text.rlike(K.CJK)


def display_text(text: Column, limit: int = K.DISPLAY_CHARS) -> Column:
    """First ``limit`` characters plus a line with the number of characters left out."""
    more = F.length(text) - limit
    return F.when(
        more > 0,
        F.concat(
            F.left(text, F.lit(limit)),
            F.lit("\n  ...(后面还有 "),
            more.cast("string"),
            F.lit(" 字符)"),
        ),
    ).otherwise(text)


def context_text(text: Column, limit: int = K.MAX_BATCH_CHARS, marker: str = K.CUT_MARKER) -> Column:
    """Text cut to ``limit`` characters with a marker."""
    return F.when(
        F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(marker))
    ).otherwise(text)


def display_name(schema: Column, table: Column) -> Column:
    """``schema.table``, or ``table`` when there is no schema."""
    return F.concat_ws(".", F.nullif(schema, F.lit("")), table)


def search_mode(selected_table: Column, use_vectors: Column) -> Column:
    """Mode name of a run."""
    return (
        F.when(F.coalesce(selected_table, F.lit("")) != "", F.lit("selected_table"))
        .when(use_vectors, F.lit("vector"))
        .otherwise(F.lit("all"))
    )
