"""Texts, signatures and lists built from catalog metadata.

A catalog column frame has ``db_name, schema_name, table_name, table_comment, column_order,
column_name, data_type, column_comment``. Groups are single tables; PostgreSQL-compatible
catalogs allow at most 1,600 columns per table, so every ordered text below is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.functions import constants as K
from tablescout.functions import text
from tablescout.operators import filters

KEY = ["db_name", "schema_name", "table_name"]
# Both header forms are read, so a one-table card is not taken for an empty catalog.
_CARD_HEAD = rf"(?U)^\s*(?:{K.CARD_HEADER.strip()}|{K.ONE_CARD_HEADER.strip()})\s*([\w.]+)"


def _inline() -> Column:
    return F.expr(
        "concat(column_name, '[', data_type, ']', "
        "if(column_comment <> '', concat('(', column_comment, ')'), ''))"
    )


def _card_line() -> Column:
    return F.expr(
        "concat('    ', column_name, ' [', data_type, ']', "
        "if(column_comment <> '', concat(' (', column_comment, ')'), ''))"
    )


def _vector_part() -> Column:
    """Comment, else the name if it has CJK characters, else null (skipped)."""
    return F.when(F.col("column_comment") != "", F.col("column_comment")).when(
        text.has_cjk(F.col("column_name")), F.col("column_name")
    )


def _no_null_comments(df: DataFrame) -> DataFrame:
    fixed = {c: F.coalesce(F.col(c), F.lit("")) for c in ("table_comment", "column_comment")}
    return df.withColumns(fixed)


def extract_columns(attributes: DataFrame, classes: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Three-way inner join attribute - class - namespace with the exclusion set.

    Classes and namespaces are filtered before the joins; the sides are broadcast only when
    Spark knows them to be under the session's size limit.
    """
    spaces = namespaces.where(F.coalesce("has_usage", F.lit(False)))
    tables = classes.join(spaces, "namespace_id").where(
        filters.visible_items(F.col("schema_name"), F.col("table_name"), F.col("kind"))
    )
    return attributes.join(tables, "class_id").select(
        *KEY, "table_comment", "column_order", "column_name", "data_type", "column_comment"
    )


def column_texts(columns: DataFrame) -> DataFrame:
    """Inline, card and vector texts of each table's columns, with the column count."""
    return (
        _no_null_comments(columns)
        .withColumns({"_inline": _inline(), "_line": _card_line(), "_part": _vector_part()})
        .groupBy(*KEY)
        .agg(
            F.expr("listagg(_inline, ', ') within group (order by column_order)").alias("columns_text"),
            F.expr("listagg(_line, '\n') within group (order by column_order)").alias("columns_card"),
            F.expr(
                f"listagg(_part, '{K.VECTOR_SEPARATOR}') within group (order by column_order)"
            ).alias("columns_vector"),
            F.count(F.lit(1)).alias("column_count"),
            F.max("table_comment").alias("table_comment"),
        )
    )


def column_json(columns: DataFrame) -> DataFrame:
    """JSON array of {name, comment, type} in column order."""
    fields = F.array_sort(
        F.collect_list(F.struct("column_order", "column_name", "column_comment", "data_type"))
    )
    named = F.transform(
        fields,
        lambda s: F.struct(
            s["column_name"].alias("name"),
            s["column_comment"].alias("comment"),
            s["data_type"].alias("type"),
        ),
    )
    return (
        _no_null_comments(columns).groupBy(*KEY).agg(F.to_json(named).alias("columns_json"))
    )


def table_list(columns: DataFrame) -> DataFrame:
    """One row per table: comment, column count, column names in order."""
    ordered = F.array_sort(F.collect_list(F.struct("column_order", "column_name")))
    return columns.groupBy(*KEY).agg(
        F.max(F.coalesce("table_comment", F.lit(""))).alias("table_comment"),
        F.count(F.lit(1)).alias("column_count"),
        F.transform(ordered, lambda s: s["column_name"]).alias("columns"),
    )


def table_vector_text(schema: Column, table: Column, comment: Column, parts: Column) -> Column:
    """``schema.table``, then the comment, then the column words; empty parts are left out."""
    return F.trim(
        F.concat(
            F.coalesce(schema, F.lit("")),
            F.lit("."),
            table,
            F.when(comment != "", F.concat(F.lit(" "), comment)).otherwise(F.lit("")),
            F.when(parts != "", F.concat(F.lit(K.VECTOR_COLUMNS), parts)).otherwise(F.lit("")),
        )
    )


def knowledge_vector_text(question: Column, sql: Column) -> Column:
    return F.concat(F.lit(K.QUESTION_LABEL), question, F.lit("\n" + K.SQL_LABEL), sql)


def glossary_vector_text(term: Column, definition: Column) -> Column:
    return F.concat(term, F.lit(": "), definition)


def vector_texts(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Table comments joined with the column texts on the table key."""
    texts = column_texts(columns).drop("table_comment")
    joined = tables.select(*KEY, F.coalesce("table_comment", F.lit("")).alias("table_comment"))
    return joined.join(texts, KEY).select(
        *KEY,
        "table_comment",
        "column_count",
        table_vector_text(
            F.col("schema_name"), F.col("table_name"), F.col("table_comment"), F.col("columns_vector")
        ).alias("vector_text"),
    )


def signatures(columns: DataFrame) -> DataFrame:
    """One MD5 per table over its vector text.

    Extraction and polling share this function, so the stored hash and the polled signature
    agree.
    """
    texts = column_texts(columns)
    body = table_vector_text(
        F.col("schema_name"), F.col("table_name"), F.col("table_comment"), F.col("columns_vector")
    )
    return texts.select(*KEY, F.md5(body).alias("signature"))


def card_header(schema: Column, table: Column, comment: Column) -> Column:
    return F.concat(
        F.lit(K.CARD_HEADER),
        text.display_name(schema, table),
        F.when(comment != "", F.concat(F.lit(K.CARD_COMMENT), comment)).otherwise(F.lit("")),
    )


def schema_cards(columns: DataFrame) -> DataFrame:
    """One card per table: header, then the indented column lines."""
    t = column_texts(columns)
    head = card_header(F.col("schema_name"), F.col("table_name"), F.col("table_comment"))
    body = F.when(
        F.col("columns_card") != "", F.concat(F.lit("\n" + K.CARD_COLUMNS + "\n"), F.col("columns_card"))
    ).otherwise(F.lit(""))
    return t.select(*KEY, F.concat(head, body).alias("card"))


def parse_cards(cards: DataFrame, keep: list[str], card: str = "card") -> DataFrame:
    """Cards back to (schema, table, column) rows.

    Every input row may hold one card or several joined by blank lines; the split is local
    to the row. A card without columns gives one row with a null column.
    """
    blocks = F.filter(
        F.split(F.col(card), "\n\n"), lambda b: b.rlike(_CARD_HEAD)
    )
    one = cards.select(*keep, F.posexplode(blocks).alias("block_no", "_block"))
    name = F.lower(F.regexp_extract(F.col("_block"), _CARD_HEAD, 1))
    fields = F.transform(
        F.filter(
            F.split("_block", "\n"), lambda s: s.rlike(r"(?U)^\s+\w+\s*\[")
        ),
        lambda s: F.lower(F.regexp_extract(s, r"(?U)^\s+(\w+)\s*\[", 1)),
    )
    qualified = F.contains(F.col("_name"), F.lit("."))
    return (
        one.select(*keep, "block_no", name.alias("_name"), fields.alias("_fields"))
        .select(
            *keep,
            "block_no",
            F.when(qualified, F.substring_index("_name", ".", 1)).alias("schema_name"),
            F.when(qualified, F.expr("substring(_name, instr(_name, '.') + 1)"))
            .otherwise(F.col("_name"))
            .alias("table_name"),
            F.explode_outer("_fields").alias("column_name"),
        )
    )


def field_sets(columns: DataFrame) -> DataFrame:
    """Sorted distinct lower-case column names per table."""
    return columns.groupBy(*KEY).agg(
        F.array_sort(F.collect_set(F.lower("column_name"))).alias("fields")
    )


def resolve_names(wanted: DataFrame, tables: DataFrame, strict_schema: bool = False) -> DataFrame:
    """Resolve names to tables: a qualified match first, else the first schema with the table.

    ``wanted`` has ``request_id, pos, db_name, name``. With ``strict_schema`` (the list form) a
    qualified miss in an existing schema does not fall back. Rows keep ``pos``; a miss has a
    null table. Candidates are reduced to one by an aggregate that combines before the
    shuffle, so a table name found in very many schemas is no hot spot.
    """
    qualified = F.contains(F.col("name"), F.lit("."))
    asked = wanted.select(
        "request_id",
        "pos",
        "db_name",
        "name",
        F.when(qualified, F.substring_index("name", ".", 1)).alias("_schema"),
        F.when(qualified, F.expr("substring(name, instr(name, '.') + 1)"))
        .otherwise(F.col("name"))
        .alias("_table"),
    )
    # First schema per table name: the fallback target, one row per (tenant, table).
    first = tables.groupBy("db_name", F.col("table_name").alias("_table")).agg(
        F.min("schema_name").alias("_first_schema")
    )
    exact = tables.select(
        "db_name",
        F.col("schema_name").alias("_schema"),
        F.col("table_name").alias("_table"),
        F.lit(True).alias("_exact"),
    ).distinct()
    out = asked.join(exact, ["db_name", "_schema", "_table"], "left").join(
        first, ["db_name", "_table"], "left"
    )
    fallback = F.col("_first_schema")
    if strict_schema:
        schemas = tables.select(
            "db_name", F.col("schema_name").alias("_schema"), F.lit(True).alias("_known")
        ).distinct()
        out = out.join(schemas, ["db_name", "_schema"], "left")
        fallback = F.when(F.col("_known").isNull(), fallback)
    schema = F.when(F.col("_exact"), F.col("_schema")).otherwise(fallback)
    return out.select(
        "request_id",
        "pos",
        "db_name",
        "name",
        schema.alias("schema_name"),
        F.when(schema.isNotNull(), F.col("_table")).alias("table_name"),
        F.when(F.col("_exact"), F.lit("exact"))
        .when(schema.isNotNull(), F.lit("fallback"))
        .otherwise(F.lit("missing"))
        .alias("match"),
    )


def single_card(columns: DataFrame) -> DataFrame:
    """The one-table card form: ``表: s.t (注释: c)``, then the indented column lines."""
    t = column_texts(columns)
    head = F.concat(
        F.lit(K.ONE_CARD_HEADER),
        text.display_name(F.col("schema_name"), F.col("table_name")),
        F.when(
            F.col("table_comment") != "",
            F.concat(F.lit(" (注释: "), F.col("table_comment"), F.lit(")")),
        ).otherwise(F.lit("")),
    )
    return t.select(
        *KEY,
        F.concat(head, F.lit("\n" + K.CARD_COLUMNS + "\n"), F.col("columns_card")).alias("card"),
    )


def named_cards(resolved: DataFrame, columns: DataFrame) -> DataFrame:
    """The one-table card of every resolved name (see ``resolve_names``), a not-found text for a miss."""
    # A miss gets a key of its own that no table has, so all misses do not meet in one task.
    spread = F.concat(F.lit("? "), F.col("request_id").cast("string"), F.lit(" "), F.col("pos").cast("string"))
    keyed = resolved.withColumns(
        {
            "schema_name": F.when(F.col("table_name").isNull(), "").otherwise(F.col("schema_name")),
            "table_name": F.coalesce("table_name", spread),
        }
    )
    found = keyed.join(single_card(columns), KEY, "left")
    missing = F.concat(F.lit(K.NOT_FOUND), F.col("name"))
    return found.select("request_id", "pos", "db_name", "name", F.coalesce("card", missing).alias("card"))
