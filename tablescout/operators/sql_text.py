"""Jobs over a column of SQL texts, checked against a catalog.

A text frame has ``db_name, query_id, sql``. A catalog is a column frame (see
``catalog_text``). Facts about a name are looked up with one equi-join on (tenant, name); Spark
broadcasts the name table only when it is under the session's size limit and otherwise
shuffles it, where adaptive execution splits names that are used very often. All further
logic is local to a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.functions import constants as K
from tablescout.functions import text


def _all(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _lower_all(c: Column, pattern: str, group: int = 1) -> Column:
    return F.transform(_all(c, pattern, group), F.lower)


# Marker names "#0".."#n": every tenant with a catalog has them, so a text finds out with the
# same join whether its tenant has any table. Many markers keep a large tenant spread out.
_MARKERS = 256


def _lower_catalog(columns: DataFrame) -> DataFrame:
    return columns.select(
        "db_name",
        F.lower("schema_name").alias("s"),
        F.lower("table_name").alias("t"),
        F.lower("column_name").alias("c"),
    )


def _markers(columns: DataFrame) -> DataFrame:
    every = F.transform(
        F.sequence(F.lit(0), F.lit(_MARKERS - 1)), lambda i: F.concat(F.lit("#"), i.cast("string"))
    )
    return columns.select("db_name").distinct().select(
        "db_name", F.explode(every).alias("name"), F.lit("m").alias("role")
    )


def name_facts(columns: DataFrame) -> DataFrame:
    """Rows (tenant, name, role): schemas ``s``, tables ``t``, fields ``f``, ``table.field`` pairs ``p``, markers ``m``.

    A name may have several roles but one row per role. Nothing is collected, so a table name
    that occurs in very many schemas is no large group.
    """
    pair = F.concat("t", F.lit("."), "c")
    roles = {"s": F.col("s"), "t": F.col("t"), "f": F.col("c"), "p": pair}
    # The catalog is read once: a column gives its four names, and one distinct settles them all.
    named = F.array(*[F.struct(n.alias("name"), F.lit(r).alias("role")) for r, n in roles.items()])
    tenant = F.struct(F.lit("#").alias("name"), F.lit("m").alias("role"))
    rows = _lower_catalog(columns).select("db_name", F.explode(F.array_append(named, tenant)).alias("x"))
    distinct = rows.select("db_name", "x.name", "x.role").where("name <> ''").distinct()
    # A tenant's one marker becomes all of them.
    every = F.when(F.col("role") == "m", F.transform(
        F.sequence(F.lit(0), F.lit(_MARKERS - 1)), lambda i: F.concat(F.lit("#"), i.cast("string"))
    )).otherwise(F.array("name"))
    return distinct.select("db_name", F.explode(every).alias("name"), "role")


def table_fields(columns: DataFrame) -> DataFrame:
    """Rows (tenant, name, role ``t``, fields) per short table name, and markers.

    The list holds the distinct field names of all tables of one short name; a single table has
    at most 1,600.
    """
    tables = _lower_catalog(columns).groupBy("db_name", F.col("t").alias("name")).agg(
        F.lit("t").alias("role"), F.collect_set("c").alias("fields")
    )
    return tables.unionByName(_markers(columns), allowMissingColumns=True)


def _marker(query_id: Column) -> Column:
    return F.concat(F.lit("#"), F.pmod(F.hash(query_id), F.lit(_MARKERS)).cast("string"))


def table_refs(sql: Column) -> Column:
    """Lower-case names after FROM and JOIN, in order."""
    return _lower_all(text.without_literals(sql, quoted_names=False), K.SQL_REF)


def alias_pairs(cleaned: Column) -> Column:
    """(prefix, table, own name?) in order: each table names itself, then its alias.

    An empty alias or a keyword in its place gives no alias entry.
    """
    tables = _lower_all(cleaned, K.SQL_REF_ALIAS, 1)
    aliases = _lower_all(cleaned, K.SQL_REF_ALIAS, 2)
    keywords = F.array(*[F.lit(w) for w in ["", *K.NON_ALIAS_WORDS]])

    def pair(t: Column, a: Column) -> Column:
        name = F.substring_index(t, ".", -1)
        return F.array(
            F.struct(name.alias("prefix"), name.alias("target"), F.lit(True).alias("own")),
            F.struct(a.alias("prefix"), name.alias("target"), F.lit(False).alias("own")),
        )

    pairs = F.flatten(F.zip_with(tables, aliases, pair))
    return F.filter(pairs, lambda p: p["own"] | ~F.array_contains(keywords, p["prefix"]))


def sql_aliases(queries: DataFrame, columns: DataFrame, keep: list[str]) -> DataFrame:
    """Alias rows ``query, prefix, target``; the last entry of a prefix wins.

    A table names itself only when the catalog has it.
    """
    tables = columns.select("db_name", F.lower("table_name").alias("target")).distinct().withColumn(
        "_known", F.lit(True)
    )
    pairs = queries.select(
        "db_name", *keep, F.posexplode(alias_pairs(text.without_literals(F.col("sql")))).alias("_at", "_p")
    ).select("db_name", *keep, "_at", "_p.*")
    return (
        pairs.join(tables, ["db_name", "target"], "left")
        .where(~F.col("own") | F.col("_known"))
        .groupBy("db_name", *keep, "prefix")
        .agg(F.max_by("target", "_at").alias("target"))
    )


def _known(role: str) -> Column:
    """The text's own names that the catalog has in this role."""
    return F.transform(F.filter("facts", lambda f: f["role"] == role), lambda f: f["name"])


def _with_facts(queries: DataFrame, known_names: DataFrame, names: Column, carried: list[str]) -> DataFrame:
    """Queries with ``facts``, a list (role, name, ..) of their own names, and ``known``.

    A text becomes one small row per name; its carried lists ride on just one of these rows,
    chosen by hash, so they are shuffled once and not once per name.
    """
    listed = queries.select(
        "db_name",
        "query_id",
        F.struct(*carried).alias("_lists"),
        F.concat(F.array(_marker(F.col("query_id"))), names).alias("_names"),
    )
    carrier = F.pmod(F.hash("query_id"), F.size("_names"))
    one_each = F.transform(
        "_names",
        lambda n, i: F.struct(n.alias("name"), F.when(i == carrier, F.col("_lists")).alias("_carried")),
    )
    rows = listed.select("db_name", "query_id", F.inline(one_each))
    # The name comes first: it tells keys apart, a tenant has very many of them.
    found = rows.join(known_names, ["name", "db_name"], "left")
    # A name without facts is done. The rows are dealt out as they are: the lists of an aggregate begun before,
    # mostly of one row, would be larger.
    found = found.where("role IS NOT NULL OR _carried IS NOT NULL").repartition("db_name", "query_id")
    entry = F.when(F.col("role").isNotNull(), F.struct("role", "name", *[c for c in known_names.columns if c == "fields"]))
    grouped = found.groupBy("db_name", "query_id").agg(
        F.first("_carried", ignorenulls=True).alias("_carried"),
        F.collect_list(entry).alias("facts"),
    )
    return grouped.select(
        "db_name", "query_id", "_carried.*", "facts",
        F.exists("facts", lambda f: f["role"] == "m").alias("known"),
    )


def _packed(parts: DataFrame, names: Column) -> DataFrame:
    """The lists of a text as one string, without what can be told from the rest; shuffled, it is far smaller.

    Names hold word characters only, so commas, bars and dots part them; each item has a comma before it, so
    an empty list is no list of an empty name.
    """
    flag = lambda a: F.when(a["own"], F.lit("1")).otherwise(F.lit("0"))
    lists = [
        F.col("ctes"),
        F.col("as_names"),
        F.transform("dotted", lambda d: F.concat(d["left"], F.lit("."), d["written"])),
        F.col("bare.written"),
        F.transform("aliases", lambda a: F.concat(flag(a), F.lit("."), a["prefix"], F.lit("."), a["target"])),
    ]
    joined = [F.array_join(F.transform(x, lambda i: F.concat(F.lit(","), i)), "") for x in lists]
    return parts.select("db_name", "query_id", names.alias("_all"), F.concat_ws("|", *joined).alias("_packed"))


def _unpacked(q: DataFrame) -> DataFrame:
    """The lists that ``_packed`` joined, as columns of their own."""
    q = q.withColumn("_lists", F.split("_packed", r"\|", -1))
    none = F.array().cast("array<string>")
    items = {}
    for i, name in enumerate(["ctes", "as_names", "dotted", "bare", "aliases"]):
        joined = F.element_at("_lists", i + 1)
        items[name] = F.when(joined == "", none).otherwise(F.split(F.substr(joined, F.lit(2)), ",", -1))
    q = q.withColumns(items)

    def dotted(d: Column) -> Column:
        written = F.substring_index(d, ".", -1)
        return F.struct(F.substring_index(d, ".", 1).alias("left"), F.lower(written).alias("right"), written.alias("written"))

    def alias(a: Column) -> Column:
        part = F.split(a, r"\.", -1)
        return F.struct(part[1].alias("prefix"), part[2].alias("target"), (part[0] == "1").alias("own"))

    return q.withColumns({
        "dotted": F.transform("dotted", dotted),
        "bare": F.transform("bare", lambda w: F.struct(w.alias("written"), F.lower(w).alias("name"))),
        "aliases": F.transform("aliases", alias),
    }).drop("_lists", "_packed")


def sql_lint(queries: DataFrame, columns: DataFrame) -> DataFrame:
    """Unknown identifiers per query, sorted, in their original case.

    ``a.b`` is checked against the table behind ``a`` when that is known, else against all
    fields; bare names against every field, table and schema. CTE names, AS names and used
    prefixes are exempt. Three-part names are read two parts at a time, AS names may hide
    real errors, and double-quoted names are not checked.
    """
    cleaned = queries.select("db_name", "query_id", text.without_literals(F.col("sql")).alias("_c"))
    dotted = F.zip_with(
        _all(F.col("_c"), K.SQL_DOTTED, 1),
        _all(F.col("_c"), K.SQL_DOTTED, 2),
        lambda a, b: F.struct(F.lower(a).alias("left"), F.lower(b).alias("right"), b.alias("written")),
    )
    bare = F.filter(
        F.array_distinct(_all(F.col("_c"), K.SQL_BARE)), lambda w: ~F.lower(w).isin(*K.RESERVED_WORDS)
    )
    parts = cleaned.select(
        "db_name",
        "query_id",
        _lower_all(F.col("_c"), K.SQL_CTE).alias("ctes"),
        _lower_all(F.col("_c"), K.SQL_AS).alias("as_names"),
        dotted.alias("dotted"),
        F.transform(bare, lambda w: F.struct(w.alias("written"), F.lower(w).alias("name"))).alias("bare"),
        alias_pairs(F.col("_c")).alias("aliases"),
    )
    # Every table a prefix may stand for, with the field: looked up as one name.
    pairs = F.flatten(
        F.transform(
            "dotted",
            lambda d: F.transform(
                F.filter("aliases", lambda a: a["prefix"] == d["left"]),
                lambda a: F.concat(a["target"], F.lit("."), d["right"]),
            ),
        )
    )
    names = F.array_distinct(
        F.concat(
            F.col("bare.name"), F.col("dotted.left"), F.col("dotted.right"), F.col("aliases.target"), pairs
        )
    )
    q = _with_facts(_packed(parts, names), name_facts(columns), F.col("_all"), ["_packed"])
    q = _unpacked(q)
    # Each step is a column of its own, so no lambda evaluates it again for every element.
    q = q.withColumns(
        {"_schemas": _known("s"), "_tables": _known("t"), "_fields": _known("f"), "_pairs": _known("p")}
    )
    q = q.withColumn(
        "_aliases",
        F.filter("aliases", lambda a: ~a["own"] | F.array_contains("_tables", a["target"])),
    )

    def with_target(d: Column) -> Column:
        mine = F.filter("_aliases", lambda a: a["prefix"] == d["left"])
        return F.struct(
            d["left"].alias("left"), d["right"].alias("right"), d["written"].alias("written"),
            F.try_element_at(mine, F.lit(-1))["target"].alias("target"),
        )

    # Dotted names that are no schema.table and whose right side is no AS or CTE name.
    open_names = F.filter(
        F.array_distinct("dotted"),
        lambda d: ~(
            (F.array_contains("_schemas", d["left"]) & F.array_contains("_tables", d["right"]))
            | F.array_contains("as_names", d["right"])
            | F.array_contains("ctes", d["right"])
        ),
    )
    q = q.withColumn("_dotted", F.transform(open_names, with_target))

    def bad_dotted(d: Column) -> Column:
        has_it = F.array_contains("_pairs", F.concat(d["target"], F.lit("."), d["right"]))
        by_any = ~F.array_contains("ctes", d["left"]) & ~F.array_contains("_fields", d["right"])
        of_table = F.coalesce(F.array_contains("_tables", d["target"]), F.lit(False))
        return F.when(of_table, ~has_it).otherwise(by_any)

    exempt = F.concat("ctes", "as_names", F.col("dotted.left"), "_fields", "_tables", "_schemas")
    q = q.withColumns(
        {
            "_bad": F.filter("_dotted", bad_dotted)["written"],
            "_unknown": F.array_except(F.col("bare.name"), exempt),
        }
    )
    found = F.array_union(
        "_bad", F.filter("bare", lambda w: F.array_contains("_unknown", w["name"]))["written"]
    )
    # A tenant without any table has nothing to check against.
    checked = F.when(F.col("known"), F.array_sort(found)).otherwise(F.array().cast("array<string>"))
    return q.select("db_name", "query_id", checked.alias("unknown_names"))


def relevant_blocks(queries: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables whose blocks a query needs: those it references by full or short name.

    Rows are ``db_name, query_id, scope, schema_name, table_name``. A query that references no
    known table needs every block of the tenant; it gets one row with scope ``all`` and null
    names instead of a copy of the whole catalog.
    """
    names = tables.select(
        "db_name", "schema_name", "table_name",
        F.lower("table_name").alias("_short"),
        F.lower(F.concat_ws(".", F.nullif(F.col("schema_name"), F.lit("")), "table_name")).alias("_full"),
    )
    keys = names.select(
        "db_name", "schema_name", "table_name",
        F.explode(F.array_distinct(F.array("_short", "_full"))).alias("name"),
    )
    refs = F.col("_refs")
    both = F.array_distinct(F.concat(refs, F.transform(refs, lambda r: F.substring_index(r, ".", -1))))
    asked = queries.select("db_name", "query_id", table_refs(F.col("sql")).alias("_refs")).select(
        "db_name", "query_id", F.explode(both).alias("name")
    )
    hits = (
        asked.join(keys, ["db_name", "name"])
        .select("db_name", "query_id", F.lit("referenced").alias("scope"), "schema_name", "table_name")
        .distinct()
    )
    none = F.lit(None).cast("string")
    rest = queries.select("db_name", "query_id").join(hits, ["db_name", "query_id"], "left_anti")
    return hits.unionByName(
        rest.select(
            "db_name", "query_id", F.lit("all").alias("scope"),
            none.alias("schema_name"), none.alias("table_name"),
        )
    )


def field_hint(queries: DataFrame, columns: DataFrame) -> DataFrame:
    """Allowed-field text per query: one line per referenced known table, first use first."""
    refs = table_refs(F.col("sql"))
    parts = queries.select("db_name", "query_id", refs.alias("refs"))
    names = F.array_distinct(F.transform("refs", lambda r: F.substring_index(r, ".", -1)))
    q = _with_facts(parts, table_fields(columns), names, ["refs"])
    shorts = F.transform("refs", lambda r: F.substring_index(r, ".", -1))
    # A later reference to a table that was already used adds nothing.
    tables = F.filter("facts", lambda f: f["role"] == "t")
    first_use = F.filter(
        F.zip_with("refs", shorts, lambda r, t: F.struct(r.alias("r"), t.alias("t"))),
        lambda p, i: (F.array_position(shorts, p["t"]) == i + 1)
        & F.exists(tables, lambda f: f["name"] == p["t"]),
    )

    def line(p: Column) -> Column:
        fields = F.array_sort(F.element_at(F.filter(tables, lambda f: f["name"] == p["t"]), 1)["fields"])
        return F.when(
            F.size(fields) > 0,
            F.concat(F.lit("- "), p["r"], F.lit(K.FIELD_HINT), F.array_join(fields, ", ")),
        ).otherwise(F.concat(F.lit("- "), p["r"], F.lit(K.FIELD_UNKNOWN)))

    return q.select(
        "db_name", "query_id", F.array_join(F.transform(first_use, line), "\n").alias("hint")
    )


def screen(queries: DataFrame, keep: list[str]) -> DataFrame:
    """Cleaned text, read-only gate and the first write pattern of every query."""
    return queries.select(*keep, text.clean_sql(F.col("sql")).alias("cleaned")).select(
        *keep,
        "cleaned",
        text.is_read_query(F.col("cleaned")).alias("is_read"),
        text.first_write_pattern(F.col("cleaned")).alias("write_pattern"),
    )
