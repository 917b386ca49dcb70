"""Scoring of SQL candidates against retrieval hits and question words.

Hits are ``request_id, rank, schema_name, table_name, score`` (a few per request, one per asked
top-k), candidates are ``request_id, batch, sql``. Hits and words travel as one small array per
request, so a candidate is scored in its own row and no pair of texts is ever multiplied out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.functions import constants as K
from tablescout.functions import text


def distance_weight(score: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - score / 2.0)


def _hit_lists(hits: DataFrame) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("rank", "schema_name", "table_name", "score")))
    return hits.groupBy("request_id").agg(listed.alias("_hits"))


def _weighted(hits: Column) -> Column:
    n = F.size(hits)

    def weigh(h: Column, i: Column) -> Column:
        position = (n - i).cast("double") / n
        w = K.RANK_SHARE * position + K.DISTANCE_SHARE * distance_weight(F.coalesce(h["score"], F.lit(1.0)))
        return F.struct(
            h["rank"].alias("rank"),
            F.lower(F.coalesce(h["schema_name"], F.lit(""))).alias("schema_name"),
            F.lower(h["table_name"]).alias("table_name"),
            w.alias("weight"),
        )

    return F.transform(hits, weigh)


def hit_weights(hits: DataFrame) -> DataFrame:
    """Weight of each hit: 0.6 of its place plus 0.4 of its closeness."""
    return _hit_lists(hits).select("request_id", F.inline(_weighted(F.col("_hits"))))


def _keys(weighted: Column) -> Column:
    """(``schema.table`` or ``table``, weight) per hit; the last entry of a key wins."""
    entries = F.flatten(
        F.transform(
            weighted,
            lambda h: F.array(
                F.struct(F.concat(h["schema_name"], F.lit("."), h["table_name"]).alias("key"), h["weight"].alias("w")),
                F.struct(h["table_name"].alias("key"), h["weight"].alias("w")),
            ),
        )
    )
    keys = F.transform(entries, lambda e: e["key"])
    last = F.transform(
        F.array_distinct(keys), lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)
    )
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), entries).otherwise(last)


def candidate_scores(candidates: DataFrame, requests: DataFrame, hits: DataFrame) -> DataFrame:
    """Score parts of every candidate; ``requests`` has ``request_id, question``."""
    per_request = requests.select("request_id", text.keywords(F.col("question")).alias("_words")).join(
        _hit_lists(hits).select("request_id", _keys(_weighted(F.col("_hits"))).alias("_keys")), "request_id", "left"
    )
    low = candidates.withColumn("_low", F.lower("sql")).join(per_request, "request_id", "left")
    found = low.select(
        "request_id", "batch", "sql",
        F.filter("_keys", lambda e: F.contains(F.col("_low"), e["key"])).alias("_used"),
        F.size(F.filter("_words", lambda w: F.contains(F.col("_low"), w))).alias("_n"),
    )
    tables = F.aggregate("_used", F.lit(0.0), lambda a, e: a + e["w"])
    joined = found.select(
        "request_id", "batch", "sql",
        F.coalesce(tables, F.lit(0.0)).alias("table_score"),
        F.greatest(F.coalesce("_n", F.lit(0)), F.lit(0)).alias("keyword_hits"),
        F.greatest(F.coalesce(F.size("_used"), F.lit(0)), F.lit(0)).alias("tables_used"),
    )
    total = K.TABLE_WEIGHT * F.col("table_score") + F.col("keyword_hits") + (10 - F.col("batch")) * K.BATCH_STEP
    return joined.withColumn("score", total)


def best_candidate(scored: DataFrame) -> DataFrame:
    """Best candidate per request, the earliest batch on a tie."""
    best = F.max(F.struct("score", (-F.col("batch")).alias("_b"), "sql")).alias("_best")
    return scored.groupBy("request_id").agg(best, F.count(F.lit(1)).alias("candidates")).select(
        "request_id", (-F.col("_best._b")).alias("batch"), "_best.sql", "_best.score", "candidates"
    )


def _with_all(texts: DataFrame, tenants: DataFrame | None, column: str, empty: str) -> DataFrame:
    """The texts, and for each listed tenant without one the text that says so."""
    if tenants is None:
        return texts
    bare = tenants.select("db_name").distinct().join(texts.select("db_name").distinct(), "db_name", "left_anti")
    return texts.unionByName(bare.withColumn(column, F.lit(empty)), allowMissingColumns=True)


def few_shot(items: DataFrame, n: int = 5, tenants: DataFrame | None = None) -> DataFrame:
    """Example text per tenant: the first n items, those with both fields.

    ``tenants`` adds those without any item.
    """
    from tablescout.operators.numbering import first_n_per_group

    first = first_n_per_group(items, ["db_name"], ["id"], n, "_rank")
    both = (F.coalesce("question", F.lit("")) != "") & (F.coalesce("sql", F.lit("")) != "")
    example = F.when(
        both, F.concat(F.lit(K.QUESTION_LABEL), "question", F.lit("\n" + K.SQL_LABEL), "sql")
    )
    ordered = F.array_sort(F.collect_list(F.when(both, F.struct("_rank", example.alias("x")))))
    joined = F.array_join(F.transform(ordered, lambda s: s["x"]), "\n\n")
    texts = first.groupBy("db_name").agg(F.coalesce(F.nullif(joined, F.lit("")), F.lit(K.NO_EXAMPLES)).alias("examples"))
    return _with_all(texts, tenants, "examples", K.NO_KNOWLEDGE)


def glossary_text(items: DataFrame, ids_per_part: int = 256, tenants: DataFrame | None = None) -> DataFrame:
    """Glossary lines per tenant as ordered parts of at most ``ids_per_part`` ids.

    The parts of a tenant in order, joined by newlines, are its whole glossary text, and no
    task puts a whole tenant together. ``tenants`` adds those without a line, with a null part.
    """
    term, definition = text.strip(F.col("term")), text.strip(F.col("definition"))
    lines = items.select(
        "db_name", "id", F.floor(F.col("id") / ids_per_part).cast("long").alias("part"),
        F.concat(F.lit("- **"), term, F.lit("**："), definition).alias("_line"),
    ).where((term != "") & (definition != ""))
    parts = lines.groupBy("db_name", "part").agg(
        F.expr("listagg(_line, '\n') within group (order by id)").alias("glossary")
    )
    return _with_all(parts, tenants, "glossary", K.NO_GLOSSARY)


def context_choice(questions: DataFrame, named: DataFrame, nearest: DataFrame) -> DataFrame:
    """Context of each question: its named table, else its nearest tables, else all tables.

    ``named`` and ``nearest`` have ``request_id, schema_name, table_name`` (``nearest`` also
    ``rank``). A question without either gets one row of scope ``all`` with null names.
    """
    tagged = named.select(
        "request_id", F.lit(1).alias("_p"), F.lit("named").alias("scope"), F.lit(1).alias("rank"), "schema_name", "table_name"
    ).unionByName(
        nearest.select("request_id", F.lit(2).alias("_p"), F.lit("nearest").alias("scope"), "rank", "schema_name", "table_name")
    )
    best = tagged.groupBy("request_id").agg(F.min("_p").alias("_p"))
    kept = tagged.join(best, ["request_id", "_p"]).drop("_p")
    rest = questions.select("request_id").join(kept, "request_id", "left")
    return rest.withColumn("scope", F.coalesce("scope", F.lit("all")))
