"""Questions to the schema text they are answered with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.functions import constants as K
from tablescout.functions import text
from tablescout.operators import packing
from tablescout.operators.catalog_text import KEY


def _listed(value: str, order: str, separator: str) -> Column:
    """Non-null values of a group in order, as one text."""
    return F.expr(f"listagg({value}, '{separator}') within group (order by {order})")


def cards_selected(resolved: DataFrame, cards: DataFrame) -> DataFrame:
    """``request_id, context``: the cards of each request's names in order, two line ends between them.

    ``resolved`` comes from ``resolve_names`` in its list form. Names without a table are left out; a
    request without any gets the text that names them. A request lists a few names.
    """
    # A miss gets a key of its own, so that all misses do not meet in one task.
    spread = F.concat(F.lit("? "), F.col("request_id").cast("string"), F.lit(" "), F.col("pos").cast("string"))
    keyed = resolved.withColumns(
        {"schema_name": F.coalesce("schema_name", F.lit("")), "table_name": F.coalesce("table_name", spread)}
    )
    found = keyed.join(cards.select(*KEY, "card"), KEY, "left")
    return found.groupBy("request_id").agg(
        F.coalesce(
            _listed("card", "pos", r"\n\n"), F.concat(F.lit(K.SELECTED_NOT_FOUND), _listed("name", "pos", ", "))
        ).alias("context")
    )


def tenant_contexts(cards: DataFrame, pos: str, tenants: DataFrame | None = None, **packing_options) -> DataFrame:
    """``db_name, batch_no, context``: all cards of a tenant, packed once whatever asks for them.

    ``pos`` is a unique integer order within the tenant. ``tenants`` adds those without a card, with the
    text that says so.
    """
    packed = packing.pack_blocks(cards, "db_name", pos, "card", **packing_options)
    texts = packing.batch_texts(cards, packed, "db_name", pos, "card").withColumnRenamed("batch_text", "context")
    if tenants is None:
        return texts
    bare = tenants.select("db_name").distinct().join(texts.select("db_name").distinct(), "db_name", "left_anti")
    return texts.unionByName(bare.select("db_name", F.lit(0).cast("long").alias("batch_no"), F.lit(K.NO_TABLES).alias("context")))


def question_context(choice: DataFrame, requests: DataFrame, cards: DataFrame) -> DataFrame:
    """``request_id, db_name, scope, context`` of every request, from ``context_choice``.

    A named table or the nearest tables give their cards in order. A named table without a card
    falls back to scope ``all``; nearest tables of which none has a card give the text that names them.
    Scope ``all`` has a null context: its text is the tenant's in ``tenant_contexts``, kept once.
    """
    asked = requests.select("request_id", "db_name")
    rows = choice.where("scope <> 'all'").join(asked, "request_id").join(cards.select(*KEY, "card"), KEY, "left").withColumn(
        "_name", text.display_name(F.col("schema_name"), F.col("table_name"))
    )
    texts = rows.groupBy("request_id", "scope").agg(
        _listed("card", "rank", r"\n\n").alias("_cards"), _listed("_name", "rank", ", ").alias("_names")
    )
    missing = F.when(F.col("scope") == "nearest", F.concat(F.lit(K.SELECTED_NOT_FOUND), "_names"))
    own = texts.withColumn("context", F.coalesce("_cards", missing)).where("context IS NOT NULL")
    return asked.join(own.select("request_id", "scope", "context"), "request_id", "left").withColumn(
        "scope", F.coalesce("scope", F.lit("all"))
    )
