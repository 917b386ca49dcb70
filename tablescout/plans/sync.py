"""Incremental vector sync and the gated check, as plans over whole item tables.

``items`` has ``db_name, schema_name, table_name, vector_text``; stored vectors have the key,
``provider, text_hash, embedding, updated_at``, one row per (item, provider). The hash is kept
per provider, so one provider's update never hides another's.

Keys and hashes alone tell what moved, by the digests of ``operators.diff``. When the keys of the moved
items are measured to be small they are broadcast, and neither texts nor vectors are shuffled. Otherwise a
bitmap of them tells which texts to encode where they lie, and vectors are joined by shuffling; texts never are.
Items and stored vectors are read once each, items once for each encoder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.functions import constants as K
from tablescout.operators import diff, encode, upsert
from tablescout.operators.catalog_text import glossary_vector_text, knowledge_vector_text
from tablescout.operators.filters import visible_items
from tablescout.operators.sized import BROADCAST_BYTES, broadcast_if_small, likely_among, measured_bytes
from tablescout.sources.lineage import cut_lineage

ITEM = [*diff.KEY, "provider"]
STORED = (
    "db_name string, schema_name string, table_name string, provider string, text_hash string, "
    "embedding array<float>, updated_at timestamp_ntz"
)


def default_encoders() -> dict[str, Callable]:
    return {p: encode.hashed_ngrams for p in K.PROVIDERS}


def sync_classes(items: DataFrame, stored: DataFrame, unchanged: bool = False) -> DataFrame:
    """Status of every (item, provider), written once as the sync reads it twice.

    Rows that are unchanged are left out unless asked for.
    """
    hashed = items.select(*diff.KEY, F.md5("vector_text").alias("text_hash"))
    old = stored.select(
        *ITEM, "text_hash", F.col("embedding").isNotNull().alias("has_vector")
    )
    return cut_lineage((diff.classify if unchanged else diff.moved)(hashed, old))


def apply_sync(
    classes: DataFrame,
    items: DataFrame,
    stored: DataFrame,
    now: Column,
    encoders: dict[str, Callable] | None = None,
) -> DataFrame:
    """Next version of the stored vectors, with the ``status`` that led to each row.

    New and changed texts are encoded, vectors of removed items become null, all other rows
    pass through as they are; only texts to encode go through Python, and few others whose hash a bitmap of
    very many keys does not tell apart. ``classes`` may hold unchanged rows or leave them out.
    """
    makers = encoders or default_encoders()
    out = [*ITEM, "text_hash", "embedding", "updated_at", "status"]
    moved = classes.where("status <> 'unchanged'").select(*ITEM, F.col("cur_text_hash").alias("text_hash"), "status")
    small = measured_bytes(moved) <= BROADCAST_BYTES
    hinted = F.broadcast if small else lambda df: df
    texts = diff.with_key(items).select(*diff.KEY, "vector_text")
    todo = moved.where("status IN ('new', 'changed')")
    coded = _encode(texts.join(hinted(todo), diff.KEY), makers) if small else _encode_in_place(texts, todo, makers)
    coded = coded.withColumn("updated_at", now)
    # One pass over the stored rows: those encoded anew go, removed ones lose their vector.
    status = F.coalesce("_status", F.lit("unchanged"))
    left = diff.with_key(stored).join(hinted(moved.select(*ITEM, F.col("status").alias("_status"))), ITEM, "left")
    left = left.where("_status IS NULL OR _status IN ('removed', 'gone')").withColumns(
        {
            "embedding": F.when(F.col("_status").isNull(), F.col("embedding")),
            "updated_at": F.when(F.col("_status") == "removed", now).otherwise(F.col("updated_at")),
            "status": status,
        }
    )
    return coded.select(*out).unionByName(left.select(*out))


def _encode(work: DataFrame, makers: dict[str, Callable], keep_text: bool = False) -> DataFrame:
    """Encode in one pass when all providers share an encoder, else one pass per provider."""
    if len(set(makers.values())) == 1:
        coded = encode.encode(work, "vector_text", next(iter(makers.values())))
    else:
        coded = encode.encode_for_providers(work, "vector_text", makers)
    return coded if keep_text else coded.drop("vector_text")


def _encode_in_place(texts: DataFrame, todo: DataFrame, makers: dict[str, Callable]) -> DataFrame:
    """``todo`` with the vector of each item's text, which is encoded before any shuffle, once for an encoder."""
    if len(set(makers.values())) == 1:
        shares = [(next(iter(makers.values())), todo)]
    else:
        shares = [(make, todo.where(F.col("provider") == p)) for p, make in makers.items()]
        served = F.coalesce(F.col("provider").isin(list(makers)), F.lit(False))
        shares.append((None, todo.where(~served)))
    out = None
    for make, mine in shares:
        if make is None:
            vectors = texts.select(*diff.KEY, F.lit(None).cast("array<float>").alias("embedding"))
        else:
            vectors = encode.encode(likely_among(texts, mine, diff.KEY), "vector_text", make).drop("vector_text")
        part = vectors.join(mine, diff.KEY)
        out = part if out is None else out.unionByName(part)
    return out


def incremental_sync(
    items: DataFrame,
    stored: DataFrame,
    now: Column,
    encoders: dict[str, Callable] | None = None,
) -> DataFrame:
    return apply_sync(sync_classes(items, stored), items, stored, now, encoders)


def rebuild_all(items: DataFrame, now: Column, encoders: dict[str, Callable] | None = None) -> DataFrame:
    """Encode every item for every provider; nothing is compared."""
    every = diff.with_key(items).select(
        *diff.KEY, "vector_text", F.md5("vector_text").alias("text_hash"),
        F.explode(F.array(*[F.lit(p) for p in K.PROVIDERS])).alias("provider"),
    )
    coded = _encode(every, encoders or default_encoders())
    return coded.withColumn("updated_at", now).select(
        *ITEM, "text_hash", "embedding", "updated_at", F.lit("new").alias("status")
    )


def upsert_items(
    items: DataFrame, stored: DataFrame, now: Column, encoders: dict[str, Callable] | None = None
) -> DataFrame:
    """Next version of the stored vectors with these items encoded anew for every provider.

    For single items after a write, whatever their hashes; the rows of all other items stay. A null
    schema is the empty one, and the provider is part of the key.
    """
    coded = rebuild_all(items, now, encoders).drop("status")
    return upsert.bulk_upsert(diff.with_key(stored).select(*coded.columns), coded, ITEM, now)


def text_vectors(
    knowledge: DataFrame, glossary: DataFrame, encoders: dict[str, Callable] | None = None
) -> DataFrame:
    """Vectors of knowledge and glossary rows for every provider.

    Pass filtered frames to encode single rows after a write. Rows are ``kind, db_name, id,
    provider, vector_text, embedding``.
    """
    return _encode(_text_pairs(knowledge, glossary), encoders or default_encoders(), keep_text=True)


def _text_pairs(knowledge: DataFrame, glossary: DataFrame) -> DataFrame:
    """The text of every knowledge and glossary row, once per provider."""
    pairs = knowledge.select(
        F.lit("knowledge").alias("kind"), "db_name", "id",
        knowledge_vector_text(F.col("question"), F.col("sql")).alias("vector_text"),
    ).unionByName(
        glossary.select(
            F.lit("glossary").alias("kind"), "db_name", "id",
            glossary_vector_text(F.col("term"), F.col("definition")).alias("vector_text"),
        )
    )
    return pairs.withColumn("provider", F.explode(F.array(*[F.lit(p) for p in K.PROVIDERS])))


TEXT_KEY = ["kind", "db_name", "id", "provider"]


def backfilled_text_vectors(
    knowledge: DataFrame, glossary: DataFrame, stored: DataFrame, encoders: dict[str, Callable] | None = None
) -> DataFrame:
    """Next version of the knowledge and glossary vectors: gaps are encoded, rows without an item go.

    ``stored`` has ``kind, db_name, id, provider, text_hash, embedding``; so has the result, with
    ``encoded`` where a missing vector, a null one or a changed text was encoded again.
    """
    wanted = _text_pairs(knowledge, glossary).withColumn("text_hash", F.md5("vector_text"))
    ready = stored.where(F.col("embedding").isNotNull()).select(*TEXT_KEY, "text_hash", "embedding")
    keys = wanted.select(*TEXT_KEY, "text_hash")
    kept = ready.join(keys, [*TEXT_KEY, "text_hash"], "left_semi").withColumn("encoded", F.lit(False))
    work = wanted.join(ready.select(*TEXT_KEY, "text_hash"), [*TEXT_KEY, "text_hash"], "left_anti")
    coded = _encode(work, encoders or default_encoders()).withColumn("encoded", F.lit(True))
    return kept.unionByName(coded.select(*kept.columns))


def store(synced: DataFrame) -> DataFrame:
    """The rows to write as the next version."""
    return synced.drop("status")


def check_tenants(
    items: DataFrame, stored: DataFrame, fingerprints: DataFrame
) -> DataFrame:
    """Fingerprint gate: per tenant ``full``, ``fill`` or ``none``."""
    missing = diff.missing_vectors(diff.with_key(items).select(*diff.KEY), diff.with_key(stored), diff.KEY)
    return diff.fingerprint_gate(diff.fingerprint(items, ["db_name"]), fingerprints, missing)


def check_and_sync(
    items: DataFrame, stored: DataFrame, fingerprints: DataFrame, now: Column
) -> DataFrame:
    """Sync the tenants that need it and drop rows of excluded schemas and tables.

    Tenants whose gate says ``none`` pass through unread by the encoder; a null schema counts as the
    empty one and is never excluded.
    """
    gate = cut_lineage(check_tenants(items, stored, fingerprints))
    todo = broadcast_if_small(gate.where(F.col("action") != "none").select("db_name"))
    busy = items.join(todo, "db_name", "left_semi")
    synced = store(incremental_sync(busy, stored.join(todo, "db_name", "left_semi"), now))
    rest = diff.with_key(stored).join(todo, "db_name", "left_anti")
    visible = visible_items(F.col("schema_name"), F.col("table_name"))
    return upsert.delete_where(synced.unionByName(rest.select(*synced.columns)), ~visible)


def sync_pass(
    items: DataFrame, stored: DataFrame, fingerprints: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame]:
    """``(vectors, fingerprints)`` to store after a gated check.

    The fingerprints are those of the items that were synced, so that a second pass over the same
    items finds nothing to do for any tenant. Items of excluded schemas and tables take no part;
    tenants without items keep the fingerprint they had.
    """
    shown = upsert.delete_where(
        items, ~visible_items(F.coalesce("schema_name", F.lit("")), F.col("table_name"))
    )
    vectors = check_and_sync(shown, stored, fingerprints, now)
    current = diff.fingerprint(shown, ["db_name"])
    left = fingerprints.select("db_name", "fingerprint").join(current.select("db_name"), "db_name", "left_anti")
    return vectors, current.unionByName(left)
