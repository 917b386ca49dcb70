"""Questions to ranked tables and their cards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.operators import encode, filters, nearest


def vector_scan(vectors: DataFrame, provider: str, listed: str | None = None) -> DataFrame:
    """Filled vectors of one provider, optionally of the listed schemas."""
    return vectors.where(
        (F.col("provider") == provider)
        & F.col("embedding").isNotNull()
        & filters.in_list(F.col("schema_name"), listed)
    )


def search_questions(
    questions: DataFrame,
    items: DataFrame,
    k: int = 10,
    factory: Callable = encode.hashed_ngrams,
    question_id: str = "query_id",
    question: str = "question",
    **scope,
) -> DataFrame:
    """Encode questions and rank the ``k`` nearest items of each: ``query_id, vec_id, score, rank``.

    ``items`` has ``vec_id, embedding``. ``scope`` goes to ``nearest.knn_batch``: ``by`` holds questions
    to the items of their tenant and provider, ``listed`` to the schemas that they list, ``k_col`` gives
    a question a k of its own, and ``id_col`` names what the hits are called by.
    """
    used = [question_id, question, *scope.get("by", []), *[scope[c] for c in ("k_col", "listed") if scope.get(c)]]
    coded = encode.encode(questions.select(*dict.fromkeys(used)), question, factory, out="query_vector")
    return nearest.knn_batch(items, coded, k, query_id=question_id, **scope)


def search_or_build(
    questions: DataFrame,
    vectors: DataFrame,
    build: Callable[[], DataFrame],
    k: int = 10,
    tenant: str | None = None,
    provider: str | None = None,
) -> DataFrame:
    """Search, building the vectors first when the tenant and provider have none.

    ``build`` gives the vectors of that tenant and provider.
    """
    own = vectors.where(F.col("embedding").isNotNull())
    if tenant is not None:
        own = own.where(F.col("db_name") == tenant)
    if provider is not None:
        own = own.where(F.col("provider") == provider)
    return search_questions(questions, own if filters.any_row(own) else build(), k)
