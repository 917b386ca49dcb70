"""Secret scans over an incremental ledger of blobs.

Every version of a file is addressed by the SHA-256 of its content. A ledger notes for each blob
which rule versions have read it and what they found. A run reads only the (blob, rule version)
pairs that the ledger lacks, once per blob however many paths and versions hold it, and findings
are joined back to all of these. Raising a rule's version scans the known blobs for that rule only.

Everything is a column expression or a join, nothing runs outside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.llm import spans as S
from tablescout.llm.common import empty_frame, stored


class Rule(NamedTuple):
    """A kind of secret. ``gate`` is a cheap test of the text, ``keep`` tests a match."""

    kind: str
    version: int
    pattern: str
    gate: Callable[[Column], Column]
    keep: Callable[[Column], Column] | None = None

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The patterns of the contract, possessive where that changes nothing.
ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
)
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"[0-9a-f]++"


def _assigned(hit: Column) -> Column:
    return F.length(F.regexp_extract(hit, "^" + ASSIGN, 2)) >= 6


BASE_RULES = (
    Rule("assign", 1, ASSIGN, lambda t: t.rlike("(?i)passw|secret|token|api_?key"), _assigned),
    Rule("access", 1, ACCESS, lambda t: F.contains(t, F.lit("AKIA")), lambda h: F.length(h) >= 20),
    Rule("hex", 1, HEX, lambda t: t.rlike("[0-9a-f]{24}"), lambda h: F.length(h) >= 24),
)
#: Formats that issuers publish.
MORE_RULES = (
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", lambda t: F.contains(t, F.lit("PRIVATE KEY-----"))),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", lambda t: F.contains(t, F.lit("eyJ"))),
    Rule("forge_token", 1, r"gh[pousr]_[A-Za-z0-9]{36,}+", lambda t: t.rlike("gh[pousr]_")),
)
RULES = BASE_RULES + MORE_RULES

LEDGER = f"blob string, scanned array<string>, spans {S.SPAN}"


def blob_of(text: Column) -> Column:
    """Content address; a null text is the empty blob."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan(text: Column, pending: Column, rules=RULES) -> Column:
    """Sorted spans of the rules whose name is in ``pending``."""
    t = F.coalesce(text, F.lit(""))
    found = [
        F.when(
            F.array_contains(pending, r.name) & r.gate(t), S.spans(S.matches(t, r.pattern), r.kind, rank, r.keep)
        ).otherwise(S.no_spans())
        for rank, r in enumerate(rules)
    ]
    return F.array_sort(F.concat(*found))


def advance(
    versions: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", id_col: str = "doc_id", rules=RULES
) -> tuple[DataFrame, DataFrame]:
    """``(ledger, paths)`` after a run over the versions.

    The new ledger has one row per known blob: ``blob, scanned, spans``; it holds what the given one
    held, except findings of rule versions that a newer version replaces. ``paths`` is every given
    row's ``id, blob``. Findings of a blob: join the two.

    Null texts are the empty blob, equal texts are one blob, equal ids are separate paths. Empty
    tables give empty results; columns other than the two named ones are not read.
    """
    spark = versions.sparkSession
    known = empty_frame(spark, LEDGER) if ledger is None else ledger
    names = F.array(*[F.lit(r.name) for r in rules])
    text = F.col(text_col)
    paths = stored(versions.select(F.col(id_col).alias("id"), blob_of(text).alias("blob")), "secret-paths")
    # One path stands for all that hold the same blob; the null id is a path too.
    blobs = paths.groupBy("blob").agg(F.min(F.struct("id")).alias("first"))
    unseen = (
        blobs.join(known.select("blob", "scanned"), "blob", "left")
        .select(
            "blob", F.col("first.id").alias("id"),
            F.array_except(names, F.coalesce("scanned", F.array().cast("array<string>"))).alias("pending"),
        )
        .where(F.size("pending") > 0)
    )
    texts = versions.select(F.col(id_col).alias("id"), text.alias("text"), blob_of(text).alias("blob"))
    same = (texts["blob"] == unseen["blob"]) & texts["id"].eqNullSafe(unseen["id"])
    news = stored(
        texts.join(unseen.hint("shuffle_hash"), same)
        .select(unseen["blob"], "pending", scan(F.col("text"), F.col("pending"), rules).alias("found"))
        # The same path may come twice with the same text.
        .dropDuplicates(["blob"]),
        "secret-news",
    )
    current = {r.kind: r.name for r in rules}
    old = F.coalesce(F.col("spans"), S.no_spans())
    redone = F.transform(F.coalesce("pending", F.array().cast("array<string>")), lambda p: F.split(p, "@")[0])
    merged = known.join(news, "blob", "full_outer").select(
        "blob",
        F.array_sort(F.array_union(
            F.filter(
                F.coalesce("scanned", F.array().cast("array<string>")),
                lambda s: ~F.array_contains(redone, F.split(s, "@")[0]),
            ),
            F.coalesce("pending", F.array().cast("array<string>")),
        )).alias("scanned"),
        F.array_sort(F.concat(
            F.filter(old, lambda s: ~F.array_contains(redone, s["kind"])), F.coalesce("found", S.no_spans())
        )).alias("spans"),
    )
    assert len(current) == len(rules), "one version per kind"
    return merged, paths


def findings(ledger: DataFrame, paths: DataFrame) -> DataFrame:
    """``id, spans`` of every path: findings joined back to all paths of a blob."""
    found = ledger.where(F.size("spans") > 0).select("blob", "spans")
    return paths.join(found, "blob", "left").select("id", F.coalesce("spans", S.no_spans()).alias("spans"))
