"""Finding the changed part of two row sets by a tree of digests, before any join.

Rows of both sides are dealt into ranges of their key's hash: first by the leading part of the key, then by
the rest. A range's digest is the sum of its rows' hashes, those of the earlier side taken negative, so
it is zero where both sides hold the same rows. Sums combine before the shuffle, and a node of the tree
that sums to zero needs no look at its leaves. Only rows of changed leaves go on to be joined; the
others are known to be alike without having been moved.

There are ``2 ** (2 * BITS)`` leaves whatever the size of the tables, so the table of changed leaves is
bounded and can be broadcast. Two unlike ranges sum to zero in all four words with a chance of 2 ** -128.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a key's hash on either level of the tree: 512 nodes of 512 leaves.
BITS = 9


def leaf_of(lead: list[str], rest: list[str]) -> Column:
    """Leaf of a key: its node by the leading columns, so that changes which keep together touch few nodes."""
    part = lambda names: F.pmod(F.xxhash64(*names), F.lit(1 << BITS)).cast("int")
    return part(lead) * F.lit(1 << BITS) + part(rest)


def _changed(rows: DataFrame, by: str, side: str, words: list[Column]) -> DataFrame:
    sums = [F.sum(F.col(side) * w).alias(f"_w{i}") for i, w in enumerate(words)]
    nonzero = " OR ".join(f"_w{i} <> 0" for i in range(len(words)))
    return rows.groupBy(by).agg(*sums).where(nonzero).select(by)


def changed_leaves(rows: DataFrame, content: list[str], leaf: str = "_leaf", side: str = "_side") -> DataFrame:
    """The leaves whose rows differ between side 1 and side -1, at most ``2 ** (2 * BITS)``.

    ``content`` are the columns that make a row, nulls included. Read ``rows`` from a written table: they
    are scanned once for each level.
    """
    hashes = [F.xxhash64(*content), F.xxhash64(F.lit("digest"), *content)]
    low = lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))
    words = [w for h in hashes for w in (low(h), low(F.shiftrightunsigned(h, 32)))]
    nodes = rows.withColumn("_node", F.shiftright(leaf, BITS))
    changed = _changed(nodes, "_node", side, words)
    # Both tables have a fixed most number of rows.
    below = nodes.join(F.broadcast(changed), "_node", "left_semi")
    return _changed(below, leaf, side, words)


def split_by_change(
    rows: DataFrame, content: list[str], leaf: str = "_leaf", side: str = "_side"
) -> tuple[DataFrame, DataFrame]:
    """``(touched, alike)``: rows of changed leaves, both sides, and the rows of side 1 in all others."""
    changed = F.broadcast(changed_leaves(rows, content, leaf, side))
    return rows.join(changed, leaf, "left_semi"), rows.where(F.col(side) == 1).join(changed, leaf, "left_anti")
