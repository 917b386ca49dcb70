"""Broadcasting behind a measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keys of up to this many bytes are broadcast; more are joined by shuffling.
BROADCAST_BYTES = 10 * 1024 * 1024
# Bits of a bitmap of hashes: for each key, and at most in all (16 MB).
KEY_BITS, MOST_BITS = 64, 1 << 27
# A page of it, as ``bitmap_construct_agg`` makes them, has two to the power of so many bits.
_PAGE = 15


def measured_bytes(keys: DataFrame) -> int:
    """Bytes of the values, with eight for each field as in Spark's rows."""
    parts = [
        F.coalesce(F.octet_length(f.name), F.lit(0)) if isinstance(f.dataType, T.StringType) else F.lit(0)
        for f in keys.schema.fields
    ]
    row = sum(parts, F.lit(8 * len(parts)))
    return keys.agg(F.sum(row.cast("long")).alias("b")).first()["b"] or 0


def broadcast_if_small(keys: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``keys`` (already written) with a broadcast hint when they are measured to be small.

    Without the hint Spark plans the join by itself.
    """
    return F.broadcast(keys) if measured_bytes(keys) <= limit else keys


def likely_among(rows: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """The rows whose ``by`` is in ``keys``, and a few others; no row is shuffled.

    A bitmap of the keys' hashes is broadcast, whose size is bounded whatever their number. One other row in
    64 passes, more from two million keys on, so join with the keys afterwards. Both frames need the same types.
    """
    bits = min(MOST_BITS, 1 << max(_PAGE, (KEY_BITS * keys.count()).bit_length()))
    slot = F.pmod(F.xxhash64(*by), F.lit(bits))
    spot = slot.bitwiseAND(F.lit((1 << _PAGE) - 1))
    pages = keys.groupBy(F.shiftright(slot, _PAGE).alias("_page")).agg(F.bitmap_construct_agg(spot).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(spot, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (spot % 8 + 1).cast("int"))) > 0
    return rows.join(F.broadcast(pages), (F.shiftright(slot, _PAGE) == F.col("_page")) & hit, "left_semi")
