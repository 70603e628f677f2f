"""Which rows may have a key that another table has, told without moving them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots, in bits, of the table that tells which keys may be known; results do not depend on it.
SLOT_BITS = 27


def marked(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """`rows` with `_met`: false where `key` is in no row of `known` for sure, true for all others.

    Keys are hashed to slots; the table of slots is broadcast and has at most `2^SLOT_BITS / 64` rows, however
    many keys are known. The fuller it is, the more rows are met for nothing; an exact join follows for those.
    """
    slot = F.xxhash64(key).bitwiseAND(F.lit((1 << SLOT_BITS) - 1))
    word, bit = F.shiftright(slot, 6), slot.bitwiseAND(F.lit(63)).cast("int")
    one = known.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("one"))
    words = one.groupBy("_word").agg(F.bit_or("one").alias("_bits"))
    return rows.withColumn("_word", word).join(F.broadcast(words), "_word", "left").select(
        *rows.columns, (F.coalesce(F.getbit("_bits", bit), F.lit(0)) == 1).alias("_met")
    )
