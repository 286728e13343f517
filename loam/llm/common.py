"""Column expressions that several operators share."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from loam.session import discard, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character as it is.

    ``lower`` agrees with that on pure ASCII, where it is a byte loop; other texts take ``translate``.
    """
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


#: A bitmap's slots for each key, the slots of one of its rows (4 KB), and the most slots that are broadcast (64 MB).
PER_KEY, ROW_SLOTS, MOST_SLOTS = 16, 1 << 15, 1 << 29


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that no column of ``df`` has, in either case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


@dataclass(frozen=True)
class Bitmap:
    """A set of keys as the slots that they hash to: rows of (bucket, bits)."""

    rows: DataFrame
    slots: int


def _slot(slots: int, *keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots)) + 1


def bitmap_of(keys: DataFrame, most_slots: int = MOST_SLOTS) -> Bitmap | None:
    """The set of all rows of ``keys``, sized by their number, so that about a sixteenth of other keys are taken for members.

    Where that would be more than ``most_slots``, the bitmap is as large as is allowed down to four slots
    a key, and beyond that there is none: see :func:`probed`.
    """
    keys = written(keys, "keys")
    n = keys.count()
    if 4 * n > most_slots:
        return None
    slots = min(most_slots, max(ROW_SLOTS, 1 << (PER_KEY * max(1, n) - 1).bit_length()))
    found = keys.select(_slot(slots, *[F.col(c) for c in keys.columns]).alias("slot"))
    found = found.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    bitmap = Bitmap(written(found, "bitmap"), slots)
    discard(keys)
    return bitmap


def probed(rows: DataFrame, bitmap: Bitmap | None, into: str, *keys: Column) -> DataFrame:
    """``rows`` with a flag ``into``: whether the keys may be in the set, as all of its keys are.

    The bitmap, of 64 MB at most, is broadcast. Without one, the set being too large for it, every row may
    be a member, and it is left to the join that follows.
    """
    if bitmap is None:
        return rows.withColumn(into, F.lit(True))
    bucket, bits = fresh(rows, "bucket", "bits")
    slot = _slot(bitmap.slots, *keys)
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(F.col(bits), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    own = bitmap.rows.select(F.col("bucket").alias(bucket), F.col("bits").alias(bits))
    joined = rows.withColumn(bucket, F.bitmap_bucket_number(slot)).join(F.broadcast(own), bucket, "left")
    hit = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return joined.withColumn(into, hit).drop(bucket, bits)
