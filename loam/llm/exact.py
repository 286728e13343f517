"""Exact dedup by progressive refinement, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loam.llm.common import Bitmap, ascii_lower, bitmap_of, fresh, probed, text_or_empty
from loam.session import written


def _keys(text: Column, prefix_chars: int) -> tuple[Column, Column]:
    """What the first two refinements group by: bytes of the text, and a hash of its first characters."""
    return F.octet_length(text), F.xxhash64(ascii_lower(F.substring(text, 1, prefix_chars)))


def survivors(docs: DataFrame, text_col: str = "text", prefix_chars: int = 256) -> Bitmap | None:
    """The set of rows that share both length and prefix with another row; None if it is too large to broadcast."""
    text = text_or_empty(text_col)
    length, prefix = _keys(text, prefix_chars)
    by_length = docs.groupBy(length.alias("length")).count().where("count > 1")
    same_length = probed(docs.select(text.alias("text")), bitmap_of(by_length.select("length")), "candidate", F.octet_length("text"))
    length, prefix = _keys(F.col("text"), prefix_chars)
    keyed = same_length.where("candidate").select(length.alias("length"), prefix.alias("prefix"))
    by_prefix = keyed.groupBy("length", "prefix").count().where("count > 1")
    return bitmap_of(by_prefix.select("length", "prefix"))


def refined_hashes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256, digest_all: bool = False
) -> DataFrame:
    """(id, length, prefix, candidate, digest) of every row, as a written table.

    Rows are grouped by byte length, rows of shared lengths by a hash of their first characters,
    and only rows that still share both get a SHA-256 of the whole normalised text. Survivors
    reach the next scan as a bitmap sized by their number, so nothing but counts is shuffled; a slot
    shared by chance costs one needless hash and changes no result, and where survivors are too
    many to broadcast, every row is hashed. ``digest_all`` hashes the other rows too, for callers
    that report digests.
    """
    bitmap = survivors(docs, text_col, prefix_chars)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    length, prefix = _keys(F.col("text"), prefix_chars)
    found = probed(rows.withColumns({"length": length, "prefix": prefix}), bitmap, "candidate", F.col("length"), F.col("prefix"))
    digest = F.sha2(ascii_lower(F.col("text")), 256)
    if not digest_all:
        digest = F.when(F.col("candidate"), digest)
    hashed = found.select("id", "length", "prefix", "candidate", digest.alias("digest"))
    return written(hashed, "exact")


def duplicate_groups(hashed: DataFrame) -> DataFrame:
    """(digest, keep, size) of the texts that more than one row has; ``keep`` is the largest id."""
    return (
        hashed.where("candidate")
        .groupBy("digest", "length", "prefix")
        .agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("size"))
        .where("size > 1")
        .select("digest", "keep", "size")
    )


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256, digest_all: bool = False
) -> DataFrame:
    """One decision per row: (id_col, keep_id, group_size, kept, digest).

    Texts are equal when identical after lower-casing A-Z; a null text is empty. The row with the
    largest id stays. Rows that repeat both id and text are one document: all of them are counted
    in ``group_size`` and carry the same ``kept``. A null id is smaller than any other. Texts of any
    length are hashed whole. An empty table gives an empty result; columns other than the two
    named are ignored.

    Groups are counted with map-side sums, and joined back on the digest alone, so that a group
    of any size is dealt over many tasks as a skewed join.
    """
    hashed = refined_hashes(docs, id_col, text_col, prefix_chars, digest_all)
    groups = duplicate_groups(hashed)
    return hashed.join(groups, "digest", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("keep", "id").alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("size").isNull() | F.col("id").eqNullSafe(F.col("keep"))).alias("kept"),
        "digest",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256) -> DataFrame:
    """``docs`` with one row of each text, in the columns of ``docs``.

    Rows as in :func:`exact_dedup`; of rows that repeat both id and text, one stays. Texts whose length
    or prefix nobody shares pass straight through; only the others meet their groups in a join.
    """
    candidate, digest, id_, n = fresh(docs, "candidate", "digest", "id_of_group", "n")
    text = text_or_empty(text_col)
    found = probed(docs, survivors(docs, text_col, prefix_chars), candidate, *_keys(text, prefix_chars))
    alone = found.where(~F.col(candidate)).select(*docs.columns)
    shared = found.where(candidate).withColumn(digest, F.sha2(ascii_lower(text), 256))
    counts = shared.groupBy(digest, F.col(id_col).alias(id_)).agg(F.count(F.lit(1)).alias(n))
    last = F.max(F.struct(id_, n)).alias("last")
    groups = written(counts.groupBy(digest).agg(last).select(digest, "last.*"), "groups")
    stays = shared.join(groups, digest).where(F.col(id_col).eqNullSafe(F.col(id_)))
    if groups.where(F.col(n) > 1).limit(1).count():
        stays = stays.dropDuplicates([digest])
    return alone.union(stays.select(*docs.columns))
