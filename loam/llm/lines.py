"""Line dedup by range-partitioned hashes, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loam.llm.common import ascii_lower, bitmap_of, probed, text_or_empty
from loam.session import discard, written

#: White space that is stripped from both ends of a line.
BLANK = " \t\n\x0b\x0c\r"
#: Lines that share a bitmap word.
WORD_BITS = 63


def _hashed_lines(text: Column, min_chars: int) -> Column:
    """array<struct<pos, h1, h2>> of the lines whose key is long enough; 96 bits tell keys apart."""
    keys = F.transform(F.split(text, "\n", -1), lambda line: ascii_lower(F.trim(line, F.lit(BLANK))))
    hashed = F.transform(
        keys,
        lambda key, i: F.struct(
            i.cast("int").alias("pos"),
            F.when(F.length(key) >= min_chars, F.xxhash64(key)).alias("h1"),
            F.hash(key).alias("h2"),
        ),
    )
    return F.filter(hashed, lambda line: line["h1"].isNotNull())


def _uid(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), text_or_empty(text_col)).alias("uid")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, salts: int = 32) -> DataFrame:
    """(h1, h2, keep, pos): line keys that at least ``min_docs`` rows hold, and the first occurrence of each.

    First is the largest id, and in it the first position. Each document gives a key once, with its
    first position. Keys are first counted by salt, so that a line that a third of all documents
    hold shrinks to one row per salt; the partial rows are then range-partitioned by hash, with
    document and position as the secondary sort, and each range is streamed: the first row of a
    key is its surviving occurrence.
    """
    lines = F.transform(_hashed_lines(text_or_empty(text_col), min_chars), lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["pos"].alias("pos")))
    ordered = docs.select(F.col(id_col).alias("id"), F.array_sort(lines).alias("lines"))

    def first_of_key(x: Column, i: Column) -> Column:
        before = F.get("lines", i - 1)
        return (i == 0) | (before["h1"] != x["h1"]) | (before["h2"] != x["h2"])

    held = ordered.select("id", F.explode(F.filter("lines", first_of_key)).alias("line")).select("id", "line.*")
    partial = held.groupBy("h1", "h2", F.pmod(F.hash("id"), F.lit(salts)).alias("salt")).agg(
        F.max("id").alias("id"), F.max_by("pos", "id").alias("pos"), F.count(F.lit(1)).alias("docs")
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key, order = Window.partitionBy("h1", "h2"), [F.desc("id"), F.asc("pos")]
    ranged = partial.repartitionByRange(parts, "h1", "h2").sortWithinPartitions("h1", "h2", *order)
    return (
        ranged.withColumn("nth", F.row_number().over(key.orderBy(*order)))
        .withColumn("docs", F.sum("docs").over(key))
        .where((F.col("nth") == 1) & (F.col("docs") >= min_docs))
        .select("h1", "h2", F.col("id").alias("keep"), "pos")
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(id_col, uid, kept): which lines stay in each document that loses any, as a compressed bitmap; a written table.

    A text is cut at \\n. A line's key is the line without white space at both ends, A-Z in lower
    case. Keys of at least ``min_chars`` characters that at least ``min_docs`` documents hold lose
    all their lines but those in the largest id that holds them. Keys are equal by 96 bits of hash, and their
    texts are not compared.

    ``kept`` is array<struct<word int, bits bigint>>: bit ``i`` of word ``w`` says that line
    ``63 * w + i`` stays. Words all of whose lines stay are left out, and so are documents that
    lose nothing. Line numbers count from 0. A null text is one empty line; texts of any length
    count whole. Rows that repeat an id count as documents of their own: ``uid``, a hash of id and
    text, tells their bitmaps apart. A null id is smaller than any other. An empty table gives no
    bitmaps, and columns other than the two named are ignored.
    """
    first = written(repeated_lines(docs, id_col, text_col, min_chars, min_docs), "lines")
    lines = docs.select(
        F.col(id_col).alias("id"), _uid(id_col, text_col), F.explode(_hashed_lines(text_or_empty(text_col), min_chars)).alias("line")
    ).select("id", "uid", "line.*")
    lost = lines.join(first.select("h1", "h2", "keep"), ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("keep")))
    words = lost.groupBy("id", "uid", F.floor(F.col("pos") / WORD_BITS).cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, pos % {WORD_BITS})")).alias("gone")
    )
    word = F.struct("word", F.bitwise_not("gone").bitwiseAND(F.lit((1 << WORD_BITS) - 1)).alias("bits"))
    found = words.groupBy("id", "uid").agg(F.array_sort(F.collect_list(word)).alias("kept"))
    made = written(found.select(F.col("id").alias(id_col), "uid", "kept"), "bitmaps")
    discard(first)
    return made


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_lines, n_dropped, kept_text): the texts with the lines that ``bitmaps`` keeps.

    Only texts that may lose a line are shuffled to their bitmaps; the others pass in place. Nulls,
    repeats and empty tables are as in :func:`line_dedup`.
    """
    texts = docs.select(F.col(id_col).alias("id"), _uid(id_col, text_col), text_or_empty(text_col).alias("text"))
    marked = probed(texts, bitmap_of(bitmaps.select("uid")), "loses", F.col("uid"))
    marks = bitmaps.select(F.col(id_col).alias("mark_id"), F.col("uid").alias("mark_uid"), F.map_from_entries("kept").alias("kept"))
    met = marked.where("loses").join(marks, F.col("id").eqNullSafe(F.col("mark_id")) & (F.col("uid") == F.col("mark_uid")), "left")

    def stays(i: Column) -> Column:
        bits = F.try_element_at("kept", F.floor(i / WORD_BITS).cast("int"))
        return F.coalesce(F.getbit(bits, (i % WORD_BITS).cast("int")) == 1, F.lit(True))

    met = met.select("id", "text", F.split("text", "\n", -1).alias("lines"), "kept")
    met = met.select("id", "text", "lines", F.when(F.col("kept").isNotNull(), F.filter("lines", lambda line, i: stays(i))).alias("kept"))
    n_lines = lambda text: (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    whole = marked.where("NOT loses").select("id", n_lines(F.col("text")).alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.col("text").alias("kept_text"))
    cut = met.select(
        "id",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.coalesce("kept", "lines"))).cast("long").alias("n_dropped"),
        F.coalesce(F.array_join("kept", "\n"), "text").alias("kept_text"),
    )
    return whole.union(cut).withColumnRenamed("id", id_col)
