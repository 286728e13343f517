"""Mixing sources to target weights by nested hash histograms, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from loam.llm.common import fresh, n_words, text_or_empty
from loam.session import written

#: Bits of a document's hash: 15 hex digits.
HASH_BITS = 60


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, total, target) from (source, size): the water level over the sources.

    Sources in code-point order, null last, take ``weights`` in turn and share ``share`` of all
    sizes. A target stops at ``cap`` times its source's size and the excess goes to the others by
    weight. The level is found from running sums over one row per source.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("total"))
    ranked = per_source.withColumn("turn", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    chosen = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") % len(weights) + 1).cast("int"))
    filled = ranked.withColumn("weight", chosen).withColumn("most", F.col("total") * F.lit(float(cap)))
    filled = filled.withColumn("full_at", F.col("most") / F.col("weight"))
    order = Window.orderBy("full_at", "turn")
    everything = Window.partitionBy()
    filled = (
        filled.withColumn("before", F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weights_on", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.sum("total").over(everything) * F.lit(float(share)) - F.col("before")) / F.col("weights_on"))
    )
    first = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "turn", "level"))).over(everything)
    level = F.coalesce(first.getField("level"), F.lit(float("inf")))
    return filled.withColumn("water", level).select(
        "source", "total", F.least(F.col("most"), F.col("water") * F.col("weight")).alias("target")
    )


def _hash(id_col: str) -> Column:
    """60 bits of an id's MD5; a null id hashes as an empty text."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _copies(h: Column, copies: Column, edge: Column, shift: Column, nearer: Column) -> Column:
    """How often a document is taken: the source's whole copies, and once more below its threshold."""
    place = F.call_function("shiftright", h, shift)
    return copies + ((place < edge) | ((place == edge) & nearer)).cast("long")


def _sizes(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(id, size, h, unnamed, name), written: all that the histograms need."""
    return written(
        docs.select(
            F.col(id_col).alias("id"),
            n_words(text_or_empty(text_col)).alias("size"),
            _hash(id_col).alias("h"),
            F.col(source_col).isNull().alias("unnamed"),
            F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("name"),
        ),
        "sizes",
    )


def _thresholds(sizes: DataFrame, weights: Sequence[float], share: float, cap: float, bits: int) -> DataFrame:
    """One written row per source: (unnamed, name, total, target, copies, edge, shift, nearer)."""
    key = ["unnamed", "name"]
    plan = written(
        targets(sizes.select(F.when(~F.col("unnamed"), F.col("name")).alias("source"), "size"), weights, share, cap)
        .withColumn("copies", F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(F.lit(0)).cast("long"))
        .select(
            F.col("source").isNull().alias("unnamed"),
            F.coalesce("source", F.lit("")).alias("name"),
            "total",
            "target",
            "copies",
            (F.col("target") - F.col("copies") * F.col("total")).alias("left"),
        ),
        "targets",
    )
    cut = plan.select(*key, F.lit(0).cast("long").alias("edge"), "left", F.lit(True).alias("open"))
    shift = HASH_BITS
    while shift > 0:
        step = min(bits, shift)
        inside = sizes.join(cut.where("open").select(*key, "edge"), key).where(F.shiftright("h", shift) == F.col("edge"))
        shift -= step
        buckets = inside.groupBy(*key, F.shiftright("h", shift).alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("h").alias("low"), F.max("h").alias("high")
        )
        upto = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = buckets.withColumn("upto", F.sum("words").over(upto)).join(cut.select(*key, "left"), key)
        boundary = summed.where(F.col("upto") > F.col("left")).groupBy(*key).agg(
            F.min(F.struct("bucket", (F.col("left") - F.col("upto") + F.col("words")).alias("left"), "words", "low", "high")).alias("b")
        )
        finer = cut.where("open").select(*key).join(boundary, key, "left").select(
            *key,
            F.coalesce("b.bucket", F.lit(1 << HASH_BITS)).alias("edge"),  # no boundary: the budget covers all
            F.coalesce("b.left", F.lit(0.0)).alias("left"),
            F.coalesce(F.col("b.left") * 2 >= F.col("b.words"), F.lit(False)).alias("nearer"),
            F.coalesce(F.col("b.low") < F.col("b.high"), F.lit(False)).alias("open"),
            F.lit(shift).alias("shift"),
        )
        cut = written(finer.unionByName(cut.where("not open")) if "nearer" in cut.columns else finer, "cut")
        if not cut.where("open").limit(1).count():
            break
    return written(plan.drop("left").join(cut.select(*key, "edge", "shift", "nearer"), key), "thresholds")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    bits: int = 10,
) -> DataFrame:
    """How often the mix takes each document: (id_col, size, source_size, target, copies, taken).

    A document's size is its number of words (null text: 0). Of each source, every document is
    taken ``floor(target / source_size)`` times, and those below a threshold of their id's hash
    once more. Thresholds come from histograms: sizes are summed by source and hash bucket, and
    only the bucket in which the budget runs out is cut into finer ones, ``bits`` at a time, until
    it holds one document; that one is taken if this brings the sum nearer. Nothing is sorted,
    and the result depends on the ids alone, so reruns agree.

    A null source is a source of its own and comes last; a null id hashes as an empty text; rows
    that repeat an id are taken or left together. Texts of any length are counted whole. Sources
    without words have target 0. An empty table gives an empty result, and columns other than
    the three named are ignored.
    """
    sizes = _sizes(docs, id_col, source_col, text_col)
    plan = _thresholds(sizes, weights, share, cap, bits)
    copies = _copies(*[F.col(c) for c in ("h", "copies", "edge", "shift", "nearer")])
    return sizes.join(plan, ["unnamed", "name"]).select(
        F.col("id").alias(id_col),
        "size",
        F.col("total").alias("source_size"),
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    bits: int = 10,
) -> DataFrame:
    """``docs`` as the mix takes them, in the columns of ``docs``: each row as often as ``copies`` says.

    Cases as in :func:`mix`. Texts meet one row per source, by a broadcast where the measured size
    of that table allows it.
    """
    plan = _thresholds(_sizes(docs, id_col, source_col, text_col), weights, share, cap, bits)
    own = dict(zip([*plan.columns, "h", "taken", "copy"], fresh(docs, *plan.columns, "h", "taken", "copy")))
    plan = plan.select(*[F.col(c).alias(own[c]) for c in plan.columns])
    name = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    named = docs.withColumns({own["h"]: _hash(id_col), own["unnamed"]: F.col(source_col).isNull(), own["name"]: name})
    copies = _copies(*[F.col(own[c]) for c in ("h", "copies", "edge", "shift", "nearer")])
    taken = named.join(plan, [own["unnamed"], own["name"]]).withColumn(own["taken"], copies).where(F.col(own["taken"]) > 0)
    return taken.withColumn(own["copy"], F.explode(F.sequence(F.lit(1).cast("long"), F.col(own["taken"])))).select(*docs.columns)
