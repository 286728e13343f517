"""Numbers of rows in a total order, without a task that has all rows or all rows of one key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from loam.session import written

#: What ``monotonically_increasing_id`` gives is the partition, and in these bits the place in it.
_PLACE_BITS = 33


def _placed(rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``rows``, written, in ranges of ``order``, with their range ``range_`` and their place ``place_`` in it."""
    at = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at_", at)
    place = F.col("at_").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return written(ranged, name).withColumns({"range_": F.shiftright("at_", _PLACE_BITS), "place_": place}).drop("at_")


def numbered(rows: DataFrame, order: Sequence[Column], into: str = "nth", name: str = "numbered") -> DataFrame:
    """``rows`` with a number ``into``, from 0 on, for each row's place in ``order``; rows are written in that order.

    Rows go to ranges of the order, each range is sorted and counted, and the counts before a range, one
    row for each range, are added to the places in it. Where the order tells all rows apart, ranges
    split any key. Rows that the order doesn't tell apart get numbers in any order, which stay
    as they are, since the table is written. An empty table stays empty.
    """
    placed = _placed(rows, order, name)
    counts = placed.groupBy("range_").agg(F.count(F.lit(1)).alias("n_"))
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = counts.select("range_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    return placed.join(F.broadcast(starts), "range_").withColumn(into, F.col("start_") + F.col("place_")).drop("range_", "place_", "start_")


def numbered_within(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], into: str = "nth", name: str = "numbered") -> DataFrame:
    """``rows`` with a number ``into``, from 0 on, for each row's place among the rows of its keys, of which none is null.

    As :func:`numbered`, but a key's numbers begin with its first row. A key may have any number of
    ranges; counts of (range, key) tell each range where the key's numbers begin there, so no
    task needs all rows of a key.
    """
    placed = _placed(rows, [*[F.col(k) for k in keys], *order], name)
    parts = placed.groupBy("range_", *keys).agg(F.count(F.lit(1)).alias("n_"), F.min("place_").alias("first_"))
    before = Window.partitionBy(*keys).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a key
    starts = parts.select("range_", *keys, (F.coalesce(F.sum("n_").over(before), F.lit(0)) - F.col("first_")).alias("start_"))
    found = placed.join(starts, ["range_", *keys]).withColumn(into, F.col("start_") + F.col("place_"))
    return found.select(*rows.columns, into)
