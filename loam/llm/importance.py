"""Importance resampling towards a target: hashed n-gram counts of both, log-ratio weights, and a Gumbel draw."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from loam.operators.ordinals import numbered
from loam.session import small_batches, written

#: Bytes of UTF-8 to what words are split from: A-Z become a-z, and ASCII that is neither a letter nor a digit a space.
_WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
_NEW = ("n_words", "n_features", "weight", "score", "rank")


def _features(data: bytes, most: int) -> tuple[int, list[int]]:
    """How many words a text has, and the CRC-32 of each run of 1 to ``most`` consecutive words joined by a space.

    A run's checksum goes on from that of the run without its last word, so no run is put together.
    """
    words = data.translate(_WORD_BYTES).split()
    seeds = [zlib.crc32(w) for w in words]
    found = list(seeds)
    for n in range(1, most):
        seeds = [zlib.crc32(w, zlib.crc32(b" ", seed)) for seed, w in zip(seeds, words[n:])]
        found += seeds
    return len(words), found


def _bytes_of(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")


def bucket_counts(docs: DataFrame, text_col: str = "text", n: int = 2, buckets: int = 10_000) -> DataFrame:
    """(bucket, features): how many n-grams of all texts fall into each bucket that has any.

    Each task counts its own texts, so a bucket is shuffled once for each task, whatever its share.
    Null and empty texts have no features; an empty table has no buckets.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for batch in batches:
            for data in batch.column(0):
                total.update(crc % buckets for crc in _features(data.as_py(), n)[1])
        yield pa.RecordBatch.from_pydict({"bucket": list(total.keys()), "features": list(total.values())}, pa.schema([("bucket", pa.int64()), ("features", pa.int64())]))

    parts = docs.select(_bytes_of(text_col).alias("data")).mapInArrow(count, "bucket long, features long")
    return parts.groupBy("bucket").agg(F.sum("features").alias("features"))


def gains(source: Iterable[tuple[int, int]], target: Iterable[tuple[int, int]], buckets: int) -> list[int]:
    """Of each bucket, a thousand times the log of its share in the target over that in the source, rounded down; one is added to all counts."""
    s, t = dict(source), dict(target)
    all_s, all_t = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)
    return [math.floor(1000 * math.log(float(t.get(b, 0) + 1) * all_s / (float(s.get(b, 0) + 1) * all_t))) for b in range(buckets)]


def _noise(seed: int, key: str) -> int:
    """A Gumbel variate in thousandths, from a hash of the key."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    n: int = 2,
    buckets: int = 10_000,
    percent: int = 25,
    min_words: int = 20,
    seed: int = 7,
    carry: tuple[str, ...] | None = None,
) -> DataFrame:
    """Every row of ``docs`` with (n_words, n_features, weight, score, rank): a draw of ``percent`` towards ``target``.

    Features are all runs of 1 to ``n`` words of the whole text, hashed into ``buckets``. A document's
    weight is the mean of its features' gains, see :func:`gains`, rounded down, its score the weight
    and a Gumbel variate of its id, so that the highest scores are a draw without replacement in
    proportion to the weights' exponentials. Of the rows with ``min_words`` words or more the highest are drawn: ``rank`` counts
    them from 1, and is null for all others.

    Texts are read twice: once for the counts, which come to the driver as ``buckets`` sums at
    most, and once for the weights. Ranks come from sorted ranges, see
    :func:`loam.operators.ordinals.numbered`. ``carry`` names the columns of ``docs`` that go along, all by
    default; those that are named as a result is are left out.

    Null and empty texts, and those without words, have no features, weight 0 and a score. Very long texts
    are read whole. Equal scores go by the smaller id, null ids last, then by the larger weight and number
    of features; rows that repeat all of these are each a row and may be drawn in either order. A null id is hashed
    as an empty text. An empty table stays empty; an empty target makes all its counts one.
    """
    small_batches(docs.sparkSession)
    if carry is None:
        carry = tuple(c for c in docs.columns if c.lower() not in _NEW)
    kept = [docs.schema[c] for c in carry]
    counted = [list(map(tuple, bucket_counts(rows, column, n, buckets).collect())) for rows, column in ((docs, text_col), (target, target_col))]  # bounded by buckets
    gain = docs.sparkSession.sparkContext.broadcast(gains(*counted, buckets))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = gain.value
        for batch in batches:
            columns: list[list[int]] = [[], [], [], []]
            for data, key in zip(batch.column(0), batch.column(1)):
                words, found = _features(data.as_py(), n)
                weight = sum(own[crc % buckets] for crc in found) // max(1, len(found))
                for column, x in zip(columns, (words, len(found), weight, weight + _noise(seed, key.as_py()))):
                    column.append(x)
            arrays = [*batch.columns[2:], *[pa.array(c, pa.int64()) for c in columns]]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[2:], *_NEW[:4]])

    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    passed = docs.select(_bytes_of(text_col).alias("data_"), key.alias("key_"), *[F.col(c) for c in carry], *([] if id_col in carry else [F.col(id_col)]))
    schema = StructType([*kept, *([] if id_col in carry else [docs.schema[id_col]]), *[StructField(c, LongType()) for c in _NEW[:4]]])
    weighed = written(passed.mapInArrow(weigh, schema), "weights")
    enough = weighed.where(F.col("n_words") >= min_words)
    drawn = percent * enough.count() // 100
    order = [F.desc("score"), F.asc_nulls_last(id_col), F.desc("weight"), F.desc("n_features")]
    ranked = numbered(enough, order, "rank", "ranks").withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1))
    rest = weighed.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.union(rest).select(*carry, *_NEW)
