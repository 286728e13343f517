"""Best-fit packing of documents into bins, with conflicts."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from loam.llm.common import ascii_lower, n_words, text_or_empty

SCHEMA = "id long, part int, start long, size long, shard int, bin long, slot int"


class Bins:
    """Open bins in order of what is left in them.

    A bin carries a bitmap of duplicate clusters and, for each of ``per_source`` planes, a bitmap of
    sources: plane i has a source's bit if the bin holds more than i of its documents.
    """

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.open: list[tuple[int, int]] = []  # (left, bin), ascending
        self.clusters: list[int] = []
        self.planes: list[list[int]] = []
        self.filled: list[int] = []

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, slot) of the tightest bin that has room and no conflict, or of a new one."""
        at = bisect_left(self.open, (size, -1))
        while at < len(self.open):
            left, b = self.open[at]
            if not (self.clusters[b] & cluster or self.planes[b][-1] & source):
                del self.open[at]
                break
            at += 1
        else:
            left, b = self.capacity, len(self.filled)
            self.clusters.append(0)
            self.planes.append([0] * self.per_source)
            self.filled.append(0)
        self.clusters[b] |= cluster
        carry = source
        for i, plane in enumerate(self.planes[b]):
            self.planes[b][i], carry = plane | carry, plane & carry
            if not carry:
                break
        if left > size:
            insort(self.open, (left - size, b))
        slot = self.filled[b]
        self.filled[b] += 1
        return b, slot


def pack_shard(rows: pd.DataFrame, capacity: int, per_source: int) -> pd.DataFrame:
    """Parts of one shard's documents with their bins; largest first, ties by id."""
    source_bit = {s: 1 << i for i, s in enumerate(pd.unique(rows["source"]))}
    shared = rows["cluster"].value_counts()
    cluster_bit = {c: 1 << i for i, c in enumerate(shared.index[shared > 1])}
    bins = Bins(capacity, per_source)
    out: list[tuple[int | None, int, int, int, int, int]] = []
    rest = []
    for id_, size, source, cluster in rows[["id", "size", "source", "cluster"]].itertuples(index=False):
        id_ = None if pd.isna(id_) else int(id_)
        source, cluster = source_bit[source], cluster_bit.get(cluster, 0)
        whole, last = divmod(size, capacity)
        for part in range(whole):
            b, slot = bins.place(capacity, source, cluster)
            out.append((id_, part, part * capacity, capacity, b, slot))
        if last or not whole:
            rest.append((-last, id_ is None, id_ or 0, whole, source, cluster))
    for last, null, id_, part, source, cluster in sorted(rest):
        b, slot = bins.place(-last, source, cluster)
        out.append((None if null else id_, part, part * capacity, -last, b, slot))
    packed = pd.DataFrame(out, columns=["id", "part", "start", "size", "bin", "slot"])
    packed["id"] = packed["id"].astype("Int64")
    packed["shard"] = np.int32(rows["shard"].iloc[0])
    return packed[["id", "part", "start", "size", "shard", "bin", "slot"]]


def pack(
    docs: DataFrame,
    capacity: int = 4096,
    per_source: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cluster_col: str | None = None,
    shard_docs: int = 8192,
) -> DataFrame:
    """(id_col, part, start, size, bin_id, slot): where each document goes in bins of ``capacity`` words.

    A bin holds no two documents of one duplicate cluster (``cluster_col``; without one, documents
    of the same text apart from the case of A-Z) and at most ``per_source`` of one source. Of the
    bins that have room, a document takes the fullest without a conflict, and opens a new one if
    there is none. Documents longer than a bin are cut into parts of full bins and a rest, so
    that every word is packed; ``start`` is a part's first word.

    Documents are dealt to shards of about ``shard_docs`` by a hash, and a shard is packed in one
    task from (id, size, source, cluster) alone, so memory and time of a task don't grow with the
    input; what sharding costs is the part-filled bins of each shard.

    A null or blank text has size 0 and still gets a place. Null sources are one source, null
    clusters are no cluster, null ids are packed after others of their size. Rows that repeat an
    id are packed each, and conflict. An empty table gives an empty result.
    """
    text = text_or_empty(text_col)
    own = F.col(cluster_col) if cluster_col else ascii_lower(text)
    sized = docs.select(
        F.col(id_col).cast("long").alias("id"),
        n_words(text).alias("size"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("")).alias("source"),
        F.when(own.isNotNull(), F.hex(F.xxhash64(own))).alias("cluster"),
    )
    shards = -(-docs.select(F.count(F.lit(1)).alias("n")).first()["n"] // shard_docs) or 1
    dealt = sized.withColumn("shard", F.pmod(F.xxhash64("id", "size", "cluster"), F.lit(shards)).cast("int"))
    packed = dealt.groupBy("shard").applyInPandas(lambda rows: pack_shard(rows, capacity, per_source), SCHEMA)
    return packed.select(
        F.col("id").alias(id_col),
        "part",
        "start",
        "size",
        (F.col("shard").cast("long") * (1 << 32) + F.col("bin")).alias("bin_id"),
        "slot",
    )
