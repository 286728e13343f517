"""A search index as tables on disk: postings by term, added to in segments and merged."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from loam.operators.search import BLOCK, checked_limit, cut_at, inverted, ranked, sorted_distinct, terms
from loam.session import discard, written

#: What ends a segment's writing; without it a segment is not there.
DONE = "_DONE"
#: Blocks of one segment, at most: the rest of a block's number is the segment's.
_SEGMENT_BITS = 32


def _left(lists: pa.Table, gone: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """Of the pairs of one block's lists that are not gone: the list of each, and its id."""
    ids = lists["ids"].combine_chunks()
    own, flat = np.repeat(np.arange(len(ids)), pc.list_value_length(ids).to_numpy()), ids.flatten()
    if len(gone):
        here = pc.invert(pc.is_in(flat, value_set=gone["id"].combine_chunks()))
        own, flat = own[here.to_numpy(zero_copy_only=False)], flat.filter(here)
    return own, flat


class SearchIndex:
    """An index of (id, text) rows in a folder that the cluster shares.

    A segment has postings, in buckets by the hash of their term so that a search reads those of its terms, the
    ids it holds, and, by block, the ids of earlier segments that it replaces. It counts once its last file is
    there, so a killed write leaves nothing that is read. A merged segment stands for all before it.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # ---- segments

    def _files(self):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def segments(self) -> list[tuple[int, str]]:
        """(number, folder) of the segments that count, oldest first."""
        jvm, fs = self._files()
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        found = sorted((int(n[1:]), n) for n in names if re.fullmatch(r"[am][0-9]{6}", n) and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/{DONE}")))
        merged = max((i for i, n in found if n[0] == "m"), default=0)
        return [(i, f"{self.path}/{n}") for i, n in found if i >= merged]

    def _next(self, kind: str) -> tuple[int, str]:
        jvm, fs = self._files()
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        taken = [int(s.getPath().getName()[1:]) for s in fs.listStatus(at) if re.fullmatch(r"[am][0-9]{6}", s.getPath().getName())] if fs.exists(at) else []
        number = max(taken, default=0) + 1
        return number, f"{self.path}/{kind}{number:06}"

    def _read(self, what: str) -> DataFrame | None:
        found = None
        for number, folder in self.segments():
            rows = self.spark.read.parquet(f"{folder}/{what}").withColumn("segment", F.lit(number))
            found = rows if found is None else found.unionByName(rows)
        return found

    def _write(self, kind: str, docs: DataFrame, ids: DataFrame, gone: DataFrame | None) -> None:
        """Writes a segment of (id, terms) or (id, text) rows, ``ids`` being all ids. A task writes the lists of its blocks, in a file for each bucket.

        Rows are sorted by their bucket alone, which is a number that Spark sorts without comparing rows.
        """
        number, folder = self._next(kind)
        count = ids.count()
        if count > BLOCK << (_SEGMENT_BITS - 1):
            raise ValueError("too many documents for a segment")
        blocks = max(1, -(-count // BLOCK))
        base = F.lit(number).cast("long") * F.lit(1 << _SEGMENT_BITS)
        block = F.pmod(F.xxhash64("id"), F.lit(blocks)) + base
        ids.select("id", block.alias("block")).write.parquet(f"{folder}/ids")
        made = inverted(docs.withColumn("block", block), blocks).withColumn("bucket", self._bucket())
        made.sortWithinPartitions("bucket").write.partitionBy("bucket").parquet(f"{folder}/postings")
        if gone is not None:
            gone.write.parquet(f"{folder}/gone")
        jvm, fs = self._files()
        fs.create(jvm.org.apache.hadoop.fs.Path(f"{folder}/{DONE}")).close()

    def _bucket(self):
        return F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")

    def _gone(self) -> DataFrame | None:
        """(block, id): the ids of each block that a later segment replaced."""
        found = None
        jvm, fs = self._files()
        for number, folder in self.segments():
            if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/gone")):
                rows = self.spark.read.parquet(f"{folder}/gone")
                found = rows if found is None else found.union(rows)
        return found

    def _by_block(self, found: DataFrame, gone: DataFrame | None, made, schema: StructType) -> DataFrame:
        """``made`` of each block's lists and of what is gone of it, which a task looks up once for all of its lists."""
        if gone is None:
            gone = self.spark.createDataFrame([], StructType([found.schema["block"], StructField("id", found.schema["ids"].dataType.elementType)]))
        return found.select("block", "term", "ids").groupBy("block").cogroup(gone.select("block", "id").groupBy("block")).applyInArrow(made, schema)

    def _documents(self) -> DataFrame:
        """(id, terms) of all segments without replaced ids."""
        found = self._read("postings")
        schema = StructType([StructField("id", found.schema["ids"].dataType.elementType), StructField("terms", ArrayType(found.schema["term"].dataType))])

        def of_documents(lists: pa.Table, gone: pa.Table) -> pa.Table:
            own, flat = _left(lists, gone)
            ids, place = sorted_distinct(flat)
            order = np.argsort(place, kind="stable")
            cuts = cut_at(place[order])
            terms_ = lists["term"].combine_chunks().take(pa.array(own[order]))
            return pa.table([ids, pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), terms_)], ["id", "terms"])

        return self._by_block(found, self._gone(), of_documents, schema)

    # ---- what users call

    def add(self, docs: DataFrame, id_col: str, text_col: str) -> None:
        """Adds a segment of documents; those whose id the index has are replaced. An id that repeats in ``docs`` counts once, with all its terms.

        A document without any term replaces too. Rows without an id are left out.
        """
        docs = docs.where(F.col(id_col).isNotNull())
        ids = written(docs.select(F.col(id_col).alias("id")).distinct(), "ids")
        have = self._read("ids")
        gone = None
        if have is not None:
            gone = have.join(ids, "id", "left_semi").select("block", "id")
        self._write("a", docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), ids, gone)
        discard(ids)

    def postings(self, wanted: DataFrame | None = None) -> DataFrame:
        """(term, block, ids, n) of all segments without replaced ids; only of the ``wanted`` terms if given."""
        found = self._read("postings")
        if found is None:
            raise FileNotFoundError(f"no index in {self.path}")
        if wanted is not None:
            buckets = [r[0] for r in wanted.select(self._bucket().alias("bucket")).distinct().collect()]  # at most the index's buckets
            found = found.where(F.col("bucket").isin(buckets)).join(wanted.select("term"), "term", "left_semi")
        found = found.select("term", "block", "ids", "n")
        gone = self._gone()
        if gone is None:
            return found

        def kept(lists: pa.Table, gone_: pa.Table) -> pa.Table:
            own, flat = _left(lists, gone_)
            n = np.bincount(own, minlength=len(lists))
            some = np.flatnonzero(n)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n[some])]).astype(np.int32)), flat)
            rows = lists.take(pa.array(some))
            return pa.table([rows["term"], rows["block"], ids, pa.array(n[some])], ["term", "block", "ids", "n"])

        return self._by_block(found, gone, kept, found.schema)

    def search(self, queries: DataFrame, query_col: str, text_col: str, limit: int = 10) -> DataFrame:
        """(query, id, score, rank), as :func:`loam.operators.search.search` over the documents that the index has."""
        wanted = written(terms(queries, query_col, text_col).withColumnRenamed("id", "query").distinct(), "wanted")
        index = written(self.postings(wanted.select("term").distinct()), "index")
        return ranked(index, wanted, checked_limit(limit))

    def merge(self) -> None:
        """One segment in place of all; ids that were replaced go, and the old folders are deleted once it counts."""
        old = self.segments()
        ids = written(self._read("ids").select("id").distinct(), "ids")
        self._write("m", self._documents(), ids, None)
        jvm, fs = self._files()
        for _, folder in old:
            fs.delete(jvm.org.apache.hadoop.fs.Path(folder), True)
        discard(ids)
