"""Full-text postings and ranked search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from loam.functions.text import narrow_breaks, tokens
from loam.session import small_batches, written


def terms(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term) pairs, each once."""
    return docs.select(F.col(id_col).alias("id"), F.explode(tokens(F.col(text_col))).alias("term"))


def term_frequencies(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def postings(pairs: DataFrame, block: Column | None = None, blocks: int = 1) -> DataFrame:
    """(term, block, ids): the sorted ids that hold each term, in blocks of bounded size.

    A block is a range of ids (``block``, say id div 4096) or, for ids that aren't numbers, one of
    ``blocks`` hash buckets, so that a term that every document holds is no single list.
    """
    at = F.pmod(F.xxhash64("id"), F.lit(blocks)) if block is None else block
    return pairs.groupBy("term", at.alias("block")).agg(F.array_sort(F.collect_list("id")).alias("ids"))


#: Documents of a block, about.
BLOCK = 1024


def indexed(pairs: DataFrame, documents: int) -> DataFrame:
    """(term, block, ids, n) of (id, term) pairs: postings in hash blocks of about 1024 of ``documents``; repeats count once."""
    block = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-documents // BLOCK))))
    found = pairs.groupBy("term", block.alias("block")).agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return found.withColumn("n", F.size("ids").cast("long"))


#: Blocks of a task that inverts documents, at least and at most, and pairs that it holds before repeats are left out.
_BLOCKS_PER_TASK, _HELD = (4, 32), 4_000_000


def sorted_distinct(ids: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The different ids in their order, and the place of each of ``ids`` among them."""
    known = ids.dictionary_encode()
    order = pc.array_sort_indices(known.dictionary)
    places = np.empty(len(order), np.int64)
    places[order.to_numpy()] = np.arange(len(order))
    return known.dictionary.take(order), places[known.indices.to_numpy()]


def cut_at(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the end of the last."""
    return np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)


#: Every byte of a UTF-8 text, with a space for those that are ASCII and in no term.
_SPACED = np.array([b if b > 127 or chr(b).isalnum() or chr(b) in "_-" else 32 for b in range(256)], np.uint8)


def _spaced(texts: pa.Array) -> pa.Array:
    """Texts of :func:`narrow_breaks` with spaces in place of what is between terms, whose number of bytes stays."""
    valid, offsets, data = texts.buffers()
    if data is None:
        return texts
    return pa.Array.from_buffers(texts.type, len(texts), [valid, offsets, pa.py_buffer(_SPACED[np.frombuffer(data, np.uint8)])], offset=texts.offset)


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The words of at least two characters in texts with spaces between words, and the number of each one's text."""
    own, flat = _flat(pc.split_pattern(texts, " "))
    long = pc.greater_equal(pc.utf8_length(flat), 2)
    return own[long.to_numpy(zero_copy_only=False)], flat.filter(long)


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The items of lists, and the number of each one's list."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten()


def _codes(parts: list[pa.Array]) -> tuple[np.ndarray, pa.Array]:
    """Of each value of ``parts`` its place among the different ones, and those."""
    known = pa.chunked_array(parts).dictionary_encode().unify_dictionaries()
    return np.concatenate([c.indices.to_numpy() for c in known.chunks]).astype(np.int64), known.chunk(0).dictionary


def inverted(docs: DataFrame, blocks: int) -> DataFrame:
    """(term, block, ids, n) of (id, block, terms) or (id, block, text) rows, of which an id may have several in its block: the sorted ids of each term and block.

    Documents go to the task of their block whole, with one row each, and are turned into lists there, so no row is made for each
    of their terms, and a text is split there too, without a list of its own. Blocks are dealt in turn, so that tasks have as many of them.
    A task streams its blocks; of one that has very many pairs repeats are left out meanwhile.
    """
    small_batches(docs.sparkSession)
    id_type = docs.schema["id"].dataType
    given = "terms" if "terms" in docs.columns else "text"
    term_type = docs.schema["terms"].dataType.elementType if given == "terms" else docs.schema["text"].dataType
    schema = StructType([StructField("term", term_type), docs.schema["block"], StructField("ids", ArrayType(id_type)), StructField("n", LongType())])
    parted = _flat if given == "terms" else _words

    def pairs_of(held: list[tuple]) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """The sorted ids and the terms of a block, and its pairs of them as sorted numbers: the term's times the number of ids, and the id's."""
        ids, place = sorted_distinct(pa.chunked_array([h[0] for h in held]).combine_chunks())
        starts = np.cumsum([0] + [len(h[0]) for h in held])
        own = place[np.concatenate([h[1] + start for h, start in zip(held, starts.tolist())])]
        codes, terms = _codes([h[2] for h in held])
        keys = np.sort(codes * len(ids) + own)
        return ids, terms, keys[cut_at(keys)[:-1]]

    def turned(block: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not any(len(h[2]) for h in held):
            return
        ids, terms, keys = pairs_of(held)
        cuts = cut_at(keys // len(ids))
        for i in range(0, len(cuts) - 1, 10_000):
            some = cuts[i : i + 10_001]
            own = ids.take(pa.array(keys[some[0] : some[-1]] % len(ids)))
            lists = pa.ListArray.from_arrays(pa.array((some - some[0]).astype(np.int32)), own)
            columns = [terms.take(pa.array(keys[some[:-1]] // len(ids))), pa.array(np.full(len(lists), block)), lists, pa.array(np.diff(some))]
            yield pa.RecordBatch.from_arrays(columns, ["term", "block", "ids", "n"])

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0
        for batch in batches:
            at = batch.column(1).to_numpy()
            given_ = batch.column(2) if given == "terms" else _spaced(batch.column(2))
            cuts = cut_at(at)
            for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if at[start] != now:
                    if held:
                        yield from turned(now, held)
                    now, held, size = at[start], [], 0
                own, flat = parted(given_.slice(start, end - start))
                held.append((batch.column(0).slice(start, end - start), own, flat))
                size += len(own)
                if size > _HELD:
                    ids, terms, keys = pairs_of(held)
                    held = [(ids, keys % len(ids), terms.take(pa.array(keys // len(ids))))]
                    size = len(keys) // 2  # else nothing but repeats would be looked for where there are few
        if held:
            yield from turned(now, held)

    least, most = _BLOCKS_PER_TASK
    tasks = -(-blocks // min(most, max(least, blocks // 64)))
    dealt = docs.select("id", "block", given).repartitionById(tasks, F.pmod("block", F.lit(tasks)).cast("int")).sortWithinPartitions("block")
    if given == "text":
        dealt = dealt.select("id", "block", narrow_breaks(F.col("text")).alias("text"))
    return dealt.mapInArrow(invert, schema)


def _scored(asked: DataFrame, index: DataFrame, limit: int) -> DataFrame:
    """(query, block, id, score) from (query, block, term): of each query and block the best ids by how many of the terms they have.

    A block's lists go to one task once, whatever the number of queries: together they are what its documents hold.
    """
    id_type = index.schema["ids"].dataType.elementType
    schema = StructType([asked.schema["query"], asked.schema["block"], StructField("id", id_type), StructField("score", LongType())])

    def count(key: tuple, lists: pa.Table, wanted: pa.Table) -> pa.Table:
        ids = lists["ids"].combine_chunks()
        known = ids.flatten().dictionary_encode()
        ranks = np.empty(len(known.dictionary), np.int64)  # of the block's ids in their order, so that a smaller id is a smaller number
        ranks[pc.array_sort_indices(known.dictionary).to_numpy()] = np.arange(len(ranks))
        local = ranks[known.indices.to_numpy()]
        sorted_ids = known.dictionary.take(pc.array_sort_indices(known.dictionary))
        ends = np.cumsum(pc.list_value_length(ids).to_numpy())
        place = {t: i for i, t in enumerate(lists["term"].to_pylist())}
        by_query: dict = {}
        for q, t in zip(wanted["query"].to_pylist(), wanted["term"].to_pylist()):
            if t in place:
                by_query.setdefault(q, []).append(place[t])
        queries: list = []
        found: list[np.ndarray] = []
        scores: list[np.ndarray] = []
        for q, places in by_query.items():
            counts = np.bincount(np.concatenate([local[(ends[i - 1] if i else 0) : ends[i]] for i in places]), minlength=1)
            hits = np.flatnonzero(counts)
            best_ = hits[np.lexsort((hits, -counts[hits]))[:limit]]
            queries += [q] * len(best_)
            found.append(best_)
            scores.append(counts[best_])
        chosen = np.concatenate(found) if found else np.empty(0, np.int64)
        columns = [
            pa.array(queries, wanted.schema.field("query").type), pa.array([key[0].as_py()] * len(queries), wanted.schema.field("block").type),
            sorted_ids.take(pa.array(chosen)), pa.array(np.concatenate(scores) if scores else chosen, pa.int64()),
        ]
        return pa.table(columns, names=["query", "block", "id", "score"])

    needed = index.join(asked.select("term", "block").distinct(), ["term", "block"], "left_semi")
    return needed.select("block", "term", "ids").groupBy("block").cogroup(asked.select("query", "block", "term").groupBy("block")).applyInArrow(count, schema)


def ranked(index: DataFrame, wanted: DataFrame, limit: int) -> DataFrame:
    """(query, id, score, rank) from postings (term, block, ids, n) and (query, term) pairs.

    Terms and blocks meet by their counts first. Each query's most promising blocks, ``limit`` of them, are scored whole,
    and the last of their best scores is a bound: an id that is to reach it must have one of the query's rarest terms,
    all but as many as the bound less one. Blocks without any of those, or with fewer of the terms than the bound, are never
    read. Lists are joined as blocks, not as ids, and each block gives its ``limit`` best, of which Spark keeps as
    many for each query before they are shuffled.
    """
    frequencies = index.groupBy("term").agg(F.sum("n").alias("df"))
    by_query = Window.partitionBy("query")  # a query's terms
    place = F.row_number().over(by_query.orderBy("df", "term"))
    asked = written(wanted.join(frequencies, "term").select("query", "term", place.alias("place"), F.count(F.lit(1)).over(by_query).alias("terms")), "asked")
    spread = index.select("term", "block", "n").join(asked, "term").groupBy("query", "block")
    spread = spread.agg(F.count(F.lit(1)).alias("bound"), F.sum("n").alias("weight"), F.min("place").alias("rarest"), F.max("terms").alias("terms"))
    promising = F.row_number().over(by_query.orderBy(F.desc("bound"), F.desc("weight"), "block"))
    spread = written(spread.withColumn("nth", promising), "spread")
    terms_of = asked.select("query", "term")
    seeds = written(_scored(spread.where(F.col("nth") <= limit).select("query", "block").join(terms_of, "query"), index, limit), "seeds")
    scores = F.sort_array(F.collect_list("score"), asc=False)  # at most limit x limit of them
    least = seeds.groupBy("query").agg(F.coalesce(F.get(scores, F.lit(limit - 1)), F.lit(1)).alias("least"))
    needed = (F.col("rarest") <= F.col("terms") - F.col("least") + 1) & (F.col("bound") >= F.col("least"))
    found = seeds
    if spread.where(F.col("nth") > limit).limit(1).count():
        blocks = spread.where(F.col("nth") > limit).join(least, "query").where(needed).select("query", "block")
        found = seeds.union(_scored(blocks.join(terms_of, "query"), index, limit))
    rank = F.row_number().over(by_query.orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit).select("query", "id", "score", "rank")


def best(pairs: DataFrame, wanted: DataFrame, limit: int, documents: int | None = None) -> DataFrame:
    """(query, id, score, rank) from (id, term) and (query, term) pairs: of each query the ids with the most of its terms; ties to the smaller id.

    An index of the wanted terms alone is written, and :func:`ranked`. ``documents`` tells about how many ids there are,
    which are counted where it isn't given.
    """
    wanted = written(wanted.distinct(), "wanted")
    kept = pairs.join(wanted.select("term").distinct(), "term", "left_semi")
    if documents is None:
        documents = pairs.agg(F.approx_count_distinct("id")).first()[0]
    return ranked(written(indexed(kept, documents), "index"), wanted, limit)


def checked_limit(limit: int) -> int:
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= 50:
        raise ValueError("limit must be a whole number from 1 to 50")
    return limit


def search(pairs: DataFrame, queries: DataFrame, query_col: str, text_col: str, limit: int = 10, documents: int | None = None) -> DataFrame:
    """(query, id, score, rank): for each query, the documents with the most of its terms; ties to the smaller id.

    See :func:`ranked`: no document is listed for a query that it shares no term with, or can't be among the best of. ``documents`` as in :func:`best`.
    """
    wanted = terms(queries, query_col, text_col).withColumnRenamed("id", "query")
    return best(pairs, wanted, checked_limit(limit), documents)
