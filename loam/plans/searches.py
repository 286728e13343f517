"""Registered queries over a search index on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loam.operators.search_index import SearchIndex
from loam.plans.catalogue import TERMS, query, table
from loam.session import new_path

#: SQL for the best ten documents of each benchmark item, from a table ``d`` of (doc_id, term).
BEST = f"""q AS (SELECT item_id, unnest({TERMS.format('text')}) AS term FROM benchmark),
    s AS (SELECT item_id AS query, doc_id AS id, count(*) AS score FROM q JOIN d USING (term) GROUP BY ALL)
    SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INT AS rank FROM s
    QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 10"""


def _index(spark, sf, merged: bool) -> SearchIndex:
    """An index of all documents, of which a third came first with other texts, and a third in a second segment."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    index = SearchIndex(spark, new_path(spark, "index"), buckets=16)
    index.add(docs.where("doc_id % 3 < 2").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("stale words of before "), F.reverse("text"))).otherwise(F.col("text"))), "doc_id", "text")
    index.add(docs.where("doc_id % 3 <> 1"), "doc_id", "text")
    if merged:
        index.merge()
    return index


@query(f"WITH d AS (SELECT doc_id, unnest({TERMS.format('text')}) AS term FROM documents), {BEST}")
def index_search(spark, sf) -> DataFrame:
    """Search over two segments, of which the second replaces documents of the first."""
    return _index(spark, sf, merged=False).search(table(spark, sf, "benchmark"), "item_id", "text", 10)


@query(f"WITH d AS (SELECT doc_id, unnest({TERMS.format('text')}) AS term FROM documents) SELECT term, count(*) AS df, min(doc_id) AS first, max(doc_id) AS last FROM d GROUP BY term")
def merged_postings(spark, sf) -> DataFrame:
    """What a merged index holds of each term: the documents as they are now."""
    rows = _index(spark, sf, merged=True).postings()
    lists = rows.groupBy("term").agg(F.sum("n").alias("df"), F.min(F.array_min("ids")).alias("first"), F.max(F.array_max("ids")).alias("last"))
    return lists.select("term", "df", "first", "last")
