"""Registered queries over trees of files that are written and read back, and over numbered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loam.operators import exchange as X, parsing
from loam.operators.formatting import formatted
from loam.plans.catalogue import query, table
from loam.session import new_path, written
from loam.sources.bundle import read_bundle
from loam.sources.sink import write_files, write_pieces

#: SQL for a document's path in a tree: a folder for each source and hundred, some of them hidden.
DOCUMENT_PATH = "coalesce(source, 'none') || '/' || CASE WHEN doc_id % 3 = 0 THEN '.h' ELSE 'd' END || (doc_id // 100) || '/' || CASE WHEN doc_id % 7 = 0 THEN '_' ELSE '' END || doc_id || '.md'"
TIDY = r"""b AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n|\r', e'\n', 'g'), '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', e'\n\n', 'g'), '^\n+|\n+$', '', 'g') AS tidy FROM documents)"""


def _document_files(spark, sf) -> DataFrame:
    """(path, content): each document as a file."""
    number = F.col("doc_id").cast("string")
    folder = F.concat(F.when(F.col("doc_id") % 3 == 0, ".h").otherwise("d"), F.expr("doc_id div 100").cast("string"))
    name = F.concat(F.when(F.col("doc_id") % 7 == 0, "_").otherwise(""), number, F.lit(".md"))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), folder, name)
    return table(spark, sf, "documents").select(path.alias("path"), F.coalesce("text", F.lit("")).alias("content"))


@query(f"SELECT {DOCUMENT_PATH} AS path, sha256(coalesce(text, '')) AS sha FROM documents")
def written_tree(spark, sf):
    """Documents written as a tree of files, hidden ones among them, listed and read back."""
    root = new_path(spark, "tree")
    write_files(_document_files(spark, sf), root)
    return read_bundle(spark, root).select("path", F.sha2("content", 256).alias("sha"))


@query(f"WITH {TIDY} SELECT {DOCUMENT_PATH} AS path, sha256(CASE WHEN tidy = '' THEN '' ELSE tidy || chr(10) END) AS sha, false AS changed FROM b")
def rewritten_tree(spark, sf):
    """A bundle that is written, read, formatted, written over itself, and formatted once more, which changes nothing."""
    root = new_path(spark, "tree")
    write_files(_document_files(spark, sf), root)
    changed = formatted(read_bundle(spark, root)).where("changed").select("path", F.col("formatted").alias("content"))
    write_files(changed, root, replace=True)
    again = read_bundle(spark, root).withColumn("sha", F.sha2("content", 256))
    return formatted(again, keep=["sha"]).select("path", "sha", "changed")


@query(
    """WITH n AS (SELECT 'c' || c_custkey AS id, 'n' || c_nationkey AS up FROM customer),
        e AS (SELECT id, up, row_number() OVER (ORDER BY id) - 1 AS nth FROM n)
        SELECT id, NULL AS source, NULL AS target FROM (SELECT id FROM n UNION SELECT 'n' || n_nationkey FROM nation)
        UNION ALL SELECT id || '->' || up || ':fk:' || nth, id, up FROM e"""
)
def graph_document(spark, sf):
    """The graph of customers and nations as one JSON file, written in pieces and read back as elements."""
    root = new_path(spark, "graph")
    none = F.lit(None).cast("string")
    own = lambda rows, id_: rows.select(id_.alias("id"), none.alias("path"), none.alias("type"), none.alias("title"), F.lit(None).cast("array<string>").alias("tags"))
    customer = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    nodes = own(table(spark, sf, "customer"), customer).union(own(table(spark, sf, "nation"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))))
    edges = table(spark, sf, "customer").select(customer.alias("source"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("target"), F.lit("fk").alias("kind"))
    write_pieces(X.graph_json(nodes, edges), ["part", "key"], root)
    # its elements are a line each, and the whole is one object
    lines = spark.read.text(f"{root}/graph.json").where("value RLIKE '^[{].*[}],?$'")
    found = lines.select(F.from_json(F.regexp_replace("value", ",$", ""), "id string, source string, target string").alias("e"))
    return found.select("e.id", "e.source", "e.target")


@query(
    f"""WITH {TIDY}, s AS (SELECT doc_id, {DOCUMENT_PATH} AS path FROM b)
        SELECT regexp_replace(path, '\\.md$', '.html') AS path, count(*) OVER () AS pages FROM s"""
)
def written_site(spark, sf):
    """The pages of a site for all documents, written and listed."""
    from loam.sources.tree import list_tree

    root = new_path(spark, "site")
    parsed = written(parsing.parse(_document_files(spark, sf)), "parsed")
    pages = X.site_pages(parsed.where("kind = 'concept'"))
    write_files(pages.select("path", F.col("html").alias("content")), root)
    found = written(list_tree(spark, root, include="**/*.html"), "pages")
    return found.join(F.broadcast(found.agg(F.count(F.lit(1)).alias("pages")))).where(F.col("size") > 0).select("path", "pages")  # one row
