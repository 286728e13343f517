"""Registered queries over anchored front matter, reserved files, kept shards and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loam.operators import graph as G, packing as P
from loam.operators.formatting import formatted
from loam.operators.incremental import ParseCache
from loam.plans.catalogue import query, table
from loam.session import new_path, spread, written

#: SQL for a text of lines.
_LINES = "array_to_string([{}], chr(10)) || chr(10)"


def _sql_lines(*lines: str) -> str:
    return _LINES.format(", ".join(lines))


@query(
    f"""SELECT c_custkey, '---' || chr(10) || CASE c_custkey % 5
        WHEN 0 THEN {_sql_lines("'type: Note'", "'zeta: &n ' || c_name", "'title: *n'")}
        WHEN 1 THEN {_sql_lines("'b: &x ' || c_name", "'a: &x 2'", "'type: T'")}
        WHEN 2 THEN {_sql_lines("'type: T'", "'base: &b'", "'  k: ' || c_custkey", "'extra:'", "'  <<: *b'")}
        WHEN 3 THEN {_sql_lines("'type: T'", "'a: ' || c_name", "'b: 2'")}
        ELSE {_sql_lines("'x: 1'", "'zz: [&l ' || c_custkey || ', 2]'", "'y: &m {p: *l}'", "'description: [*m, *l]'")} END || '---' || chr(10) || chr(10) || c_name || chr(10) AS formatted FROM customer"""
)
def anchored_front(spark, sf) -> DataFrame:
    """Keys in their order, but anchors before what names them; one set twice keeps all in place."""
    name, key = F.col("c_name"), F.col("c_custkey").cast("string")
    lines = lambda *parts: F.concat(*[F.concat(F.lit(p) if isinstance(p, str) else p, F.lit("\n")) for p in parts])
    kinds = [
        lines(F.concat(F.lit("zeta: &n "), name), "title: *n", "type: Note"), lines(F.concat(F.lit("b: &x "), name), "a: &x 2", "type: T"),
        lines("base: &b", F.concat(F.lit("  k: "), key), "extra:", "  <<: *b", "type: T"), lines("b: 2", "type: T", F.concat(F.lit("a: "), name)),
        lines(F.concat(F.lit("zz: [&l "), key, F.lit(", 2]")), "y: &m {p: *l}", "x: 1", "description: [*m, *l]"),
    ]
    front = F.element_at(F.array(*kinds), (F.col("c_custkey") % 5 + 1).cast("int"))
    rows = spread(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey")
    files = rows.select(key.alias("path"), F.concat(F.lit("---\n"), front, F.lit("---\n"), name, F.lit("\n")).alias("content"))
    return formatted(files).select(F.col("path").cast("long").alias("c_custkey"), "formatted")


@query(
    """WITH m AS (SELECT 'c' || c_custkey AS id, 'n' || c_nationkey AS up, c_mktsegment AS segment FROM customer),
        g AS (SELECT up, least(min(id), up) AS cluster FROM m GROUP BY up)
        SELECT id, cluster FROM m JOIN g USING (up) UNION ALL SELECT 'n' || n_nationkey, coalesce(cluster, 'n' || n_nationkey) FROM nation LEFT JOIN g ON up = 'n' || n_nationkey
        UNION ALL SELECT segment || '/index', min(cluster) FROM m JOIN g USING (up) GROUP BY segment"""
)
def cluster_members(spark, sf) -> DataFrame:
    """Clusters of customers by nation, with an index for each segment that links across all nations and bridges none."""
    customer = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    rows = table(spark, sf, "customer")
    edges = rows.select(customer.alias("source"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("target"))
    nodes = rows.select(customer.alias("id")).union(table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))))
    found = written(G.clusters(nodes, edges), "clusters")
    index = F.concat("c_mktsegment", F.lit("/index"))
    own = rows.select(index.alias("source"), customer.alias("target"))
    return found.union(G.reserved_members(found, own.select(F.col("source").alias("id")).distinct(), own))


@query(
    """WITH f AS (SELECT 'p' || p_partkey || '.md' AS path, p_partkey AS k, substr(sha256('p' || p_partkey || '.md'), 1, 2) AS shard FROM part),
        s AS (SELECT *, CASE WHEN shard >= '80' THEN 'hit' WHEN k % 3 = 0 THEN 'key' WHEN k % 3 = 1 THEN 'missing' ELSE 'gone' END AS state FROM f)
        SELECT path, state, CASE WHEN state = 'key' THEN 'content_hash' ELSE '' END AS differs, shard >= '80' AS untouched FROM s"""
)
def kept_shards(spark, sf) -> DataFrame:
    """Parts as files of which those in one half of the shards change, come and go; and whether a file's shard was left as it was."""
    path = F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".md"))
    low = F.substring(F.sha2(path, 256), 1, 2) < "80"
    kind = F.when(low, F.col("p_partkey") % 3).otherwise(-1)
    rows = table(spark, sf, "part").select(path.alias("path"), F.col("p_name").alias("content"), kind.alias("kind"))
    cache = ParseCache(spark, new_path(spark, "cache"), {"version": "0.1"})
    cache.refresh(rows.where("kind <> 1"))
    before = written(cache.table().select("shard", F.input_file_name().alias("file")).distinct(), "before")
    now = rows.where("kind <> 2").select("path", F.when(F.col("kind") == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")).alias("content"))
    states = written(cache.states(now).withColumn("shard", F.substring(F.sha2("path", 256), 1, 2)), "states")
    cache.refresh(now)
    after = cache.table().select("shard", F.input_file_name().alias("file")).distinct()
    same = before.join(after, ["shard", "file"], "left_semi").groupBy("shard").agg(F.lit(True).alias("same"))
    return states.join(same, "shard", "left").select("path", "state", F.array_join("differs", ",").alias("differs"), F.coalesce("same", F.lit(False)).alias("untouched"))


@query(
    """WITH l AS (SELECT 'doc/' || doc_id || '.md' AS path, sha256(coalesce(text, '')) AS sha, 'doc/' || doc_id AS id FROM documents),
        a AS (SELECT substr(sha256(path), 1, 6) AS b, count(*) AS files, sha256('manifest-v1' || chr(10) || string_agg(path || chr(0) || sha || chr(0) || id || chr(10), '' ORDER BY path)) AS hash FROM l GROUP BY 1),
        m AS (SELECT substr(b, 1, 3) AS b, sum(files)::BIGINT AS files, sha256('manifest-v1' || chr(10) || string_agg(b || chr(0) || files || chr(0) || hash || chr(10), '' ORDER BY b)) AS hash FROM a GROUP BY 1)
        SELECT sum(files)::BIGINT AS files, sha256('manifest-v1' || chr(10) || string_agg(b || chr(0) || files || chr(0) || hash || chr(10), '' ORDER BY b)) AS hash FROM m"""
)
def manifest_tree(spark, sf) -> DataFrame:
    """One hash over all documents as files."""
    number = F.col("doc_id").cast("string")
    files = table(spark, sf, "documents").select(
        F.concat(F.lit("doc/"), number, F.lit(".md")).alias("path"), F.col("text").alias("content"), F.concat(F.lit("doc/"), number).alias("id")
    )
    return P.manifest_tree(files)
