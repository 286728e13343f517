"""The registered queries over the driver's tables, each with its SQL.

Operators take tables with named columns, so the same code serves Markdown bundles and the tables
here: documents and conversations are read as file contents, pages as linked files, and concepts
are generated from region, nation and supplier rows and parsed back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from loam.functions import text as T
from loam.functions.paths import is_private_host, resource_host
from loam.operators import diff as D, exchange as X, graph as G, packing as P, parsing, rules as R, search as S
from loam.operators.ordinals import numbered
from loam.session import spread, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: The time that rules on age take as now.
NOW, NOW_MS = "2024-07-01 00:00:00", 1719792000000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _filled(sql: str) -> str:
    """SQL with the common tables that are defined further down."""
    return sql.replace("{names}", NAMES).replace("{changes}", CHANGES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- scalar functions and row rules -------------------------------------------------------------


@query("SELECT doc_id, 'sha256:' || sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@query(
    r"""SELECT p_partkey,
        regexp_replace(trim(regexp_replace(regexp_replace(lower(p_name), '[`*_~]', '', 'g'), '[^\p{L}\p{N} -]+', '', 'g')), '[ -]+', '-', 'g') AS slug,
        CASE WHEN regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g') = '' THEN 'item' ELSE trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') END AS type_slug
        FROM part"""
)
def slugs(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", T.slugify(F.col("p_name")).alias("slug"), T.ascii_slug(F.col("p_type")).alias("type_slug")
    )


@query(
    r"""WITH f AS (SELECT doc_id, regexp_matches(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----') AS k,
            regexp_matches(text, '\bAKIA[0-9A-Z]{16}\b') OR regexp_matches(text, '(?i)\b(?:api[_-]?key|secret|token)\b[^\S\r\n]*[:=][^\S\r\n]*[''"]?[A-Za-z0-9_.-]{20,}') AS t,
            regexp_matches(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b') AS e FROM documents)
        SELECT doc_id, 'private-key' AS finding FROM f WHERE k UNION ALL SELECT doc_id, 'token' FROM f WHERE t UNION ALL SELECT doc_id, 'email' FROM f WHERE e"""
)
def secret_findings(spark, sf):
    text = F.col("text")
    kinds = {"private-key": T.has_private_key(text), "token": T.has_token(text), "email": T.has_email(text)}
    hits = F.array(*[F.when(hit, F.lit(kind)) for kind, hit in kinds.items()])
    return table(spark, sf, "documents").select("doc_id", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("finding"))


@query(
    r"""SELECT conv_id, turn, CASE WHEN b = '' THEN '' ELSE b || chr(10) END AS body FROM (
        SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n|\r', e'\n', 'g'), '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', e'\n\n', 'g'), '^\n+|\n+$', '', 'g') AS b
        FROM conversations)"""
)
def normalized_bodies(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.normalized_body(F.coalesce("text", F.lit(""))).alias("body"))


@query(
    r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/?$', '.md') AS path FROM pages)
        SELECT page_id, NOT regexp_matches(path, '^[a-z0-9][a-z0-9_./-]*\.md$') AS bad_name FROM p"""
)
def file_name_format(spark, sf):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "/?$", ".md")
    return table(spark, sf, "pages").select("page_id", (~path.rlike(T.FILE_NAME)).alias("bad_name"))


@query(
    r"""SELECT p_partkey, tag FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS tag FROM part) WHERE NOT regexp_matches(tag, '^[a-z0-9]+(?:-[a-z0-9]+)*$')
        UNION ALL SELECT p_partkey, tag FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS tag FROM part) WHERE NOT regexp_matches(tag, '^[a-z0-9]+(?:-[a-z0-9]+)*$')"""
)
def tag_format(spark, sf):
    words = table(spark, sf, "part").select("p_partkey", F.explode(F.concat(F.split("p_type", " "), F.split("p_name", " "))).alias("tag"))
    return words.where(~F.col("tag").rlike(T.TAG))


@query(
    f"""SELECT o_orderkey, epoch_ms(o_orderdate) AS ts_ms,
        epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(o_orderdate) > 180 * 86400000::BIGINT AS stale FROM orders"""
)
def stale_timestamps(spark, sf):
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    now = F.unix_millis(F.lit(NOW).cast("timestamp"))
    rows = table(spark, sf, "orders").select("o_orderkey", T.iso_utc_ms(stamp).alias("ts_ms"))
    return rows.withColumn("stale", now - F.col("ts_ms") > F.lit(T.STALE_DAYS * 86_400_000))


@query(
    """SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, array_to_string(json_keys(props), ',') AS keys,
        json_extract_string(props, '$.k') IS NULL AS missing FROM events"""
)
def front_fields(spark, sf):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").select(
        "event_id", k.cast("long").alias("k"), F.array_join(F.json_object_keys("props"), ",").alias("keys"), k.isNull().alias("missing")
    )


@query("SELECT event_id, event_id % 3 = 1 AS equal FROM events")
def json_equality(spark, sf):
    """Objects whose keys are in another order and whose numbers are written otherwise, of which every third is the same."""
    swapped = F.concat(F.lit('{"b":1,"a":'), "props", F.lit("}"))
    straight = F.concat(F.lit('{ "a": '), "props", F.lit(', "b": '), (F.col("event_id") % 3).cast("string"), F.lit(" }"))
    return table(spark, sf, "events").select("event_id", (T.canonical_json(swapped) == T.canonical_json(straight)).alias("equal"))


# ---- groups, duplicates and search -----------------------------------------------------------


@query("SELECT doc_id, count(*) OVER (PARTITION BY sha256(text)) AS copies FROM documents")
def duplicate_content(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.unhex(F.sha2("text", 256)).alias("key"))
    groups = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "groups")
    return rows.join(groups, "key", "left").select("doc_id", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))


@query("SELECT p_partkey FROM part QUALIFY count(*) OVER (PARTITION BY lower(trim(p_name))) > 1")
def duplicate_titles(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.lower(T.trimmed(F.col("p_name"))).alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(shared, "key", "left_semi").select("p_partkey")


TERMS = r"list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}\p{{M}}_-]+'), lambda t: length(t) >= 2))"


@query(f"SELECT term, count(*) AS df FROM (SELECT unnest({TERMS.format('text')}) AS term FROM documents) GROUP BY term")
def term_frequencies(spark, sf):
    return S.term_frequencies(S.terms(table(spark, sf, "documents"), "doc_id", "text"))


@query(
    f"SELECT term, item_id // 1024 AS block, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS ids FROM (SELECT item_id, unnest({TERMS.format('text')}) AS term FROM benchmark) GROUP BY ALL"
)
def postings(spark, sf):
    found = S.postings(S.terms(table(spark, sf, "benchmark"), "item_id", "text"), F.expr("id div 1024"))
    return found.select("term", "block", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query(
    f"SELECT term, doc_id // 1024 AS block, count(*) AS ids, min(doc_id) AS first FROM (SELECT doc_id, unnest({TERMS.format('text')}) AS term FROM documents) GROUP BY ALL"
)
def document_postings(spark, sf):
    found = S.postings(S.terms(table(spark, sf, "documents"), "doc_id", "text"), F.expr("id div 1024"))
    return found.select("term", "block", F.size("ids").cast("long").alias("ids"), F.col("ids")[0].alias("first"))


@query(
    f"""WITH d AS (SELECT doc_id, unnest({TERMS.format('text')}) AS term FROM documents),
        q AS (SELECT item_id, unnest({TERMS.format('text')}) AS term FROM benchmark),
        s AS (SELECT item_id AS query, doc_id AS id, count(*) AS score FROM q JOIN d USING (term) GROUP BY ALL)
        SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INT AS rank FROM s
        QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 10"""
)
def search_top(spark, sf):
    docs = table(spark, sf, "documents")
    return S.search(S.terms(docs, "doc_id", "text"), table(spark, sf, "benchmark"), "item_id", "text", 10, docs.count())


# ---- diagnostics over documents as concepts ---------------------------------------------------


def _document_context(spark, sf) -> R.Context:
    """Documents as concept files in a folder for each source; the first line is the title."""
    docs = table(spark, sf, "documents")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    front = F.concat(F.lit("---\ntype: Document\ntags: ["), "lang", F.lit("]\n---\n"))
    files = docs.select(path.alias("path"), F.concat(front, F.coalesce("text", F.lit(""))).alias("content"))
    parsed = written(parsing.parse(files), "parsed")
    links = written(parsing.resolved_links(parsed), "links")
    return R.Context(parsed, links, R.Config(rules={"graph/orphan-concept": "off", "graph/circular-reference": "off"}))


DIAGNOSTICS = r"""f AS (SELECT source || '/' || doc_id || '.md' AS path, source, text FROM documents),
    t AS (SELECT *, regexp_matches(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----') AS k,
            regexp_matches(text, '\bAKIA[0-9A-Z]{16}\b') OR regexp_matches(text, '(?i)\b(?:api[_-]?key|secret|token)\b[^\S\r\n]*[:=][^\S\r\n]*[''"]?[A-Za-z0-9_.-]{20,}') AS t,
            regexp_matches(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b') AS e FROM f),
    g AS (SELECT 'hygiene/missing-title' AS code, 'warning' AS severity, path, source FROM t UNION ALL
          SELECT 'hygiene/missing-description', 'warning', path, source FROM t UNION ALL
          SELECT 'hygiene/empty-body', 'warning', path, source FROM t WHERE length(trim(text, e' \t\n\r')) = 0 UNION ALL
          SELECT 'security/suspicious-secret', 'error', path, source FROM t WHERE k OR t UNION ALL
          SELECT 'security/private-key', 'error', path, source FROM t WHERE k UNION ALL
          SELECT 'security/token-looking-value', 'warning', path, source FROM t WHERE t UNION ALL
          SELECT 'security/unredacted-email', 'warning', path, source FROM t WHERE e)"""


@query(f"WITH {DIAGNOSTICS} SELECT code, severity, path FROM g")
def lint_union(spark, sf):
    return R.lint(_document_context(spark, sf)).select("code", "severity", "path")


@query(f"""WITH {DIAGNOSTICS} SELECT count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warning') AS warning,
    count(*) FILTER (severity = 'advice') AS advice, count(*) FILTER (severity = 'info') AS info,
    greatest(0, 100 - 20 * count(*) FILTER (severity = 'error') - 8 * count(*) FILTER (severity = 'warning') - 3 * count(*) FILTER (severity = 'advice'))::BIGINT AS score FROM g""")
def readiness_score(spark, sf):
    return R.readiness(R.severity_counts(R.lint(_document_context(spark, sf))))


@query(f"WITH {DIAGNOSTICS} SELECT count(*) FILTER (severity = 'error') > 0 AS exceeds FROM g")
def threshold_exceeded(spark, sf):
    return R.exceeds(R.lint(_document_context(spark, sf)), "error")


@query(f"WITH {DIAGNOSTICS} SELECT path, bool_or(severity = 'error') AS exceeds FROM g GROUP BY path")
def failing_documents(spark, sf):
    """Whether each document has a diagnostic that fails a lint."""
    return R.exceeds(R.lint(_document_context(spark, sf)), "error", by=("path",))


@query(f"""WITH {DIAGNOSTICS} SELECT source, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM g GROUP BY source""")
def diagnostics_by_source(spark, sf):
    found = R.lint(_document_context(spark, sf)).withColumn("source", F.regexp_extract("path", "^[^/]+", 0))
    return found.groupBy("source").agg(
        F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings")
    )


# ---- links and hosts of pages -------------------------------------------------------------------

HREF = r'href="([^"]*)"'


def _page_links(spark, sf) -> DataFrame:
    hrefs = F.regexp_extract_all("html", F.lit(HREF), F.lit(1))
    rows = table(spark, sf, "pages").select("page_id", F.posexplode(hrefs).alias("ordinal", "target"))
    return rows.withColumn("kind", T.link_kind(F.col("target")))


HREFS = r"""h AS (SELECT page_id, unnest(l) AS target, generate_subscripts(l, 1) - 1 AS ordinal FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages)),
    k AS (SELECT page_id, ordinal, target, CASE WHEN trim(target) = '' THEN 'unknown' WHEN target LIKE '#%' THEN 'anchor'
          WHEN regexp_matches(trim(target), '^(?:[A-Za-z][A-Za-z0-9+.-]*:|//)') THEN 'external' ELSE 'internal' END AS kind FROM h)"""
PAGE_PATH = r"regexp_replace(url, '^[a-z]+://[^/]*', '')"


@query(f"WITH {HREFS} SELECT page_id, ordinal::INT AS ordinal, target, kind FROM k")
def page_links(spark, sf):
    return _page_links(spark, sf)


@query(f"WITH {HREFS} SELECT kind, count(*) AS links, count(DISTINCT target) AS targets FROM k GROUP BY kind")
def link_kinds(spark, sf):
    return _page_links(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("target").alias("targets"))


@query(f"WITH {HREFS} SELECT page_id, ordinal::INT AS ordinal, target FROM k WHERE kind = 'internal' AND target NOT IN (SELECT {PAGE_PATH} FROM pages)")
def broken_links(spark, sf):
    paths = table(spark, sf, "pages").select(F.regexp_replace("url", "^[a-z]+://[^/]*", "").alias("target")).distinct()
    return _page_links(spark, sf).where("kind = 'internal'").join(paths, "target", "left_anti").select("page_id", "ordinal", "target")


@query(f"WITH {HREFS} SELECT target AS id, count(DISTINCT page_id) AS \"references\" FROM k WHERE kind = 'internal' GROUP BY target ORDER BY 2 DESC, 1 LIMIT 10")
def top_referenced(spark, sf):
    return G.top_referenced(_page_links(spark, sf).where("kind = 'internal'").select(F.col("page_id").alias("source"), "target"))


@query(
    r"""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host FROM pages),
        common AS (SELECT host FROM h GROUP BY host ORDER BY count(*) DESC, host LIMIT 3)
        SELECT page_id, host, host NOT IN (SELECT host FROM common) AS not_allowed,
               host = 'localhost' OR host LIKE '%.local' OR host LIKE '10.%' OR host LIKE '127.%' OR host LIKE '192.168.%' AS private FROM h"""
)
def resource_hosts(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", resource_host("url").alias("host"))
    allowed = rows.groupBy("host").count().orderBy(F.desc("count"), "host").limit(3).select("host", F.lit(True).alias("allowed"))
    joined = rows.join(allowed, "host", "left")
    return joined.select("page_id", "host", F.col("allowed").isNull().alias("not_allowed"), is_private_host("host").alias("private"))


@query(
    rf"""WITH d AS (SELECT DISTINCT regexp_extract({PAGE_PATH}, '^(.*)/[^/]*$', 1) AS dir FROM pages)
        SELECT dir FROM d EXCEPT SELECT regexp_extract({PAGE_PATH}, '^(.*)/[^/]*$', 1) FROM pages WHERE regexp_matches({PAGE_PATH}, '(^|/)index\.md$')"""
)
def missing_indexes(spark, sf):
    return G.missing_indexes(table(spark, sf, "pages").select(F.regexp_replace("url", "^[a-z]+://[^/]*", "").alias("path")))


# ---- concepts generated from rows, and parsed back --------------------------------------------


def _generated(spark, sf) -> DataFrame:
    """(path, content): a Markdown file for each region, nation and supplier that links to its parent."""

    def files(rows: DataFrame, folder: str, key: str, name: str, parent: str) -> DataFrame:
        number = lambda c: F.format_string("%06d", F.col(c).cast("long"))
        link = F.concat(F.lit(f"\nPart of [its parent](../{parent}/"), number("up"), F.lit(".md).\n")) if parent else F.lit("\n")
        content = F.concat(
            F.lit('---\ntype: Table\ntitle: "'), F.col(name), F.lit(f'"\nresource: "db://{folder}/'), F.col(key).cast("string"),
            F.lit(f'"\ntags: [{folder}, generated]\n---\n\n# '), F.col(name), F.lit("\n"), link, F.lit("\n```\n[not](../a/link.md)\n```\n"),
        )
        return rows.select(F.concat(F.lit(f"{folder}/"), number(key), F.lit(".md")).alias("path"), content.alias("content"))

    region = files(table(spark, sf, "region").withColumn("up", F.lit(0)), "region", "r_regionkey", "r_name", "")
    nation = files(table(spark, sf, "nation").withColumn("up", F.col("n_regionkey")), "nation", "n_nationkey", "n_name", "region")
    supplier = files(table(spark, sf, "supplier").withColumn("up", F.col("s_nationkey")), "supplier", "s_suppkey", "s_name", "nation")
    return region.union(nation).union(supplier)


NAMES = """n AS (SELECT 'region/' || printf('%06d', r_regionkey::BIGINT) AS id, r_name AS title, NULL AS parent, 'region' AS folder, r_regionkey::VARCHAR AS key FROM region UNION ALL
    SELECT 'nation/' || printf('%06d', n_nationkey::BIGINT), n_name, 'region/' || printf('%06d', n_regionkey::BIGINT), 'nation', n_nationkey::VARCHAR FROM nation UNION ALL
    SELECT 'supplier/' || printf('%06d', s_suppkey::BIGINT), s_name, 'nation/' || printf('%06d', s_nationkey::BIGINT), 'supplier', s_suppkey::VARCHAR FROM supplier)"""


@query(f"WITH {NAMES} SELECT c.id, l.id AS source FROM n c LEFT JOIN n l ON l.parent = c.id")
def gen_backlinks(spark, sf):
    parsed = parsing.parse(_generated(spark, sf))
    return G.backlinks(parsed.select("id"), parsing.resolved_links(parsed).where("resolved").select("source", "target"))


@query(f"WITH {NAMES} SELECT l.id AS source, p.id AS target, p.id IS NOT NULL AS resolved FROM n l LEFT JOIN n p ON l.parent = p.id WHERE l.parent IS NOT NULL")
def gen_links(spark, sf):
    return parsing.resolved_links(parsing.parse(_generated(spark, sf))).select("source", "target", "resolved")


@query(
    f"""WITH {NAMES} SELECT id, 'Table' AS type, title, 'db://' || folder || '/' || key AS resource, folder || ',generated' AS tags,
        'type,title,resource,tags' AS keys, '1 ' || title AS headings FROM n"""
)
def gen_roundtrip(spark, sf):
    heading = F.transform("headings", lambda h: F.concat(h["level"].cast("string"), F.lit(" "), h["title"]))
    return parsing.parse(_generated(spark, sf)).select(
        "id", "type", "title", F.col("resource")[0].alias("resource"), F.array_join("tags", ",").alias("tags"),
        F.array_join("keys", ",").alias("keys"), F.array_join(heading, ",").alias("headings"),
    )


@query(f"WITH {NAMES} SELECT count(*) AS concepts, 0::BIGINT AS indexes, 0::BIGINT AS logs, count(parent) AS links, 0::BIGINT AS broken_links FROM n")
def gen_stats(spark, sf):
    parsed = parsing.parse(_generated(spark, sf))
    return parsing.bundle_stats(parsed, parsing.resolved_links(parsed))


@query(f"WITH {NAMES} SELECT c.code, n.id FROM n, (VALUES ('agent/missing-summary'), ('hygiene/missing-description')) c(code) UNION ALL SELECT 'graph/no-backlinks', id FROM n WHERE folder = 'supplier' UNION ALL SELECT 'graph/high-degree-hub', p.id FROM n p JOIN n l ON l.parent = p.id GROUP BY p.id, p.parent HAVING count(*) + (p.parent IS NOT NULL)::INT >= 25 UNION ALL SELECT 'graph/no-backlinks', p.id FROM n p WHERE p.parent IS NOT NULL AND folder <> 'supplier' AND NOT EXISTS (FROM n l WHERE l.parent = p.id) UNION ALL SELECT 'agent/missing-index', NULL")
def gen_doctor(spark, sf):
    parsed = written(parsing.parse(_generated(spark, sf)), "parsed")
    found, _ = R.doctor(R.Context(parsed, written(parsing.resolved_links(parsed), "links"), R.Config(rules={"graph/orphan-concept": "off"})))
    return found.select("code", F.col("concept_id").alias("id"))


STAMP = "2024-01-01T00:00:00.000Z"
SLUG = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')"


@query(
    f"""WITH t AS (SELECT 'ds-' || p_brand AS dataset, p_name AS name, p_partkey FROM part),
        c AS (SELECT 'tables/' || {SLUG.format("dataset || '-' || name")} || '.md' AS path, 'bigquery://wh/' || dataset || '/' || name AS identity, dataset || '.' || name AS title FROM t)
        SELECT path, identity, title, 'Imported from BigQuery metadata.' AS description FROM c"""
)
def imported_tables(spark, sf):
    tables = spread(table(spark, sf, "part").select("p_partkey", "p_brand", "p_name"), "p_partkey").select(
        F.lit("wh").alias("project"), F.concat(F.lit("ds-"), "p_brand").alias("dataset"), F.col("p_name").alias("table"), F.lit(None).cast("string").alias("description"),
        F.array(F.struct(F.lit("key").alias("name"), F.lit("INT64").alias("type"), F.lit(None).cast("string").alias("description"))).alias("columns"),
    )
    made = X.table_concepts(tables, STAMP)
    # both are written, as the join's conditions would else be pushed to where the table is read, and every row parsed there
    concepts = written(made.select("path", "content").distinct(), "concepts")
    parsed = written(parsing.parse(spread(concepts, "path")).select("path", "title", "description", "resource"), "parsed")
    return made.join(parsed, "path").where(F.col("identity") == F.col("resource")[0]).select("path", "identity", "title", "description")


@query(
    f"""SELECT 'tables/' || CASE WHEN c_custkey % 10 = 0 THEN 'model' ELSE {SLUG.format("c_name")} END || '.md' AS path, 'model.' || c_custkey AS identity,
        CASE WHEN c_custkey % 10 = 0 THEN 'dbt model' ELSE c_name END AS title, CASE WHEN c_custkey % 7 = 0 THEN '- source\\.' || c_nationkey ELSE 'No upstream dbt dependencies declared.' END AS sources
        FROM customer WHERE c_custkey % 3 > 0"""
)
def imported_models(spark, sf):
    """Manifests as JSON texts, one for each nation and thousand customers; every third node is no model."""
    key = F.col("c_custkey")
    node = F.struct(
        F.when(key % 3 > 0, F.lit("model")).otherwise("test").alias("resource_type"), F.when(key % 10 > 0, F.col("c_name")).alias("name"),
        F.struct(F.when(key % 7 == 0, F.array(F.concat(F.lit("source."), F.col("c_nationkey").cast("string")))).alias("nodes")).alias("depends_on"),
    )
    nodes = table(spark, sf, "customer").groupBy("c_nationkey", F.expr("c_custkey div 1000")).agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("model."), key.cast("string")), node))).alias("nodes"))
    made = X.model_concepts(X.manifest_nodes(nodes.select(F.to_json(F.struct("nodes")).alias("content"))), STAMP)
    title = F.get_json_object(F.concat(F.lit("["), F.regexp_extract("content", "(?m)^title: (.*)$", 1), F.lit("]")), "$[0]")
    return made.select("path", "identity", title.alias("title"), F.regexp_extract("content", r"(?m)^## Source Tables\n\n(.*)$", 1).alias("sources"))


@query(
    """SELECT 'apis/' || CASE WHEN s_suppkey % 4 = 0 THEN 'get-supplier-' || s_suppkey ELSE 'op-' || s_suppkey END || '.md' AS path, 'get /supplier/' || s_suppkey AS identity,
        CASE WHEN s_suppkey % 4 = 0 THEN 'GET /supplier/' || s_suppkey ELSE s_name END AS title, 'All suppliers' AS description FROM supplier"""
)
def imported_routes(spark, sf):
    """Specifications as JSON texts, one for each nation and thousand suppliers; entries that are no HTTP method don't count."""
    key = F.col("s_suppkey").cast("string")
    operation = F.struct(F.when(F.col("s_suppkey") % 4 > 0, F.concat(F.lit("op-"), key)).alias("operationId"), F.when(F.col("s_suppkey") % 4 > 0, F.col("s_name")).alias("summary"))
    item = F.struct(operation.alias("get"), F.struct(F.lit("x").alias("name")).alias("parameters"))
    paths = table(spark, sf, "supplier").groupBy("s_nationkey", F.expr("s_suppkey div 1000")).agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("/supplier/"), key), item))).alias("paths"))
    spec = paths.select(F.to_json(F.struct(F.struct(F.lit("All suppliers").alias("description")).alias("info"), "paths")).alias("content"))
    made = X.route_concepts(X.specification_routes(spec), STAMP)
    parsed = parsing.parse(made).select("path", "title", "description")
    return made.select("path", "identity").join(parsed, "path")


@query(
    f"""SELECT 'catalog/' || {SLUG.format("c_name")} || '.md' AS path, 'urn:c:' || c_custkey AS identity, 'imported,datahub,' || {SLUG.format("c_mktsegment")} AS tags FROM customer"""
)
def imported_datasets(spark, sf):
    rows = spread(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey").select(
        F.concat(F.lit("urn:c:"), F.col("c_custkey").cast("string")).alias("urn"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("description"), F.col("c_mktsegment").alias("platform")
    )
    made = X.dataset_concepts(rows, STAMP)
    return made.select("path", "identity").join(parsing.parse(made).select("path", F.array_join("tags", ",").alias("tags")), "path")


@query(
    """SELECT CASE s_suppkey % 3 WHEN 0 THEN 'notes/_con.md' WHEN 1 THEN 'notes/a-b-' || s_suppkey || '.md' ELSE 'x/n-' || s_suppkey || '.md' END AS path,
        CASE s_suppkey % 3 WHEN 0 THEN 'notes/con' WHEN 1 THEN './notes/a:b?' || s_suppkey || '.md' ELSE 'y/../x/n-' || s_suppkey || '.MD' END AS identity FROM supplier"""
)
def imported_notes(spark, sf):
    number = F.col("s_suppkey").cast("string")
    path = F.when(F.col("s_suppkey") % 3 == 0, "notes/con").when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("./notes/a:b?"), number, F.lit(".md"))).otherwise(
        F.concat(F.lit("y/../x/n-"), number, F.lit(".MD"))
    )
    none = F.lit(None).cast("string")
    sources = table(spark, sf, "supplier").select(path.alias("path"), none.alias("title"), F.col("s_name").alias("body"), F.lit(None).cast("array<string>").alias("tags"))
    return X.note_concepts(sources, STAMP).select(F.regexp_replace("path", "b\\?", "b-").alias("path"), "identity")


@query(
    """WITH f AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'A/' ELSE 'a/' END || (p_partkey // 5) || '-' || p_partkey % 5 // 4 || '.md' AS path FROM part),
        n AS (SELECT *, count(*) OVER (PARTITION BY lower(path)) AS same FROM f)
        SELECT p_partkey, same > 1 AS renamed, count(*) OVER () AS files FROM n"""
)
def generated_paths(spark, sf):
    """Paths that are the same but for case get different ones; no two of all are the same after that."""
    key = F.col("p_partkey")
    number = lambda c: F.floor(c).cast("long").cast("string")
    path = F.concat(F.when(key % 5 == 0, "A/").otherwise("a/"), number(key / 5), F.lit("-"), number(key % 5 / 4), F.lit(".md"))
    files = spread(table(spark, sf, "part").select("p_partkey"), "p_partkey").select(path.alias("path"), F.lit("").alias("content"), F.concat(F.lit("part "), key.cast("string")).alias("identity"))
    made = written(X.disambiguated(files), "paths")
    total = made.agg(F.countDistinct(F.lower("path")).alias("files"))
    renamed = F.col("path").rlike(r"-[0-9a-z]{7,}(?:-[0-9]+)?\.md$")
    return made.select(F.regexp_extract("identity", "[0-9]+$", 0).cast("long").alias("p_partkey"), renamed.alias("renamed")).join(F.broadcast(total))  # one row


# ---- a bundle in which every rule fires -------------------------------------------------------------


def _defective_parts(spark, sf) -> DataFrame:
    """(path, content): a concept for each part, with a defect by its number modulo 40."""
    parts = spread(table(spark, sf, "part").select("p_partkey"), "p_partkey")
    rows = parts.select(F.col("p_partkey").cast("long").alias("k"), (F.col("p_partkey") % 40).cast("int").alias("v"))
    number = lambda c: F.format_string("p%06d", c)
    v = F.col("v")
    name = F.concat(F.when(v == 18, "parts/P").when(v == 3, "parts/./p").otherwise("parts/p"), F.format_string("%06d", "k"), F.lit(".md"))
    kind = F.when(v == 19, "API").when(v == 20, "Metric").when(v == 21, "Runbook").otherwise("Note")
    title = F.when(v == 7, "The same").otherwise(F.concat(F.lit("Part "), F.col("k").cast("string")))
    lines = [
        F.when(v == 15, F.lit("description: d\n")).otherwise(""),
        F.when(v != 2, F.concat(F.lit("type: "), kind, F.lit("\n"))).otherwise(""),
        F.when(v != 4, F.concat(F.lit('title: "'), title, F.lit('"\n'))).otherwise(""),
        F.when(~v.isin(5, 15), F.lit("description: A part.\n")).otherwise(""),
        F.when(v == 8, F.lit("resource: 'urn:same'\n")).when(v == 26, F.lit("resource: http://localhost/x\n")).when(v == 27, F.lit("resource: https://other.example/x\n"))
        .when(v == 30, F.lit("resource: [https://OK.example:80/x, 'http://127.1/']\n")).otherwise(""),
        F.when(v == 17, F.lit("tags: [good, Bad_Tag]\n")).when(v == 31, F.lit('tags:\n  - deprecated\n  - "x\\u0041"\n')).otherwise(""),
        F.when(v == 16, F.lit("timestamp: 2024-13-01\n")).when(v == 28, F.lit("timestamp: 2020-01-01T00:00:00Z\n")).otherwise(""),
        F.when(v == 29, F.lit("status: Deprecated\n")).when(v == 32, F.lit("replacement: new\nstatus: deprecated\n")).otherwise(""),
    ]
    front = F.when(v == 0, "").when(v == 1, F.lit("---\ntitle: [\n---\n")).otherwise(F.concat(F.lit("---\n"), *lines, F.lit("---\n")))
    hub = "[hub](hub.md) is linked.\n"
    body = (
        F.when(v == 6, F.lit("```\ncode only\n```\n")).when(v == 10, F.lit("Alone.\n"))
        .when(v == 9, F.concat(F.lit(hub + "[x](gone"), F.col("k").cast("string"), F.lit(".md)\n")))
        .when(v == 13, F.concat(F.lit(hub + "[on]("), number(F.col("k") + 1), F.lit(".md)\n"))).when(v == 14, F.concat(F.lit(hub + "[back]("), number(F.col("k") - 1), F.lit(".md)\n")))
        .when(v == 20, F.lit(hub + "## Misusage\n")).when(v == 21, F.lit(hub + "## Asymptomatic\n")).when(v == 22, F.lit(hub + "api_key = abcdefghij0123456789\n"))
        .when(v == 23, F.lit(hub + "-----BEGIN RSA PRIVATE KEY-----\n")).when(v == 24, F.lit(hub + "Mail me@host.example.\n"))
        .when(v == 25, F.lit(hub + "See (http://10.0.0.1/x).\n")).when(v == 33, F.lit(hub + "tokens: abcdefghij0123456789\ntoken: abcdefghij/0123456789\n"))
        .when(v == 34, F.lit(hub + "[a](x(b(c))d.md) [![i](j.md)](p.md)\n")).otherwise(F.lit(hub))
    )
    return rows.select(name.alias("path"), F.concat(front, body).alias("content"))


def _hub(spark) -> DataFrame:
    """(path, content) of the file that defective parts link to."""
    return spark.range(1).select(F.lit("parts/hub.md").alias("path"), F.lit("---\ntype: Note\ntitle: Hub\ndescription: All link here.\n---\nHere.\n").alias("content"))


def _defective(spark, sf) -> DataFrame:
    """The concepts of :func:`_defective_parts`, and one that all link to."""
    return _defective_parts(spark, sf).union(_hub(spark))


DEFECTS = """f AS (SELECT p_partkey AS k, p_partkey % 40 AS v, CASE p_partkey % 40 WHEN 18 THEN 'parts/P' WHEN 3 THEN 'parts/./p' ELSE 'parts/p' END || printf('%06d', p_partkey::BIGINT) || '.md' AS path FROM part),
    r(v, code) AS (VALUES (0, 'spec/missing-frontmatter'), (1, 'spec/invalid-frontmatter'), (2, 'spec/missing-type'), (3, 'spec/invalid-concept-path'),
        (0, 'hygiene/missing-title'), (1, 'hygiene/missing-title'), (4, 'hygiene/missing-title'), (0, 'hygiene/missing-description'), (1, 'hygiene/missing-description'),
        (5, 'hygiene/missing-description'), (0, 'agent/missing-summary'), (1, 'agent/missing-summary'), (5, 'agent/missing-summary'), (6, 'hygiene/empty-body'),
        (7, 'hygiene/duplicate-title'), (8, 'hygiene/duplicate-resource'), (26, 'hygiene/duplicate-resource'), (27, 'hygiene/duplicate-resource'),
        (30, 'hygiene/duplicate-resource'), (30, 'hygiene/duplicate-resource'), (9, 'graph/broken-internal-link'), (34, 'graph/broken-internal-link'), (34, 'graph/broken-internal-link'),
        (6, 'graph/orphan-concept'), (10, 'graph/orphan-concept'), (13, 'graph/circular-reference'), (15, 'style/frontmatter-key-order'), (16, 'style/timestamp-format'),
        (17, 'style/tag-format'), (31, 'style/tag-format'), (18, 'style/file-name-format'), (19, 'agent/missing-usage'), (20, 'agent/missing-usage'), (19, 'agent/missing-owner'),
        (20, 'agent/missing-owner'), (21, 'agent/missing-owner'), (20, 'agent/metric-missing-source'), (21, 'agent/runbook-missing-symptoms'), (19, 'agent/api-missing-auth-notes'),
        (22, 'security/suspicious-secret'), (22, 'security/token-looking-value'), (23, 'security/suspicious-secret'), (23, 'security/private-key'), (24, 'security/unredacted-email'),
        (25, 'security/internal-url'), (26, 'security/private-url'), (30, 'security/private-url'), (26, 'security/non-allowlisted-resource'), (27, 'security/non-allowlisted-resource'),
        (30, 'security/non-allowlisted-resource'), (28, 'agent/stale-timestamp'), (29, 'agent/deprecated-missing-replacement'), (31, 'agent/deprecated-missing-replacement')),
    d AS (SELECT code, path FROM f JOIN r USING (v) UNION ALL SELECT 'graph/no-backlinks', path FROM f WHERE v NOT IN (6, 10, 13, 14)
        UNION ALL SELECT 'graph/high-degree-hub', 'parts/hub.md' UNION ALL SELECT 'agent/missing-index', NULL UNION ALL SELECT 'spec/unsupported-version', NULL)"""


def _defective_context(spark, sf) -> R.Context:
    parsed = written(parsing.parse(_defective(spark, sf)), "parsed")
    config = R.Config(version="9.9", allow_hosts=("ok.example",), now_ms=1719792000000)
    return R.Context(parsed, written(parsing.resolved_links(parsed), "links"), config)


@query(f"WITH {DEFECTS} SELECT code, path FROM d")
def lint_defects(spark, sf):
    """Every rule, over concepts of which each breaks some."""
    return R.doctor(_defective_context(spark, sf))[0].select("code", "path")


@query(f"WITH {DEFECTS} SELECT code, path FROM d WHERE code LIKE 'spec/%'")
def validate_defects(spark, sf):
    return R.lint(_defective_context(spark, sf), only=lambda code: code.startswith("spec/")).select("code", "path")


@query(
    """WITH f AS (SELECT p_partkey, p_partkey % 40 AS v, 'parts/p' || printf('%06d', p_partkey::BIGINT) AS id FROM part)
        SELECT id, CASE v WHEN 6 THEN '' WHEN 10 THEN 'Alone.' WHEN 20 THEN 'hub is linked. Misusage' WHEN 24 THEN 'hub is linked. Mail me@host.example.' ELSE 'hub is linked.' END AS text
        FROM f WHERE v IN (4, 6, 10, 20, 24)"""
)
def plain_texts(spark, sf):
    parsed = parsing.parse(_defective(spark, sf)).where("id RLIKE '^parts/p[0-9]+$'").withColumn("text", parsing.plain_text(F.col("body")))
    number = F.regexp_extract("id", "[0-9]+$", 0).try_cast("long")
    return parsed.where((number % 40).isin(4, 6, 10, 20, 24)).select("id", "text")


@query(
    """SELECT CASE v WHEN 18 THEN 'parts/P' WHEN 3 THEN 'parts/./p' ELSE 'parts/p' END || printf('%06d', k::BIGINT) || '.md' AS path,
        CASE v WHEN 6 THEN '' WHEN 10 THEN 'Alone.' ELSE 'hub is linked.' || CASE v WHEN 9 THEN ' x' WHEN 13 THEN ' on' WHEN 14 THEN ' back' WHEN 20 THEN ' Misusage' WHEN 21 THEN ' Asymptomatic'
            WHEN 22 THEN ' api key = abcdefghij0123456789' WHEN 23 THEN ' BEGIN RSA PRIVATE KEY' WHEN 24 THEN ' Mail me@host.example.' WHEN 25 THEN ' See (http://10.0.0.1/x).'
            WHEN 33 THEN ' tokens: abcdefghij0123456789 token: abcdefghij/0123456789' WHEN 34 THEN ' a' ELSE '' END END AS text
        FROM (SELECT p_partkey AS k, p_partkey % 40 AS v FROM part) UNION ALL SELECT 'parts/hub.md', 'Here.'"""
)
def all_plain_texts(spark, sf):
    """The words of every defective concept, links in links and in parentheses included."""
    return parsing.parse(_defective(spark, sf)).select("path", parsing.plain_text(F.col("body")).alias("text"))


@query(
    """WITH f AS (SELECT p_partkey AS k, 'parts/p' || printf('%06d', p_partkey::BIGINT) || '.md' AS path, length('Part ' || p_partkey) AS n FROM part WHERE p_partkey % 40 = 9)
        SELECT path, 'hub' AS label, 6 AS line, 1 AS "column", (50 + n)::INT AS "offset" FROM f UNION ALL SELECT path, 'x', 7, 1, (50 + n + 25)::INT FROM f"""
)
def link_places(spark, sf):
    number = F.regexp_extract("path", "([0-9]+)", 1).try_cast("long")
    rows = parsing.located(_defective(spark, sf).where(F.coalesce(number, F.lit(0)) % 40 == 9)).where("what = 'link'")
    return rows.select("path", "label", "line", "column", "offset")


@query(
    """SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'Front matter keys must be strings.' WHEN 1 THEN 'Front matter numbers must be finite.' WHEN 2 THEN 'Front matter must be a YAML mapping.'
            WHEN 3 THEN 'Front matter holds an invalid explicit YAML tag value.' WHEN 4 THEN 'Front matter keys must be unique.' WHEN 5 THEN 'Front matter must not hold recursive YAML aliases.' END AS invalid,
        CASE c_custkey % 8 WHEN 6 THEN '{"type":"Note","name":"' || c_name || '","deep":{"list":[1,true,null,"a: b"],"key":' || c_custkey || '},"again":[1,true,null,"a: b"]}'
            WHEN 7 THEN '{"type":"Note","text":"one two' || chr(92) || 'nthree","quoted":"' || c_name || '!","set":{"a":null},"tagged":{"!own":"v"}}' END AS json FROM customer"""
)
def front_matter_values(spark, sf):
    """YAML of several kinds, good and refused, for each customer."""
    kinds = [
        F.lit("1: one\n"), F.lit("n: [.inf]\n"), F.lit("- a\n- b\n"), F.lit("n: !!int abc\n"), F.lit("a: 1\na: 2\n"), F.lit("a: &x [*x]\n"),
        F.concat(F.lit("type: Note\nname: "), "c_name", F.lit("\ndeep:\n  list: &l [1, true, ~, 'a: b']\n  key: "), F.col("c_custkey").cast("string"), F.lit("  # number\nagain: *l\n")),
        F.concat(F.lit('type: Note\ntext: >-\n  one\n  two\n\n  three\nquoted: "'), "c_name", F.lit('\\x21"\nset: !!set {a: null}\ntagged: !own v\n')),
    ]
    front = F.element_at(F.array(*kinds), (F.col("c_custkey") % 8 + 1).cast("int"))
    rows = spread(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey")
    files = rows.select(F.col("c_custkey").cast("string").alias("path"), F.concat(F.lit("---\n"), front, F.lit("---\n")).alias("content"))
    return parsing.parse(files).select(F.col("path").cast("long").alias("c_custkey"), "invalid", F.col("front_json").alias("json"))


# ---- functions over rows: hosts, paths, texts ---------------------------------------------------------


def _sql_form(key: str, kinds: list[tuple], column: int) -> str:
    """SQL that picks one of some literals by a key."""
    values = [k[column] for k in kinds]
    texts = ["NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" for v in values]
    return f"[{', '.join(texts)}][{key} % {len(values)} + 1]"


def _form(key: str, kinds: list[tuple], column: int):
    """The same as a column."""
    return F.element_at(F.array(*[F.lit(k[column]) for k in kinds]), (F.col(key) % len(kinds) + 1).cast("int"))


#: URL, its host, and whether that is private.
HOSTS = [
    ("http://127.1/", "127.0.0.1", True), ("HTTP://EXAMPLE.com:80/x", "example.com", False), ("http://[::127.0.0.1]:8/", "::7f00:1", True),
    ("http://0x7f.1", "127.0.0.1", True), ("db://Some_Host/x", "some_host", False), ("http://1.2.3.4.5/", None, False), ("https://user@h..", "h", False),
    ("mailto:a@b", None, False), ("http://[::ffff:10.0.0.1]", "::ffff:a00:1", True), ("http://a%2eb/", "a.b", False), ("http://local/", "local", True),
    ("http://x.localhost", "x.localhost", True), ("http://[fd00::1]/", "fd00::1", True), ("http://172.32.0.1", "172.32.0.1", False),
]


@query(f"SELECT c_custkey, {_sql_form('c_custkey', HOSTS, 1)} AS host, {_sql_form('c_custkey', HOSTS, 2)} AS private FROM customer")
def host_forms(spark, sf):
    rows = spread(table(spark, sf, "customer").select("c_custkey"), "c_custkey").select("c_custkey", resource_host(_form("c_custkey", HOSTS, 0)).alias("host"))
    return rows.withColumn("private", is_private_host("host"))


#: Linking file, target, and what it is resolved to.
TARGETS = [
    ("a/b.md", "./dir/", "a/dir/"), ("a/b.md", "?q", None), ("b.md", "../x", None), ("a/b.md", "../x.md#y", "x"), ("a/b.md", "/c.md", "c"), ("a.md", ".", None),
    ("a.md", "//x", None), ("a.md", "x%20y.md", "x y"), ("a.md", "#t", None), ("a/b/c.md", ".././d%2Fe.md?q#r", "a/d/e"), ("a.md", "x%ff.md", "x%ff"), ("a.md", "b\\(c\\).md", "b(c)"),
]


@query(f"SELECT p_partkey, {_sql_form('p_partkey', TARGETS, 2)} AS target FROM part")
def resolved_targets(spark, sf):
    from loam.functions.paths import resolve_target

    return spread(table(spark, sf, "part").select("p_partkey"), "p_partkey").select("p_partkey", resolve_target(_form("p_partkey", TARGETS, 0), _form("p_partkey", TARGETS, 1)).alias("target"))


#: A file, and whether a package leaves it out.
PACKED = [
    (".env", True), (".env.example", False), ("a/.ENV.local", True), ("x/_netrc", True), (".docker/config.json", True), ("docker/config.json", False), ("x.tfstate", True),
    ("x.tfstate.backup", True), ("credentials", False), ("a.key", False), (".ssh/known", True), ("b.P12", True), ("notes.md", False), ("a/.kube/config", True),
]


@query(f"SELECT path FROM (SELECT 'd' || s_suppkey || '/' || {_sql_form('s_suppkey', PACKED, 0)} AS path, {_sql_form('s_suppkey', PACKED, 1)} AS out FROM supplier) WHERE NOT out")
def packable_files(spark, sf):
    path = F.concat(F.lit("d"), F.col("s_suppkey").cast("string"), F.lit("/"), _form("s_suppkey", PACKED, 0))
    return P.packable(table(spark, sf, "supplier").select(path.alias("path"), F.col("s_name").alias("content"))).select("path")


@query(
    r"""SELECT p_partkey, regexp_replace(p_name || ' [' || p_size || ']*', '([!-/:-@\[-`{-~])', '\\\1', 'g') AS escaped, '`` a`' || p_partkey || ' ``' AS span,
        '../' || (p_partkey % 3) || '/x.md' AS relative, p_name || '?[31m' AS safe FROM part"""
)
def written_texts(spark, sf):
    """Texts as Markdown, as code, as a link from one folder to another, and for a terminal."""
    from loam.functions.paths import relative_target

    key = F.col("p_partkey").cast("string")
    return spread(table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), "p_partkey").select(
        "p_partkey",
        T.escape_markdown_text(F.concat("p_name", F.lit(" ["), F.col("p_size").cast("string"), F.lit("]*"))).alias("escaped"),
        T.spaced_code_span(F.concat(F.lit("a`"), key)).alias("span"),
        relative_target(F.concat(F.lit("a"), key, F.lit("/y.md")), F.concat((F.col("p_partkey") % 3).cast("string"), F.lit("/x.md"))).alias("relative"),
        T.terminal_safe(F.concat("p_name", F.lit("\x1b[31m"))).alias("safe"),
    )


@query(
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00.000Z' WHEN 1 THEN '2024-02-30' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS stamp FROM orders"""
)
def normalized_timestamps(spark, sf):
    day, key = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 3
    raw = F.when(key == 0, day).when(key == 1, "2024-02-30").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return table(spark, sf, "orders").select("o_orderkey", T.normalized_timestamp(raw).alias("stamp"))


@query(
    """SELECT s_suppkey, '---' || chr(10) || 'type: Note' || chr(10) || 'title: ' || s_name || chr(10) || 'tags:' || chr(10) || '  - b' || chr(10) || '  - a' || chr(10) || 'timestamp: 2024-03-01T00:00:00.000Z' || chr(10)
        || 'extra: 1' || chr(10) || 'zeta: 2' || chr(10) || '---' || chr(10) || chr(10) || s_name || chr(10) AS formatted FROM supplier"""
)
def formatted_front(spark, sf):
    """Keys in their order with their lines, whole time stamps, and a tidy body."""
    from loam.operators.formatting import formatted

    front = F.concat(F.lit("---\nzeta: 2\ntags:\n  - b\n  - a\ntitle: "), "s_name", F.lit("\nextra: 1\ntimestamp: 2024-03-01\ntype: Note\n---\n\n\n"), "s_name", F.lit("  \n\n\n"))
    files = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), front.alias("content"))
    return formatted(files).select(F.col("path").cast("long").alias("s_suppkey"), "formatted")


@query(f"WITH {DEFECTS} SELECT DISTINCT code FROM d")
def used_rules(spark, sf):
    return R.used_rules(R.doctor(_defective_context(spark, sf))[0]).select("code")


@query(
    f"""WITH {DEFECTS}, l AS (SELECT *, CASE WHEN code LIKE 'spec/%' OR code IN ('security/suspicious-secret', 'security/private-key', 'security/non-allowlisted-resource') THEN 'error'
            WHEN code IN ('graph/orphan-concept', 'graph/no-backlinks', 'graph/high-degree-hub', 'agent/missing-summary', 'agent/missing-usage', 'agent/missing-owner', 'agent/api-missing-auth-notes') THEN 'advice'
            ELSE 'warning' END AS severity FROM d)
        SELECT severity, count(*) AS diagnostics FROM l GROUP BY severity"""
)
def severity_groups(spark, sf):
    return R.by_severity(R.doctor(_defective_context(spark, sf))[0]).select("severity", "diagnostics")


@query("SELECT 0 AS before_score, 100 - 8 AS after_score, 92 AS delta, true AS changed FROM (SELECT count(*) AS n FROM supplier) WHERE n > 0")
def readiness_changes(spark, sf):
    """From suppliers as files without front matter to whole concepts in a ring; what is left is that there is no index."""
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("k"), "s_name")
    last = rows.agg(F.max("k").alias("last"))
    name = lambda c: F.format_string("s%06d", c)
    after = rows.join(F.broadcast(last)).select(  # one row
        F.concat(name(F.col("k")), F.lit(".md")).alias("path"),
        F.concat(F.lit("---\ntype: Note\ntitle: "), "s_name", F.lit("\ndescription: A supplier.\n---\nSee [x]("), name((F.col("k") + 1) % (F.col("last") + 1)), F.lit(".md).\n")).alias("content"),
    )
    before = after.select("path", F.lit("no front matter").alias("content"))
    scores = []
    for files in (before, after):
        parsed = written(parsing.parse(files), "parsed")
        scores.append(R.doctor(R.Context(parsed, written(parsing.resolved_links(parsed), "links"), R.Config(rules={"graph/circular-reference": "off"})))[1])
    return D.readiness_change(*scores).select(*[F.col(c).cast("int").alias(c) for c in ("before_score", "after_score", "delta")], "changed")


@query(
    """SELECT 'c' || c_custkey || '.md' AS path, CASE c_custkey % 4 WHEN 0 THEN 'hit' WHEN 1 THEN 'content' WHEN 2 THEN 'new' ELSE 'gone' END AS state FROM customer"""
)
def cache_states(spark, sf):
    """Customers as files, of which a quarter each is as it was, changed, new and gone since they were parsed."""
    from loam.operators import incremental as I

    key = F.col("c_custkey") % 4
    rows = table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".md")).alias("path"), F.col("c_name").alias("content"), key.alias("v"))
    kept = parsing.parse(rows.where("v <> 2")).withColumn("parser", F.lit(I.parser_key({"version": "0.1"})))
    now = rows.where("v <> 3").select("path", F.when(F.col("v") == 1, "changed").otherwise(F.col("content")).alias("content"))
    return I.cache_states(now, kept, {"version": "0.1"})


@query(f"WITH {{names}} SELECT 'out' AS direction, parent AS id FROM n WHERE id = 'nation/000001' UNION SELECT 'in', id FROM n WHERE parent = 'nation/000001' UNION SELECT 'out', unnest(['resource:db://nation/1', 'tag:nation', 'tag:generated'])")
def neighbors(spark, sf):
    from loam.bundle import Bundle

    return Bundle(_generated(spark, sf), R.Config()).neighbors("nation/000001")


# ---- changes of concepts ------------------------------------------------------------------------------


def _versions(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Suppliers as concepts before and after a change by their number modulo 6."""
    rows, v = table(spark, sf, "supplier"), F.col("s_suppkey") % 6
    path = F.concat(F.lit("s/"), F.format_string("%06d", F.col("s_suppkey").cast("long")), F.lit(".md")).alias("path")
    none = F.lit("")
    was = F.concat(F.lit("---\ntype: Note\ntags: [a, b]\nmeta: {x: 1, y: [1, 2]}\n---\n"), "s_name", F.lit("\n[l](000001.md)\n"))
    now = F.concat(
        F.lit("---\ntype: "), F.when(v == 1, "Other").otherwise("Note"), F.lit("\ntags: "), F.when(v == 2, "[a]").otherwise("[a, b]"),
        F.lit("\nmeta: "), F.when(v == 3, "{x: 1, y: [2, 1]}").otherwise("{y: [1, 2], x: 1.0}"), F.when(v == 4, "\nnew: 1").otherwise(none), F.lit("\n---\n"), "s_name",
        F.lit("\n[l]("), F.when(v == 5, "000002.md").otherwise("000001.md"), F.lit(")\n"),
    )
    return rows.select(path, was.alias("content")), rows.select(path, now.alias("content"))


@query(
    """WITH s AS (SELECT 's/' || printf('%06d', s_suppkey::BIGINT) AS id, s_suppkey % 6 AS v FROM supplier)
        SELECT id, CASE v WHEN 1 THEN 'frontmatter.type changed' WHEN 2 THEN 'frontmatter.tags changed' WHEN 3 THEN 'frontmatter.meta changed' WHEN 4 THEN 'frontmatter.new changed'
            ELSE 'body changed;link added: s/000002;link removed: s/000001' END AS changes, v = 5 AS body_changed, v = 2 AS tags_changed FROM s WHERE v > 0"""
)
def concept_changes(spark, sf):
    before, after = (written(parsing.parse(f), "parsed") for f in _versions(spark, sf))
    refs = [parsing.resolved_links(p).select("source", F.coalesce("target", "target_raw").alias("target")) for p in (before, after)]
    found = D.concept_changes(before, after, *refs)
    return found.select("id", F.array_join("changes", ";").alias("changes"), "body_changed", "tags_changed")


@query(
    f"""WITH {{changes}} SELECT change, id, old_id, nth::INT AS nth FROM (SELECT *, row_number() OVER (PARTITION BY change ORDER BY id) AS nth FROM c) WHERE nth <= 5"""
)
def diff_highlights(spark, sf):
    return D.highlights(D.diff(*_snapshots(spark, sf), fields=["chars"]))


@query(
    f"""WITH {{names}} SELECT id, CASE folder WHEN 'region' THEN 'Table' ELSE 'Table' END AS type, title AS label, id || '.md' AS path FROM n
        UNION ALL SELECT DISTINCT 'resource:db://' || folder || '/' || key, 'resource', 'db://' || folder || '/' || key, NULL FROM n
        UNION ALL SELECT DISTINCT 'tag:' || t, 'tag', t, NULL FROM (SELECT unnest([folder, 'generated']) AS t FROM n)"""
)
def exported_nodes(spark, sf):
    """Nodes of the graph, those included that only edges name."""
    from loam.bundle import Bundle

    bundle = Bundle(_generated(spark, sf), R.Config())
    return X.cytoscape_nodes(X.graph_nodes(bundle.parsed), bundle.edges()).select("id", "type", "label", "path")


@query(f"WITH {{names}} SELECT id || '.html' AS path, count(l) AS links FROM (SELECT n.id, p.id AS l FROM n LEFT JOIN n p ON n.parent = p.id) GROUP BY id")
def site_links(spark, sf):
    """Pages of a static site, with how many links they hold."""
    from loam.bundle import Bundle

    context = Bundle(_generated(spark, sf), R.Config()).context
    return X.site_pages(context.concepts, context.edges).select("path", F.regexp_count("html", F.lit("<li>")).cast("long").alias("links"))


@query("SELECT (SELECT count(*) FROM region) AS clusters, 0::BIGINT AS single")
def isolated_clusters(spark, sf):
    return G.isolated_clusters(G.clusters(*_places(spark, sf)))


# ---- graphs over foreign keys ---------------------------------------------------------------------


def _supply(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Suppliers and parts, and an edge from each supplier to the parts it delivered."""
    lines = table(spark, sf, "lineitem")
    edges = lines.select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"))
    nodes = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id")).union(
        table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"))
    )
    return nodes, edges


SUPPLY = """e AS (SELECT DISTINCT 's' || l_suppkey AS source, 'p' || l_partkey AS target FROM lineitem),
    n AS (SELECT 's' || s_suppkey AS id FROM supplier UNION ALL SELECT 'p' || p_partkey FROM part),
    d AS (SELECT id, (SELECT count(*) FROM e WHERE target = id AND target IN (SELECT id FROM n)) AS indegree,
                 (SELECT count(*) FROM e WHERE source = id AND target IN (SELECT id FROM n)) AS outdegree FROM n)"""


@query(f"WITH {SUPPLY} SELECT id, indegree, outdegree FROM d")
def degrees(spark, sf):
    return G.degrees(*_supply(spark, sf))


@query(f"WITH {SUPPLY} SELECT id FROM d WHERE indegree = 0 AND outdegree = 0")
def orphans(spark, sf):
    return G.orphans(G.degrees(*_supply(spark, sf)))


@query(f"WITH {SUPPLY} SELECT id FROM d WHERE indegree = 0 AND outdegree > 0")
def no_backlinks(spark, sf):
    return G.no_backlinks(G.degrees(*_supply(spark, sf)))


@query(f"WITH {SUPPLY} SELECT id, indegree + outdegree AS degree FROM d WHERE indegree + outdegree >= 25")
def hubs(spark, sf):
    return G.hubs(G.degrees(*_supply(spark, sf)))


def _places(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Customers link to their nation, nations to their region."""
    customer, nation, region = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    edges = customer.select(F.concat(F.lit("c"), "c_custkey").alias("source"), F.concat(F.lit("n"), "c_nationkey").alias("target")).union(
        nation.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"))
    )
    nodes = customer.select(F.concat(F.lit("c"), "c_custkey").alias("id")).union(nation.select(F.concat(F.lit("n"), "n_nationkey"))).union(
        region.select(F.concat(F.lit("r"), "r_regionkey"))
    )
    return nodes, edges


PLACES = """m AS (SELECT 'c' || c_custkey AS id, n_regionkey AS region FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL
    SELECT 'n' || n_nationkey, n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, r_regionkey FROM region)"""


@query(f"WITH {PLACES} SELECT id, min(id) OVER (PARTITION BY region) AS cluster FROM m")
def clusters(spark, sf):
    return G.clusters(*_places(spark, sf))


@query(
    f"""WITH {PLACES}, o AS (SELECT 'c' || o_custkey AS id, max(epoch_ms(o_orderdate)) AS ts FROM orders GROUP BY 1),
        g AS (SELECT min(m.id) AS cluster, count(*) AS members, max(ts) AS newest FROM m LEFT JOIN o USING (id) GROUP BY region)
        SELECT * FROM g WHERE newest < epoch_ms(TIMESTAMP '{NOW}') - 180 * 86400000::BIGINT"""
)
def stale_clusters(spark, sf):
    times = table(spark, sf, "orders").groupBy(F.concat(F.lit("c"), "o_custkey").alias("id")).agg(F.max(F.unix_millis(F.col("o_orderdate").cast("timestamp"))).alias("ts_ms"))
    now = 1719792000000  # NOW in milliseconds
    return G.stale_clusters(G.clusters(*_places(spark, sf)), times, now, T.STALE_DAYS)


@query(
    f"""WITH {PLACES} SELECT count(*) AS nodes, (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) AS edges, 0::BIGINT AS broken, 0::BIGINT AS orphans FROM m"""
)
def graph_stats(spark, sf):
    nodes, edges = _places(spark, sf)
    return G.graph_stats(nodes, edges.withColumn("resolved", F.lit(True)), G.degrees(nodes, edges))


@query(
    """WITH e AS (SELECT 'c' || c_custkey AS source, 'n' || c_nationkey AS target FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)
        SELECT source || '->' || target || ':fk:' || (row_number() OVER (ORDER BY source, target) - 1) AS id, '  "' || source || '" -> "' || target || '";' AS line FROM e"""
)
def rendered_edges(spark, sf):
    edges = _places(spark, sf)[1].withColumns({"kind": F.lit("fk"), "resolved": F.lit(True)})
    ids = X.cytoscape_edges(edges).select("id", F.concat(F.lit('  "'), "source", F.lit('" -> "'), "target", F.lit('";')).alias("line"))
    return ids.join(X.dot_lines(edges), "line")


def _transitions(spark, sf) -> DataFrame:
    from pyspark.sql import Window

    step = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf, "events").select(F.col("event_type").alias("source"), step.alias("target"))
    return rows.where("target IS NOT NULL").distinct()


STEPS = """t AS (SELECT DISTINCT event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events),
    e AS (SELECT * FROM t WHERE target IS NOT NULL),
    r AS (SELECT source, target FROM e UNION SELECT r.source, e.target FROM r JOIN e ON r.target = e.source)"""


@query(f"WITH RECURSIVE {STEPS} SELECT a.source AS node, min(a.target) AS scc FROM r a JOIN r b ON a.source = b.target AND a.target = b.source GROUP BY a.source")
def strong_components(spark, sf):
    return G.strong_components(_transitions(spark, sf))


@query(
    f"""WITH RECURSIVE {STEPS}, c AS (SELECT a.source AS node, min(a.target) AS scc FROM r a JOIN r b ON a.source = b.target AND a.target = b.source GROUP BY a.source),
        i AS (SELECT ca.scc, e.source, e.target FROM e JOIN c ca ON e.source = ca.node JOIN c cb ON e.target = cb.node AND ca.scc = cb.scc),
        w AS (SELECT scc, min(target) AS node, [scc, min(target)] AS path FROM i WHERE source = scc GROUP BY scc
              UNION ALL SELECT w.scc, i.target, list_append(w.path, i.target) FROM w JOIN i ON i.scc = w.scc AND i.source = w.node
              WHERE w.node <> w.scc AND (i.target = w.scc OR NOT list_contains(w.path, i.target)))
        SELECT scc, array_to_string(arg_min(path, (len(path), path)), ' -> ') AS cycle FROM w WHERE node = scc GROUP BY scc"""
)
def representative_cycles(spark, sf):
    steps = _transitions(spark, sf)
    found = G.representative_cycles(steps, G.strong_components(steps))
    return found.select("scc", F.array_join("cycle", " -> ").alias("cycle"))


def _rings(spark, sf) -> DataFrame:
    """Parts in tens: each links to the next, and of every other ten the last links to the first."""
    part = table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("k"))
    name = lambda c: F.format_string("p%06d", c)
    ten, last = F.floor(F.col("k") / 10), F.col("k") % 10 == 9
    end = F.when(~last, F.col("k") + 1).when(ten % 2 == 0, ten * 10)
    return part.select(name(F.col("k")).alias("source"), name(end.cast("long")).alias("target"), end.alias("end")).where("end IS NOT NULL AND k > 9").drop("end")


@query(
    """WITH p AS (SELECT p_partkey AS k FROM part),
        e AS (SELECT k AS a, CASE WHEN k % 10 <> 9 THEN k + 1 WHEN k // 10 % 2 = 0 THEN k // 10 * 10 END AS b FROM p WHERE k > 9),
        known AS (SELECT a, b FROM e WHERE b IN (SELECT k FROM p))
        SELECT printf('p%06d', k::BIGINT) AS id FROM p WHERE k NOT IN (SELECT a FROM known UNION SELECT b FROM known)"""
)
def ring_orphans(spark, sf):
    """Parts that are in no chain and no ring."""
    nodes = table(spark, sf, "part").select(F.format_string("p%06d", F.col("p_partkey").cast("long")).alias("id"))
    return G.orphans(G.degrees(nodes, _rings(spark, sf)))


@query(
    """SELECT printf('p%09d', min(p_partkey)::BIGINT) AS scc, string_agg(printf('p%09d', p_partkey::BIGINT), ' -> ' ORDER BY p_partkey) || ' -> ' || printf('p%09d', min(p_partkey)::BIGINT) AS cycle
        FROM part GROUP BY p_partkey // 10000 HAVING count(*) > 1"""
)
def long_rings(spark, sf):
    """Parts in rings of ten thousand, beside as many orders in a chain that is no cycle."""
    name = lambda c: F.format_string("p%09d", c)
    part = table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("k"), F.expr("p_partkey div 10000").alias("ring"))
    ends = part.groupBy("ring").agg(F.min("k").alias("first"), F.max("k").alias("last")).where("first < last")
    after = F.when(F.col("k") == F.col("last"), F.col("first")).otherwise(F.col("k") + 1)
    ring = part.join(ends, "ring").select(name(F.col("k")).alias("source"), name(after).alias("target"))
    orders = numbered(table(spark, sf, "orders").select("o_orderkey"), [F.col("o_orderkey")])
    chain = orders.select(F.format_string("q%09d", "nth").alias("source"), F.format_string("q%09d", F.col("nth") + 1).alias("target"))
    edges = written(ring.union(chain), "edges")
    found = G.representative_cycles(edges, G.strong_components(edges))
    return found.select("scc", F.array_join("cycle", " -> ").alias("cycle"))


RINGS = "r AS (SELECT p_partkey AS k, p_partkey // 10 * 10 AS first FROM part WHERE p_partkey > 9 AND p_partkey // 10 % 2 = 0 AND p_partkey // 10 * 10 + 9 <= (SELECT max(p_partkey) FROM part))"


@query(f"WITH {RINGS} SELECT printf('p%06d', k::BIGINT) AS node, printf('p%06d', first::BIGINT) AS scc FROM r")
def ring_components(spark, sf):
    return G.strong_components(_rings(spark, sf))


@query(f"WITH {RINGS} SELECT printf('p%06d', first::BIGINT) AS scc, string_agg(printf('p%06d', k::BIGINT), ' -> ' ORDER BY k) || ' -> ' || printf('p%06d', first::BIGINT) AS cycle FROM r GROUP BY first")
def ring_cycles(spark, sf):
    rings = _rings(spark, sf)
    found = G.representative_cycles(rings, G.strong_components(rings))
    return found.select("scc", F.array_join("cycle", " -> ").alias("cycle"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (FROM orders WHERE o_custkey = c_custkey)")
def missing_sources(spark, sf):
    sourced = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(sourced, "c_custkey", "left_anti").select("c_custkey")


# ---- differences of snapshots and manifests -------------------------------------------------------


def _snapshots(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Documents before and after a move of other languages than English to folders and a trim of the English ones."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("n"), F.coalesce("text", F.lit("")).alias("text"), "lang")
    before = docs.select(F.concat(F.lit("doc/"), F.lpad("n", 12, "0")).alias("id"), F.sha2("text", 256).alias("content_hash"), F.length("text").alias("chars"))
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    folder = F.when(english, F.lit("doc")).otherwise(F.coalesce("lang", F.lit("none")))
    text = F.when(english, F.regexp_replace("text", r"\n[^\n]*\z", "")).otherwise(F.col("text"))
    after = docs.select(F.concat(folder, F.lit("/"), F.lpad("n", 12, "0")).alias("id"), F.sha2(text, 256).alias("content_hash"), F.length(text).alias("chars"))
    return before, after


CHANGES = r"""d AS (SELECT lpad(doc_id::VARCHAR, 12, '0') AS n, coalesce(text, '') AS text, coalesce(lang, 'none') AS lang FROM documents),
    b AS (SELECT 'doc/' || n AS id, sha256(text) AS h, length(text) AS chars FROM d),
    a AS (SELECT CASE WHEN lang = 'en' THEN 'doc/' ELSE lang || '/' END || n AS id, sha256(t) AS h, length(t) AS chars
          FROM (SELECT *, CASE WHEN lang = 'en' THEN regexp_replace(text, '\n[^\n]*\z', '') ELSE text END AS t FROM d)),
    gone AS (SELECT id, h, row_number() OVER (PARTITION BY h ORDER BY id) AS k FROM b WHERE id NOT IN (SELECT id FROM a)),
    come AS (SELECT id, h, row_number() OVER (PARTITION BY h ORDER BY id) AS k FROM a WHERE id NOT IN (SELECT id FROM b)),
    c AS (SELECT 'changed' AS change, id, NULL AS old_id, CASE WHEN a.chars <> b.chars THEN 'content_hash,chars' ELSE 'content_hash' END AS changed FROM a JOIN b USING (id) WHERE a.h <> b.h UNION ALL
          SELECT CASE WHEN come.id IS NULL THEN 'removed' WHEN gone.id IS NULL THEN 'added' ELSE 'renamed' END, coalesce(come.id, gone.id), CASE WHEN come.id IS NOT NULL THEN gone.id END, ''
          FROM gone FULL JOIN come ON gone.h = come.h AND gone.k = come.k)"""


@query(f"WITH {CHANGES} SELECT * FROM c")
def snapshot_diff(spark, sf):
    found = D.diff(*_snapshots(spark, sf), fields=["chars"])
    return found.withColumn("changed", F.array_join("changed", ","))


@query(f"""WITH {CHANGES} SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed,
    count(*) FILTER (change = 'renamed') AS renamed, count(*) FILTER (change = 'changed') AS changed FROM c""")
def diff_summary(spark, sf):
    return D.summary(D.diff(*_snapshots(spark, sf), fields=["chars"]))


@query(
    """WITH b AS (SELECT DISTINCT o_custkey AS id, o_orderpriority AS target FROM orders WHERE o_orderstatus = 'F'),
        a AS (SELECT DISTINCT o_custkey AS id, o_orderpriority AS target FROM orders WHERE o_orderstatus <> 'F'),
        ids AS (SELECT id FROM a INTERSECT SELECT id FROM b),
        plus AS (SELECT * FROM a EXCEPT SELECT * FROM b), minus AS (SELECT * FROM b EXCEPT SELECT * FROM a)
        SELECT id, coalesce((SELECT string_agg(target, ',' ORDER BY target) FROM plus p WHERE p.id = ids.id), '') AS added,
               coalesce((SELECT string_agg(target, ',' ORDER BY target) FROM minus m WHERE m.id = ids.id), '') AS removed
        FROM ids WHERE added <> '' OR removed <> ''"""
)
def link_changes(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderpriority").alias("target"), "o_orderstatus")
    found = D.link_changes(rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus <> 'F'"))
    return found.select("id", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))


@query(
    """WITH l AS (SELECT 'doc/' || doc_id || '.md' AS path, sha256(coalesce(text, '')) AS sha, 'doc/' || doc_id AS id FROM documents)
        SELECT substr(sha256(path), 1, 2) AS bucket, count(*) AS files,
               sha256('manifest-v1' || chr(10) || string_agg(path || chr(0) || sha || chr(0) || id || chr(10), '' ORDER BY path)) AS hash
        FROM l GROUP BY bucket"""
)
def manifest_hashes(spark, sf):
    number = F.col("doc_id").cast("string")
    files = table(spark, sf, "documents").select(
        F.concat(F.lit("doc/"), number, F.lit(".md")).alias("path"), F.col("text").alias("content"), F.concat(F.lit("doc/"), number).alias("id")
    )
    return P.manifest_hash(files, buckets_hex=2)


# ---- exports and the whole edge set -----------------------------------------------------------------


@query(
    f"""WITH {NAMES} SELECT id AS source, parent AS target, 'markdown-link' AS kind, 'its parent' AS label FROM n WHERE parent IS NOT NULL
        UNION ALL SELECT id, 'resource:db://' || folder || '/' || key, 'resource', 'db://' || folder || '/' || key FROM n
        UNION ALL SELECT id, 'tag:' || t, 'tag', t FROM (SELECT id, unnest([folder, 'generated']) AS t FROM n)"""
)
def edge_union(spark, sf):
    from loam.bundle import Bundle

    return Bundle(_generated(spark, sf), R.Config()).edges().select("source", "target", "kind", "label")


@query(
    f"""WITH {DIAGNOSTICS} SELECT code || ' ' || path AS key, '{{"ruleId":"' || code || '","level":"' || severity || '","uri":"' || path || '"}}' AS result
        FROM g WHERE severity IN ('error', 'warning')"""
)
def sarif_rows(spark, sf):
    found = R.lint(_document_context(spark, sf))
    rows = X.sarif_results(found).select(F.from_json("result", "ruleId string, level string, uri string").alias("r"))
    return rows.select(F.concat_ws(" ", "r.ruleId", "r.uri").alias("key"), F.to_json("r").alias("result"))


@query(
    """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS safe FROM pages"""
)
def escaped_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.escape_html(F.col("html")).alias("safe"))


@query(
    r"""SELECT doc_id, CASE WHEN b = '' THEN '' ELSE b || chr(10) END AS formatted FROM (
        SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n|\r', e'\n', 'g'), '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', e'\n\n', 'g'), '^\n+|\n+$', '', 'g') AS b
        FROM documents)"""
)
def formatted_documents(spark, sf):
    from loam.operators.formatting import formatted

    files = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return formatted(files).select(F.col("path").cast("long").alias("doc_id"), "formatted")


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM part")
def titles_from_paths(spark, sf):
    path = F.concat(F.lit("parts/"), F.regexp_replace("p_name", " ", "-"), F.lit(".md"))
    return table(spark, sf, "part").select("p_partkey", T.title_from_path(path).alias("title"))


ORACLE_SQL.update({name: _filled(sql) for name, sql in ORACLE_SQL.items()})
