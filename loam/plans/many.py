"""Registered queries over many bundles at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loam.bundles import Bundles
from loam.operators import rules as R
from loam.plans.catalogue import NAMES, NOW_MS, _defective_parts, _generated, _hub, query

#: Parts of a bundle.
EACH = 400


def _part_bundles(spark, sf) -> Bundles:
    """The defective concepts of :func:`loam.plans.catalogue._defective_parts`, a bundle for each 400 parts, each with its own hub."""
    files = _defective_parts(spark, sf)
    number = F.regexp_extract("path", "([0-9]+)", 1).try_cast("long")
    own = files.select(F.concat(F.lit("b"), F.floor(number / EACH).cast("string")).alias("bundle"), "path", "content")
    hubs = own.select("bundle").distinct().join(F.broadcast(_hub(spark))).select("bundle", "path", "content")  # one row
    return Bundles(own.union(hubs), R.Config(version="9.9", allow_hosts=("ok.example",), now_ms=NOW_MS))


PART_BUNDLES = f"""f AS (SELECT p_partkey AS k, p_partkey % 40 AS v, 'b' || (p_partkey // {EACH}) AS bundle, CASE p_partkey % 40 WHEN 18 THEN 'parts/P' WHEN 3 THEN 'parts/./p' ELSE 'parts/p' END || printf('%06d', p_partkey::BIGINT) || '.md' AS path FROM part),
    m AS (SELECT *, count(*) OVER (PARTITION BY bundle, v) AS same, v = 13 AND k + 1 NOT IN (SELECT k FROM f) AS broken FROM f),
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
    g AS (SELECT bundle, code, path FROM m JOIN r USING (v) WHERE (code NOT LIKE 'hygiene/duplicate-%' OR same > 1) AND NOT (broken AND code = 'graph/circular-reference')
        UNION ALL SELECT bundle, 'graph/broken-internal-link', path FROM m WHERE broken
        UNION ALL SELECT bundle, 'graph/no-backlinks', path FROM m WHERE v NOT IN (6, 10, 13, 14) OR broken
        UNION ALL SELECT bundle, 'graph/high-degree-hub', 'parts/hub.md' FROM m WHERE v NOT IN (6, 10) GROUP BY bundle HAVING count(*) >= 25
        UNION ALL SELECT DISTINCT bundle, 'agent/missing-index', NULL FROM m UNION ALL SELECT DISTINCT bundle, 'spec/unsupported-version', NULL FROM m)"""


@query(f"WITH {PART_BUNDLES} SELECT bundle, code, path FROM g")
def many_lint(spark, sf) -> DataFrame:
    """The doctor's diagnostics of all bundles in one job: titles, links, hubs and cycles count in their own bundle alone."""
    return _part_bundles(spark, sf).doctor()[0].select("bundle", "code", "path")


@query(
    f"""WITH {PART_BUNDLES}, points AS (SELECT bundle, code, CASE WHEN code LIKE 'spec/%' OR code IN ('security/suspicious-secret', 'security/private-key', 'security/non-allowlisted-resource') THEN 20
            WHEN code IN ('graph/orphan-concept', 'graph/no-backlinks', 'graph/high-degree-hub', 'agent/missing-summary', 'agent/missing-usage', 'agent/missing-owner', 'agent/api-missing-auth-notes') THEN 3
            ELSE 8 END AS lost FROM g)
        SELECT bundle, count(*) FILTER (lost = 20) AS error, count(*) FILTER (lost = 8) AS warning, count(*) FILTER (lost = 3) AS advice, greatest(0, 100 - sum(lost))::BIGINT AS score FROM points GROUP BY bundle"""
)
def many_scores(spark, sf) -> DataFrame:
    return _part_bundles(spark, sf).doctor()[1].select("bundle", "error", "warning", "advice", "score")


def _nation_bundles(spark, sf) -> Bundles:
    """A bundle for each nation: its own file and its suppliers', which link to it; all regions are in each, under the same paths."""
    parsed = _generated(spark, sf)
    up = F.regexp_extract("content", r"\.\./nation/([0-9]+)\.md", 1)
    suppliers = parsed.where("path LIKE 'supplier/%'").select(F.concat(F.lit("n"), up).alias("bundle"), "path", "content")
    nations = parsed.where("path LIKE 'nation/%'").select(F.concat(F.lit("n"), F.regexp_extract("path", "([0-9]+)", 1)).alias("bundle"), "path", "content")
    regions = parsed.where("path LIKE 'region/%'").select("path", "content")
    everywhere = nations.select("bundle").join(F.broadcast(regions)).select("bundle", "path", "content")  # five rows
    return Bundles(suppliers.union(nations).union(everywhere), R.Config())


NATION_BUNDLES = f"""{NAMES},
    b AS (SELECT 'n' || substr(CASE folder WHEN 'supplier' THEN parent ELSE id END, 8) AS bundle, id, parent FROM n WHERE folder <> 'region'
          UNION ALL SELECT 'n' || substr(n.id, 8), r.id, NULL FROM n, n r WHERE n.folder = 'nation' AND r.folder = 'region')"""


@query(f"WITH {NATION_BUNDLES} SELECT c.bundle, c.id, l.id AS source FROM b c LEFT JOIN b l ON l.bundle = c.bundle AND l.parent = c.id")
def many_backlinks(spark, sf) -> DataFrame:
    return _nation_bundles(spark, sf).backlinks().select("bundle", "id", "source")


@query(
    f"""WITH {NATION_BUNDLES}, top AS (SELECT bundle, parent AS region FROM b WHERE id LIKE 'nation/%')
        SELECT b.bundle, b.id, CASE WHEN b.id LIKE 'region/%' AND b.id <> region THEN b.id ELSE least('nation/' || substr(b.bundle, 2), region) END AS cluster FROM b JOIN top USING (bundle)"""
)
def many_clusters(spark, sf) -> DataFrame:
    return _nation_bundles(spark, sf).clusters().select("bundle", "id", "cluster")


@query(
    f"""WITH {NATION_BUNDLES} SELECT bundle, count(*) AS files, count(*) AS concepts, count(parent) AS links, 0::BIGINT AS broken_links FROM b GROUP BY bundle"""
)
def many_listed(spark, sf) -> DataFrame:
    return _nation_bundles(spark, sf).list().select("bundle", "files", "concepts", "links", "broken_links")


@query(
    f"""WITH {NATION_BUNDLES}, named AS (SELECT b.*, n.title FROM b JOIN n USING (id)),
        scored AS (SELECT bundle, id, 1 + (id LIKE 'supplier/%')::INT AS score FROM named)
        SELECT bundle, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY bundle ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= 10"""
)
def many_search(spark, sf) -> DataFrame:
    """Each bundle's best concepts for two words, of which one is a supplier's tag and the other everybody's."""
    return _nation_bundles(spark, sf).search("supplier generated").select("bundle", "id", "score", "rank")
