"""Imports of metadata as Markdown files, and exports of graphs, diagnostics and sites as text rows.

Imports take tables with the metadata's fields, or JSON documents as they are; wrong input is an error
that names the field, raised when the rows are computed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from loam.functions.paths import concept_path, identity_hash, path_key
from loam.functions.text import ascii_slug, blank, escape_html, escape_markdown_text, json_text, spaced_code_span
from loam.operators.ordinals import numbered
from loam.session import written

# The methods of an HTTP interface that operations are read of.
METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")


def _stamp(now: str | None) -> Column:
    return F.lit(now) if now else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _front(kind: str, title: Column, description: Column, tags: Sequence[Column | str], now: str | None, resource: Column | None = None) -> Column:
    fields = [F.lit("---"), F.lit(f"type: {kind}"), F.concat(F.lit("title: "), json_text(title)), F.concat(F.lit("description: "), json_text(description))]
    if resource is not None:
        fields.append(F.concat(F.lit("resource: "), json_text(resource)))
    listed = [F.concat(F.lit("  - "), F.lit(t) if isinstance(t, str) else t) for t in tags]
    return _lines(*fields, "tags:", *listed, F.concat(F.lit("timestamp: "), _stamp(now)), "---", "")


def _required(value: Column, what: str) -> Column:
    """The value, or an error where it is null or blank."""
    return F.when(blank(value), F.raise_error(F.lit(f"{what} must be a text that isn't empty")).cast("string")).otherwise(value)


def table_concepts(tables: DataFrame, now: str | None = None) -> DataFrame:
    """(path, content, identity) from (project, dataset, table, description, columns array<struct<name,type,description>>)."""
    project, dataset, table = (_required(F.col(c), f"a table's {c}") for c in ("project", "dataset", "table"))
    rows = tables.select(project.alias("project"), dataset.alias("dataset"), table.alias("table"), "description", "columns")
    given = lambda c: F.coalesce(c != "", F.lit(False))
    lines = F.transform(
        "columns",
        lambda c: F.concat(
            F.lit("- "), spaced_code_span(c["name"]),
            F.when(given(c["type"]), F.concat(F.lit(" ("), escape_markdown_text(c["type"]), F.lit(")"))).otherwise(""),
            F.when(given(c["description"]), F.concat(F.lit(": "), escape_markdown_text(c["description"]))).otherwise(""),
        ),
    )
    name, identity = F.concat_ws(".", "dataset", "table"), F.concat(F.lit("bigquery://"), F.concat_ws("/", "project", "dataset", "table"))
    listing = F.when(F.size("columns") > 0, F.array_join(lines, "\n")).otherwise("No columns provided.")
    front = _front("Table", name, F.coalesce("description", F.lit("Imported from BigQuery metadata.")), ["imported", "bigquery"], now, identity)
    content = _lines(front, F.concat(F.lit("# "), escape_markdown_text(name)), "", "## Columns", "", listing, "")
    path = F.concat(F.lit("tables/"), ascii_slug(F.concat_ws("-", "dataset", "table"), "table"), F.lit(".md"))
    return rows.select(path.alias("path"), content.alias("content"), identity.alias("identity"))


def model_concepts(manifest: DataFrame, now: str | None = None) -> DataFrame:
    """(path, content, identity) of the models in a manifest: (id, node struct<resource_type,name,description,depends_on>)."""
    models = manifest.where("node.resource_type = 'model'")
    needs = F.coalesce("node.depends_on.nodes", F.array().cast("array<string>"))
    listing = F.when(F.size(needs) > 0, F.array_join(F.transform(needs, lambda n: F.concat(F.lit("- "), escape_markdown_text(n))), "\n"))
    title = F.coalesce("node.name", F.lit("dbt model"))
    front = _front("Table", title, F.coalesce("node.description", F.lit("Imported from dbt manifest.")), ["imported", "dbt"], now)
    listing = F.coalesce(listing, F.lit("No upstream dbt dependencies declared."))
    content = _lines(front, F.concat(F.lit("# "), escape_markdown_text(title)), "", "## Source Tables", "", listing, "")
    path = F.concat(F.lit("tables/"), ascii_slug(F.coalesce("node.name", F.lit("model")), "model"), F.lit(".md"))
    return models.select(path.alias("path"), content.alias("content"), F.col("id").alias("identity"))


def manifest_nodes(documents: DataFrame) -> DataFrame:
    """(id, node) of dbt manifests, from (content) rows of whole JSON texts."""
    node = "struct<resource_type: string, name: string, description: string, depends_on: struct<nodes: array<string>>>"
    nodes = _object(documents, "nodes", "a dbt manifest")
    rows = nodes.select(F.explode("entries").alias("id", "text"))
    return rows.select("id", _typed(F.col("text"), node, ("resource_type", "name", "description"), "a dbt node").alias("node"))


def route_concepts(spec: DataFrame, now: str | None = None) -> DataFrame:
    """(path, content, identity) of (route, method, operation struct<operationId,summary,description>[, description])."""
    rows = spec.where(F.lower("method").isin(*METHODS))
    made = F.regexp_replace(F.regexp_replace(F.concat_ws("-", "method", "route"), "[^a-zA-Z0-9]+", "-"), "^-|-$", "")
    title = F.coalesce("operation.summary", F.concat_ws(" ", F.upper("method"), "route"))
    about = [F.col("description")] if "description" in spec.columns else []
    front = _front("API", title, F.coalesce("operation.description", *about, F.lit("Imported from OpenAPI.")), ["imported", "openapi"], now)
    content = _lines(
        front, F.concat(F.lit("# "), escape_markdown_text(title)), "", "## Usage", "",
        F.concat(F.lit("- Method: "), spaced_code_span(F.upper("method"))), F.concat(F.lit("- Path: "), spaced_code_span(F.col("route"))),
        "", "## Auth Notes", "", "Document authentication requirements before publishing.", "",
    )
    path = F.concat(F.lit("apis/"), ascii_slug(F.coalesce("operation.operationId", made), "operation"), F.lit(".md"))
    return rows.select(path.alias("path"), content.alias("content"), F.concat_ws(" ", F.lower("method"), "route").alias("identity"))


def specification_routes(documents: DataFrame) -> DataFrame:
    """(route, method, operation, description) of OpenAPI documents, from (content) rows of whole JSON texts."""
    operation = "struct<operationId: string, summary: string, description: string>"
    about = F.get_json_object("content", "$.info.description").alias("description")
    paths = _object(documents.select("content", about), "paths", "an OpenAPI document", "description")
    routes = paths.select("description", F.explode("entries").alias("route", "text"))
    methods = routes.select("description", "route", _entries(F.col("text"), "an OpenAPI path item").alias("methods"))
    rows = methods.select("description", "route", F.explode("methods").alias("method", "text")).where(F.lower("method").isin(*METHODS))
    read = _typed(F.col("text"), operation, ("operationId", "summary", "description"), "an OpenAPI operation")
    return rows.select("route", "method", read.alias("operation"), "description")


def _entries(text: Column, what: str) -> Column:
    """A JSON object's entries, each value as JSON text; an error for anything else."""
    found = F.from_json(text, "map<string,string>")
    fits = F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))
    return F.when(fits, found).otherwise(F.raise_error(F.lit(f"{what} must be an object")).cast("map<string,string>"))


def _object(documents: DataFrame, field: str, what: str, *keep: str) -> DataFrame:
    """(entries, keep): the entries of an object in each document's JSON; none where the field is absent."""
    inner = F.try_element_at(_entries(F.col("content"), what), F.lit(field))
    entries = F.when(inner.isNull(), F.from_json(F.lit("{}"), "map<string,string>")).otherwise(_entries(inner, f"{field} of {what}"))
    return documents.select(*keep, entries.alias("entries"))


def _typed(text: Column, schema: str, texts: Sequence[str], what: str) -> Column:
    """A JSON object by a schema, with an error where one of ``texts`` is there and no text."""
    value = F.try_parse_json(text)
    kinds = {t: F.schema_of_variant(F.try_variant_get(value, f"$.{t}", "variant")) for t in texts}
    wrong = F.coalesce(*[F.when(~kind.isin("STRING", "VOID"), F.lit(t)) for t, kind in kinds.items()])
    fits = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    error = F.raise_error(F.concat(F.lit(f"{what} must be an object with texts: "), F.coalesce(wrong, F.lit("itself")))).cast(schema)
    return F.when(fits & wrong.isNull(), F.from_json(text, schema)).otherwise(error)


def dataset_concepts(datasets: DataFrame, now: str | None = None) -> DataFrame:
    """(path, content, identity) of (urn, name, description, platform)."""
    rows = datasets.select(_required(F.col("urn"), "a dataset's urn").alias("urn"), "name", "description", "platform")
    title = F.coalesce("name", "urn")
    tags = ["imported", "datahub", json_text(ascii_slug(F.coalesce("platform", F.lit("dataset")), "dataset"))]
    front = _front("Dataset", title, F.coalesce("description", F.lit("Imported from DataHub metadata.")), tags, now, F.col("urn"))
    content = _lines(front, F.concat(F.lit("# "), escape_markdown_text(title)), "", F.concat(F.lit("DataHub URN: "), spaced_code_span(F.col("urn"))), "")
    path = F.concat(F.lit("catalog/"), ascii_slug(title, "dataset"), F.lit(".md"))
    return rows.select(path.alias("path"), content.alias("content"), F.col("urn").alias("identity"))


def note_concepts(sources: DataFrame, now: str | None = None) -> DataFrame:
    """(path, content, identity) of Markdown texts: (path, title, body, tags). Paths are made portable and must stay relative."""
    name = F.regexp_replace(F.element_at(F.filter(F.split(F.replace(F.col("path"), F.lit("\\"), F.lit("/")), "/"), lambda p: p != ""), -1), r"(?i)\.md$", "")
    title = F.coalesce("title", F.regexp_replace(F.initcap(F.regexp_replace(name, "[-_.]+", " ")), "^ | $", ""))
    tags = F.coalesce("tags", F.array(F.lit("imported")))
    listed = F.when(F.size(tags) == 0, "tags: []").otherwise(
        F.concat(F.lit("tags:\n"), F.array_join(F.transform(tags, lambda t: F.concat(F.lit("  - "), json_text(t))), "\n"))
    )
    about = F.concat(F.lit("Imported from "), "path", F.lit("."))
    content = _lines(
        "---", "type: Note", F.concat(F.lit("title: "), json_text(title)), F.concat(F.lit("description: "), json_text(about)), listed,
        F.concat(F.lit("timestamp: "), _stamp(now)), "---", "", F.coalesce("body", F.lit("")), "",
    )
    return sources.select(concept_path("path").alias("path"), content.alias("content"), F.col("path").alias("identity"))


def disambiguated(files: DataFrame) -> DataFrame:
    """(path, content, identity) with paths that no file system confuses.

    Paths that are the same but for case or composition each get a hash of their file's identity, and
    where that meets another path, a number as well. Equal identities of one path are an error.
    """
    keyed = written(files.withColumn("key", path_key("path")).withColumn("hash", identity_hash("identity")), "generated")
    counts = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "keys")
    same = keyed.join(counts.where("n > 1").select("key"), "key", "left_semi")
    twice = same.groupBy("key", "identity").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"generated files share the path {twice[0]['path']!r} and the identity {twice[0]['identity']!r}")
    done = keyed.join(counts.where("n = 1").select("key"), "key", "left_semi").select("key", *files.columns)
    stem, end = F.regexp_extract("path", r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract("path", r"^(.*?)(\.[^./]*)?$", 2)
    left = same.withColumn("attempt", F.lit(1))
    while left.limit(1).count():  # again only where a suffixed path is taken
        number = F.when(F.col("attempt") > 1, F.concat(F.lit("-"), F.col("attempt").cast("string"))).otherwise("")
        tried = written(left.withColumn("new", F.concat(stem, F.lit("-"), "hash", number, end)).withColumn("new_key", path_key("new")), "tried")
        first = F.row_number().over(Window.partitionBy("new_key").orderBy("key", "identity"))
        free = tried.join(done.select(F.col("key").alias("new_key")), "new_key", "left_anti").withColumn("nth", first).where("nth = 1")
        free = written(free.select("new_key", "key", "identity", "new", *[c for c in files.columns if c not in ("path", "identity")]), "free")
        named = free.select(F.col("new_key").alias("key"), *[F.col("new").alias("path") if c == "path" else F.col(c) for c in files.columns])
        done = written(done.union(named), "done")
        left = tried.join(free.select("key", "identity"), ["key", "identity"], "left_anti").drop("new", "new_key").withColumn("attempt", F.col("attempt") + 1)
    return done.select(*files.columns)


def graph_nodes(parsed: DataFrame) -> DataFrame:
    """(id, path, type, title, tags) of all files; indexes and logs have their kind as type and title."""
    kind = F.initcap("kind")
    own = F.col("kind") == "concept"
    return parsed.select(
        "id", "path", F.when(own, F.col("type")).otherwise(kind).alias("type"), F.when(own, F.col("title")).otherwise(kind).alias("title"), F.when(own, F.col("tags")).alias("tags")
    )


def cytoscape_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label, type, path, tags) of the nodes, and of each edge's target that is none, as its first edge has it."""
    known = nodes.select("id", F.coalesce("title", "id").alias("label"), "type", "path", "tags")
    others = edges.join(nodes.select(F.col("id").alias("target")), "target", "left_anti")
    label = F.coalesce("label", F.regexp_replace("target", "^(?:resource|tag):", ""))
    kind = F.when(F.col("resolved"), F.col("kind")).otherwise("Unresolved")
    first = others.groupBy(F.col("target").alias("id")).agg(F.min(F.struct("source", "kind", label.alias("label"), kind.alias("type"))).alias("e"))
    none = F.lit(None)
    return known.union(first.select("id", "e.label", "e.type", none.cast("string"), none.cast("array<string>"))).orderBy("id")


def dot_lines(edges: DataFrame) -> DataFrame:
    quote = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, r"([\\\"])", r"\\$1"), F.lit('"'))
    return edges.where("resolved").select(F.concat(F.lit("  "), quote(F.col("source")), F.lit(" -> "), quote(F.col("target")), F.lit(";")).alias("line"))


def cytoscape_edges(edges: DataFrame) -> DataFrame:
    """(id, source, target, kind, label, resolved): an edge's id ends in its number among all edges.

    Edges are numbered from 0 in order of source, target, kind and label, by ranges of that order. An edge without label or
    ``resolved`` has nulls there.
    """
    have = {c: F.col(c) if c in edges.columns else F.lit(None).cast(t) for c, t in (("label", "string"), ("resolved", "boolean"))}
    rows = edges.select("source", "target", "kind", *[v.alias(c) for c, v in have.items()])
    found = numbered(rows, [F.col("source"), F.col("target"), F.col("kind"), F.asc_nulls_first("label"), F.asc_nulls_first("resolved")], "number", "edges")
    id_ = F.concat("source", F.lit("->"), "target", F.lit(":"), "kind", F.lit(":"), F.col("number").cast("string"))
    return found.select(id_.alias("id"), "source", "target", "kind", "label", "resolved")


def graph_json(nodes: DataFrame, edges: DataFrame, path: str = "graph.json") -> DataFrame:
    """(path, part, key, text): a graph as one JSON document in pieces, a line for each node and edge, for ``write_pieces``.

    The nodes come in order of their ids, then the edges in order of theirs. An element's comma stands before it, so that only the
    first of each list differs: it is the one without a predecessor, found as the least key.
    """
    spark = nodes.sparkSession

    def listed(rows: DataFrame, part: int, key: str) -> DataFrame:
        least = F.broadcast(rows.agg(F.min(key).alias("least_")))  # one row
        comma = F.when(F.col(key) == F.col("least_"), F.lit("\n")).otherwise(F.lit(",\n"))
        return rows.join(least).select(F.lit(part).alias("part"), F.col(key).alias("key"), F.concat(comma, F.to_json(F.struct(*rows.columns))).alias("text"))

    fixed = spark.createDataFrame([(0, "", '{"nodes":['), (2, "", '\n],"edges":['), (4, "", "\n]}\n")], "part int, key string, text string")
    found = fixed.union(listed(nodes.select("id", "path", "type", "title", "tags"), 1, "id"))
    found = found.union(listed(cytoscape_edges(edges), 3, "id"))
    return found.select(F.lit(path).alias("path"), "part", "key", "text")


def sarif_results(diagnostics: DataFrame) -> DataFrame:
    """(result): a SARIF result object for each diagnostic, as JSON; its URI is escaped."""
    level = F.when(F.col("severity") == "error", "error").when(F.col("severity") == "warning", "warning").otherwise("note")
    uri = F.replace(F.replace(F.url_encode("path"), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20"))
    return diagnostics.select(
        F.to_json(F.struct(F.col("code").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), uri.alias("uri"))).alias("result")
    )


def sarif_run(diagnostics: DataFrame, tool: str = "loam") -> DataFrame:
    """(ordinal, line): the lines of a SARIF log, to be written in order; its results are a line each."""
    rules = diagnostics.select("code").distinct().agg(F.array_sort(F.collect_list("code")).alias("codes"))  # as many as there are rules
    head = rules.select(
        F.concat(
            F.lit('{"version":"2.1.0","runs":[{"tool":{"driver":'),
            F.to_json(F.struct(F.lit(tool).alias("name"), F.transform("codes", lambda c: F.struct(c.alias("id"))).alias("rules"))),
            F.lit('},"results":['),
        ).alias("line")
    )
    rows = written(sarif_results(diagnostics).withColumn("nth", F.monotonically_increasing_id() + 1), "sarif")
    first = F.broadcast(rows.agg(F.min("nth").alias("first")))  # one row
    lines = rows.join(first).select("nth", F.concat(F.when(F.col("nth") > F.col("first"), ",").otherwise(""), "result").alias("line"))
    end = diagnostics.sparkSession.range(1).select(F.lit((1 << 63) - 1).alias("nth"), F.lit("]}]}").alias("line"))
    return head.select(F.lit(0).cast("long").alias("nth"), "line").union(lines).union(end)


def graph_html(stats: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ordinal, line): a page with a graph's counts, nodes and edges, to be written in order of (part, line)."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    counts = stats.select(F.lit(0).alias("part"), F.concat(F.lit("<!doctype html><h1>Graph</h1><p>"), safe(F.to_json(F.struct("*"))), F.lit("</p>")).alias("line"))
    own = nodes.select(F.lit(1), F.concat(F.lit("<pre>"), safe(F.col("id")), F.lit("</pre>")))
    arrows = edges.select(F.lit(2), F.concat(F.lit("<pre>"), safe(F.concat("source", F.lit(" -> "), "target")), F.lit("</pre>")))
    return counts.union(own).union(arrows)


def site_pages(concepts: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(path, html): a page for each concept, with its links to other pages where ``links`` (source, target) is given, and an index."""
    title = F.coalesce("title", "id")
    rows = concepts.select("id", title.alias("title"), F.coalesce("description", F.lit("")).alias("description"), "body")
    if links is not None:
        pages = rows.select(F.col("id").alias("target"), F.col("title").alias("name"))
        item = F.concat(F.lit('<li><a href="'), F.repeat(F.lit("../"), F.size(F.split("source", "/")) - 1), escape_html(F.col("target")), F.lit('.html">'), escape_html(F.col("name")), F.lit("</a></li>"))
        listed = links.select("source", "target").distinct().join(pages, "target").select(F.col("source").alias("id"), item.alias("item"))
        listed = listed.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("item")), "").alias("items"))
        rows = rows.join(listed, "id", "left")
    else:
        rows = rows.withColumn("items", F.lit(None).cast("string"))
    more = F.when(F.col("items").isNotNull(), F.concat(F.lit("<ul>"), "items", F.lit("</ul>"))).otherwise("")
    html = F.concat(
        F.lit('<!doctype html><html><head><meta charset="utf-8"><title>'), escape_html(F.col("title")), F.lit("</title></head><body><h1>"), escape_html(F.col("title")),
        F.lit("</h1><p>"), escape_html(F.col("description")), F.lit("</p><pre>"), escape_html(F.col("body")), F.lit("</pre>"), more, F.lit("</body></html>"),
    )
    return rows.select(F.concat("id", F.lit(".html")).alias("path"), html.alias("html"))


def site_index(concepts: DataFrame) -> DataFrame:
    """(id, line): the index page's entries, a line for each concept, to be written in order of id."""
    title = F.coalesce("title", "id")
    return concepts.select("id", F.concat(F.lit('<li><a href="'), escape_html(F.col("id")), F.lit('.html">'), escape_html(title), F.lit("</a></li>")).alias("line"))


def site_index_pieces(concepts: DataFrame, stats: DataFrame, title: str, path: str = "index.html") -> DataFrame:
    """(path, part, key, text): the index page of a site in pieces, for ``write_pieces``: counts of the bundle, then a line for each concept."""
    name = escape_html(F.lit(title))
    counts = F.concat(*[F.concat(F.lit(f"<dt>{what}</dt><dd>"), F.col(c).cast("string"), F.lit("</dd>")) for what, c in (("Concepts", "concepts"), ("Links", "links"), ("Broken links", "broken_links"))])
    head = F.concat(F.lit('<!doctype html><html><head><meta charset="utf-8"><title>'), name, F.lit("</title></head><body><h1>"), name, F.lit("</h1><dl>"), counts, F.lit("</dl><ul>\n"))
    lines = site_index(concepts).select(F.lit(1), F.col("id"), F.concat("line", F.lit("\n")))
    end = concepts.sparkSession.createDataFrame([(2, "", "</ul></body></html>\n")], "part int, key string, text string")
    return stats.select(F.lit(0).alias("part"), F.lit("").alias("key"), head.alias("text")).union(lines).union(end).select(F.lit(path).alias("path"), "part", "key", "text")
