"""One handle on a bundle: its parsed files, links and every query over them."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loam.operators import diff as D, exchange as X, formatting, graph as G, packing, parsing, rules as R, search as S
from loam.session import written
from loam.sources.bundle import EXCLUDED, read_bundle
from loam.sources.sink import write_files, write_pieces
from loam.sources.tree import read_files


#: Names of a bundle's configuration; the first that is there counts.
CONFIG_NAMES = ("loam.config.json", "loam.json", ".loam.json")


def find_config(root: str) -> str | None:
    return next((p for name in CONFIG_NAMES if os.path.isfile(p := os.path.join(root, name))), None)


def load_config(path: str) -> R.Config:
    """A configuration from a JSON file.

    Its settings are rules, presets, version, allowHosts, keyOrder, hubDegree, staleDays, include, exclude and failOn.
    """
    with open(path, encoding="utf-8") as f:
        raw: Mapping = json.load(f)
    names = {"allowHosts": "allow_hosts", "keyOrder": "key_order", "hubDegree": "hub_degree", "staleDays": "stale_days", "nowMs": "now_ms", "failOn": "fail_on"}
    known = set(R.Config.__dataclass_fields__)
    fields = {names.get(k, k): tuple(v) if isinstance(v, list) else v for k, v in raw.items()}
    if unknown := set(fields) - known:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return R.Config(**fields)


@dataclass
class Bundle:
    """Results are DataFrames; parsed files and links are written once and shared by all of them."""

    files: DataFrame
    config: R.Config

    @classmethod
    def load(cls, spark: SparkSession, root: str, config: R.Config | None = None, **options) -> Bundle:
        """The bundle in a folder, as its configuration's globs choose; options go to the source."""
        if config is None:
            path = None if "://" in root else find_config(root)
            config = load_config(path) if path else R.Config()
        globs = {"include": ",".join(config.include), "exclude": ",".join([EXCLUDED, *config.exclude])}
        return cls(read_bundle(spark, root, **{**globs, **options}), config)

    @cached_property
    def parsed(self) -> DataFrame:
        return written(parsing.parse(self.files), "parsed")

    @cached_property
    def links(self) -> DataFrame:
        return written(parsing.resolved_links(self.parsed), "links")

    @cached_property
    def context(self) -> R.Context:
        return R.Context(self.parsed, self.links, self.config)

    def stats(self) -> DataFrame:
        return parsing.all_stats(self.parsed, self.links)

    def failed(self) -> bool:
        """Whether lint finds anything as severe as the configuration's ``fail_on``."""
        return bool(R.exceeds(self.lint(), self.config.fails_on).first()["exceeds"])

    def nodes(self) -> DataFrame:
        return X.graph_nodes(self.parsed)

    def places(self) -> DataFrame:
        """Line, column and offset of every heading and link."""
        return parsing.located(self.files)

    def validate(self) -> DataFrame:
        """The diagnostics of the ``spec/`` rules; nothing else is built."""
        return R.ordered(R.lint(self.context, only=lambda code: code.startswith("spec/")))

    def lint(self, extra=None) -> DataFrame:
        return R.ordered(R.lint(self.context, extra))

    def doctor(self) -> tuple[DataFrame, DataFrame]:
        return R.doctor(self.context)

    def concept(self, id_: str) -> DataFrame:
        return self.parsed.where(F.col("id") == id_)

    def edges(self) -> DataFrame:
        """(source, target, kind, resolved, label): links, resources and tags of the concepts."""
        links = self.links.where("kind = 'internal'").select(
            "source", F.coalesce("target", "target_raw").alias("target"), F.lit("markdown-link").alias("kind"), "resolved", F.col("text").alias("label")
        )
        for column, kind in (("resource", "resource"), ("tags", "tag")):
            values = F.array_distinct(F.filter(F.transform(column, lambda v: F.trim(v)), lambda v: v != ""))
            rows = self.context.concepts.select(F.col("id").alias("source"), F.explode(values).alias("label"))
            links = links.unionByName(
                rows.select("source", F.concat(F.lit(f"{kind}:"), "label").alias("target"), F.lit(kind).alias("kind"), F.lit(True).alias("resolved"), "label")
            )
        return links

    def neighbors(self, id_: str) -> DataFrame:
        """(direction, id): what a concept points to, tags and resources included, and what links to it."""
        edges = self.edges().where("resolved")
        out = edges.where(F.col("source") == id_).select(F.lit("out").alias("direction"), F.col("target").alias("id"))
        return out.union(edges.where(F.col("target") == id_).select(F.lit("in"), "source")).distinct()

    def backlinks(self) -> DataFrame:
        return G.backlinks(self.context.concepts, self.context.edges)

    def clusters(self, reserved: bool = False) -> DataFrame:
        """(id, cluster) of the concepts; with ``reserved`` also of the indexes and logs that a cluster reaches, which bridge none."""
        found = G.clusters(self.context.concepts, self.context.concept_edges)
        if not reserved:
            return found
        found = written(found, "clusters")
        return found.union(G.reserved_members(found, self.parsed.where("kind <> 'concept'"), self.context.edges))

    def search(self, text: str, limit: int = 10) -> DataFrame:
        """(id, score, rank, path, title, description, type) of the best concepts for a text; a text without terms lists them by id."""
        S.checked_limit(limit)
        spark = self.parsed.sparkSession
        asked = spark.createDataFrame([(0, text)], "q int, text string")
        fields = self.context.concepts.select("id", "path", "title", "description", "type")
        if not S.terms(asked, "q", "text").limit(1).count():
            listed = fields.select("id").orderBy("id").limit(limit)
            found = listed.select("id", F.lit(1).cast("long").alias("score"), F.row_number().over(Window.orderBy("id")).alias("rank"))  # at most fifty rows
        else:
            words = F.concat_ws("\n", "title", "description", F.array_join("tags", " "), "body")
            pairs = S.terms(self.context.concepts.withColumn("words", words), "id", "words")
            found = S.search(pairs, asked, "q", "text", limit, fields.count()).drop("query")
        return found.join(fields, "id").orderBy("rank")

    def diff(self, before: Bundle) -> DataFrame:
        fields = ["title", "description", "type", "resource", "tags", "timestamp", "body"]
        return D.diff(before.context.concepts, self.context.concepts, fields)

    def changes(self, before: Bundle) -> DataFrame:
        """What differs in the concepts of both bundles, key by key and link by link."""
        refs = [b.links.select("source", F.coalesce("target", "target_raw").alias("target")) for b in (before, self)]
        return D.concept_changes(before.context.concepts, self.context.concepts, *refs)

    def readiness_change(self, before: Bundle) -> DataFrame:
        return D.readiness_change(before.doctor()[1], self.doctor()[1])

    def formatted(self) -> DataFrame:
        return formatting.formatted(self.files, self.config.key_order)

    def format_files(self, root: str, check: bool = False, mounted: bool = False) -> DataFrame:
        """(path, size) of the files that formatting changes, written in their places below ``root``; with ``check`` only named."""
        changed = self.formatted().where("changed").select("path", F.col("formatted").alias("content"))
        if check:
            return changed.select("path", F.octet_length("content").cast("long").alias("size"))
        return write_files(changed, root, replace=True, mounted=mounted)

    def write_site(self, root: str, title: str = "Bundle", replace: bool = False, mounted: bool = False) -> DataFrame:
        """(path, size) of a static site: a page for each concept, an index in order of id, and the graph as JSON."""
        concepts = self.context.concepts
        pages = X.site_pages(concepts, self.edges().where("resolved AND kind = 'markdown-link'"))
        written_pages = write_files(pages.select("path", F.col("html").alias("content")), root, replace, mounted)
        pieces = X.site_index_pieces(concepts, self.stats(), title).union(X.graph_json(self.nodes(), self.edges()))
        return written_pages.union(write_pieces(pieces, ["part", "key"], root, replace, mounted))

    def write_reports(self, root: str, replace: bool = False, mounted: bool = False) -> DataFrame:
        """(path, size) of graph.json, graph.dot, graph.html and diagnostics.sarif, each of them one task's stream of sorted rows."""
        edges, nodes = self.edges(), self.nodes()
        dot = X.dot_lines(edges).select(F.lit(1).alias("part"), F.col("line").alias("key"), F.concat("line", F.lit("\n")).alias("text"))
        ends = self.parsed.sparkSession.createDataFrame([(0, "", "digraph bundle {\n"), (2, "", "}\n")], "part int, key string, text string")
        html = X.graph_html(self.stats(), nodes, edges.where("resolved")).select("part", F.col("line").alias("key"), F.concat("line", F.lit("\n")).alias("text"))
        sarif = X.sarif_run(self.lint()).select(F.lit(0).alias("part"), F.lpad(F.col("nth").cast("string"), 20, "0").alias("key"), F.concat("line", F.lit("\n")).alias("text"))
        pieces = X.graph_json(nodes, edges)
        for path, rows in (("graph.dot", ends.union(dot)), ("graph.html", html), ("diagnostics.sarif", sarif)):
            pieces = pieces.union(rows.select(F.lit(path).alias("path"), "part", "key", "text"))
        return write_pieces(pieces, ["part", "key"], root, replace, mounted)

    def package(self, root: str, out: str | None = None, mounted: bool = False) -> tuple[DataFrame, DataFrame]:
        """((path, content) of what a package of the tree takes, the manifest's row): all its files but the sensitive ones, as bytes."""
        listed = packing.pack_listing(self.parsed.sparkSession, root, self.config.exclude, out, mounted)
        files = packing.packable(read_files(listed, root, binary=True))
        return files, self.manifest(files)

    def manifest(self, files: DataFrame | None = None) -> DataFrame:
        """One row (files, hash) over what a package may hold: the bundle's files, or ``files`` (path, content) of all kinds."""
        with_id = packing.packable(self.files if files is None else files).join(self.parsed.select("path", "id"), "path", "left")
        return packing.manifest_tree(with_id)
