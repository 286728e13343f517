"""Any number of bundles at once: one table with a bundle column, one job for each question."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from loam.operators import diff as D, graph as G, parsing, rules as R, search as S
from loam.operators.scopes import SEPARATOR, bundle_of, scoped, within
from loam.session import written


def _split(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with the bundle of their first key as a column before the others, and keys as the bundle knows them."""
    rest = [within(F.col(c)).alias(c) if c in keys else F.col(c) for c in rows.columns if c != "bundle"]
    return rows.select(bundle_of(F.col(keys[0])).alias("bundle"), *rest)


@dataclass
class Bundles:
    """Bundles as rows of (bundle, path, content), under one configuration.

    Inside, a concept's id leads with its bundle's name, and so do titles, resources and hashes that are grouped, so that
    the operators on one bundle serve a million of them in the same few jobs; results have a ``bundle`` column and the ids that
    each bundle knows. A bundle may have any share of all rows: groups and joins are on scoped keys, never on the bundle alone, but for counts.
    Bundles without a name, or with the separator (U+001F) in it, are refused when rows are computed.
    """

    files: DataFrame
    config: R.Config

    @cached_property
    def parsed(self) -> DataFrame:
        """Parsed files, with scoped ids."""
        bad = F.col("bundle").isNull() | F.contains("bundle", F.lit(SEPARATOR))
        name = F.when(bad, F.raise_error(F.lit("a bundle needs a name without U+001F")).cast("string")).otherwise(F.col("bundle"))
        made = parsing.parse(self.files.withColumn("bundle", name), keep=("bundle",))
        return written(made.withColumn("id", scoped(F.col("bundle"), F.col("id"))), "parsed")

    @cached_property
    def links(self) -> DataFrame:
        return written(parsing.resolved_links(self.parsed, scope="bundle"), "links")

    @cached_property
    def context(self) -> R.Context:
        return R.Context(self.parsed, self.links, self.config, scope="bundle")

    @cached_property
    def names(self) -> DataFrame:
        return self.parsed.groupBy("bundle").agg(F.lit(1).alias("one")).select("bundle")

    def list(self) -> DataFrame:
        """(bundle, files, concepts, indexes, logs, links, broken_links, diagnostics): a row for each bundle."""
        return parsing.all_stats(self.parsed, self.links, by=("bundle",))

    def backlinks(self) -> DataFrame:
        return _split(G.backlinks(self.context.concepts, self.context.edges), "id", "source")

    def degrees(self) -> DataFrame:
        return _split(self.context.degree, "id")

    def clusters(self) -> DataFrame:
        return _split(G.clusters(self.context.concepts, self.context.concept_edges), "id", "cluster")

    def cycles(self) -> DataFrame:
        """(bundle, scc, cycle): a shortest cycle through each strong component's least concept."""
        found = G.representative_cycles(self.context.concept_edges, G.strong_components(self.context.concept_edges))
        return _split(found.withColumn("cycle", F.transform("cycle", within)), "scc")

    def lint(self, extra=None) -> DataFrame:
        """(bundle, code, severity, severity_rank, message, path, concept_id) of all bundles."""
        return _diagnosed(R.lint(self.context, extra))

    def doctor(self) -> tuple[DataFrame, DataFrame]:
        """The doctor's diagnostics, and a row of counts and score for each bundle."""
        found = _diagnosed(R.doctor_diagnostics(self.context))
        counts = self.names.join(R.severity_counts(found, by=("bundle",)), "bundle", "left").na.fill(0)
        return found, R.readiness(counts)

    def search(self, text: str, limit: int = 10) -> DataFrame:
        """(bundle, id, score, rank): the best concepts of each bundle that has any for a text."""
        words = F.concat_ws("\n", "title", "description", F.array_join("tags", " "), "body")
        pairs = S.terms(self.context.concepts.withColumn("words", words), "id", "words")
        pairs = pairs.select("id", scoped(bundle_of(F.col("id")), F.col("term")).alias("term"))
        wanted = S.terms(self.names.withColumn("text", F.lit(text)), "bundle", "text")
        wanted = wanted.select(F.col("id").alias("query"), scoped(F.col("id"), F.col("term")).alias("term"))
        found = S.best(pairs, wanted, S.checked_limit(limit), self.context.concepts.count())
        return found.select(F.col("query").alias("bundle"), within(F.col("id")).alias("id"), "score", "rank")

    def diff(self, before: Bundles) -> DataFrame:
        """(bundle, change, id, old_id, changed); a file that moved to another bundle is removed there and added here."""
        fields = ["title", "description", "type", "resource", "tags", "timestamp", "body"]
        own = lambda b: b.context.concepts.withColumn("content_hash", scoped(F.col("bundle"), F.col("content_hash")))
        return _split(D.diff(own(before), own(self), fields), "id", "old_id")


def _diagnosed(found: DataFrame) -> DataFrame:
    """Diagnostics with the bundle that their concept's scoped id names; those of a whole bundle have no concept."""
    named = F.nullif(within(F.col("concept_id")), F.lit(""))
    named = F.when(F.col("code") != "spec/invalid-frontmatter", named)
    return found.select(bundle_of(F.col("concept_id")).alias("bundle"), "code", "severity", "severity_rank", "message", "path", named.alias("concept_id"))
