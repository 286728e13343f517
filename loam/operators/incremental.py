"""Reuse of parsed files: only what changed since a kept table is parsed again."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loam.functions.text import content_hash
from loam.operators.parsing import parse
from loam.session import discard, written

#: Changes when parsing gives other columns or values.
PARSER_VERSION = "2"


def parser_key(settings: Mapping | None = None) -> str:
    """What a kept row depends on beside its file: this parser's version, and settings such as the bundle's version."""
    text = json.dumps(dict(settings or {}), sort_keys=True, default=str)
    return PARSER_VERSION if text == "{}" else f"{PARSER_VERSION}:{hashlib.sha256(text.encode()).hexdigest()[:16]}"


def cache_states(files: DataFrame, kept: DataFrame, settings: Mapping | None = None) -> DataFrame:
    """(path, state) of (path, content) against ``kept``, a parsed table with a ``parser`` column.

    States are hit, new (no row of the path), content and parser (a row of another content, or by another
    parser or settings), and gone for kept paths without a file.
    """
    hashed = files.select("path", content_hash(F.coalesce("content", F.lit(""))).alias("now"))
    both = hashed.join(kept.select("path", F.col("content_hash").alias("was"), "parser"), "path", "full_outer")
    state = (
        F.when(F.col("now").isNull(), "gone").when(F.col("was").isNull(), "new").when(F.col("was") != F.col("now"), "content")
        .when(F.col("parser") != parser_key(settings), "parser").otherwise("hit")
    )
    return both.select("path", state.alias("state"))


def stale_files(files: DataFrame, kept: DataFrame, settings: Mapping | None = None) -> DataFrame:
    """The (path, content) rows that ``kept``, a parsed table with a ``parser`` column, has no current row for."""
    hashed = files.withColumn("content_hash", content_hash(F.coalesce("content", F.lit(""))))
    current = kept.where(F.col("parser") == parser_key(settings)).select("path", "content_hash")
    return hashed.join(current, ["path", "content_hash"], "left_anti").select("path", "content")


def refreshed(files: DataFrame, kept: DataFrame, settings: Mapping | None = None) -> DataFrame:
    """The parsed table of ``files``: rows of ``kept`` where path, content, parser and settings are the same, others parsed."""
    key = parser_key(settings)
    hashed = files.select("path", content_hash(F.coalesce("content", F.lit(""))).alias("content_hash"))
    same = kept.where(F.col("parser") == key).join(hashed, ["path", "content_hash"], "left_semi")
    made = parse(stale_files(files, kept, settings)).withColumn("parser", F.lit(key))
    return same.select(*made.columns).unionByName(made)


#: Digits of a path's hash that name its shard.
SHARD_DIGITS = 2
#: Changes when a kept row has other columns.
CACHE_SCHEMA = 1
KEY_PARTS = ("tool_version", "config_hash", "path", "content_hash", "parser_version", "rule_version")


class ParseCache:
    """Parsed files in shards on disk, of which a refresh rewrites those alone in which something changed.

    A row is kept under six parts: the tool's version, a hash of the configuration, path and content hash, and the versions
    of parser and rules. Shards are folders by the first digits of the path's hash, so a file's next row takes the
    place of its last. What a lost write leaves out is a miss and parsed again.
    """

    def __init__(self, spark: SparkSession, path: str, config: Mapping | None = None, tool_version: str = "1", rule_version: str = "1") -> None:
        self.spark, self.path = spark, path.rstrip("/")
        text = json.dumps(dict(config or {}), sort_keys=True, default=str)
        self.parts = {"tool_version": tool_version, "config_hash": hashlib.sha256(text.encode()).hexdigest(), "parser_version": PARSER_VERSION, "rule_version": rule_version}

    def _files(self):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def shards(self) -> list[str]:
        """The shards that there are, at most 256."""
        _, at, fs = self._files()
        return sorted(s.getPath().getName().removeprefix("shard=") for s in fs.listStatus(at) if s.getPath().getName().startswith("shard=")) if fs.exists(at) else []

    def table(self) -> DataFrame | None:
        """The kept rows, None before the first refresh."""
        return self.spark.read.option("basePath", self.path).parquet(self.path).withColumn("shard", self._shard()) if self.shards() else None

    def _shard(self) -> Column:
        return F.substring(F.sha2("path", 256), 1, SHARD_DIGITS)

    def states(self, files: DataFrame) -> DataFrame:
        """(path, state, differs): hit; missing, invalid, schema or key for a miss and its reason; gone for a kept path without a file.

        ``differs`` names the parts of a key that are others. A kept row without content or id is invalid.
        """
        now = files.select("path", content_hash(F.coalesce("content", F.lit(""))).alias("now"))
        kept = self.table()
        none = F.array().cast("array<string>")
        if kept is None:
            return now.select("path", F.lit("missing").alias("state"), none.alias("differs"))
        own = [c for c in KEY_PARTS if c not in ("path", "content_hash")]
        both = now.join(kept.select("path", "id", "content_hash", "cache_schema", *own), "path", "full_outer")
        other = [F.when(~F.col(c).eqNullSafe(F.lit(self.parts[c])), F.lit(c)) for c in own] + [F.when(F.col("content_hash") != F.col("now"), F.lit("content_hash"))]
        differs = F.array_sort(F.filter(F.array(*other), lambda c: c.isNotNull()))
        state = (
            F.when(F.col("now").isNull(), "gone").when(F.col("cache_schema").isNull(), "missing").when(F.col("cache_schema") != CACHE_SCHEMA, "schema")
            .when(F.col("id").isNull() | F.col("content_hash").isNull(), "invalid").when(F.size(differs) > 0, "key").otherwise("hit")
        )
        return both.select("path", state.alias("state"), F.when(state == "key", differs).otherwise(none).alias("differs"))

    def refresh(self, files: DataFrame) -> DataFrame:
        """The kept table of ``files``, after parsing what missed: shards with a miss or a gone path are rewritten, others stay as they are."""
        states = written(self.states(files).withColumn("shard", self._shard()), "states")
        touched = states.where("state <> 'hit'").select("shard").distinct()
        missed = files.join(states.where("state NOT IN ('hit', 'gone')").select("path"), "path", "left_semi")
        made = parse(missed).select("*", *[F.lit(v).alias(k) for k, v in self.parts.items()], F.lit(CACHE_SCHEMA).alias("cache_schema")).withColumn("shard", self._shard())
        kept = self.table()
        if kept is not None:
            hits = states.where("state = 'hit'").join(touched, "shard", "left_semi").select("path")
            made = made.unionByName(kept.join(hits, "path", "left_semi"))
        made = written(made, "shards")
        gone = [r["shard"] for r in touched.join(made.select("shard").distinct(), "shard", "left_anti").collect()]  # at most 256
        made.repartition("shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(self.path)
        jvm, _, fs = self._files()
        for shard in gone:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/shard={shard}"), True)
        discard(states, made)
        found = self.table()
        return parse(files.limit(0)) if found is None else found
