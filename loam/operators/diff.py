"""Differences between two snapshots of (id, path, content_hash, ...) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from loam.functions.yaml import read_front_matter
from loam.operators.ordinals import numbered_within
from loam.session import written


def diff(before: DataFrame, after: DataFrame, fields: Sequence[str] = ()) -> DataFrame:
    """(change, id, old_id, changed): added, removed, renamed and changed rows.

    Rows of both snapshots with another content hash or another of ``fields`` are changed, and
    ``changed`` lists what differs. Removed and added rows of one content hash are paired in order
    of id: the k-th of the one is the k-th of the other renamed; what is left over stays removed or
    added. Null hashes are paired with none. A hash that any number of rows share is numbered by ranges of its
    rows and paired by number, so no task has all of them.
    """
    columns = ["content_hash", *fields]
    old = before.select("id", *[F.col(c).alias(f"old_{c}") for c in columns], F.lit(True).alias("was"))
    new = after.select("id", *columns, F.lit(True).alias("is"))
    both = old.join(new, "id", "full_outer")
    differ = F.filter(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"old_{c}")), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    side = F.when(F.col("is").isNull(), "gone").when(F.col("was").isNull(), "come").otherwise("both")
    rows = both.select("id", side.alias("side"), F.when(side == "gone", F.col("old_content_hash")).otherwise(F.col("content_hash")).alias("h"), differ.alias("changed"))
    rows = written(rows.where((F.col("side") != "both") | (F.size("changed") > 0)), "diff")
    none, no_id = F.array().cast("array<string>"), F.lit(None).cast("string")
    changed = rows.where("side = 'both'").select(F.lit("changed").alias("change"), "id", no_id.alias("old_id"), "changed")
    # a hash with one row on each side pairs by its sums; the rows of others are numbered, however many one has
    one = lambda s: F.count_if(F.col("side") == s).alias(s)
    first = lambda s: F.min(F.when(F.col("side") == s, F.col("id"))).alias(f"{s}_id")
    groups = written(rows.where("side <> 'both' AND h IS NOT NULL").groupBy("h").agg(one("gone"), one("come"), first("gone"), first("come")), "hashes")
    pairs = groups.where("gone <= 1 AND come <= 1")
    moved = pairs.select(F.col("gone_id").alias("old_id"), F.col("come_id").alias("id"))
    many = rows.where("side <> 'both'").join(groups.where("gone > 1 OR come > 1").select("h"), "h", "left_semi")
    if groups.where("gone > 1 OR come > 1").limit(1).count():
        nth = lambda s: numbered_within(many.where(F.col("side") == s).select("h", "id"), ["h"], [F.col("id")], "n", "renames")
        moved = moved.union(nth("gone").withColumnRenamed("id", "old_id").join(nth("come"), ["h", "n"], "full_outer").select("old_id", "id"))
    blank = rows.where("side <> 'both' AND h IS NULL")
    moved = moved.union(blank.select(F.when(F.col("side") == "gone", F.col("id")), F.when(F.col("side") == "come", F.col("id"))))
    kind = F.when(F.col("id").isNull(), "removed").when(F.col("old_id").isNull(), "added").otherwise("renamed")
    return changed.union(moved.select(kind, F.coalesce("id", "old_id"), F.when(F.col("id").isNotNull(), F.col("old_id")), none))


def link_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, added, removed): targets that each source of both snapshots gained and lost, from (source, target).

    Links that stayed cancel out first, so that only changes are listed.
    """
    old, new = before.select("source", "target").distinct(), after.select("source", "target").distinct()
    both = old.withColumn("was", F.lit(True)).join(new.withColumn("is", F.lit(True)), ["source", "target"], "full_outer")
    changed = both.where("was IS NULL OR `is` IS NULL")
    kept = old.select("source").distinct().join(new.select("source").distinct(), "source", "left_semi")
    listed = lambda side: F.array_sort(F.collect_list(F.when(F.col(side), F.col("target"))))
    found = changed.join(kept, "source", "left_semi").groupBy(F.col("source").alias("id"))
    return found.agg(listed("is").alias("added"), listed("was").alias("removed"))


def concept_changes(before: DataFrame, after: DataFrame, links_before: DataFrame, links_after: DataFrame) -> DataFrame:
    """(id, path, front_changed, body_changed, resource_changed, tags_changed, links_added, links_removed, changes).

    Of concepts in both snapshots, those that differ: which front matter keys have other values, at any
    depth, and which link targets came and went. ``changes`` says it in words. Front matter is read
    again only of concepts whose content or links differ.
    """
    columns = ["front", "body", "resource", "tags", "content_hash"]
    old = before.select("id", *[F.col(c).alias(f"old_{c}") for c in columns])
    both = old.join(after.select("id", "path", *columns), "id").join(link_changes(links_before, links_after), "id", "left")
    both = both.where((F.col("content_hash") != F.col("old_content_hash")) | F.col("added").isNotNull())
    values = both.withColumns({"new_values": read_front_matter("front")["values"], "old_values": read_front_matter("old_front")["values"]})
    none = F.array().cast("array<string>")
    a, b = (F.coalesce(c, F.from_json(F.lit("{}"), "map<string,string>")) for c in ("new_values", "old_values"))
    values = values.withColumns({"a": a, "b": b})
    keys = F.array_union(F.map_keys("a"), F.map_keys("b"))
    changed = F.array_sort(F.filter(keys, lambda k: ~F.try_element_at("a", k).eqNullSafe(F.try_element_at("b", k))))
    rows = values.select(
        "id",
        "path",
        changed.alias("front_changed"),
        (F.col("body") != F.col("old_body")).alias("body_changed"),
        (~F.col("resource").eqNullSafe(F.col("old_resource"))).alias("resource_changed"),
        (~F.col("tags").eqNullSafe(F.col("old_tags"))).alias("tags_changed"),
        F.coalesce("added", none).alias("links_added"),
        F.coalesce("removed", none).alias("links_removed"),
    )

    def said(flag: str, key: str) -> Column:
        named = F.array_contains("front_changed", key) if key != "body" else F.lit(False)
        return F.when(F.col(flag) & ~named, F.array(F.lit(f"{key} changed"))).otherwise(none)

    words = F.concat(
        F.transform("front_changed", lambda k: F.concat(F.lit("frontmatter."), k, F.lit(" changed"))),
        said("body_changed", "body"), said("resource_changed", "resource"), said("tags_changed", "tags"),
        F.transform("links_added", lambda t: F.concat(F.lit("link added: "), t)), F.transform("links_removed", lambda t: F.concat(F.lit("link removed: "), t)),
    )
    return rows.withColumn("changes", words).where(F.size("changes") > 0)


def highlights(changes: DataFrame, most: int = 5) -> DataFrame:
    """(change, id, old_id, nth): the first few of each kind of change, in order of id."""
    nth = F.row_number().over(Window.partitionBy("change").orderBy("id"))
    return changes.select("change", "id", "old_id").withColumn("nth", nth).where(F.col("nth") <= most)


def readiness_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row (before_score, after_score, delta, changed) from two rows of :func:`loam.operators.rules.readiness`."""
    both = before.select(F.col("score").alias("before_score")).join(F.broadcast(after.select(F.col("score").alias("after_score"))))  # one row each
    delta = F.col("after_score") - F.col("before_score")
    return both.withColumn("delta", delta).withColumn("changed", delta != 0)


def summary(changes: DataFrame) -> DataFrame:
    kinds = ("added", "removed", "renamed", "changed")
    return changes.agg(*[F.count_if(F.col("change") == k).alias(k) for k in kinds])
