"""From (path, content) rows to concepts, headings and links, with built-in functions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from loam.functions import text as T
from loam.functions.markdown import places, scanned_links, unlinked
from loam.functions.paths import resolve_target
from loam.functions.yaml import read_front_matter
from loam.operators.scopes import scoped

# The fields that name what replaces a concept.
REPLACEMENT_KEYS = ("replacement", "replaced_by", "replacedBy", "superseded_by", "supersededBy")
#: Front matter: a first line of three dashes up to the next line of three dashes.
_FRONT = r"(?s)\A---(?:\r\n|\n|\r)(.*?)(?<=[\r\n])---[ \t]*(?:\r\n|\n|\r|\z)"
_FENCE = r"(?ms)^ {0,3}(`{3,}|~{3,})[^\n]*(?:\n.*?(?:^ {0,3}\1[`~]*[ \t]*$|\z)|\z)"
_CODE = r"(?s)(?<![`\\])(`+)(?!`)(?:.*?[^`])\1(?!`)"
_HEADING = r"(?m)^ {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$"
# Runs are possessive and repeats bounded, so that hostile texts neither backtrack nor nest deeply.
_LABEL = r"(?:[^\[\]\\]++|\\.|\[[^\[\]]*+\]){0,200}"
_DESTINATION = r"<[^<>\n]*+>|(?:[^()\s\\<]++|\\.|\((?:[^()\s\\]++|\\.){0,64}\)){0,64}"
_INLINE = rf"\[({_LABEL})\]\([ \t]*({_DESTINATION})(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*\)"
_LINK, _IMAGE = rf"(?<![!\\]){_INLINE}", rf"(?<!\\)!{_INLINE}"
#: Links that need no more than these patterns; a text with others is scanned.
_EASY = r"\[[^\[\]\r\n]*+\]\([ \t]*+(?:<[^<>\r\n]*+>|[^\s()<>\"']*+)(?:[ \t]++(?:\"[^\"\r\n]*+\"|'[^'\r\n]*+'))?[ \t]*+\)"
# Front matter of plain entries, which is read by line: words, dates, quoted texts without escapes, and lists of them.
_WORDS = r"(?!(?:true|True|TRUE|false|False|FALSE|null|Null|NULL)[ \t]*$)[A-Za-z](?:[^\r\n:#]|:(?=[^\s]))*+|[0-9]{4}-[0-9]{2}-[0-9]{2}(?:T[0-9:.]++Z)?[ \t]*+"
_QUOTED = r"\"[^\"\\\r\n]*+\"[ \t]*+|'[^'\r\n]*+'[ \t]*+"
_INNER = r"[ ]*+(?!(?:true|True|TRUE|false|False|FALSE|null|Null|NULL)[ ]*[,\]])[A-Za-z][A-Za-z0-9_. /-]*+"
_PLAIN_FRONT = (
    rf"(?m)\A(?:[A-Za-z_][A-Za-z0-9_-]*+:[ \t]++(?:{_QUOTED}|{_WORDS}|\[{_INNER}(?:,{_INNER})*+\][ \t]*+)$\n?"
    rf"|[A-Za-z_][A-Za-z0-9_-]*+:[ \t]*+\n([ ]*+)-[ ]++(?:{_QUOTED}|{_WORDS})$\n?(?:\1-[ ]++(?:{_QUOTED}|{_WORDS})$\n?)*+)*+\z"
)
_KEY_LINES = r"(?m)^([A-Za-z_][A-Za-z0-9_-]*):"
#: Longest front matter that is read by line; the pattern's depth grows with its lines.
_PLAIN_LENGTH = 2000


def _if_any(text: Column, marks: Sequence[str], made: Column, otherwise: Column) -> Column:
    """``made`` for texts with one of the marks: most have none, and a search for them is far cheaper than a pattern."""
    found = reduce(lambda x, y: x | y, [F.contains(text, F.lit(m)) for m in marks])
    return F.when(found, made).otherwise(otherwise)


def masked(body: Column) -> Column:
    """The body without fenced code and code spans, which hold no headings and no links."""
    return _if_any(body, ("`", "~~~"), F.regexp_replace(F.regexp_replace(body, _FENCE, ""), _CODE, " "), body)


def _has_key(front: Column, key: str) -> Column:
    """Whether the front matter may have a key: most of those asked for are absent, and patterns are tried only for the others."""
    return F.contains(front, F.lit(f"{key}:"))


def scalar(front: Column, key: str) -> Column:
    """A top-level scalar of the front matter, unquoted; null if absent or empty."""
    value = F.regexp_extract(front, rf"(?m)^{key}:[ \t]*(.*?)[ \t]*$", 1)
    bare = F.regexp_replace(value, r"^\"(.*)\"$|^'(.*)'$", "$1$2")
    return F.when(_has_key(front, key), F.when((bare != "") & ~value.rlike(r"^[\[{|>&*!]"), bare))


def sequence(front: Column, key: str) -> Column:
    """A top-level list of the front matter, inline or in lines; null if absent or empty."""
    inline = F.regexp_extract(front, rf"(?m)^{key}:[ \t]*\[(.*?)\][ \t]*$", 1)
    block = F.regexp_extract(front, rf"(?ms)^{key}:[ \t]*\n(.*?)(?=^[^\s-]|\z)", 1)
    items = F.when(inline != "", F.split(inline, ",")).otherwise(F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]*-[ \t]+(.*?)[ \t]*$"), F.lit(1)))
    bare = F.filter(F.transform(items, lambda x: F.regexp_replace(F.trim(x), r"^[\"']|[\"']$", "")), lambda x: x != "")
    return F.when(_has_key(front, key), F.when(F.size(bare) > 0, bare))


def _needs_scan(text: Column) -> Column:
    """Whether a text has links that the easy pattern doesn't take apart."""
    hard = (F.regexp_count(text, F.lit(r"\]\(")) != F.regexp_count(text, F.lit(_EASY))) | F.contains(text, F.lit("\\"))
    return _if_any(text, ("](",), hard, F.lit(False))


def plain_text(body: Column, asked: Column | None = None) -> Column:
    """The words of a body: no fenced code, no images, links and headings as their text, no marks, single spaces.

    Links that the patterns can't take apart are scanned, in texts for which ``asked`` holds, all by default.
    """
    outside = _if_any(body, ("```", "~~~"), F.regexp_replace(body, _FENCE, " "), body)
    hard = _needs_scan(outside) if asked is None else F.when(asked, _needs_scan(outside)).otherwise(F.lit(False))
    easy = _if_any(outside, ("](",), F.regexp_replace(F.regexp_replace(outside, _IMAGE, ""), _LINK, "$1"), outside)
    bare = F.coalesce(unlinked(F.when(hard, outside)), easy)
    titles = F.regexp_replace(F.regexp_replace(bare, _HEADING, "$2"), "`+", "")
    text = _if_any(bare, ("#", "`"), titles, bare)
    return T.trimmed(F.regexp_replace(F.translate(text, "*_~>-", "     "), rf"[{T.SPACE}]+", " "))


def is_empty(body: Column) -> Column:
    """Whether a body has no plain text; told by a letter or digit where nothing could hide it."""
    plain = ~(F.contains(body, F.lit("```")) | F.contains(body, F.lit("~~~")) | F.contains(body, F.lit("!["))) & body.rlike("[A-Za-z0-9]")
    return F.when(plain, F.lit(False)).otherwise(plain_text(body, ~plain) == "")


def parse(files: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(path, content) to one row per file with typed front matter, headings and link texts.

    Front matter of plain entries is read by patterns, any other by a YAML reader in batches; ``front`` is
    its text, null where a file has none. ``invalid`` says why it is refused, in which case the
    file has no field; ``front_json`` is the mapping as JSON where the reader was asked. Fields are
    texts and lists of texts: other values count as absent. Links that the patterns can't take apart
    are scanned. A null content is an empty file. Columns named in ``keep`` go along.
    """
    content = F.coalesce("content", F.lit(""))
    has = F.startswith("content", F.lit("---")) & F.col("content").rlike(_FRONT)
    rows = files.select(*keep, "path", content.alias("content"))
    rows = rows.withColumns({"kind": T.file_kind(F.col("path")), "front": F.when(has, F.regexp_extract("content", _FRONT, 1))})
    rows = rows.withColumn("body", F.when(F.col("front").isNotNull(), F.regexp_replace("content", _FRONT, "")).otherwise(F.col("content")))
    named = F.regexp_extract_all("front", F.lit(_KEY_LINES), F.lit(1))
    by_line = (F.length("front") < _PLAIN_LENGTH) & F.when(F.length("front") < _PLAIN_LENGTH, F.col("front").rlike(_PLAIN_FRONT))
    by_line = by_line & (F.length("front") > 0) & (F.size(F.array_distinct(named)) == F.size(named))
    rows = rows.withColumns({"plain": masked(F.col("body")), "by_line": F.col("front").isNull() | by_line})
    rows = rows.withColumn("scan", _needs_scan(F.col("plain")))
    rows = rows.withColumns(
        {"read": read_front_matter(F.when(~F.col("by_line"), F.col("front"))), "scanned": scanned_links(F.when(F.col("scan"), F.col("body")))}
    )
    front = F.coalesce("front", F.lit(""))

    def text_of(key: str) -> Column:
        return F.when(F.col("by_line"), scalar(front, key)).otherwise(F.try_element_at("read.texts", F.lit(key)))

    def list_of(key: str) -> Column:
        return F.when(F.col("by_line"), sequence(front, key)).otherwise(F.try_element_at("read.lists", F.lit(key)))

    one = text_of("resource")
    return rows.select(
        *keep,
        T.concept_id(F.col("path")).alias("id"),
        "path",
        "kind",
        F.coalesce(text_of("type"), F.lit("")).alias("type"),
        text_of("title").alias("title"),
        text_of("description").alias("description"),
        F.coalesce(list_of("resource"), F.when(one.isNotNull(), F.array(one))).alias("resource"),
        list_of("tags").alias("tags"),
        text_of("timestamp").alias("timestamp"),
        text_of("owner").alias("owner"),
        text_of("status").alias("status"),
        F.exists(F.array(*[text_of(k) for k in REPLACEMENT_KEYS]), lambda v: ~T.blank(v)).alias("replaced"),
        "front",
        F.col("read.invalid").alias("invalid"),
        F.col("read.json").alias("front_json"),
        F.col("read.rest").alias("front_rest"),
        F.when(F.col("by_line"), F.coalesce(named, F.array().cast("array<string>"))).otherwise(F.col("read.keys")).alias("keys"),
        "body",
        is_empty(F.col("body")).alias("empty"),
        headings(F.col("plain")).alias("headings"),
        F.when(F.col("scan"), F.col("scanned")).otherwise(links(F.col("plain"))).alias("links"),
        T.content_hash(F.col("content")).alias("content_hash"),
    )


def located(files: DataFrame) -> DataFrame:
    """(path, ordinal, what, label, target, line, column, offset) of the headings and links of (path, content).

    Lines and columns count from 1 and offsets from 0, in UTF-16 units of the whole file.
    """
    content = F.coalesce("content", F.lit(""))
    body = F.regexp_replace(content, _FRONT, "")
    return files.select("path", F.posexplode(places(content, body)).alias("ordinal", "place")).select("path", "ordinal", "place.*")


def headings(plain: Column) -> Column:
    marks = F.regexp_extract_all(plain, F.lit(_HEADING), F.lit(1))
    titles = F.regexp_extract_all(plain, F.lit(_HEADING), F.lit(2))
    both = F.arrays_zip(marks.alias("m"), titles.alias("t"))
    made = F.transform(
        both,
        lambda h: F.struct(F.length(h["m"]).alias("level"), F.trim(h["t"]).alias("title"), T.slugify(h["t"]).alias("slug")),
    )
    return _if_any(plain, ("#",), made, F.from_json(F.lit("[]"), "array<struct<level: int, title: string, slug: string>>"))


def links(plain: Column) -> Column:
    labels = F.regexp_extract_all(plain, F.lit(_LINK), F.lit(1))
    targets = F.regexp_extract_all(plain, F.lit(_LINK), F.lit(2))
    both = F.arrays_zip(labels.alias("l"), targets.alias("t"))
    made = F.transform(
        both,
        lambda x: F.struct(
            F.nullif(T.trimmed(x["l"]), F.lit("")).alias("text"), F.regexp_replace(x["t"], r"^<(.*)>$", "$1").alias("target")
        ),
    )
    return _if_any(plain, ("](",), made, F.from_json(F.lit("[]"), "array<struct<text: string, target: string>>"))


def resolved_links(parsed: DataFrame, scope: str | None = None) -> DataFrame:
    """One row per link: (source, source_path, ordinal, text, target_raw, kind, target, resolved).

    Internal targets are resolved against the linking file and looked up among all files by a left
    join; external and anchor links count as resolved. With ``scope``, the name of a column, ids are scoped
    by it, links find targets in their own scope alone, and the column goes along.
    """
    own = [scope] if scope else []
    rows = parsed.select(*own, F.col("id").alias("source"), F.col("path").alias("source_path"), F.posexplode("links").alias("ordinal", "link"))
    rows = rows.select(*own, "source", "source_path", "ordinal", "link.text", F.col("link.target").alias("target_raw"))
    rows = rows.withColumn("kind", T.link_kind(F.col("target_raw")))
    wanted = F.when(F.col("kind") == "internal", resolve_target("source_path", "target_raw"))
    wanted = scoped(F.col(scope), wanted) if scope else wanted
    ids = parsed.select(F.col("id").alias("target")).distinct()
    joined = rows.withColumn("wanted", wanted).join(ids, F.col("wanted") == F.col("target"), "left")
    resolved = F.when(F.col("kind") == "internal", F.col("target").isNotNull()).otherwise(F.col("kind") != "unknown")
    return joined.drop("wanted").withColumn("resolved", resolved)


def bundle_stats(parsed: DataFrame, links_: DataFrame) -> DataFrame:
    """One row of counts: concepts, indexes, logs, links, broken links."""
    return all_stats(parsed, links_).drop("files", "diagnostics")


def all_stats(parsed: DataFrame, links_: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row of all counts of a bundle: also its files, and those whose front matter is refused. ``by`` gives a row for each of its values."""
    kinds = (("concept", "concepts"), ("index", "indexes"), ("log", "logs"))
    files = parsed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("files"), *[F.count_if(F.col("kind") == k).alias(n) for k, n in kinds], F.count("invalid").alias("diagnostics")
    )
    edges = links_.groupBy(*by).agg(
        F.count(F.lit(1)).alias("links"), F.count_if((F.col("kind") == "internal") & ~F.col("resolved")).alias("broken_links")
    )
    if by:
        return files.join(edges, list(by), "left").na.fill(0, ["links", "broken_links"])
    return files.join(F.broadcast(edges))  # two tables of one row
