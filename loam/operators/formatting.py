"""Deterministic formatting of Markdown files: body whitespace and the order of front matter keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from loam.functions import text as T
from loam.functions.yaml import with_anchors_ordered
from loam.operators.parsing import _FENCE, _FRONT

#: A character that stands for a fenced block while the text around it is normalised.
_MARK = "\ue000"


def _in_steps(rows: DataFrame, column: str, steps: Sequence[tuple[Column, str, str]]) -> DataFrame:
    """A text column led through (has, pattern, replacement): a pattern is tried only where ``has`` tells that its fixed part is there.

    A step is a column of its own, as one expression would hold each step many times.
    """
    for has, pattern, new in steps:
        rows = rows.withColumn(column, F.when(has, F.regexp_replace(column, pattern, new)).otherwise(F.col(column)))
    return rows


def with_normalized_body(rows: DataFrame, body: str, into: str) -> DataFrame:
    """``rows`` with a body as :func:`loam.functions.text.normalized_body` has it, with fenced blocks as they are.

    Only texts with a fence's marks are taken apart, and blocks are found once, however many there are.
    """
    holds = lambda text, *marks: reduce(lambda x, y: x | y, [F.contains(text, F.lit(m)) for m in marks])
    end = F.substring("tidy_", -3, 3)  # what a pattern's end may see: another line terminator can follow
    pattern = f"({_FENCE[len('(?ms)'):]})".join(["(?ms)", ""]).replace(r"\1", r"\2")
    rows = _in_steps(rows.withColumn("tidy_", F.col(body)), "tidy_", [(holds("tidy_", "\r"), r"\r\n|\r", "\n"), (holds("tidy_", _MARK), _MARK, "")])
    rows = rows.withColumn("fences_", F.when(holds("tidy_", "```", "~~~"), F.regexp_extract_all("tidy_", F.lit(pattern), F.lit(1))))
    steps = [
        (F.col("fences_").isNotNull(), _FENCE, _MARK),
        (holds("tidy_", " \n", "\t\n") | holds(end, " ", "\t"), r"[ \t]+(?=\n|$)", ""),
        (holds("tidy_", "\n\n\n"), r"\n{3,}", "\n\n"),
        (F.startswith("tidy_", F.lit("\n")) | holds(end, "\n"), r"^\n+|\n+$", ""),
    ]
    rows = _in_steps(rows, "tidy_", steps).withColumn("tidy_", F.when(F.col("tidy_") == "", F.lit("")).otherwise(F.concat("tidy_", F.lit("\n"))))
    pieces = F.arrays_zip(F.split("tidy_", _MARK).alias("p"), F.col("fences_").alias("f"))
    joined = F.array_join(F.transform(pieces, lambda x: F.when(x["p"].isNotNull(), F.concat(x["p"], F.coalesce(x["f"], F.lit(""))))), "")  # nulls are left out
    return rows.withColumn(into, F.when(F.col("fences_").isNull(), F.col("tidy_")).otherwise(joined)).drop("fences_", "tidy_")


def ordered_front(front: Column, order: Sequence[str]) -> Column:
    """Top-level entries of a block mapping by rank, then by key; the lines of an entry stay together.

    Front matter with anchors, aliases or merge keys is ordered so that an anchor comes before its aliases, see
    :func:`loam.functions.yaml.ordered_entries`; a flow mapping at the top is left as it is.
    """
    entries = F.split(F.regexp_replace(front, r"\n+\z", ""), r"\n(?=[^\s#-][^\n]*?:(?:[ \t]|\n|$))")
    key = lambda e: F.regexp_extract(e, r"(?m)^([^\s#:-][^:\n]*?)[ \t]*:", 1)
    rank = lambda e: F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(k) for k in order]), key(e)), F.lit(0)), F.lit(1 << 30))
    sorted_ = F.array_sort(F.transform(entries, lambda e, i: F.struct(rank(e).alias("r"), key(e).alias("k"), i.alias("i"), e.alias("e"))))
    moved = F.concat(F.array_join(F.transform(sorted_, lambda x: x["e"]), "\n"), F.lit("\n"))
    flow = front.rlike(r"\A\s*[{\[]") | (F.trim(front) == "")
    linked = ~flow & front.rlike(r"(?m)(?:^|[ \t\[,])[&*][^\s]|^<<[ \t]*:")
    return F.when(flow, front).otherwise(F.coalesce(with_anchors_ordered(F.when(linked, front), order), moved))


def formatted(files: DataFrame, order: Sequence[str] = ("type", "title", "description", "resource", "tags", "timestamp"), keep: Sequence[str] = ()) -> DataFrame:
    """(path, formatted, changed) of (path, content): ordered keys, whole time stamps, tidy body.

    A second run changes nothing. A null content is an empty file. Columns named in ``keep`` go along.
    """
    rows = files.select(*keep, "path", F.coalesce("content", F.lit("")).alias("content"))
    content = F.col("content")
    rows = rows.withColumn("has_", F.startswith(content, F.lit("---")) & content.rlike(_FRONT))
    rows = rows.withColumn("front_", F.when(F.col("has_"), F.regexp_replace(F.regexp_extract(content, _FRONT, 1), r"\r\n|\r", "\n")))
    rows = rows.withColumn("body_", F.when(F.col("has_"), F.regexp_replace(content, _FRONT, "")).otherwise(content))
    front = F.col("front_")
    stamp = F.regexp_replace(front, r"(?m)^(timestamp:[ \t]*)([0-9]{4}-[0-9]{2}-[0-9]{2})[ \t]*$", "$1$2T00:00:00.000Z")
    real = F.try_to_timestamp(F.nullif(F.regexp_extract(front, r"(?m)^timestamp:[ \t]*([0-9]{4}-[0-9]{2}-[0-9]{2})[ \t]*$", 1), F.lit(""))).isNotNull()
    rows = with_normalized_body(rows.withColumn("head_", ordered_front(F.when(real, stamp).otherwise(front), order)), "body_", "tidy_body_")
    body = F.col("tidy_body_")
    made = F.when(F.col("has_"), F.concat(F.lit("---\n"), "head_", F.lit("---\n"), F.when(body == "", F.lit("")).otherwise(F.concat(F.lit("\n"), body)))).otherwise(body)
    # out of an array, so that a filter on what has changed does not work it out again
    rows = rows.select("*", F.explode(F.array(made)).alias("formatted"))
    return rows.select(*keep, "path", "formatted", (F.col("formatted") != content).alias("changed"))
