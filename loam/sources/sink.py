"""Files written as a tree: staged by tasks under names of their attempts, checked, and then moved into place by tasks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from loam.functions.paths import path_key
from loam.session import discard, small_batches, written
from loam.sources.store import FILE, FOLDER, LINK, Store, shared_store

#: Folders in which files wait for their places; a tree's listing never shows one that is done.
STAGING = ".staging-"
#: Characters and names that no portable path has.
_UNPORTABLE = r"[\\\x00-\x1f]|(?:^|/)(?:\.{1,2})?(?:/|$)"


def refused_paths(files: DataFrame) -> DataFrame:
    """(path, why) of the rows of (path, content) that can't be written: no portable path, no content, or a path taken twice.

    Paths that differ in case or composition alone count as one, and a path that is a folder of another is taken too.
    Repeats are counted by key before any row meets another, so a path that most rows have is no task's burden.
    """
    path = F.col("path")
    bad = path.isNull() | (path == "") | path.rlike(_UNPORTABLE) | path.rlike("^[A-Za-z]:")
    rows = files.select("path", F.col("content").isNull().alias("empty"), F.coalesce(bad, F.lit(True)).alias("bad"))
    why = F.when(F.col("bad"), "not a portable path").when(F.col("empty"), "no content")
    own = rows.where("bad OR empty").select("path", why.alias("why")).distinct()
    keyed = rows.where("NOT bad").select("path", path_key("path").alias("key"))
    taken = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path"))
    twice = taken.where("n > 1").select("path", F.lit("taken more than once").alias("why"))
    parts = F.split("key", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    folders = taken.where(F.size(parts) > 1).select(F.explode(above).alias("key")).distinct()
    inside = taken.join(folders, "key", "left_semi").select("path", F.lit("also a folder").alias("why"))
    return own.union(twice).union(inside)


def _blocked(store: Store, path: str, replace: bool) -> str | None:
    """Why nothing may be written at a path now; None if it may."""
    parts = path.split("/")
    for i in range(1, len(parts) + 1):
        kind = store.kind("/".join(parts[:i]))
        if kind is None:
            return None
        if kind == LINK:
            return "behind a link"
        if i < len(parts) and kind != FOLDER:
            return "below a file"
        if i == len(parts):
            return "not a file" if kind != FILE else None if replace else "there already"
    return None


def _publish(rows: DataFrame, paths: DataFrame, root: str, replace: bool, mounted: bool) -> DataFrame:
    """Writes (path, text) rows, those of one path being neighbours in one partition; ``paths`` has (path, content) to check."""
    spark = rows.sparkSession
    store = shared_store(spark, root, mounted)
    if store.kind("") not in (None, FOLDER):
        raise NotADirectoryError(f"not a folder, or a link: {root}")
    staging = STAGING + uuid.uuid4().hex
    names = pa.schema([("path", pa.string()), ("staged", pa.string()), ("size", pa.int64())])

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Store(root)
        for batch in batches:
            found = [(p, why) for p in batch.column(0).to_pylist() if (why := _blocked(own, p, replace))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], ["path", "why"])

    def staged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, context = Store(root), TaskContext.get()
        folder, n = f"{staging}/{context.partitionId()}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}", 0
        own.make_folder(folder)
        made: list[tuple[str, str, int]] = []
        now, out, size = None, None, 0
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if path != now:
                    if out is not None:
                        out.close()
                        made.append((now, f"{folder}/{n}", size))
                    now, n, size = path, n + 1, 0
                    out = own.create(f"{folder}/{n}")
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                out.write(data)
                size += len(data)
            if len(made) >= 10_000:
                yield pa.RecordBatch.from_pylist([dict(zip(names.names, x)) for x in made], names)
                made = []
        if out is not None:
            out.close()
            made.append((now, f"{folder}/{n}", size))
        yield pa.RecordBatch.from_pylist([dict(zip(names.names, x)) for x in made], names)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, made = Store(root), set()
        for batch in batches:
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own.kind(at) is None:
                    if own.kind(path) != FILE:
                        raise FileNotFoundError(f"neither staged nor in place: {path!r}")
                    continue  # an earlier attempt of this task moved it
                if why := _blocked(own, path, replace):
                    raise FileExistsError(f"{why}: {path!r}")
                folder = path.rpartition("/")[0]
                if folder and folder not in made:
                    own.make_folder(folder)
                    made.add(folder)
                own.move(at, path)
            yield batch.select(["path", "size"])

    try:
        found = refused_paths(paths).union(paths.where("path IS NOT NULL").select("path").mapInArrow(checked, "path string, why string"))
        refused = written(found, "refused")
        if some := refused.orderBy("path", "why").limit(5).collect():
            raise ValueError("; ".join(f"{r['why']}: {r['path']!r}" for r in some))
        store.make_folder("")
        ready = written(rows.mapInArrow(staged, "path string, staged string, size long"), "staged")
        done = written(ready.mapInArrow(placed, "path string, size long"), "placed")
        discard(refused, ready)
        return done
    finally:
        store.remove(staging)


def write_files(files: DataFrame, root: str, replace: bool = False, mounted: bool = False) -> DataFrame:
    """Writes (path, content) rows as UTF-8 files below ``root``; returns (path, size) of what was written.

    First all paths are checked, in :func:`refused_paths` and against the tree: nothing is
    written if one can't be, or would replace a file without ``replace``, or lies behind a link. Then tasks stage contents under names of their own
    attempts, so that a lost or repeated task leaves only names that nobody asks for. The names of
    the attempts that counted are a written table, and tasks move those files into place. A move that is
    repeated finds its file in place and is done. In the end, or after an error, the
    staging folder goes, so a killed write leaves whole files or none at each path. A row is one file, a file one row: contents are held
    one at a time, however long. No rows make an empty tree.
    """
    small_batches(files.sparkSession)
    kept = written(files.select("path", F.col("content").cast("string").alias("content")), "files")
    try:
        return _publish(kept, kept, root, replace, mounted)
    finally:
        discard(kept)


def write_pieces(pieces: DataFrame, order: Sequence[str], root: str, replace: bool = False, mounted: bool = False) -> DataFrame:
    """Writes (path, text, ...) rows: a file is the texts of its path, one after another in ``order``. Returns (path, size).

    For files that are made of many rows, such as an index or a graph: the rows of a path are sorted
    and streamed by one task, which holds one of them, so a file may be larger than any memory. Null texts count
    as empty. All else is as with :func:`write_files`.
    """
    small_batches(pieces.sparkSession)
    kept = written(pieces.select("path", F.col("text").cast("string").alias("text"), *order), "pieces")
    paths = kept.groupBy("path").agg(F.lit("").alias("content"))
    try:
        return _publish(kept.repartition("path").sortWithinPartitions("path", *order).select("path", "text"), paths, root, replace, mounted)
    finally:
        discard(kept)
