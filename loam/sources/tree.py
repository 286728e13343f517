"""Trees of files, listed by tasks a level at a time, and read by tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from loam.session import small_batches, written
from loam.sources.store import FILE, FOLDER, Store, shared_store


def glob_pattern(glob: str) -> re.Pattern:
    """``**`` spans folders, ``*`` and ``?`` stay in one; ``x/**`` also is ``x`` itself."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("/**", i) and i + 3 == len(glob):
            out, i = out + "(?:/.*)?", i + 3
        elif glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] in "*?":
            out, i = out + ("[^/]*" if glob[i] == "*" else "[^/]"), i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return re.compile(out + r"\Z", re.DOTALL)


#: Folders that are never part of a bundle, as globs.
EXCLUDED = ".git/**,node_modules/**"
#: Files of a task that lists or reads, and bytes that it hands on at once.
FOLDERS_PER_TASK, FILES_PER_TASK, BATCH_BYTES = 200, 1000, 8 << 20


class Chosen:
    """Which files and folders the globs ``include`` and ``exclude``, each a list divided by commas, choose."""

    def __init__(self, include: str, exclude: str) -> None:
        self._include = [glob_pattern(g) for g in include.split(",") if g]
        self._exclude = [glob_pattern(g) for g in exclude.split(",") if g]

    def excluded(self, path: str) -> bool:
        return any(p.match(path) for p in self._exclude)

    def file(self, path: str) -> bool:
        if self.excluded(path) or not any(p.match(path) for p in self._include):
            return False
        if "\\" in path:
            raise ValueError(f"not a portable path: {path!r}")
        return True


def children(store: Store, chosen: Chosen, folder: str) -> Iterator[tuple[str, bool, int]]:
    """(path, is a folder, size) of the chosen files of a folder and of the folders in it that aren't excluded; links are passed over."""
    for name, kind, size in store.entries(folder):
        path = f"{folder}/{name}" if folder else name
        if kind == FOLDER and not chosen.excluded(path):
            yield path, True, 0
        elif kind == FILE and chosen.file(path):
            yield path, False, size


def _dealt(rows: DataFrame, n: int, per_task: int) -> DataFrame:
    return rows.repartition(max(1, -(-n // per_task)), F.xxhash64("path"))


def list_tree(spark: SparkSession, root: str, include: str = "**/*.md", exclude: str = EXCLUDED, mounted: bool = False) -> DataFrame:
    """(path, size) of the chosen files of a tree, hidden ones included.

    Each round is a job that lists the folders that the round before found, so there are as many rounds as
    levels; excluded folders aren't entered. Paths stay in written tables: the driver gets counts
    alone. A root that is no folder is an error, an empty one has no rows.
    """
    store = shared_store(spark, root, mounted)
    if store.kind("") != FOLDER:
        raise NotADirectoryError(root)

    def list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, chosen = Store(root), Chosen(include, exclude)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = list(children(own, chosen, folder))
                for i in range(0, len(found), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found[i : i + 10_000])], ["path", "folder", "size"])

    levels: list[DataFrame] = []
    folders, n = spark.createDataFrame([("",)], "path string"), 1
    while n:
        listed = written(_dealt(folders, n, FOLDERS_PER_TASK).mapInArrow(list_folders, "path string, folder boolean, size long"), "tree")
        levels.append(listed.where("NOT folder").select("path", "size"))
        folders = listed.where("folder").select("path")
        n = folders.count()
    found = levels[0]
    for level in levels[1:]:
        found = found.union(level)
    return found


def read_files(listed: DataFrame, root: str, per_task: int = FILES_PER_TASK, batch_bytes: int = BATCH_BYTES, binary: bool = False) -> DataFrame:
    """(path, content) of listed (path, size) rows; bytes that are no UTF-8 become replacement characters, unless contents are ``binary``.

    A task reads about ``per_task`` files, or fewer where files are large, and passes them on by about ``batch_bytes``.
    """
    spark = listed.sparkSession
    small_batches(spark)
    n, size = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(-(-n // per_task), -(-size // (128 << 20)), 1)
    schema = pa.schema([("path", pa.string()), ("content", pa.binary() if binary else pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(root)
        paths: list[str] = []
        contents: list[bytes | str] = []
        held = 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                data = store.read(path)
                paths.append(path)
                contents.append(data if binary else data.decode("utf-8", "replace"))
                held += len(data)
                if held >= batch_bytes or len(paths) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((paths, contents), schema.types)], schema=schema)
                    paths, contents, held = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((paths, contents), schema.types)], schema=schema)

    return listed.select("path").repartition(tasks, F.xxhash64("path")).mapInArrow(read, f"path string, content {'binary' if binary else 'string'}")


def read_tree(spark: SparkSession, root: str, include: str = "**/*.md", exclude: str = EXCLUDED, mounted: bool = False, per_task: int = FILES_PER_TASK) -> DataFrame:
    """(path, content) of the chosen files of a tree, listed by :func:`list_tree` and read by tasks."""
    listed = written(list_tree(spark, root, include, exclude, mounted), "listed")
    return read_files(listed, root, per_task)


