"""A folder of Markdown files: as a Spark data source, and listed and read by tasks."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loam.sources.store import FOLDER, Store
from loam.sources.tree import EXCLUDED, Chosen, children, glob_pattern, read_tree as read_listed

__all__ = ["EXCLUDED", "BundleDataSource", "comparison_root", "glob_pattern", "read_bundle", "read_tree"]


class Folders(InputPartition):
    """Folders whose trees a task walks, and files that it reads."""

    def __init__(self, folders: tuple[str, ...], files: tuple[str, ...]):
        super().__init__(folders)
        self.folders, self.files = folders, files


class BundleReader(DataSourceReader):
    """The driver lists folders, level by level, until there are ``tasks`` of them; tasks walk those and read the files."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.include, self.exclude = options.get("include", "**/*.md"), options.get("exclude", EXCLUDED)
        self.per_task = int(options.get("filespertask", 1000))
        self.tasks = int(options.get("tasks", 64))

    def partitions(self) -> Sequence[InputPartition]:
        store, chosen = Store(self.root), Chosen(self.include, self.exclude)
        if store.kind("") != FOLDER:
            raise NotADirectoryError(self.root)
        folders, files = [""], []
        while folders and len(folders) < self.tasks:
            below = [child for folder in folders for child in children(store, chosen, folder)]
            folders, more = [p for p, is_folder, _ in below if is_folder], [p for p, is_folder, _ in below if not is_folder]
            files += more
        files.sort()
        parts: list[InputPartition] = [Folders((), tuple(files[i : i + self.per_task])) for i in range(0, len(files), self.per_task)]
        return parts + [Folders((folder,), ()) for folder in folders] or [Folders((), ())]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        store, chosen = Store(self.root), Chosen(self.include, self.exclude)

        def paths() -> Iterator[str]:
            yield from partition.files
            todo = list(partition.folders)
            while todo:
                for path, is_folder, _ in children(store, chosen, todo.pop()):
                    if is_folder:
                        todo.append(path)
                    else:
                        yield path

        some: list[str] = []
        for path in paths():
            some.append(path)
            if len(some) == 100:
                yield self._batch(store, some)
                some = []
        yield self._batch(store, some)

    def _batch(self, store: Store, paths: list[str]) -> pa.RecordBatch:
        texts = [store.read(p).decode("utf-8", "replace") for p in paths]
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], ["path", "content"])


class BundleDataSource(DataSource):
    """``spark.read.format("bundle").load(root)``: (path, content) of the files, hidden ones included.

    Options ``include`` and ``exclude`` are comma-separated globs; ``filesPerTask`` and ``tasks`` size partitions.
    """

    @classmethod
    def name(cls) -> str:
        return "bundle"

    def schema(self) -> str:
        return "path string, content string"

    def reader(self, schema) -> BundleReader:
        return BundleReader(dict(self.options))


def read_bundle(spark: SparkSession, root: str, include: str = "**/*.md", exclude: str = EXCLUDED, filesPerTask: int = 1000, mounted: bool = False) -> DataFrame:  # noqa: N803
    """(path, content) of a bundle, hidden files included; tasks list its folders and read its files, see :mod:`loam.sources.tree`.

    A disk is read by a cluster only where ``mounted`` says that all machines see it. A URL that only Spark can
    read goes by :func:`read_tree`.
    """
    if "://" in root and not root.startswith("file://"):
        try:
            Store(root)
        except Exception:  # noqa: BLE001  pyarrow has no driver for it
            return read_tree(spark, root, include, exclude)
    return read_listed(spark, root, include, exclude, mounted, filesPerTask)


def read_tree(spark: SparkSession, root: str, include: str = "**/*.md", exclude: str = EXCLUDED) -> DataFrame:
    """(path, content) of a tree on any file system that Spark reads, listed and read by the cluster.

    Paths are relative to ``root``. Spark passes over files whose names begin with a dot or an underscore.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(root)
    base = at.getFileSystem(conf).makeQualified(at).toString().rstrip("/") + "/"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.substring("path", F.lit(len(base) + 1), F.length("path"))
    some = lambda globs: "|".join(glob_pattern(g).pattern.replace(r"\Z", r"\z") for g in globs.split(",") if g)
    kept = rows.select(path.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    kept = kept.where(F.col("path").rlike(rf"\A(?:{some(include)})"))
    return kept.where(~F.col("path").rlike(rf"\A(?:{some(exclude)})")) if some(exclude) else kept


def comparison_root(current: str, other: str) -> str:
    """The folder of a bundle to compare with, which must lie beside the current one; ValueError elsewhere."""
    parent = os.path.realpath(os.path.dirname(os.path.realpath(current)))
    found = os.path.realpath(os.path.join(parent, other))
    if os.path.commonpath([parent, found]) != parent:
        raise ValueError(f"not beside the bundle: {other!r}")
    return found
