"""Folders and files of a tree, as tasks and the driver see them: a local or mounted disk, or what pyarrow opens."""

from __future__ import annotations

import os
import shutil
import stat
from typing import BinaryIO, NamedTuple

from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession

FILE, FOLDER, LINK, OTHER = "file", "folder", "link", "other"


class Entry(NamedTuple):
    name: str
    kind: str
    size: int


class Store:
    """A tree below ``root``: a plain path or ``file://``, or another URL that pyarrow has a file system for.

    Names are relative to the root, with forward slashes; the root is the empty name. Links exist on disks only and are never
    followed.
    """

    def __init__(self, root: str) -> None:
        self.root = root
        self.local = "://" not in root or root.startswith("file://")
        if self.local:
            self._base = root.removeprefix("file://").rstrip("/") or "/"
        else:
            self._fs, base = arrow_fs.FileSystem.from_uri(root)
            self._base = base.rstrip("/")

    def at(self, name: str) -> str:
        return f"{self._base.rstrip('/')}/{name}" if name else self._base

    def kind(self, name: str) -> str | None:
        """What is there, None for nothing."""
        if self.local:
            try:
                mode = os.lstat(self.at(name)).st_mode
            except (FileNotFoundError, NotADirectoryError):
                return None
            return LINK if stat.S_ISLNK(mode) else FOLDER if stat.S_ISDIR(mode) else FILE if stat.S_ISREG(mode) else OTHER
        return {arrow_fs.FileType.File: FILE, arrow_fs.FileType.Directory: FOLDER, arrow_fs.FileType.NotFound: None}.get(self._fs.get_file_info(self.at(name)).type, OTHER)

    def entries(self, folder: str) -> list[Entry]:
        """What a folder holds, hidden names included, in order of name."""
        found = []
        if self.local:
            with os.scandir(self.at(folder)) as entries:
                for e in entries:
                    kind = LINK if e.is_symlink() else FOLDER if e.is_dir() else FILE if e.is_file() else OTHER
                    found.append(Entry(e.name, kind, e.stat(follow_symlinks=False).st_size if kind == FILE else 0))
        else:
            kinds = {arrow_fs.FileType.File: FILE, arrow_fs.FileType.Directory: FOLDER}
            for info in self._fs.get_file_info(arrow_fs.FileSelector(self.at(folder), recursive=False)):
                found.append(Entry(info.base_name, kinds.get(info.type, OTHER), info.size or 0))
        return sorted(found)

    def read(self, name: str) -> bytes:
        if self.local:
            with open(os.open(self.at(name), os.O_RDONLY | getattr(os, "O_NOFOLLOW", 0)), "rb") as f:
                return f.read()
        with self._fs.open_input_stream(self.at(name)) as f:
            return f.read()

    def make_folder(self, name: str) -> None:
        if self.local:
            os.makedirs(self.at(name), exist_ok=True)
        else:
            self._fs.create_dir(self.at(name), recursive=True)

    def create(self, name: str) -> BinaryIO:
        """A new file that is open for writing; on a disk an error if there is one."""
        if self.local:
            return open(os.open(self.at(name), os.O_WRONLY | os.O_CREAT | os.O_EXCL | getattr(os, "O_NOFOLLOW", 0), 0o666), "wb")
        return self._fs.open_output_stream(self.at(name))

    def move(self, name: str, to: str) -> None:
        """In place of what is there; on a disk at once, elsewhere as its store does it."""
        if self.local:
            os.replace(self.at(name), self.at(to))
        else:
            self._fs.move(self.at(name), self.at(to))

    def remove(self, folder: str) -> None:
        """A folder and all in it, if it is there."""
        if self.local:
            shutil.rmtree(self.at(folder), ignore_errors=True)
        elif self.kind(folder) == FOLDER:
            self._fs.delete_dir(self.at(folder))


def shared_store(spark: SparkSession, root: str, mounted: bool = False) -> Store:
    """The store of ``root``, if all tasks see it: on a cluster a disk must be said to be ``mounted`` on all its machines.

    What lies in the folder that ``spark.checkpoint.dir`` names is seen by all.
    """
    store = Store(root)
    named = spark.conf.get("spark.checkpoint.dir", None)
    seen = mounted or not store.local or spark.sparkContext.master.startswith("local") or (bool(named) and Store(named).local and store.at("").startswith(Store(named).at("") + "/"))
    if not seen:
        raise ValueError(f"a disk that only one machine sees can't be read or written by a cluster's tasks: {root!r}; say mounted=true if all do")
    return store
