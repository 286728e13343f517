"""Manifests of file sets: hashes of files, folded in order of path, and what a package leaves out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loam.functions.paths import DEVICES, path_key
from loam.session import written
from loam.sources.tree import EXCLUDED, list_tree

#: The first line of what a manifest's hash covers.
HEADER = "manifest-v1\n"
# What never goes into a package, in lower case: file names, folders, path ends, and endings.
SENSITIVE_NAMES = (
    ".env", ".npmrc", ".pypirc", ".netrc", "_netrc", ".git-credentials", ".yarnrc.yml", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519",
)
SENSITIVE_FOLDERS = (".ssh", ".gnupg")
SENSITIVE_PATHS = (
    ".aws/credentials", ".docker/config.json", ".kube/config", ".cargo/credentials", ".cargo/credentials.toml", ".composer/auth.json",
    "application_default_credentials.json",
)
SENSITIVE_ENDINGS = (".p12", ".pfx", ".jks", ".keystore", ".tfstate")
#: The one file of the ``.env.`` family that is meant to be shared.
SHARED_ENV = ".env.example"


def is_sensitive(path: Column) -> Column:
    low = F.lower(path)
    name = F.element_at(F.split(low, "/"), -1)
    slashed = F.concat(F.lit("/"), low)
    hits = [name.isin(*SENSITIVE_NAMES), name.startswith(".env.") & (name != SHARED_ENV), F.contains(name, F.lit(".tfstate."))]
    hits += [F.contains(slashed, F.lit(f"/{folder}/")) for folder in SENSITIVE_FOLDERS]
    hits += [slashed.endswith(f"/{end}") for end in SENSITIVE_PATHS] + [name.endswith(end) for end in SENSITIVE_ENDINGS]
    return reduce(lambda a, b: a | b, hits)


def packable(files: DataFrame) -> DataFrame:
    """(path, content) rows that a package may hold: no sensitive name, no private key inside."""
    return files.where(~is_sensitive(F.col("path")) & ~F.coalesce(F.make_valid_utf8(F.col("content").cast("string")).rlike("-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"), F.lit(False)))


#: What a package never takes, as globs: the tool's own folder, and packages.
OWN = ".loam/**,**/*.tar.gz"
#: Parts of a path that some file system refuses, in any case.
_REFUSED = r"(?i)[<>:\"|?*\x00-\x1f\x7f-\x9f\\]|[ .](?:/|$)|(?:^|/)(?:" + "|".join(DEVICES) + r")(?:\.[^/]*)?(?:/|$)"


def pack_listing(spark: SparkSession, root: str, exclude: Sequence[str] = (), out: str | None = None, mounted: bool = False) -> DataFrame:
    """(path, size) of all files of a tree that a package takes, hidden ones included, listed by tasks.

    Left out are excluded files, the tool's own, packages, the file ``out`` itself, and those with a sensitive name. Paths that some
    file system refuses or can't tell apart are an error that names a few of them.
    """
    listed = list_tree(spark, root, "**/*", ",".join([EXCLUDED, OWN, *exclude]), mounted)
    listed = written(listed.where(~is_sensitive(F.col("path")) & ~F.col("path").eqNullSafe(F.lit(out))), "packed")
    bad = listed.where(F.col("path").rlike(_REFUSED)).select("path", F.lit("not portable").alias("why"))
    twice = listed.groupBy(path_key("path").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).where("n > 1")
    if some := bad.union(twice.select("path", F.lit("the same as another on some file systems"))).orderBy("path").limit(5).collect():
        raise ValueError("; ".join(f"{r['why']}: {r['path']!r}" for r in some))
    return listed


def manifest_lines(files: DataFrame) -> DataFrame:
    """(path, line): the path, the content's SHA-256 and the concept id, divided by NUL."""
    nul = F.char(F.lit(0))
    line = F.concat("path", nul, F.sha2(F.coalesce(F.col("content").cast("binary"), F.lit("").cast("binary")), 256), nul, F.coalesce("id", F.lit("")), F.lit("\n"))
    return files.select("path", line.alias("line"))


def manifest_hash(files: DataFrame, buckets_hex: int = 0, header: str = HEADER) -> DataFrame:
    """(bucket, files, hash): the hash over a bucket's lines in order of path.

    With ``buckets_hex`` 0 there is one bucket and its hash is the manifest's. For large sets a bucket
    is the first digits of the path's hash, so no task folds more than its share; the manifest's
    hash is then that of the buckets' own lines, by a second call. ``header`` sets the format apart.
    """
    bucket = F.substring(F.sha2("path", 256), 1, buckets_hex) if buckets_hex else F.lit("")
    lines = manifest_lines(files).withColumn("bucket", bucket)
    sorted_lines = F.transform(F.array_sort(F.collect_list(F.struct("path", "line"))), lambda x: x["line"])
    return lines.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("files"), F.sha2(F.concat(F.lit(header), F.array_join(sorted_lines, "")), 256).alias("hash")
    )


def _folded(buckets: DataFrame, digits: int, header: str) -> DataFrame:
    """(bucket, files, hash) of the first digits of (bucket, files, hash) rows."""
    nul = F.char(F.lit(0))
    line = F.struct("bucket", F.concat("bucket", nul, F.col("files").cast("string"), nul, "hash", F.lit("\n")).alias("line"))
    folded = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "")
    up = buckets.groupBy(F.substring("bucket", 1, digits).alias("up"))
    return up.agg(F.sum("files").alias("files"), F.sha2(F.concat(F.lit(header), folded), 256).alias("hash")).withColumnRenamed("up", "bucket")


def manifest_tree(files: DataFrame, header: str = HEADER) -> DataFrame:
    """One row (files, hash) over any number of files, by one scheme for all numbers.

    Files are folded by six digits of their paths' hashes, those sixteen million buckets by three, and the rest at last, so no task folds
    more than 4096 lines beside its share of the files. No files have no row.
    """
    return _folded(_folded(manifest_hash(files, 6, header), 3, header), 0, header).select("files", "hash")


def manifest(files: DataFrame, most: int = 50_000, header: str = HEADER) -> DataFrame:
    """One row (files, hash) over any number of files.

    Up to ``most`` files it is :func:`manifest_hash` as it is. Beyond that the files are folded by digits of
    their paths' hashes, as many as keep a bucket under ``most``, and then the buckets' own lines, up to 4096
    at a time, until one is left; so no task folds more than its share.
    """
    n, digits = files.count(), 0
    while n >> (4 * digits) > most:
        digits += 1
    found = manifest_hash(files, digits, header)
    while digits:
        digits = max(0, digits - 3)
        found = _folded(found, digits, header)
    return found.select("files", "hash")
