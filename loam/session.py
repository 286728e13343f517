"""Session helpers: a local session for tests, and written intermediates in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Where the tables that :func:`written` returned are.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session with the settings that the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loam")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one named in ``spark.checkpoint.dir``. Where that is unset a local session makes a
    temporary folder once and remembers it; a cluster's executors would not see one, so there it is
    an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("loam.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loam-")
        spark.conf.set("loam.shared.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/loam-{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Lets Arrow hand Python at most ``rows`` rows and about ``size`` bytes at a time, as suits columns of whole texts.

    A batch is held several times over, in the JVM's off-heap memory and in Python; the default of
    10,000 documents is tens of MB for each. The limits hold for the session from now on, as a
    query runs after it is built; a session's own smaller limits stay.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if now.rstrip("bB").isdigit() and int(now.rstrip("bB")) > size:  # other units were set by hand
        spark.conf.set(key, str(size))


#: Rows of a task that makes or reads a text for each row.
ROWS_PER_TASK = 10_000


def spread(rows: DataFrame, *keys: str, per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``rows`` dealt by the hash of their ``keys`` to a task for each ``per_task`` of them.

    A small file of many short rows is read by a task for each of its row groups, so what is made of its rows would be
    one task's work, however large the cluster. This counts the rows and shuffles them, so it comes
    before texts are made, and the keys should tell most rows apart.
    """
    n = rows.select(*keys).count()
    return rows.repartition(max(1, -(-n // per_task)), *keys)


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and its lineage ends there.

    A lost executor loses nothing of it, and Spark knows its size, so later joins pick their
    strategy from real figures. This runs a job; what it writes stays until :func:`discard`, since
    a result that is built on it may run at any time.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _PATHS[found] = path
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes tables that :func:`written` returned, once nothing that will still run reads them."""
    for df in tables:
        path = _PATHS.pop(df, None)
        if path is not None:
            jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(jsc.hadoopConfiguration()).delete(at, True)
