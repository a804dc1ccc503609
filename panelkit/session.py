"""Session set-up and the two ways an intermediate result may leave the lazy plan."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest table that is marked for broadcast.
SMALL_ROWS = 50_000


def local_session(cores: str = "8", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine; on a cluster use the session given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("panelkit")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; only a local session may fall back to one of its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="panelkit-work-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared


def new_path(spark: SparkSession, kind: str = "table") -> str:
    """A fresh path in the work folder."""
    return f"{work_dir(spark).rstrip('/')}/panelkit-{kind}-{uuid.uuid4().hex}"


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Have an existing path removed when the session's JVM ends."""
    _hadoop(spark, path, lambda fs, p: fs.deleteOnExit(p))


def keep(df: DataFrame) -> DataFrame:
    """Compute a table once that several passes or results read, and cut its lineage.

    The copy is Parquet in the shared work folder: losing executors does not lose it, and later passes
    read only the columns they need. :func:`discard` removes it; otherwise it goes with the session.
    """
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    remove_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*kept: DataFrame) -> None:
    """Remove the files of tables made by :func:`keep`, once nothing reads them any more."""
    for df in kept:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/panelkit-" in path:
                _hadoop(df.sparkSession, path, lambda fs, p: fs.delete(p, True))


def keep_bucketed(df: DataFrame, by: Sequence[str], buckets: int | None = None) -> DataFrame:
    """As :func:`keep`, but dealt to buckets by a hash of ``by``, one file each, and sorted by them.

    Aggregations and windows over ``by`` then read their groups where they lie, without an exchange or a
    sort. The table is external and has a name of its own in the session's catalog. The number of buckets
    is that of shuffle partitions, unless given.
    """
    spark, by = df.sparkSession, list(by)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path = f"panelkit_{uuid.uuid4().hex}", new_path(spark)
    writer = df.repartition(buckets, *by).write.format("parquet").bucketBy(buckets, *by).sortBy(*by)
    writer.option("path", path).saveAsTable(name)
    remove_at_end(spark, path)
    return spark.table(name)


def _hadoop(spark: SparkSession, path: str, act) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    act(p.getFileSystem(spark._jsc.hadoopConfiguration()), p)


def settle(df: DataFrame, max_rows: int = SMALL_ROWS) -> tuple[DataFrame, int]:
    """Compute ``df`` once and return it with its number of rows, marked for broadcast if it is small.

    The rows never pass through Python, so values come back exactly as they were, and small and large
    tables differ only in the join hint. Joins with a large one shuffle, and adaptive execution splits
    skewed partitions.
    """
    kept = keep(df)
    n = kept.count()
    return (F.broadcast(kept) if n <= max_rows else kept), n
