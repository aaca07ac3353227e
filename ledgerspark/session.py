"""Session settings and the shared workspace that loops write their rounds to."""

from __future__ import annotations

import itertools
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"

_round = itertools.count()
_local_dirs: dict[str, str] = {}


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster job brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ledgerspark")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def workspace(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it.

    A machine-local folder is used only on a local master that names none: on a
    cluster, rounds written there would be lost with the machine.
    """
    sc = spark.sparkContext
    base = sc.getConf().get(CHECKPOINT_CONF, None) or spark.conf.get(CHECKPOINT_CONF, None)
    if base is None:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        if sc.applicationId not in _local_dirs:
            _local_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="ledgerspark-")
        base = _local_dirs[sc.applicationId]
    path = f"{base.rstrip('/')}/ledgerspark-{sc.applicationId}"
    if path not in _local_dirs.values():
        jpath = sc._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(jpath)
        _local_dirs[path] = path
    return path


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{workspace(spark)}/{name}-{next(_round):06d}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the workspace and read it back.

    This cuts the lineage of a loop, survives lost executors, and gives the next
    round true file sizes, from which Spark decides whether a side may be broadcast.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._written_to = path
    return kept


def discard(*frames: DataFrame | None) -> None:
    """Delete tables that :func:`materialize` or :func:`bucketed` wrote and that nothing reads any more; others stay."""
    for df in frames:
        path = getattr(df, "_written_to", None)
        if path is not None:
            where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def bucketed(df: DataFrame, key: str, buckets: int, name: str, folder: str | None = "bucket", placed: bool = False) -> DataFrame:
    """Write ``df`` in buckets of ``key`` and read it back: joins and groups on ``key`` move the other side only.

    Rows of one ``folder`` column lie in a folder of their own. The column ``bucket`` is added and has the bucket of a row, so a reader that
    names the buckets it wants opens no other file. Rows that are ``placed`` already lie in the partitions of ``repartition(buckets, key)``.
    """
    path = fresh_path(df.sparkSession, name)
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    rows = df.withColumn("bucket", bucket_of(key, buckets)) if folder == "bucket" else df
    writer = (rows if placed else rows.repartition(buckets, key)).write.bucketBy(buckets, key).sortBy(key).option("path", path)
    (writer.partitionBy(folder) if folder else writer).saveAsTable(table)
    kept = df.sparkSession.table(table)
    kept._written_to = path
    return kept


def bucket_of(key: str, buckets: int):
    """The bucket that Spark puts ``key`` in."""
    return F.pmod(F.hash(key), F.lit(buckets))
