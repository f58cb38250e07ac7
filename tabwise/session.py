"""Session construction and lineage cutting.

On a cluster the session is created by the platform and ``spark.checkpoint.dir``
points at shared storage; we only read it.  Tests and local benches get a
fresh directory under /tmp when (and only when) the setting is absent and the
master is local.
"""

from __future__ import annotations

import tempfile
from contextlib import contextmanager
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from tabwise.errors import PipelineError


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "tabwise", driver_memory: str = "16g") -> SparkSession:
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Split small file sets across all cores (large inputs are unaffected: their
        # split size stays spark.sql.files.maxPartitionBytes).
        .config("spark.sql.files.openCostInBytes", str(1 << 20))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, creating a local one only for local masters."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise PipelineError(
            "spark.checkpoint.dir is not set; point it at shared storage before running "
            "iterative or multi-pass operators on a cluster")
    local_dir = tempfile.mkdtemp(prefix="tabwise-ckpt-", dir="/tmp")
    sc.setCheckpointDir(local_dir)
    return sc.getCheckpointDir()


@contextmanager
def session_conf(spark: SparkSession, key: str, value: str):
    """Temporarily set a SQL conf (restored afterwards)."""
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


#: What one task of an iterative fit keeps in memory and reads in every pass, at most about.
TASK_BYTES = 128 << 20
#: Rows of a task of a frame that was spread.
TASK_ROWS = 1 << 20


def _tasks(rows: int, bytes_a_row: int) -> int:
    return -(-rows * bytes_a_row // TASK_BYTES)


def deal_out(df: DataFrame, bytes_a_row: int, rows: int) -> DataFrame:
    """Spread a frame so that the ``bytes_a_row`` an iterative fit keeps come to at most about TASK_BYTES a task.

    A scan has a task for each 128 MB of compressed columns, a spread table one a
    core: as objects of a fit, these rows can be several GB.  Frames of less than
    one task stay as they are.  Persist the result: every reader would shuffle again.
    """
    tasks = _tasks(rows, bytes_a_row)
    return df.repartition(max(tasks, df.sparkSession.sparkContext.defaultParallelism)) if tasks > 1 else df


def bounded_tasks(df: DataFrame, bytes_a_row: int, rows: int | None = None) -> DataFrame:
    """``deal_out`` for frames that have too few partitions; persisted ones that are dealt out already stay."""
    rows = df.count() if rows is None else rows
    tasks = _tasks(rows, bytes_a_row)
    return deal_out(df, bytes_a_row, rows) if tasks > 1 and df.rdd.getNumPartitions() < tasks else df


def fits_at_once(spark: SparkSession, rows: int, bytes_a_row: int, most: int) -> int:
    """``most`` as long as one fit keeps less than TASK_BYTES a core, else 1: large fits have work for every core,
    and side by side they push each other's rows out of memory."""
    return most if rows * bytes_a_row <= TASK_BYTES * spark.sparkContext.defaultParallelism else 1


def ensure_parallelism(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Spread a frame that has fewer partitions than the cluster has cores, to at most TASK_ROWS of ``rows`` each.

    Only call it on frames without pending shuffles (scans, written tables,
    persisted frames): asking an adaptive plan for its partitions would run its
    shuffle stages.  Large inputs already have many partitions (no-op); a small
    input read from a few unsplittable files would otherwise leave model fits
    and iterative passes running on one core.
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    rows = df.count() if rows is None else rows
    return df.repartition(max(target, -(-rows // TASK_ROWS)))


def persist_balanced(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> DataFrame:
    """Persist (spilling to disk) and, if it came out with too few partitions, rebalance once."""
    kept = df.persist(level)
    balanced = ensure_parallelism(kept, kept.count())
    if balanced is kept:
        return kept
    balanced = balanced.persist(level)
    balanced.count()
    kept.unpersist()
    return balanced


def materialize(df: DataFrame, spread: bool = True, **options) -> DataFrame:
    """Cut lineage by writing a parquet table under the reliable checkpoint directory.

    One job (``Dataset.checkpoint`` on an unpersisted plan computes it twice),
    compressed columnar files, and later readers get column pruning and filter
    pushdown; a lost executor only re-reads files.  ``spread=False`` leaves a
    small table in as few partitions as it was written.  ``options``: of the writer.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.mode("error").options(**options).parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    return ensure_parallelism(written) if spread else written
