"""Session helpers: one place for the settings the operators rely on."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# Settings every operator in the package assumes. AQE re-plans joins at
# runtime (broadcast only when the measured side is small, skew-join split),
# and the session time zone is pinned so day arithmetic is reproducible.
SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # runtime (measured) broadcast limit; the small per-segment offset tables fit
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "duelframe", extra: dict | None = None) -> SparkSession:
    """Local session for tests and benches; cluster jobs get theirs from spark-submit."""
    builder = (SparkSession.builder.master(master).appName(app_name)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "16g"))
    for k, v in {**SESSION_DEFAULTS, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is. Only when it is unset (local tests) is a fresh scratch folder chosen.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
        return current
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="duelframe-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors share, from ``spark.checkpoint.dir``.

    Only a local master may fall back to a scratch folder of this machine; a
    cluster session without the setting is an error, because executors on
    other machines could not read what is written there.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return ensure_checkpoint_dir(spark).rstrip("/")


BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """From now on rows reach this session's Python workers in Arrow batches of about ``BATCH_BYTES``.

    The default, 10,000 rows, is tens of MB of whole texts, which each running task holds several times: in the
    executor's growing Arrow buffers and in its worker.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


# Spark's switch to delete a query's shuffle files when the query ends; they stay else until the driver's garbage is collected
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_ON_THE_WAY = threading.local()  # folders stored for results that are being made, a list for each


def stored(df, **options: str):
    """Write ``df`` once as Parquet in the shared folder and return the table read back.

    Cuts the lineage, survives lost executors, and later scans still prune
    columns and push filters down. The shuffle files of the write go when it ends, as nothing
    reads them again. ``options`` are the writer's. ``clean_stored`` removes a session's tables.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/duelframe/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before or "false")
    for paths in getattr(_ON_THE_WAY, "lists", [])[-1:]:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_result(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """``stored(make())``; the tables that ``make`` stores on its way are deleted when the result is written.

    Nothing else may read those tables: what outlives the result is made before the call.
    """
    lists = _ON_THE_WAY.lists = getattr(_ON_THE_WAY, "lists", [])
    lists.append([])
    try:
        df = make()
    finally:
        paths = lists.pop()
    out = stored(df, compression="zstd")
    _delete(spark, paths)
    return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clean_stored(spark: SparkSession) -> None:
    """Delete every table this session has stored; frames that read them become unusable."""
    _delete(spark, [f"{shared_folder(spark)}/duelframe/{spark.sparkContext.applicationId}"])
