"""SparkSession settings shared by tests, bench and the jobs."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, app: str = "lexiscope",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Local/test session. On a cluster the session comes from the launcher:
    one that is already active is returned as it is."""
    if (active := SparkSession.getActiveSession()) is not None:
        ensure_checkpoint_dir(active)
        return active
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or cpus
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only where a local session names none (tests) a scratch folder is created
    and set; on a cluster the shared folder from the configuration is used
    unchanged, and it is an error to have none.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="lexiscope-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", d)
        spark.sparkContext.setCheckpointDir(d)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def checkpointed(df):
    """Cut lineage with a reliable checkpoint in the session's checkpoint
    folder (never ``localCheckpoint``): the table is written once and
    survives the loss of the executors that computed it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def configure_for_scale(spark: SparkSession, input_bytes: int,
                        target_partition_bytes: int = 256 << 20) -> dict:
    """Shuffle sizing for large inputs, applied only where the cluster has not
    chosen a value: enough shuffle partitions that each holds about
    ``target_partition_bytes`` of the input (AQE then coalesces small ones and
    splits skewed ones), skew-join handling on, and the advisory partition
    size AQE aims for. Returns the settings it applied."""
    applied = {}

    def put(key, value):
        if spark.conf.get(key, None) in (None, "", "200"):  # 200 = Spark's untouched default
            spark.conf.set(key, str(value))
            applied[key] = str(value)

    put("spark.sql.shuffle.partitions", max(200, int(input_bytes // target_partition_bytes)))
    for key, value in (("spark.sql.adaptive.enabled", "true"),
                       ("spark.sql.adaptive.skewJoin.enabled", "true"),
                       ("spark.sql.adaptive.advisoryPartitionSizeInBytes", target_partition_bytes)):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(value))
            applied[key] = str(value)
    return applied
