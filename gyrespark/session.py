"""Session settings shared by tests, benchmarks and jobs."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "gyrespark", master: str | None = None,
                  shuffle_partitions: int | None = None,
                  driver_memory: str | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings the operators assume.

    Cluster deployments pass neither ``master`` nor memory: those belong to
    ``spark-submit``.  AQE coalesces and splits shuffle partitions at run time,
    so the partition count is only an upper bound there.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder used to cut lineage in iterative operators.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local master may
    fall back to a folder of this machine; elsewhere the setting is required,
    because executors must be able to read the files after a node is lost.
    """
    context = spark.sparkContext
    jvm_context = context._jsc.sc()
    current = jvm_context.getCheckpointDir()
    if current.isDefined():
        return current.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        path = tempfile.mkdtemp(prefix="gyrespark-checkpoint-")
    context.setCheckpointDir(path)
    return path


def cut_lineage(df):
    """Materialise ``df`` in the shared checkpoint folder and drop its plan."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df, keys: list[str]):
    """Shuffle by ``keys`` into the configured number of partitions.

    Used in front of Python group kernels: their cost is in CPU, not bytes, so
    AQE must not merge their (small) partitions into a few tasks.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)
