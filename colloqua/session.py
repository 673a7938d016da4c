"""Session helpers shared by all operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Estimated bytes of input up to which ``spread`` may move rows, and least bytes of a partition it makes.
SPREAD_BELOW, SPREAD_LEAST = 1 << 30, 1 << 14


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder of ``spark.checkpoint.dir``.

    A temporary folder is set only in local mode and only where the session names none, as in tests; a cluster without a shared
    folder is refused.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="colloqua-"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, for work that is heavy a row; only the layout changes.

    Only inputs of at most ``SPREAD_BELOW`` bytes in fewer files or blocks than cores are moved; larger ones are read as they lie
    (``spark.sql.files.maxPartitionBytes`` splits those).
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > SPREAD_BELOW:
        return df
    most = min(df.sparkSession.sparkContext.defaultParallelism, max(1, size // SPREAD_LEAST))
    return df.repartition(most) if df.rdd.getNumPartitions() < most else df
