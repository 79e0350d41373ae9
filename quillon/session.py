"""Session helpers shared by every operator."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the local bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillon")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("QUILLON_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the one the cluster names, else (on a local master alone, as in tests) a local one.

    Files of a checkpoint go when nothing refers to it any more, if the cluster sets ``spark.cleaner.referenceTracking.cleanCheckpoints``; :func:`local_session` does.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    folder = named or os.path.join(os.environ.get("TMPDIR", "/tmp"), "quillon-checkpoints")
    sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise once in the shared checkpoint folder, so a lost executor never replays the steps before."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
