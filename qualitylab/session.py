"""Session set-up and the shared folder used to cut lineage and stage files."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

#: Splits below which a source is dealt out anew.
FEW = 8


def local_session(cores: str = "8", app: str = "qualitylab", memory: str = "12g") -> SparkSession:
    """A session for tests and the local bench; on a cluster use spark-submit's own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (unit tests, local runs) is a fresh temporary
    folder taken, once, and remembered in the session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(
        "qualitylab.local.shared", None
    )
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="qualitylab-")
        spark.conf.set("qualitylab.local.shared", named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path under the shared folder."""
    return os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")


def pin(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` reliably, so that later stages see exactly these rows and
    partitions even after executors are lost."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def concurrently(spark: SparkSession, jobs: Sequence[Callable[[], T]], at_most: int = 6) -> list[T]:
    """Results of ``jobs``, independent Spark actions, in their order. Small jobs leave most of a cluster idle, so a few run at a time."""
    run = inheritable_thread_target(spark)(lambda job: job())
    with ThreadPoolExecutor(max(1, min(at_most, len(jobs)))) as pool:
        return list(pool.map(run, jobs))


def spread(df: DataFrame, few: int = FEW) -> DataFrame:
    """Use more cores on a source of fewer than ``few`` splits (one small file, under a GB or so by Spark's
    defaults). Anything larger is never shuffled, however many cores the cluster has."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(min(cores, few)) if df.rdd.getNumPartitions() < min(cores, few) else df
