"""Session defaults and lineage cuts that survive lost executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Spark's switch: shuffle files go at the end of the action that wrote them, not when the driver collects its garbage.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(name: str = "quillmine", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, read from the session.

    Only a local session that names none (tests, one machine) gets a temporary one; on a cluster
    executors would write to their own disks, so a missing setting is an error there.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_CONF, None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="quillmine-")
        context.setCheckpointDir(folder)
    return folder


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Frames planned in here leave no shuffle files behind; what reads one again makes them anew."""
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_CONF)
        else:
            spark.conf.set(CLEANUP_CONF, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: written to the shared folder, not to executor disks.

    Nothing reads the shuffle files below it any more, so they go at once: steps that follow each other don't add up
    on the executors' disks.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    with shuffles_freed(spark):
        # planned anew: the setting counts when a frame is made
        return df.select("*").checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Put this package on the path of every Python worker, once per application.

    A job started with ``--py-files`` does not need it.
    """
    context = spark.sparkContext
    if getattr(context, "_quillmine_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quillmine-"), "quillmine.zip")
    with zipfile.ZipFile(path, "w") as bundle:
        for folder, _, files in os.walk(home):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    bundle.write(full, os.path.join("quillmine", os.path.relpath(full, home)))
    context.addPyFile(path)
    context._quillmine_shipped = True
