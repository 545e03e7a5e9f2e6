"""Session helpers: local sessions for tests, and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", app: str = "primrose") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings one."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own; on a cluster an
    unset folder is an error, because a machine-local one loses data.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="primrose-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder; nothing is written yet."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession, written: DataFrame | str | None) -> None:
    """Removes what was written under the shared folder and is not read again:
    a path, or the files that a frame reads."""
    files = written.inputFiles() if isinstance(written, DataFrame) else [written] if written else []
    folders = {f.rpartition("/")[0] for f in files} if isinstance(written, DataFrame) else files
    jvm, context = spark.sparkContext._jvm, spark.sparkContext
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def pin(df: DataFrame) -> DataFrame:
    """Fix the rows of ``df`` on reliable storage and cut its lineage.

    Used where one result is read twice and both reads must see the same
    physical layout. Callers pass narrow frames (keys, sizes), never texts.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, so that
    jobs whose functions import it run from any folder and on any executor."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        here = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="primrose-"), "primrose-package")
        context.addPyFile(shutil.make_archive(archive, "zip", os.path.dirname(here), os.path.basename(here)))
        _SHIPPED.add(context.applicationId)
