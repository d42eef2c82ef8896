"""Session settings and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "chalkline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC times; extra settings as keyword arguments with `__` for `.`."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    return builder.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A cluster names it in `spark.checkpoint.dir`.

    Only a local session may go without; it then gets a temporary folder of its own.
    """
    where = spark.conf.get(CHECKPOINT_KEY, None)
    if where:
        return where.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "chalkline-" + spark.sparkContext.applicationId)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table or folder of the shared folder, if it is there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_SWEPT: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared folder, under a folder of this application that is removed when it ends."""
    own = f"{shared_dir(spark)}/scratch-{spark.sparkContext.applicationId}"
    if own not in _SWEPT:
        _SWEPT.add(own)
        atexit.register(_sweep, spark, own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def _sweep(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session has been stopped before: the folder's name tells whose it was
        pass


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a result to the shared folder and read it back: later stages restart from files, not from its lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
